"""URL filters: rules by host and path, and gradient-boosted trees for the rest (operator 6).

Everything is DataFrame functions and Spark's own trees.  The trees learn from
the URLs that a rule labels; their features are lexical (length, depth, digit
ratio, entropy, parameters) and two statistics of the host's last label over all
URLs.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.decontamination import LOWER, UPPER
from fathomline.llm.sampling import least_hashes
from fathomline.llm.shared import stored

#: (host, path, verdict); a rule fits its host and all subdomains, and paths that begin with its own.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Most labelled URLs that the trees learn from, chosen by hash.
TRAIN_URLS = 20_000
TREES, DEPTH = 10, 4
#: Suffixes whose statistics are broadcast; of more, those with at least that share of all URLs.
SUFFIXES = 100_000

FEATURES = ("length", "host_length", "labels", "depth", "digits", "entropy", "parameters", "hyphens", "suffix_urls", "suffix_blocked")


def parsed(urls: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased), path and query; null or without ``://``: empty."""
    url = F.coalesce("url", F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    urls = urls.withColumn("__rest", rest).withColumn("__host", F.regexp_extract("__rest", r"\A[^/?#]*", 0))
    after = F.col("__rest").substr(F.length("__host") + 1, F.length("__rest"))
    urls = urls.withColumn("host", F.translate("__host", UPPER, LOWER)).withColumn("__after", after)
    return urls.withColumn("path", F.regexp_extract("__after", r"\A[^?#]*", 0)).withColumn("query", F.regexp_extract("__after", r"\A[^?#]*\?([^#]*)", 1)).drop("__rest", "__host", "__after")


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule (host and path of the longest that fits, or null) and its verdict as rule_verdict."""

    def first(value) -> Column:
        out = F.lit(None).cast("string")
        for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
            fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
            out = F.when(fits, value(host, path, verdict)).otherwise(out)
        return out

    return urls.withColumn("rule", first(lambda h, p, v: F.lit(h + p))).withColumn("rule_verdict", first(lambda h, p, v: F.lit(v)))


def lexical(urls: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    urls = urls.withColumn("__chars", F.split(url, ""))
    entropy = "aggregate(transform(array_distinct(__chars), c -> size(__chars) - size(array_remove(__chars, c))), 0D, (s, k) -> s - (k / size(__chars)) * log2(k / size(__chars)))"
    return urls.select(
        "*",
        F.length(url).cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        (F.size(F.split("path", "/")) - 1).cast("double").alias("depth"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / n).alias("digits"),
        F.expr(entropy).alias("entropy"),
        F.when(F.col("query") == "", 0.0).otherwise(F.size(F.split("query", "&")).cast("double")).alias("parameters"),
        (F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        F.substring_index("host", ".", -1).alias("suffix"),
    ).drop("__chars")


def with_suffixes(urls: DataFrame, blocked: Column, most: int = SUFFIXES) -> DataFrame:
    """Adds suffix_urls (log of 1 and the URLs of the suffix) and suffix_blocked (the share of blocked ones among its other labelled URLs, smoothed).

    A row's own label does not count for it.  Up to `most` suffixes are
    broadcast; of more, the frequent ones are, and the rest meet by a shuffle.
    """
    stats = stored(urls.groupBy("suffix").agg(F.count(F.lit(1)).alias("__n"), F.coalesce(F.sum(blocked), F.lit(0.0)).alias("__blocked"), F.count("rule_verdict").alias("__labelled")))
    n, total = stats.agg(F.count(F.lit(1)), F.sum("__n")).first()
    if n <= most:
        told = urls.join(F.broadcast(stats), "suffix")
    else:
        often = F.col("__n") * most >= total  # at most `most` rows
        hot, rest = stats.where(often), stats.where(~often)
        marked = urls.join(F.broadcast(hot), "suffix", "left")
        told = marked.where("__n is not null").unionByName(marked.where("__n is null").drop("__n", "__blocked", "__labelled").join(rest, "suffix"))
    own = F.col("rule_verdict").isNotNull().cast("int")
    share = (F.col("__blocked") - F.coalesce(blocked, F.lit(0.0)) + 1) / (F.col("__labelled") - own + 2)
    return told.withColumn("suffix_urls", F.log1p(F.col("__n").cast("double"))).withColumn("suffix_blocked", share).drop("__n", "__blocked", "__labelled")


def judge(pages: DataFrame, rules=RULES, train_urls: int = TRAIN_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability: one row per row of `pages`.

    The verdict is the rule's, else the trees' (block from a probability of one
    half).  Null URLs are judged as empty ones.  Where the rules label no URL of
    one kind, the trees give way to the other kind, and to allow if they label
    none.  Other columns are ignored; repeated rows are judged each; of rules of
    one length the greater stands, and a probability of exactly one half blocks.
    """
    urls = stored(lexical(ruled(parsed(pages.select("page_id", "url")), rules)))
    blocked = (F.col("rule_verdict") == "block").cast("double")
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_suffixes(urls, blocked))
    labelled = ready.where("rule_verdict is not null").withColumn("label", blocked)
    kinds = {r[0] for r in labelled.select("rule_verdict").distinct().collect()}
    if len(kinds) < 2:
        out = ready.withColumn("block_probability", F.lit(float("block" in kinds)))
    else:
        sample = stored(least_hashes(labelled.select("url", "page_id", "features", "label"), train_urls, "url", "page_id").select("features", "label"))
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=6, featuresCol="features", labelCol="label").fit(sample.coalesce(4))
        out = model.transform(ready).withColumn("block_probability", vector_to_array("probability")[1])
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_probability")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL: dict[str, str] = {}
