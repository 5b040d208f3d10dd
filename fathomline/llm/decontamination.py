"""Benchmark decontamination through a positional inverted index (operator 5).

Everything here is DataFrame and SQL functions.  The corpus' frequencies of the
test items' terms say which term of each test window is rarest; postings of
those terms alone are stored, each with the words around it.  A window's
offset-adjusted list is intersected with its other terms' lists by looking at
those words, so a phrase costs as many rows as its rarest term has places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.shared import stored

PHRASE = 10
#: Words by which a proximity match may be wider than its run.
NEAR = 5
#: A table of test terms or windows is broadcast up to so many bytes; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 32 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A-Z lower-cased, then the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), "")


def _is_small(df: DataFrame, *sized: str | Column) -> bool:
    return (df.agg(F.sum(sum((F.length(c) for c in sized), F.lit(64)))).first()[0] or 0) <= BROADCAST_BYTES


def _small(df: DataFrame, *sized: str | Column) -> DataFrame:
    """`df` marked for broadcast if its measured size allows."""
    return F.broadcast(df) if _is_small(df, *sized) else df


def windows(items: DataFrame, phrase: int = PHRASE) -> DataFrame:
    """Distinct runs of `phrase` words of the items: run, run_items.  A shorter item, but not an empty one, is one run."""
    runs = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    runs = runs.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - phrase, F.lit(0)))))
    return runs.select(F.expr(f"slice(w, i + 1, {phrase})").alias("run"), "item_id").groupBy("run").agg(F.collect_set("item_id").alias("run_items"))


class Index:
    """Stored words of documents, and stored postings of the rarest term of each run."""

    def __init__(self, docs: DataFrame, runs: DataFrame, near: int = 0):
        text = F.coalesce("text", F.lit(""))
        self.near = near
        # doc_id may be null or repeated; a digest of the text makes rows that differ differ
        self.docs = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("digest"), words(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("number")).withColumn("n_words", F.size("words").cast("long")))
        self.runs = stored(runs)
        placed = self.runs.select("run", "run_items", F.posexplode("run").alias("at", "term"))
        terms = _small(placed.select("term").distinct(), "term")
        found = self.docs.select(F.explode("words").alias("term")).join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        #: Each run by its rarest term; a run with a term that never occurs cannot occur.
        ranked = placed.join(found, "term", "left").groupBy("run").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "at")).alias("rare"), F.first("run_items").alias("run_items"))
        self.lists = stored(ranked.where("rare.n > 0").select(F.col("rare.term").alias("term"), F.col("rare.at").alias("at"), "run", "run_items"))
        rare = self.lists.select("term").distinct()
        longest = (self.runs.agg(F.max(F.size("run"))).first()[0] or 1) + near
        self.reach = longest - 1
        placed = self.docs
        if _is_small(rare, "term"):
            placed = placed.select("doc_id", "digest", "words", F.posexplode("words").alias("pos", "term")).join(F.broadcast(rare), "term")
        else:  # only numbers and terms are dealt out by term; a document's words meet its places again by its number
            places = placed.select("number", F.posexplode("words").alias("pos", "term")).join(rare, "term").groupBy("number").agg(F.collect_list(F.struct("pos", "term")).alias("places"))
            placed = placed.join(places, "number").select("doc_id", "digest", "words", F.explode("places").alias("p")).select("doc_id", "digest", "words", "p.pos", "p.term")
        around = F.expr(f"slice(words, greatest(pos - {self.reach}, 0) + 1, least(pos, {self.reach}) + {longest})")
        self.postings = stored(placed.select("term", "doc_id", "digest", "pos", around.alias("around")))

    def _met(self) -> DataFrame:
        lists = _small(self.lists, "term", F.concat_ws(" ", "run"), F.concat_ws(" ", "run_items"))
        return self.postings.join(lists, "term").withColumn("before", F.least("pos", F.lit(self.reach)))

    def matches(self) -> DataFrame:
        """doc_id, digest, start (null unless the run stands there word for word), length, run, run_items of the proximity matches.

        A run matches where all of its words stand, in any order, among size(run)
        + near words in a row that hold its rarest term; so exact matches are
        proximity matches.
        """
        # around holds all words of the run; the first test spares most rows the others
        close = F.size(F.array_except("run", "around")) == 0
        wide = F.expr(f"exists(sequence(greatest(before - size(run) - {self.near} + 1, 0), before), s -> size(array_except(run, slice(around, s + 1, size(run) + {self.near}))) = 0)")
        met = self._met().where(close & (self._exact() | wide)).withColumn("start", F.when(self._exact(), F.col("pos") - F.col("at")))
        return met.select("doc_id", "digest", "start", F.size("run").alias("length"), "run", "run_items")

    @staticmethod
    def _exact() -> Column:
        return (F.col("before") >= F.col("at")) & F.expr("slice(around, before - at + 1, size(run)) = run")

    def phrases(self) -> DataFrame:
        """Exact matches: doc_id, digest, start, length, run, run_items."""
        return self._met().where(self._exact()).select("doc_id", "digest", (F.col("pos") - F.col("at")).alias("start"), F.size("run").alias("length"), "run", "run_items")


def contaminated(docs: DataFrame, items: DataFrame, phrase: int = PHRASE, near: int = NEAR) -> DataFrame:
    """doc_id, digest, n_words, n_hit, n_items, items (sorted strings), n_near, contaminated: one row per row of `docs`.

    A document word inside any occurrence of a run of an item is hit; n_near counts
    the items with a proximity match, exact ones among them.  Null and
    empty texts have no words; null and repeated doc_ids are kept as they are;
    repeated rows get the same counts; an item without words never occurs; an
    empty table of items contaminates nothing.  Other columns are ignored.
    """
    index = Index(docs, windows(items, phrase), near)
    spans = F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct(F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length")))))
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    hits = index.matches().groupBy("doc_id", "digest").agg(spans.alias("spans"), names(F.when(F.col("start").isNotNull(), F.col("run_items"))).alias("items"), F.size(names(F.col("run_items"))).cast("long").alias("n_near"))
    hit = "aggregate(spans, named_struct('end', 0L, 'n', 0L), (a, s) -> named_struct('end', greatest(a.end, s.start + s.length), 'n', a.n + greatest(0L, s.start + s.length - greatest(a.end, s.start))), a -> a.n)"
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), F.expr(hit).alias("n_hit"), "items", "n_near")
    every = index.docs.select("doc_id", "digest", "n_words")
    out = every.join(hits, every["doc_id"].eqNullSafe(hits["hit_id"]) & (every["digest"] == hits["hit_digest"]), "left")
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    items = F.coalesce("items", none)
    return out.select("doc_id", "digest", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.coalesce("n_near", zero).alias("n_near"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, phrase: int = PHRASE) -> DataFrame:
    """The rows of `docs` that hold no run of an item, with their columns."""
    hit = Index(docs, windows(items, phrase)).phrases().select("doc_id", "digest").distinct()
    hit = hit.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    digest = F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit["__id"]) & (digest == hit["__digest"]), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


def _sql_words(text: str) -> str:
    return f"list_filter(string_split_regex(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{BREAKS}'), lambda x: x <> '')"


ORACLE_SQL = {
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_sql_words("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_slice(w, i + 1, i + least({PHRASE}, len(w))) AS run FROM (SELECT item_id, w, unnest(generate_series(0, greatest(len(w) - {PHRASE}, 0))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(run) AS n FROM bw),
dw AS (SELECT doc_id, i, n, list_slice(w, i + 1, i + n) AS run FROM (SELECT doc_id, w, n, unnest(generate_series(0, len(w) - n)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.run = bw.run),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
anchors AS (SELECT item_id, run, list_reduce(run, lambda a, b: CASE WHEN len(b) > len(a) OR (len(b) = len(a) AND b < a) THEN b ELSE a END) AS term FROM bw),
spots AS (SELECT doc_id, p, w[p + 1] AS term, w FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1)) AS p FROM d WHERE len(w) > 0) WHERE w[p + 1] IN (SELECT term FROM anchors)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM spots JOIN anchors USING (term) WHERE len(list_filter(generate_series(greatest(p - len(run) - {NEAR} + 1, 0), p), lambda s: len(list_filter(run, lambda t: NOT list_contains(list_slice(w, s + 1, s + len(run) + {NEAR}), t))) = 0)) > 0 GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)"""
}
