"""Recorded model responses to findings (PRJ-15..19, PRJ-36, PRJ-51..52), by VARIANT and pattern functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import fixed
from fathomline.functions.scalars import coerce_cvss
from fathomline.sources.cut_json import json_parts


def unfenced(text: Column) -> Column:
    """The text without reasoning tags and fences."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<think>.*?(</think>|\z)", "")
    return F.regexp_replace(bare, r"(?m)^\s*```[A-Za-z]*\s*$", "")


def plain_json(text: Column) -> Column:
    """PRJ-16: the text without reasoning tags and fences, from its first bracket to its last, with literals and commas mended."""
    bare = F.regexp_extract(unfenced(text), r"(?s)([\[{].*[\]}])", 1)
    bare = F.regexp_replace(bare, r",(\s*[\]}])", "$1")
    for word, json in (("True", "true"), ("False", "false"), ("None", "null")):
        bare = F.regexp_replace(bare, rf"(:\s*|\[\s*|,\s*){word}\b", f"$1{json}")
    return bare


def response_items(raw: DataFrame) -> DataFrame:
    """PRJ-16..18: (file, place, item, salvaged) for every finding in responses (file, response).

    A response that parses, or whose outermost value does, gives its
    vulnerabilities, findings or the array that it is.  One that was cut off is cut
    back to its last whole object and closed; where that does not parse either, each
    whole object with a type and a severity is salvaged, whatever depth it stands at, the
    first of those of one type and location.
    """
    parts = json_parts(unfenced(F.col("response")))
    text = raw.withColumn("__p", parts).withColumn("__v", F.coalesce(F.try_parse_json(plain_json(F.col("response"))), F.try_parse_json(plain_json(F.col("__p.outer"))))).withColumn("__c", F.try_parse_json(plain_json(F.col("__p.closed"))))

    def listed(value: str) -> Column:
        return F.coalesce(*(F.try_variant_get(value, path, "array<variant>") for path in ("$.vulnerabilities", "$.findings", "$")))

    whole, closed = listed("__v"), listed("__c")
    like = F.transform("__p.objects", lambda o: F.try_parse_json(plain_json(o)))
    items = text.withColumn("salvaged", whole.isNull()).withColumn("__items", F.coalesce(whole, closed, like))
    return items.select("file", F.posexplode("__items").alias("place", "item"), "salvaged")


def _text(*paths: str) -> Column:
    found = [F.try_variant_get("item", p, "string") for p in paths]
    return F.coalesce(*[F.when(F.trim(x) != "", x) for x in found])


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def model_type(kind: Column, cwe: Column) -> Column:
    """PRJ-15: the type that a model's words stand for: a known name or synonym, whatever its case and dashes, else by the CWE number beside or in it, else by its words; null if by none."""
    name = F.upper(F.regexp_replace(F.trim(F.coalesce(kind, F.lit(""))), r"[\s-]+", "_"))
    names = {t: t for t in fixed.MODEL_TYPES} | {n: to for to, same in fixed.TYPE_SYNONYMS.items() for n in same}
    number = F.regexp_extract(F.upper(F.coalesce(cwe, kind, F.lit(""))), r"CWE[-_]?(\d+)", 1)
    low = F.lower(F.coalesce(kind, F.lit("")))
    worded = [F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), to) for words, to in fixed.MODEL_TYPE_WORDS]
    return F.coalesce(F.try_element_at(_table(names), name), F.try_element_at(_table(fixed.MODEL_CWE_TYPES), number), *worded)


def vector_score(vector: Column) -> Column:
    """PRJ-15: a score of a CVSS vector's metrics whose names begin with C, I or A, at most 10."""
    metrics = F.filter(F.split(vector, "/"), lambda m: F.rlike(m, F.lit("^[CIA].*:")))
    points = F.transform(metrics, lambda m: F.coalesce(*[F.when(F.endswith(m, F.lit(f":{end}")), F.lit(p)) for end, p in fixed.VECTOR_POINTS.items()], F.lit(0.0)))
    return F.least(F.lit(10.0), F.round(F.aggregate(points, F.lit(0.0), lambda a, b: a + b), 2))


def findings_of(items: DataFrame) -> DataFrame:
    """PRJ-15, PRJ-19: items with their synonyms and defaults as findings; the file is the one that was asked about.

    Items of no known type go.  A severity that is none counts as MEDIUM, a CWE
    that says nothing as the type's own, a score without sense as 5.
    """
    place = _text("$.location")
    # a location in words: the line beside "sink", else the last number that can be a line
    words = F.when(F.try_variant_get("item", "$.location.start_line", "int").isNull(), place)
    beside = F.coalesce(F.nullif(F.regexp_extract(words, r"(?i)sink\D*?(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(words, r"(?i)(\d+)\D*?(?:sink|call)", 1), F.lit(""))).try_cast("int")
    numbers = F.filter(F.transform(F.regexp_extract_all(F.coalesce(words, F.lit("")), F.lit(r"\b(\d{1,4})\b"), F.lit(1)), lambda x: x.cast("int")), lambda n: (n > 0) & (n < 5000))
    line = F.coalesce(F.try_variant_get("item", "$.location.start_line", "int"), beside, F.try_element_at(numbers, F.lit(-1)), F.try_variant_get("item", "$.start_line", "int"), F.try_variant_get("item", "$.line", "int"), F.lit(1))
    end = F.coalesce(F.try_variant_get("item", "$.location.end_line", "int"), F.try_variant_get("item", "$.end_line", "int"), line)
    fix = _text("$.remediation.recommendation", "$.remediation.fix", "$.remediation.description", "$.remediation", "$.recommended_fix", "$.fix")
    given = F.trim(F.coalesce(_text("$.cwe_id", "$.cwe"), F.lit("")))
    severity = F.upper(F.coalesce(_text("$.severity"), F.lit("")))
    score = F.coalesce(_text("$.cvss_score"), F.lit("5.0"))
    kind = F.col("type")
    canonical = F.try_element_at(_table({t: f"CWE-{fixed.CANONICAL_CWES[t]}" for t in fixed.CWE_BY_TYPE}), kind)
    typed = items.withColumn("type", model_type(_text("$.type", "$.vulnerability_type"), F.nullif(given, F.lit("")))).where("type is not null")
    return typed.select(
        F.col("file").alias("file_path"), "place", "salvaged", kind,
        F.when(severity.isin(*fixed.SEVERITIES), severity).otherwise("MEDIUM").alias("severity"),
        line.alias("start_line"), end.alias("end_line"),
        F.coalesce(_text("$.description"), F.lit("")).alias("description"), F.coalesce(_text("$.impact"), F.lit("")).alias("impact"), F.coalesce(fix, F.lit("")).alias("remediation"),
        F.when(~given.isin(*fixed.NO_CWES), given).otherwise(F.coalesce(canonical, F.nullif(given, F.lit("")), F.lit("CWE-Other"))).alias("cwe_id"), F.coalesce(_text("$.owasp_category", "$.owasp"), F.lit("A00: Other")).alias("owasp_category"),
        score.alias("cvss"), F.when(F.startswith(F.trim(score), F.lit("CVSS:")), vector_score(F.trim(score))).otherwise(coerce_cvss(score)).alias("cvss_score"), F.coalesce(F.try_variant_get("item", "$.references", "array<string>"), F.array().cast("array<string>")).alias("references"),
        F.coalesce(_text("$.defect_replication_notes", "$.proof_of_concept"), F.lit("")).alias("proof_of_concept"), F.coalesce(_text("$.secure_code_example", "$.remediation.secure_code_example"), F.lit("")).alias("secure_code_example"),
    )


# Whole verdict fields, and phrases of prose, each with what it means.
VERDICT_FIELDS = {
    "refuted": ("refuted", "false_positive", "false positive", "fp", "safe", "benign", "not_vulnerable", "not vulnerable", "rejected", "invalid"),
    "confirmed": ("confirmed", "true_positive", "true positive", "tp", "vulnerable", "upheld", "verified", "valid"),
}
VERDICT_PHRASES = {
    "refuted": ("false positive", "false_positive", "refuted", "dismiss the", "not a vulnerability", "not vulnerable", "benign", "claim is incorrect", "finding is a false", "finding is incorrect"),
    "confirmed": ("confirmed", "true positive", "true_positive", "vulnerable", "upheld"),
}


def verdict(text: Column) -> Column:
    """PRJ-36: confirmed, refuted or uncertain by the whole verdict (or status) field of JSON; of prose by whole phrases, refuting ones first, else `error`.

    A JSON object without a known verdict is uncertain.
    """
    told = F.try_parse_json(plain_json(text))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(told), F.lit("OBJECT")), F.lit(False))
    field = F.lower(F.trim(F.coalesce(*[F.nullif(F.try_variant_get(told, p, "string"), F.lit("")) for p in ("$.verdict", "$.status")], F.lit(""))))
    fields = [F.when(is_object & field.isin(*words), name) for name, words in VERDICT_FIELDS.items()]
    prose = F.lower(F.coalesce(text, F.lit("")))
    phrases = [F.when(F.rlike(prose, F.lit(r"(?<![\p{L}\p{N}_])(?:" + "|".join(words) + r")(?![\p{L}\p{N}_])")), name) for name, words in VERDICT_PHRASES.items()]
    return F.coalesce(*fields, F.when(is_object, "uncertain"), *phrases, F.lit("error"))

