"""Scans against labels: detections from any payload, label paths, scores per scan (PRJ-29..30, AGG-25..26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import fixed
from fathomline.functions.rules import posix_path
from fathomline.operators import scoring


def _text(*paths: str) -> Column:
    """The first of a finding's values that is a text and not blank."""
    return F.coalesce(*[F.nullif(F.try_variant_get("finding", p, "string"), F.lit("")) for p in paths], F.lit(""))


def _line() -> Column:
    def at(path: str) -> Column:
        return F.try_variant_get("finding", path, "string").try_cast("double").cast("int")

    def some(path: str) -> Column:
        return F.nullif(at(path), F.lit(0))

    return F.coalesce(some("$.start_line"), some("$.line"), at("$.line_number"), at("$.location.start_line"), at("$.start.line"), at("$.locations[0].physicalLocation.region.startLine"), F.lit(0))


def _cwe(kind: Column) -> Column:
    paths = [p for q in ("$.cwe", "$.cwe_id", "$.issue_cwe.id", "$.extra.metadata.cwe", "$.metadata.cwe") for p in (f"{q}[0]", q)]
    bare = F.trim(F.replace(F.replace(F.upper(F.trim(F.substring_index(_text(*paths), ":", 1))), F.lit("CWE-"), F.lit("")), F.lit("CWE"), F.lit("")))
    by_type = F.coalesce(*[F.when(F.contains(F.upper(kind), F.lit(t)), c) for t, c in fixed.TYPE_CWES])
    return F.when(bare.isin("", "OTHER", "000", "UNKNOWN"), F.coalesce(by_type, bare)).otherwise(bare)


def detections(payload: DataFrame) -> DataFrame:
    """PRJ-29: (id, d, file, line, cwe, type, source) of findings (id, place, finding as a variant) of any known shape.

    A finding that is no object is left out; a missing CWE follows from the type.
    """
    kind = _text("$.type", "$.vulnerability_type")
    files = _text("$.file", "$.file_path", "$.path", "$.filename", "$.location.file_path", "$.locations[0].physicalLocation.artifactLocation.uri")
    some = payload.where(F.startswith(F.schema_of_variant("finding"), F.lit("OBJECT")))
    return some.select("id", F.col("place").cast("long").alias("d"), files.alias("file"), _line().alias("line"), _cwe(kind).alias("cwe"), _text("$.type", "$.vulnerability_type", "$.test_name", "$.check_id", "$.rule_id").alias("type"), _text("$.source").alias("source"))


def label_paths(rows: DataFrame, labelled: DataFrame, column: str = "file", folder: str = "") -> DataFrame:
    """PRJ-30: `column` as the labels name it: itself, without samples/, below the data set's folder, its base name, its longest labelled ending; else as it is without samples/.

    labelled: file.
    """
    raw = posix_path(F.col(column))
    top = folder.rstrip("/")
    inside = F.when(F.startswith(raw, F.lit(top + "/")), F.substr(raw, F.lit(len(top) + 2))) if top else F.lit(None).cast("string")
    bare = F.regexp_replace(raw, "^samples/", "")
    parts = F.split(raw, "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    tries = F.concat(F.array(raw, bare, F.regexp_replace(inside, "^samples/", ""), F.element_at(parts, -1)), endings)
    keyed = rows.withColumn("__raw", raw)
    names = keyed.select("__raw").distinct().withColumn(column, F.col("__raw"))
    tried = names.select("__raw", F.posexplode(tries).alias("rank", "name")).where("name is not null")
    found = tried.join(labelled.select(F.col("file").alias("name")).distinct(), "name").groupBy("__raw").agg(F.min_by("name", "rank").alias("__name"))
    return keyed.join(found, "__raw", "left").withColumn(column, F.coalesce("__name", F.regexp_replace("__raw", "^samples/", ""))).drop("__raw", "__name")


def evaluate_scans(found: DataFrame, labels: DataFrame, exact: bool = False) -> DataFrame:
    """AGG-25, AGG-26: tp, fp, fn, precision, recall and f1 of each scan against one label set.

    found: id, d, file, line, cwe, type, source with `file` as the labels name it;
    labels: l, file, line, cwe, type, note.  Only labels of files that a scan
    names meet it, so labels are not multiplied by scans.
    """
    scanned = found.select(F.col("id").alias("scan"), "file").distinct()
    key = F.concat_ws("\u0001", F.col("scan").cast("string"), "file")
    asked = labels.join(scanned, "file").withColumn("file", key).withColumn("l", F.xxhash64("scan", "l"))
    own = found.withColumnRenamed("id", "scan").withColumn("file", key).withColumn("d", F.xxhash64("scan", "d"))
    matched = scoring.match(scoring.candidate_pairs(own, asked, exact=exact))
    tp = matched.join(own.select("d", "scan"), "d").groupBy("scan").agg(F.count(F.lit(1)).alias("tp"))
    counts = found.groupBy(F.col("id").alias("scan")).agg(F.count(F.lit(1)).alias("n")).join(tp, "scan", "left").fillna(0, ["tp"])
    told = counts.crossJoin(F.broadcast(labels.agg(F.count(F.lit(1)).alias("labels"))))  # one row
    told = told.select(F.col("scan").alias("id"), "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("labels") - F.col("tp")).alias("fn"))
    return told.select("*", *scoring.ratios(F.col("tp"), F.col("fp"), F.col("fn")))
