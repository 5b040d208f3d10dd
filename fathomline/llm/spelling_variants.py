"""Spelling variants of words through sorted permuterm rotations (operator 11).

A word ends in a terminator and is turned: the rotation that begins behind a
place reads ``b$a``, then the code point c that stands there.  Words that differ
in that code point alone share the prefix ``b$a``, and the word without it has
``b$a`` as a whole rotation.  So sorted rotations hold all words at distance one
in prefix ranges: inner members (``b$a`` and one code point) and outer ones
(the whole rotation, and the inner member whose code point repeats the one
before it, which another range has met already).  Inner members are near every
other member, outer ones are near inner ones alone; thus each near pair meets in
exactly one range, and a range has no more members than the alphabet has letters.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.llm.shared import stored
from fathomline.llm.text import column_bytes, mix, range_hashes, slices
from fathomline.llm.wordpieces import _distinct

TERMINATOR = "$"
#: Words with fewer code points, or fewer occurrences, are no words.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form occurs at least so many times as often as its variant.
TIMES = 2
#: One in so many (document, run) pairs loses a code point.
NOISE = 97
#: Prefixes of more code points stand as 128-bit fingerprints: a word's rotations would grow with its square.
LONGEST_KEY = 64
_ROWS = 1 << 16


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and code points of the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+``: ASCII letters, and all two-byte letters behind 0xC3."""
    n = len(data)
    lead = data == 0xC3
    tail = np.zeros(n, dtype=bool)
    tail[1:] = lead[:-1]
    folded = data | 0x20
    letter = ((folded >= 97) & (folded <= 122)) | lead | tail
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = ~letter[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(letter & edge[:n])
    edge[1:n] = ~letter[1:]
    edge[offsets] = True
    ends = np.flatnonzero(letter & edge[1:]) + 1
    tails = np.concatenate(([0], np.cumsum(tail, dtype=np.int64)))
    return starts, ends, ends - starts - (tails[ends] - tails[starts])


def count_words(docs: DataFrame, noise: int = NOISE, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n: the runs of letters of whole texts, A-Z lower-cased, some with a code point deleted.

    h is the unsigned crc32 of ``<doc_id>:<run>``; where `noise` divides h, code
    point h % length goes (noise 0: none does).  Results of fewer than
    `least_length` code points are left out.  Null and empty texts have no words; a null doc_id
    stands as nothing before the colon; repeated rows count each; other columns
    are ignored.  A task holds a few MB of text, or one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            data, offsets = column_bytes(batch.column("text"))
            if not len(data):
                continue
            starts, ends, points = _runs(data, offsets)
            long = points >= least_length
            starts, ends, points = starts[long], ends[long], points[long]
            if not len(starts):
                continue
            low = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
            coded, codes, n = _distinct(low, starts, ends)
            words = coded.to_pylist()
            doc = np.searchsorted(offsets, starts, side="right") - 1
            pairs, times = np.unique(doc * n + codes, return_counts=True)
            of_doc, of_word = pairs // n, pairs % n
            gone = np.zeros(len(pairs), dtype=bool)
            lost: Counter[str] = Counter()
            if noise:
                begun = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column("doc_id").to_pylist()]
                h = np.fromiter((zlib.crc32(words[w], begun[d]) for d, w in zip(of_doc.tolist(), of_word.tolist(), strict=True)), np.int64, len(pairs))
                gone = h % noise == 0
                for k in np.flatnonzero(gone).tolist():
                    word = words[of_word[k]].decode()
                    at = int(h[k]) % len(word)
                    if len(word) > least_length:
                        lost[word[:at] + word[at + 1 :]] += int(times[k])
            whole = np.bincount(of_word[~gone], weights=times[~gone], minlength=n).astype(np.int64)
            some = np.flatnonzero(whole)
            names = pa.concat_arrays([coded.take(pa.array(some)).cast(pa.string()), pa.array(list(lost), pa.string())])
            yield pa.RecordBatch.from_arrays([names, pa.array([*whole[some].tolist(), *lost.values()], pa.int64())], names=["word", "n"])

    counted = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _long_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefixes of more than LONGEST_KEY code points, from prefix sums over the word written twice."""
    names = ["key", "outer", "rank", "n"]
    for batch in batches:
        for word, rank, n in zip(*(batch.column(c).to_pylist() for c in ("word", "rank", "n")), strict=True):
            size = len(word)
            points = np.frombuffer((word + TERMINATOR + word).encode("utf-32-le"), np.uint32).astype(np.uint64)
            one, two = mix(points + np.uint64(0x9E3779B97F4A7C15)), mix(points + np.uint64(0xD6E8FEB86659FD93))
            for inner in (True, False):
                length = size if inner else size + 1
                starts = np.arange(1 if inner else 0, size + 1, dtype=np.int64)
                if length <= LONGEST_KEY:
                    continue
                high, low = range_hashes(one, starts, starts + length, 0), range_hashes(two, starts, starts + length, 1)
                # the code point before each inner prefix is the one left out; the prefix ends in the one before that
                outer = np.concatenate(([False], points[1:size] == points[: size - 1])) if inner else np.ones(len(starts), dtype=bool)
                for lo in range(0, len(starts), _ROWS):
                    part = slice(lo, lo + _ROWS)
                    keys = [f"#{a:016x}{b:016x}" for a, b in zip(high[part].tolist(), low[part].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(outer[part]), pa.array([rank] * len(keys), pa.int64()), pa.array([n] * len(keys), pa.int64())], names=names)


def rotations(words: DataFrame) -> DataFrame:
    """key, outer, rank, n: a row for each prefix range that a word (word, rank, n) is a member of, 2 * length + 1 in all."""
    size = F.char_length("word")

    def inner(i):
        char = F.substring("word", i, F.lit(1))
        before = F.substring("word", i - 1, F.lit(1))
        return F.struct(F.concat(F.substring("word", i + 1, size), F.lit(TERMINATOR), F.substring("word", F.lit(1), i - 1)).alias("key"), ((i > 1) & (char == before)).alias("outer"))

    def whole(i):
        return F.struct(F.concat(F.substring("word", i + 1, size), F.lit(TERMINATOR), F.substring("word", F.lit(1), i)).alias("key"), F.lit(True).alias("outer"))

    def turned(some: DataFrame, members) -> DataFrame:
        return some.select(F.explode(members).alias("m"), "rank", "n").select("m.key", "m.outer", "rank", "n")

    short = turned(words.where(size.between(1, LONGEST_KEY)), F.transform(F.sequence(F.lit(1), size), inner))
    short = short.unionByName(turned(words.where(size < LONGEST_KEY), F.transform(F.sequence(F.lit(0), size), whole)))
    return short.unionByName(words.where(size >= LONGEST_KEY).select("word", "rank", "n").mapInArrow(_long_rotations, "key string, outer boolean, rank long, n long"))


def ranked(words: DataFrame) -> DataFrame:
    """The words with `rank`, numbers in the words' code-point order; stored."""
    return stored(words.orderBy("word").withColumn("rank", F.monotonically_increasing_id()))


def neighbours(words: DataFrame) -> DataFrame:
    """word, near: all near pairs, both ways.  words: word, n; distinct, without nulls and TERMINATOR."""
    words = ranked(words)
    turned = rotations(words)
    a, b = turned.select("key", "outer", F.col("rank").alias("a")), turned.select("key", F.col("outer").alias("also"), F.col("rank").alias("b"))
    pairs = a.join(b, "key").where("a != b and not (outer and also)").select("a", "b")
    return pairs.join(words.select(F.col("rank").alias("a"), "word"), "a").join(words.select(F.col("rank").alias("b"), F.col("word").alias("near")), "b").select("word", "near")


def scan(words: DataFrame) -> DataFrame:
    """rank, n_near, best (less, rank, n): of each word with near words their number and the one of largest n (ties: smallest rank).

    Each member of a range gets its count and its best from the range, so the
    rows grow with the words' length, never with the pairs.
    """
    member = F.struct((-F.col("n")).alias("less"), "rank", "n")
    prefix = Window.partitionBy("key").orderBy(F.desc("n"), "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = rotations(words).select(
        "rank",
        "outer",
        F.count(F.lit(1)).over(prefix).alias("members"),
        F.count(F.when(~F.col("outer"), 1)).over(prefix).alias("inner"),
        F.first(member).over(prefix).alias("one"),
        F.nth_value(member, 2).over(prefix).alias("two"),
        F.first(F.when(~F.col("outer"), member), ignorenulls=True).over(prefix).alias("best_inner"),
    )
    other = F.when(F.col("outer"), F.col("best_inner")).when(F.col("one.rank") == F.col("rank"), F.col("two")).otherwise(F.col("one"))
    met = ranges.where("members > 1 and inner > 0").select("rank", F.when(F.col("outer"), F.col("inner")).otherwise(F.col("members") - 1).alias("n_near"), other.alias("best"))
    return met.groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """rank, root: the end of each rank's path along links (rank, to), by doubling.

    A form is at least TIMES as frequent as its variant, so no path is longer
    than the logarithm of the largest count and a few rounds suffice.
    """
    ends = stored(links.select("rank", F.col("to").alias("root")))
    while True:
        onward = ends.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        if ends.join(onward, "root", "left_semi").isEmpty():
            return ends
        ends = stored(ends.join(onward, "root", "left").select("rank", F.coalesce("next", "root").alias("root")))


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words (word, n); times at least 2.

    Two words are near if one inserted, deleted or replaced code point makes one
    the other.  The form is the near word of largest n (ties: the smallest in
    code-point order) if that is at least `times` the word's n; the root is where
    the forms of forms end, the word itself if it has none.  Words are distinct
    and hold no TERMINATOR; rows with a null word or n are left out; no words
    give no rows.  A word of m code points is 2 * m + 1 rows of at most
    LONGEST_KEY code points each, however long it is.
    """
    words = ranked(words.where("word is not null and n is not null").select("word", "n"))
    found = stored(words.join(scan(words), "rank", "left"))
    form = found.where(F.col("best.n") >= times * F.col("n")).select("rank", F.col("best.rank").alias("to"), F.col("best.n").alias("form_n"))
    linked = form.join(roots(form), "rank")
    name = words.select(F.col("rank").alias("at"), F.col("word").alias("name"))
    linked = linked.join(name.withColumnRenamed("name", "form"), F.col("to") == F.col("at")).drop("at")
    linked = linked.withColumnRenamed("root", "end").join(name.withColumnRenamed("name", "root"), F.col("end") == F.col("at")).select("rank", "form", "form_n", "root")
    out = found.join(linked, "rank", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that count_words finds at least `least_count` times."""
    return count_words(docs).where(F.col("n") >= least_count)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: crc32 byte by byte over a table; a marked gap in place of a code point stands for the replaced or the deleted one.
_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END) AS v
    FROM range(256) r(i))),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
pairs AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL),
coded AS (
  SELECT w, c, flatten(list_transform(string_split(id || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS bytes FROM pairs),
hashed AS (
  SELECT w, c, xor(list_reduce(list_prepend(4294967295, bytes), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS h FROM coded, crc_table),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
gaps AS (SELECT word, n, left(word, i - 1) || '_' || substr(word, i + 1) AS gap, left(word, i - 1) || substr(word, i + 1) AS less FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b USING (gap) WHERE a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.less = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.less = w.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
chosen AS (SELECT b.word, min(o.other) AS form, max(b.most) AS form_n FROM best b JOIN near o ON o.word = b.word AND o.n = b.most GROUP BY b.word),
forms AS (SELECT w.word, w.n, c.form, c.form_n FROM words w JOIN chosen c USING (word) WHERE c.form_n >= 2 * w.n),
paths AS (
  SELECT word, form AS target FROM forms
  UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON f.word = p.target),
ends AS (SELECT word, target FROM paths WHERE target NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, coalesce(e.target, w.word) AS root, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN ends e USING (word)
"""

ORACLE_SQL: dict[str, str] = {"op11_spelling_variants": _SQL}
