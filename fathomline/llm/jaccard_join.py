"""N-gram Jaccard join with Bayesian pruning (operator 10).

Documents become sets of five-word shingles.  Equal sets collapse first, so
copies cost nothing later.  Sets whose MinHash values agree in a whole band
become candidates; candidates' MinHash values are compared a few at a time and
a pair is dropped once the posterior probability (uniform prior) that its
similarity reaches the threshold falls below a tolerance.  What is left forms
small clusters, inside which all pairs go through the same test and are then
counted exactly on their shingles.  Pairs are counted, never listed: each task
returns counts and a spanning forest of the links it found.

Large buckets and clusters are dealt into sub-blocks; a task sees two
sub-blocks, so no group meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.components import components
from fathomline.llm.shared import stored
from fathomline.llm.text import column_bytes, joined, mix, slices, window_hashes, word_hashes, word_spans

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4  # a pair at 0.8 agrees in no band with probability 3e-5
STEP = 16  # MinHash values compared at a time
TOLERANCE = 1e-6
BUCKET_BLOCK = 2048
CLUSTER_BLOCK = 1024
#: Bytes of texts or signatures that a task's groups hold together, about.
TASK_BYTES = 4 << 20


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    n = BANDS * ROWS
    return rng.integers(1, 1 << 64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, dtype=np.uint64)


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For STEP, 2*STEP, ... values compared, the fewest agreements that keep a pair.

    With a uniform prior the posterior after m of n agreements is Beta(m + 1, n - m + 1),
    whose mass above t is the chance of at most m successes in n + 1 trials of t.
    """
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes, and their offsets.

    A text of fewer than `words` words, but not none, is one shingle.
    """
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(first[1:], sizes) - np.arange(len(h))
    at = np.flatnonzero(left >= words)
    values, owner = window_hashes(h, at, words, 0), doc[at]
    for k in np.flatnonzero((sizes > 0) & (sizes < words)):
        one = window_hashes(h[first[k] : first[k + 1]], np.zeros(1, np.int64), int(sizes[k]), 0)
        values, owner = np.append(values, one), np.append(owner, k)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(sizes) + 1))


def set_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128-bit keys of the sets, as an array of 16 bytes each."""
    out = np.zeros((len(offsets) - 1, 2), dtype=">u8")
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        with np.errstate(over="ignore"):
            for k, salt in enumerate((0x51_7CC1_B727_220A, 0x2545_F491_4F6C_DD1D)):
                out[full, k] = mix(np.add.reduceat(mix(values ^ np.uint64(salt)), offsets[:-1][full]))
    return out


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    a, b = _functions()
    full = np.flatnonzero(np.diff(offsets))
    out = np.full((len(offsets) - 1, len(a)), 0xFFFFFFFF, dtype=np.uint32)
    if len(full):
        cuts = offsets[:-1][full]
        with np.errstate(over="ignore"):
            for k in range(len(a)):
                out[full, k] = np.minimum.reduceat(((values * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), cuts)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, offsets = column_bytes(batch.column("text"))
        values, cuts = shingles(data, offsets)
        sizes = np.diff(cuts)
        keys, sigs = set_keys(values, cuts), signatures(values, cuts)
        none = sizes == 0
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([None if z else k.tobytes() for z, k in zip(none, keys, strict=True)], pa.binary()), pa.array(sizes, pa.int64()), pa.array([None if z else s.tobytes() for z, s in zip(none, sigs, strict=True)], pa.binary())], names=["doc_id", "row", "node", "n_shingles", "sig"])


def _survivors(x: np.ndarray, y: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Places of the pairs (rows of x and y) that are never dropped."""
    alive, same = np.arange(len(x)), np.zeros(len(x), np.int32)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        same += (x[alive, part] == y[alive, part]).sum(axis=1, dtype=np.int32)
        keep = same >= need
        alive, same = alive[keep], same[keep]
    return alive


def _pairs_kept(left: np.ndarray, right: np.ndarray, least: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of left, the rows of right that survive."""
    for i in range(len(left)):
        yield i, _survivors(np.broadcast_to(left[i], right.shape), right, least)


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), -1)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _bucket_edges(rows: pd.DataFrame, least: tuple[int, ...]) -> pd.DataFrame:
    """Survivors among the rows of each bucket, as the edges of one forest over all these buckets.

    Rows that survive against the bucket's first row hang on it; each other row
    meets all rows.  A node's edge leads to the least node of its tree.
    """
    rows = rows.sort_values(["bucket", "i", "j", "node"], kind="stable", ignore_index=True)
    key = rows[["bucket", "i", "j"]].to_numpy()
    cuts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(rows)]))
    sigs = _matrix(list(rows["sig"]))
    place, nodes = pd.factorize(rows["node"], sort=True)
    place, forest = place.tolist(), _Forest(len(nodes))
    # most buckets are pairs: all first rows against all others at once
    sizes = np.diff(cuts)
    first = np.repeat(cuts[:-1], sizes)
    other = np.flatnonzero(np.arange(len(rows)) != first)
    hang = np.zeros(len(rows), dtype=bool)
    for lo in range(0, len(other), 1 << 15):
        part = other[lo : lo + (1 << 15)]
        hang[part[_survivors(sigs[first[part]], sigs[part], least)]] = True
    for k in np.flatnonzero(hang).tolist():
        forest.join(place[k], place[first[k]])
    for lo, hi in zip(cuts[:-1][sizes > 2], cuts[1:][sizes > 2], strict=True):
        for k in (lo + 1 + np.flatnonzero(~hang[lo + 1 : hi])).tolist():
            for j in (lo + 1 + _survivors(np.broadcast_to(sigs[k], (hi - lo - 1, sigs.shape[1])), sigs[lo + 1 : hi], least)).tolist():
                forest.join(place[k], place[j])
    roots = [forest.root(k) for k in range(len(nodes))]
    return pd.DataFrame([(nodes[k], nodes[r]) for k, r in enumerate(roots) if k != r], columns=["a", "b"])


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[l] and sets[r] for l in left and r in right."""
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    many = np.bincount(where, minlength=len(values)) > 1
    column = np.cumsum(many) - 1
    keep = many[where]
    where, owner = column[where[keep]], owner[keep]
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    step = 2048
    for lo in range(0, int(many.sum()), step):
        a, b = np.searchsorted(where, [lo, lo + step])
        m = np.zeros((len(sets), step), dtype=np.float32)
        m[owner[a:b], where[a:b] - lo] = 1
        total += m[left] @ m[right].T
    return total.astype(np.int64)


def _cluster_links(rows: pd.DataFrame, threshold: float, least: tuple[int, ...]) -> pd.DataFrame:
    """Exact links inside each cluster: a count per node, and edges that connect the linked ones."""
    out: list[tuple] = []
    texts = [b"" if t is None else t.encode() for t in rows["text"]]
    values, cuts = shingles(*joined(texts))
    keys = set_keys(values, cuts)
    rows = rows.assign(at=np.arange(len(rows)), same=[bytes(n) == k.tobytes() for n, k in zip(rows["node"], keys, strict=True)])
    rows = rows[rows["same"]].drop_duplicates(["root", "i", "j", "node"])  # one text for each node
    for (_, i, j), g in rows.groupby(["root", "i", "j"], sort=False):
        g = g.sort_values("node", ignore_index=True)
        sets = [values[cuts[k] : cuts[k + 1]] for k in g["at"]]
        size, copies, part = np.array([len(s) for s in sets]), g["copies"].to_numpy(), g["part"].to_numpy()
        left = np.flatnonzero(part == i)
        right = np.flatnonzero(part == j)
        sigs = _matrix(list(g["sig"]))
        links, forest, nodes = np.zeros(len(g), np.int64), _Forest(len(g)), g["node"].to_numpy()
        hits: list[tuple[int, np.ndarray]] = []
        kept = [(left[a], right[b]) for a, b in _pairs_kept(sigs[left], sigs[right], least)]
        if len(left) * len(right) > 64:
            common = _common(sets, left, right)
            place = np.full(len(g), -1)
            place[right] = np.arange(len(right))
            for n, (a, bs) in enumerate(kept):
                c = common[n, place[bs]]
                hits.append((a, bs[c >= threshold * (size[a] + size[bs] - c) - 1e-9]))
        else:
            for a, bs in kept:
                c = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for b in bs], dtype=np.int64)
                hits.append((a, bs[c >= threshold * (size[a] + size[bs] - c) - 1e-9]))
        for a, bs in hits:
            bs = bs[bs > a] if i == j else bs
            links[a] += copies[bs].sum()
            np.add.at(links, bs, copies[a])
            for b in bs:
                if forest.join(int(a), int(b)):
                    out.append((nodes[a], nodes[b], 0))
        out += [(nodes[k], None, int(links[k])) for k in np.flatnonzero(links)]
    return pd.DataFrame(out, columns=["node", "other", "links"])


def _dealt(rows: DataFrame, by: list[str], count: str, block: int, parts: str = "part") -> DataFrame:
    """Adds part, i, j: groups larger than `block` are split, and each pair of parts (i <= j) gets both."""
    k = F.greatest(F.lit(1), F.ceil(F.col(count) / block)).cast("int")
    rows = rows.withColumn("k", k).withColumn(parts, F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.withColumn("i", F.least(parts, "with")).withColumn("j", F.greatest(parts, "with")).drop("k", "with")


def _row_key(docs: DataFrame):
    """Equal for rows of the same doc_id and text alone."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.md5(F.coalesce(docs["text"], F.lit(""))))))


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id, n_links, copy_id, n_shingles, row, class; one row per row of `docs`.

    n_links counts the other rows whose shingle sets reach `threshold`; class_id
    is the least doc_id among the rows joined to this one by links, directly or
    through others; copy_id the least among rows of an equal set.  Null and
    empty texts have no shingles and no links: class_id and copy_id are their own
    doc_id.  A null doc_id is never a class's name unless no row of it has one;
    repeated rows count as documents of their own.  Other columns are ignored.
    `row` stands for the doc_id and text, and `class` (null without shingles) is
    the same for the rows of a class alone.
    """
    spark = docs.sparkSession
    least = least_matches(threshold, tolerance)
    least_groups = max(64, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def groups(n_bytes: int | None) -> int:
        return max(least_groups, int((n_bytes or 0) // TASK_BYTES))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row_key(docs).alias("row"))
    signed = stored(docs.mapInArrow(_sign, "doc_id long, row binary, node binary, n_shingles long, sig binary"))
    nodes = stored(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("copy_id"), F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.max("n_shingles").alias("n_shingles")))

    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)])
    keyed = nodes.select("node", F.explode(bands).alias("bucket"))
    sizes = stored(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    sent = sizes.agg(F.sum(F.col("n") * F.ceil(F.col("n") / BUCKET_BLOCK)) * (4 * BANDS * ROWS)).first()[0]
    shared = keyed.join(sizes, "bucket").join(nodes.select("node", "sig"), "node")
    shared = _dealt(shared, ["bucket"], "n", BUCKET_BLOCK).withColumn("g", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(groups(sent))))
    close = shared.select("g", "bucket", "i", "j", "node", "sig").groupBy("g").applyInPandas(lambda rows: _bucket_edges(rows, least), "a binary, b binary")
    clusters = stored(components(close))

    inside = stored(clusters.join(clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").join(nodes, "node"))
    # a shingle begins at each word, so its hash and its word together take some 16 bytes
    sent = inside.agg(F.sum(F.col("n_shingles") * 16 * F.ceil(F.col("n") / CLUSTER_BLOCK))).first()[0]
    # one text for each node: repeated rows share a row key
    texts = inside.join(docs.join(inside.select("row"), "row", "left_semi").dropDuplicates(["row"]).select("row", "text"), "row")
    texts = _dealt(texts, ["root"], "n", CLUSTER_BLOCK).withColumn("g", F.pmod(F.xxhash64("root", "i", "j"), F.lit(groups(sent))))
    found = stored(texts.select("g", "root", "i", "j", "part", "node", "copies", "sig", "text").groupBy("g").applyInPandas(lambda rows: _cluster_links(rows, threshold, least), "node binary, other binary, links long"))

    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = roots.join(nodes.select("node", "copy_id"), "node")
    named = named.join(named.groupBy("root").agg(F.min("copy_id").alias("class_id")), "root").select("node", "class_id", "root")
    known = nodes.select("node", "copy_id", "copies").join(links, "node", "left").join(named, "node", "left")
    # copies == 1 and no link is the usual case; the rest is small
    known = known.where("copies > 1 or links is not null")
    out = signed.select("doc_id", "row", "node", "n_shingles").join(known, "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "copy_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.coalesce("copy_id", "doc_id").alias("copy_id"), "n_shingles", "row", F.coalesce("root", "node").alias("class"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of `docs` with one row left of each class: that of the least doc_id (null last), then of the least row key.

    Rows without shingles all stay.
    """
    found = join(docs, threshold, tolerance)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row"))
    stay = found.where("class is not null").groupBy("class").agg(best.alias("best")).select(F.col("best.row").alias("row"))
    # a document's columns travel in a struct, so none of them can clash with the key
    keyed = docs.select(_row_key(docs).alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    some = keyed.join(stay, "row", "left_semi").dropDuplicates(["row"])
    none = keyed.join(found.where("class is null").select("row"), "row", "left_semi")
    return some.unionByName(none).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row", "class")


ORACLE_SQL: dict[str, str] = {}
