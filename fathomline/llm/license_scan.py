"""License scans by an exact set-similarity join (operator 7).

Templates are short licence notices.  A text block, any BLOCK words in a row,
matches a template when it holds at least `threshold` of the template's distinct
tokens; line breaks are no bounds, so wrapped notices match.  Tokens are
ordered by their frequency in the whole corpus, rarest first: a block that
holds none of a template's first tokens (as many as may be missing, and one)
cannot match, nor can one with too few distinct tokens, nor one that has missed
too many of the tokens seen so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.decontamination import BREAKS, LOWER, UPPER, words
from fathomline.llm.text import column_bytes, slices

THRESHOLD = 0.8
#: Words of a block; STEP is how far apart the SQL, which goes by lines, lays the blocks of a longer line.
BLOCK, STEP = 48, 24

#: Phrases of the base labels.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Notices by label.
TEMPLATES = {
    "agpl": "licensed under the gnu affero general public license version 3",
    "apache": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc0": "dedicated to the public domain under cc0 1 0 universal",
    "gpl": "licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "licensed under the gnu lesser general public license version 3",
    "mit": "released under the mit license",
    "mpl": "subject to the terms of the mozilla public license version 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

_MAP = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def frequencies(docs: DataFrame, templates: dict[str, str]) -> dict[str, int]:
    """How often each template token occurs in all documents."""
    tokens = sorted({t for text in templates.values() for t in text.split()})
    found = docs.select(F.explode(words(F.col("text"))).alias("t")).where(F.col("t").isin(tokens)).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return dict.fromkeys(tokens, 0) | {r["t"]: r["n"] for r in found.collect()}


class Templates:
    def __init__(self, texts: dict[str, str], counts: dict[str, int], threshold: float):
        self.known = []
        self.prefixes: dict[bytes, list[int]] = {}
        for k, (label, text) in enumerate(sorted(texts.items())):
            tokens = sorted({t.encode() for t in text.split()}, key=lambda t: (counts.get(t.decode(), 0), t))
            need = math.ceil(threshold * len(tokens) - 1e-9)
            self.known.append((label, tokens, need))
            for t in tokens[: len(tokens) - need + 1]:
                self.prefixes.setdefault(t, []).append(k)
        self.bits = {t: 1 << k for k, t in enumerate(sorted({t for _, tokens, _ in self.known for t in tokens}))}
        self.masks = [sum(self.bits[t] for t in tokens) for _, tokens, _ in self.known]
        self.rare = sum(self.bits[t] for t in self.prefixes)
        self.least = min((need for _, _, need in self.known), default=0)

    def match(self, block: list[bytes]) -> Iterator[tuple[str, float]]:
        have = set(block)
        if len(have) < self.least:
            return
        for k in sorted({k for t in have if t in self.prefixes for k in self.prefixes[t]}):
            label, tokens, need = self.known[k]
            if len(have) < need:
                continue
            spare, hits = len(tokens) - need, 0
            for t in tokens:
                if t in have:
                    hits += 1
                else:
                    spare -= 1
                    if spare < 0:
                        break
            if spare >= 0:
                yield label, hits / len(tokens)

    def _told(self, present: int) -> list[tuple[str, float, bool]]:
        """What `match` says of a block with these tokens, and whether the label is the block's own: no better match has all of its words."""
        met = []
        for (label, tokens, need), mask in zip(self.known, self.masks, strict=True):
            if (n := (present & mask).bit_count()) >= max(need, 1):
                met.append((label, n / len(tokens), present & mask, mask))
        return [(label, share, not any(other > share and held & ~mask == 0 for _, other, _, mask in met)) for label, share, held, _ in met]

    def scan(self, found: list[bytes]) -> dict[str, tuple[float, bool]]:
        """Each template that some block of the text's words matches: its highest share, and whether it is some block's own label."""
        spots = [(at, self.bits[w]) for at, w in enumerate(found) if w in self.bits]
        inside, present, left, masks = dict.fromkeys(self.bits.values(), 0), 0, 0, set()
        for at, bit in spots:  # the block that ends here
            while spots[left][0] <= at - BLOCK:
                gone = spots[left][1]
                inside[gone] -= 1
                if not inside[gone]:
                    present &= ~gone
                left += 1
            inside[bit] += 1
            present |= bit
            if present & self.rare and present.bit_count() >= self.least:
                masks.add(present)
        out: dict[str, tuple[float, bool]] = {}
        for present in masks:
            for label, share, own in self._told(present):
                before = out.get(label, (0.0, False))
                out[label] = max(before[0], share), before[1] or own
        return out


def _base(found: list[bytes]) -> tuple[list[tuple[int, str]], int]:
    places, sides = [], {label: [w.encode() for w in phrase.split()] for label, phrase in PHRASES.items()}
    at = -1
    while True:
        try:
            at = found.index(b"license", at + 1)
        except ValueError:
            break
        for label, phrase in sides.items():
            lo = at - len(phrase) + 1
            if lo >= 0 and found[lo : at + 1] == phrase:
                places.append((lo, label))
    return places, len(places)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, shares: one row per row of `docs`.

    shares has every template whose containment in a block (any BLOCK words in a
    row) reaches the threshold, with its highest containment.  base_labels come
    from PHRASES, labels also from those templates, but for one that only stands
    where a better match has all of the words it found (a GPL notice holds nine
    tenths of the AGPL's); score is the best containment, 1 where a phrase
    stands, else 0.
    Null and empty texts have no words and empty labels; null or repeated doc_ids
    are kept as they are; other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    counts = frequencies(docs, templates)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, shares map<string,double>"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.map_(pa.string(), pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, counts, threshold)
        rare = set(known.prefixes)
        for batch in slices(batches, "text"):
            data, offsets = column_bytes(batch.column("text"))
            whole, rows = data.tobytes().translate(_MAP), []
            for doc_id, lo, hi in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                found = whole[lo:hi].split()
                places, n = _base(found)
                base = {label for _, label in places}
                met = {} if rare.isdisjoint(found) else known.scan(found)
                shares = {label: share for label, (share, _) in met.items()}
                labels, score = base | {label for label, (_, own) in met.items() if own}, max([float(bool(base)), *shares.values()])
                starts = [s for s, _ in places]
                rows.append((doc_id, len(found), n, min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, sorted(shares.items(), key=lambda x: (-x[1], x[0]))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("shares")


_WORDS = f"list_filter(string_split_regex(translate({{}}, '{UPPER}', '{LOWER}'), '{BREAKS}'), lambda x: x <> '')"
_PHRASES = " UNION ALL ".join(f"SELECT '{label}' AS label, {p.split()} AS phrase" for label, p in PHRASES.items())
_NOTICES = " UNION ALL ".join(f"SELECT '{label}' AS label, {sorted(set(t.split()))} AS tokens" for label, t in TEMPLATES.items())
ORACLE_SQL = {
    "op7_license_scan": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
phrases AS ({_PHRASES}), notices AS ({_NOTICES}),
spots AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE list_contains(w, 'license')),
base AS (SELECT doc_id, label, i - 1 AS place FROM spots, phrases WHERE list_slice(w, i, i + len(phrase) - 1) = phrase),
lines AS (SELECT doc_id, {_WORDS.format("line")} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
blocks AS (SELECT doc_id, row_number() OVER () AS b, list_slice(w, k + 1, k + {BLOCK}) AS w FROM (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - {BLOCK} + {STEP} - 1, 0), {STEP})) AS k FROM lines)),
found AS (SELECT doc_id, b, label, len(list_intersect(tokens, w)) / len(tokens) AS share, len(list_intersect(tokens, w)) AS hits, len(tokens) AS n FROM blocks, notices),
method AS (SELECT doc_id, label, share FROM found WHERE 10 * hits >= {round(10 * THRESHOLD)} * n QUALIFY share = max(share) OVER (PARTITION BY b)),
places AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT * FROM method UNION ALL SELECT doc_id, label, 1.0 FROM base) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN labels USING (doc_id)"""
}
