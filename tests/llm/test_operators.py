"""Each operator against a brute-force version, on awkward rows: nulls, empties, a long text, ties, copies, clashing columns."""

import collections
import html
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from fathomline.llm import attention, crf, decontamination, html_extract, jaccard_join, license_scan, lm_scoring, packing, quality_rules, repeats, substring_dedup, suffix_array, suffix_dedup, url_filter
from fathomline.llm.components import components
from fathomline.llm.sampling import least_hashes
from fathomline.llm.wordpieces import gather, split_words, word_pieces

SCHEMA = "doc_id long, text string, source string, n_words long, row string, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return " ".join(rng.choice(["w%d", "é%d", "Wort%d,"]) % rng.randint(0, vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base, passage = prose(rng, 120), prose(rng, 45)
    near = base.split(" ")
    near[60] = "changed"
    long = prose(rng, 9000, 100_000)
    out = [base, base, " ".join(near), prose(rng, 50) + "\n" + passage + "\n" + prose(rng, 30), passage + " " + prose(rng, 80), passage, long, prose(rng, 200, 3), "", None, " \n\t", "one two", "one two", "x", passage + " tail " + passage, " odd spacé İ ΣΑΣ '<|endoftext|>"]
    return out + [prose(rng, rng.randint(1, 60)) for _ in range(30)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, None if k % 5 == 0 else "s", k, "r", "k") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """A null id, a repeated id with another text, and whole repeated rows."""
    rng = random.Random(5)
    a, b = prose(rng, 60), prose(rng, 60)
    return spark.createDataFrame([(None, a, "s", 1, "r", "k"), (3, a, None, 1, "r", "k"), (3, b, "s", 1, "r", "k"), (4, b, "s", 1, "r", "k"), (4, b, "s", 1, "r", "k"), (None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# quality rules


def test_base_counts_and_verdicts(spark, docs, texts, none):
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (7, 0, 0), (6, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(docs, labels)
    assert out.columns[:4] == ["doc_id", "text", "source", "row"]
    for r in out.collect():
        text = texts[r["doc_id"]] or ""
        words = WORD.findall(text)
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        counts, cover = collections.Counter(grams), set()
        for k, g in enumerate(grams):
            if counts[g] > 1:
                cover.update(range(k, k + 5))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality_rules.judge(none, labels).count() == 0
    unlabelled = quality_rules.judge(docs, labels.where("false"))
    assert unlabelled.where("kept = base_failed").count() == 0


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(2)
    field = crf.Crf(np.zeros((1, 2)), np.zeros(2), rng.normal(size=(2, 2)))
    scores = rng.normal(size=(9, 2))
    got = field.decode(scores, np.array([0, 6, 6, 9]))

    def value(path, at):
        return sum(scores[at + k, y] for k, y in enumerate(path)) + sum(field.step[a, b] for a, b in itertools.pairwise(path))

    for at, n in ((0, 6), (6, 3)):
        best = max(itertools.product((0, 1), repeat=n), key=lambda p: value(p, at))
        assert tuple(got[at : at + n]) == best


def test_crf_learns_held_out_labels():
    rng = np.random.default_rng(4)

    def chain():
        y = np.repeat(rng.integers(0, 2, 4), rng.integers(1, 5, 4))
        return (y[:, None] * 1.5 + rng.normal(size=(len(y), 1))), y

    data = [chain() for _ in range(200)]
    field = crf.fit([x for x, _ in data], [y for _, y in data])
    test = [chain() for _ in range(100)]
    hits = np.concatenate([field.decode(field.scores(x), np.array([0, len(x)])) == y for x, y in test])
    alone = np.concatenate([(x[:, 0] > 0.75) == y for x, y in test])
    assert hits.mean() > max(0.8, alone.mean())


def test_boilerplate_lines_inside_good_documents(spark):
    rng = random.Random(8)

    def good(n):
        return [prose(rng, 25).capitalize() + "." for _ in range(n)]

    def junk(n):
        return [" ".join(rng.choice(["|", "$$$", "BUY", "NOW!!!", "###", "9.99"]) for _ in range(6)) for _ in range(n)]

    def mixed(parts):
        rng.shuffle(parts)
        return "\n".join(parts)

    made = [(k, mixed(good(8) + junk(k % 4)), 1) for k in range(60)] + [(60 + k, mixed(junk(12) + good(k % 3)), 0) for k in range(60)]
    new = [(200, mixed(good(6) + junk(3)), None), (201, mixed(junk(9) + good(1)), None), (202, mixed(good(9)), None)]
    rows = spark.createDataFrame([(k, t) for k, t, _ in made + new], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in made], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality_rules.judge(rows, labels).collect()}
    assert sum(0 < r["content_share"] < 1 for r in out.values()) > 60
    for k, text, _ in new:
        words = [(WORD.findall(line), line[0].isupper() and line.endswith(".")) for line in text.split("\n")]
        share = sum(len(w) for w, is_good in words if is_good) / sum(len(w) for w, _ in words)
        assert out[k]["content_share"] == pytest.approx(share, abs=0.1) and out[k]["kept"] == (k != 201)


def test_quality_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality_rules.accepted(odd, labels)
    assert kept.schema == odd.schema and {tuple(r) for r in kept.collect()} == {tuple(r) for r in odd.where("text is not null").collect()} and kept.count() == 5
    assert "n_words" in quality_rules.judge(odd, labels).columns and quality_rules.verdicts(odd, labels).select("document.n_words").count() == 6


@pytest.mark.parametrize(("n", "kinds"), [(4, 1), (10, 1), (31, 2), (32, 2), (33, 2), (120, 3), (121, 200)])
def test_ranks_equal_a_plain_suffix_sort(spark, n, kinds):
    rng = random.Random(n)
    symbols = [rng.randint(1, kinds) for _ in range(n)]
    rows = spark.createDataFrame(list(enumerate(symbols)), "g long, s long").repartition(3)
    got = [r["g"] for r in suffix_array.ranks(rows, n, alone=5).orderBy("rank").collect()]
    assert got == sorted(range(n), key=lambda g: symbols[g:])


def test_later_starts_equal_the_dedup(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(9)] + [None, "abab" * 6, "abab" * 6]
    docs = spark.createDataFrame([(k if k != 4 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in suffix_array.later_starts(docs, 8, alone=20).collect():
        got[r["doc_id"]].update(range(r["start"], r["start"] + 8))
    want = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_later(docs, length=8, period=7).collect() if r["n_removed"]}
    assert {k: len(v) for k, v in got.items()} == want and len(want) > 3
    assert suffix_array.later_starts(docs.where("false"), 8).count() == 0


BIG = 9007199254740993  # no double


@pytest.mark.parametrize("find", [substring_dedup.remove_repeats, suffix_dedup.remove_later])
def test_large_ids_beside_null_ids(spark, find):
    rows = spark.createDataFrame([(BIG, "a b c"), (None, "d e"), (BIG - 1, "f")], "doc_id long, text string")
    assert {r["doc_id"] for r in find(rows).collect()} == {BIG, BIG - 1, None}


def test_large_page_ids_beside_null_ids(spark):
    rows = spark.createDataFrame([(BIG, "http://a/", "<p>x"), (None, None, "<article>y</article>"), (None, "http://a/", "<p>z"), (BIG - 1, "u", "<article>w</article>")], "page_id long, url string, html string").coalesce(1)
    assert {(r["page_id"], r["text"]) for r in html_extract.extract(rows).collect()} == {(BIG, "x"), (None, "y"), (None, "z"), (BIG - 1, "w")}


def test_crf_keeps_clean_documents(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id")
    good, bad = out.where("quality = 1 and not base_failed"), out.where("quality = 0 and not base_failed")
    assert good.where("kept").count() >= 0.97 * good.count()
    assert bad.where("not kept").count() >= 0.5 * bad.count()


# packing


def test_packing_round_trip(docs, odd, texts, none):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack_documents(docs, packing.default_tokenizer(), sequence=256, group=2000).collect()
    want = {k: [*model.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    got, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0 and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
        got[r["doc_id"]].append((r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sum((ids for _, ids in sorted(v)), []) for k, v in got.items()} == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack_documents(none, packing.default_tokenizer()).count() == 0
    assert packing.pack_documents(odd, packing.default_tokenizer()).where("start = 0").count() == 6


def test_pack_balances_cost():
    rng = random.Random(1)
    sizes = [rng.randint(1, 6000) for _ in range(400)]
    made = packing.pack(sizes)
    assert sum(length for s in made for _, _, length in s) == sum(sizes)
    cost = sorted(sum(n + n * n / 12288 for _, _, n in s) for s in made if len(s) > 1 and sum(n for _, _, n in s) == 4096)
    assert cost[-1] / cost[len(cost) // 2] < 1.3


def test_word_ids_equal_the_tokenizer():
    pieces, rng = word_pieces(packing.default_tokenizer()), random.Random(3)
    words = ["'s", "don't", "a's", "<|endoftext|>", "x<|startoftext|>y", "ＡＢ", "İ", "ΣΑΣ", "é́", "½", "a b", "ﬁ", "#1", "²", "Ñ;", "''", "é&&&", "abc***", "﻿x", "\x00a", "µ", "ªº", "a" * 300, "." * 90, "×", "÷a"]
    words += ["".join(rng.choice("abcdeéÀßÿ.,&'9") for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    words += ["".join(rng.choice(["th", "e", "in", "an", "Er", "on", "ique", "é"]) for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", "**"]) for _ in range(3000)]
    ids, offsets = pieces.of_words(pa.array(words))
    for w, x, lo, hi in zip(words, pieces._general(words), offsets, offsets[1:], strict=False):
        assert ids[lo:hi].tolist() == x, w


# repeats


def test_covers_are_covers():
    for period, cover in repeats.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("block_mb", [4.0, 0.01])
def test_substring_dedup(docs, texts, block_mb):
    counts, words = collections.Counter(), {k: WORD.findall(t or "") for k, t in enumerate(texts)}
    for w in words.values():
        counts.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    for r in substring_dedup.remove_repeats(docs, block_mb=block_mb).collect():
        w, gone = words[r["doc_id"]], set()
        for k in range(len(w) - 34):
            if counts[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
        assert r["rest"]["row"] == "r" and r["rest"]["n_words"] == r["doc_id"]


@pytest.mark.parametrize("block_mb", [2.0, 0.01])
def test_suffix_dedup(docs, texts, block_mb):
    want, seen = {}, set()
    for k, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        want[k] = (len(b), int(gone.sum()), len(re.findall("1+", "".join("01"[int(x)] for x in gone))), np.frombuffer(b, np.uint8)[~gone].tobytes())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_later(docs, block_mb=block_mb).collect()}
    assert got == want


def test_repeats_on_odd_rows(odd, none):
    assert substring_dedup.remove_repeats(none).count() == 0 == suffix_dedup.remove_later(none).count()
    assert sorted(r["n_words"] - r["n_removed"] for r in substring_dedup.remove_repeats(odd).collect()) == [0] * 6
    kept = suffix_dedup.remove_later(odd).collect()
    assert len(kept) == 6 and sorted(r["n_bytes"] == 0 or r["n_removed"] == 0 for r in kept) == [False] * 3 + [True] * 3


# decontamination


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_BYTES, 0])
def test_decontamination(spark, docs, texts, odd, none, limit, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", limit)
    items = [(1, " ".join(texts[0].split(" ")[20:40])), (2, "one TWO"), (10, "one two"), (3, None), (4, "---"), (5, "never seen words"), (6, texts[6][-200:]), (7, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans(decontamination.UPPER, decontamination.LOWER)
    words = lambda t: split.findall((t or "").translate(low))
    runs = collections.defaultdict(set)
    for k, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            runs[tuple(w[i : i + 10])].add(str(k))
    for r in decontamination.contaminated(docs, bench).collect():
        w, hit, found = words(texts[r["doc_id"]]), set(), set()
        for run, ids in runs.items():
            for i in range(len(w) - len(run) + 1):
                if tuple(w[i : i + len(run)]) == run:
                    hit.update(range(i, i + len(run)))
                    found |= ids
        near = {x for run, ids in runs.items() for i in range(max(1, len(w) - len(run) - 4)) if set(run) <= set(w[i : i + len(run) + 5]) for x in ids}
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"], r["n_near"]) == (len(w), len(hit), sorted(found), bool(hit), len(near))
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(odd, bench).count() == 6 == decontamination.clean(odd, bench).count()
    assert decontamination.clean(docs, bench.where("false")).count() == len(texts)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha x y z u v w beta"), (3, "beta alpha")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    index = decontamination.Index(docs, decontamination.windows(bench), near=1)
    assert {r["doc_id"] for r in index.matches().collect()} == {1, 3}
    assert {r["doc_id"] for r in index.phrases().collect()} == {1}


# URL filter


def test_url_rules(spark):
    cases = {"http://Example.ORG/es/1": ("example.org", "/es/1", "example.org/es/", "block"), "https://a.example.org/en/12?x=1": ("a.example.org", "/en/12", "example.org/en/1", "block"), "http://example.org/en/2#t": ("example.org", "/en/2", "org/", "allow"), "ftp://notexample.org": ("notexample.org", "", None, None), "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"), "//x.com/de/": ("", "", None, None), None: ("", "", None, None), "http://x.com?u=/de/": ("x.com", "", None, None), "http://com/de/": ("com", "/de/", "com/de/", "block"), "http://ÄB.org/": ("Äb.org", "/", "org/", "allow")}
    pages = spark.createDataFrame([(k, u, None, "clash") for k, u in enumerate(cases)], "page_id long, url string, html string, host string")
    for r in url_filter.judge(pages).collect():
        host, path, rule, verdict = list(cases.values())[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict) and r["verdict"] in ("allow", "block")
    assert url_filter.judge(pages.where("false")).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages.where("url is null")).collect()} == {"allow"}


def test_url_trees_learn(spark):
    rng = random.Random(3)
    rows = [(k, f"http://h{rng.randint(0, 9)}.com/{rng.choice(['fr', 'de'])}/" + ("?a=1&b=2&c=3" if rng.random() < 0.5 else "x")) for k in range(400)]
    rows = [(k, u.replace("/fr/", "/de/") if "?" in u else u.replace("/de/", "/fr/")) for k, u in rows]
    rows += [(1000 + k, f"http://h{k % 9}.net/q/" + ("?a=1&b=2&c=3" if k % 2 else "x")) for k in range(100)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 1000").collect()
    assert sum((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got) >= 95


# licences


def test_url_trees_on_held_out_labels(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    ruled = url_filter.judge(pages).where("rule is not null").count()
    out = url_filter.judge(pages, train_urls=ruled // 2).where("rule is not null")  # at least half of them are new to the trees
    assert out.where((F.col("block_probability") >= 0.5) == (F.col("verdict") == "block")).count() >= 0.9 * ruled > 20


def test_suffix_statistics(spark):
    rows = [(k, f"http://h{k}.{'com' if k % 3 else 'x%d' % k}/{'de' if k % 2 else 'fr'}/{k}") for k in range(40)] + [(None, None), (1, "http://h1.com/de/1"), (99, "http://a.com/" + "p/" * 20_000)]
    urls = url_filter.lexical(url_filter.ruled(url_filter.parsed(spark.createDataFrame(rows, "page_id long, url string"))))
    blocked = (F.col("rule_verdict") == "block").cast("double")
    whole, split = ({(r["page_id"], r["url"]): (r["suffix_urls"], r["suffix_blocked"]) for r in url_filter.with_suffixes(urls, blocked, most).collect()} for most in (1000, 4))
    assert whole == split and len(whole) == 42
    held = [(r["url"], r["rule_verdict"], r["suffix"]) for r in urls.collect()]
    for url, verdict, suffix in held:
        others = [v for u, v, s in held if s == suffix and v]
        if verdict:
            others.remove(verdict)
        assert [v[1] for k, v in whole.items() if k[1] == url] == [pytest.approx((others.count("block") + 1) / (len(others) + 2))]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"))
    assert out.count() == 43 and out.where("page_id is null").first()["host"] == ""


def test_license_scan(spark, none):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "Apache  license, APACHE-License"), (3, "permission to use, copy modify and or distribute this software for any purpose with or without fee is"), (4, None), (5, "the general public; license general public license"), (6, "licensed under " * 50 + "cc by nc 4.0")]
    out = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1]["labels"], out[1]["n_base"], out[1]["first_word"], out[1]["last_word"], out[1]["score"]) == ("mit", 1, 4, 4, 1.0)
    assert (out[2]["base_labels"], out[2]["n_base"], out[2]["first_word"], out[2]["last_word"]) == ("apache", 2, 0, 2)
    assert out[3]["labels"] == "isc" and 0.8 <= out[3]["score"] < 1 and out[3]["base_labels"] == ""
    assert (out[4]["n_words"], out[4]["labels"], out[4]["score"], out[4]["first_word"]) == (0, "", 0.0, None)
    assert (out[5]["base_labels"], out[5]["n_base"], out[5]["first_word"]) == ("gpl", 2, 1) and out[6]["labels"] == "cc-by-nc"
    assert license_scan.scan(none).count() == 0


def test_license_scan_keeps_every_match(spark):
    isc, bsd = license_scan.TEMPLATES["isc"].split(), license_scan.TEMPLATES["bsd"].split()
    mpl, cc0 = license_scan.TEMPLATES["mpl"], license_scan.TEMPLATES["cc0"].replace(" universal", "")
    rows = [(1, f"{mpl} {cc0}"), (2, " * " + " ".join(isc[:10]) + "\n * " + " ".join(isc[10:])), (3, "x " * 90 + " ".join(bsd[:5]) + "\n# " + " ".join(bsd[5:10]) + "\n# " + " ".join(bsd[10:]) + " y" * 90), (4, license_scan.TEMPLATES["gpl"]), (5, " ".join(isc[:9]) + " x" * 48 + " " + " ".join(isc[9:]))]
    out = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["labels"] == "cc0,mpl" and out[1]["shares"] == {"mpl": 1.0, "cc0": 0.9}
    assert (out[2]["labels"], out[2]["score"]) == ("isc", 1.0) and (out[3]["labels"], out[3]["score"]) == ("bsd", 1.0)
    assert out[4]["labels"] == "gpl" and out[4]["shares"] == {"gpl": 1.0, "agpl": 0.9, "lgpl": 0.9} and out[5]["labels"] == ""


def test_license_scan_on_odd_rows(spark, odd):
    rows = odd.unionByName(spark.createDataFrame([(BIG, "MIT License " + "word " * 100_000 + "apache\nlicense", None, None, None, None), (None, "mit license", None, None, None, None)] * 2, SCHEMA))
    out = license_scan.scan(rows).collect()
    assert len(out) == 10
    long = [r for r in out if r["doc_id"] == BIG]
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in long] == [(100_004, 2, 0, 100_002, "apache,mit")] * 2
    assert sum(r["doc_id"] is None and r["base_labels"] == "mit" for r in out) == 2


def test_license_blocks_equal_brute_force(monkeypatch):
    rng = random.Random(4)
    words = [f"t{k}" for k in range(14)]
    texts = {f"l{k}": " ".join(rng.sample(words, rng.randint(1, 9))) for k in range(12)}
    known = license_scan.Templates(texts, {w: rng.randint(0, 5) for w in words}, 0.7)
    monkeypatch.setattr(license_scan, "BLOCK", 6)
    for _ in range(300):
        found = [rng.choice([*words, "x", "y", "z"] if rng.random() < 0.5 else "xyz").encode() for _ in range(rng.randint(0, 40))]
        want: dict = {}
        for k in range(max(1, len(found) - 5)):
            for label, share in known.match(found[k : k + 6]):
                want[label] = max(share, want.get(label, 0))
        assert {label: share for label, (share, _) in known.scan(found).items()} == want


def test_prefix_filters_lose_nothing():
    rng = random.Random(2)
    words = [f"t{k}" for k in range(14)]
    texts = {f"l{k}": " ".join(rng.sample(words, rng.randint(1, 9))) for k in range(12)}
    known = license_scan.Templates(texts, {w: rng.randint(0, 5) for w in words}, 0.7)
    for _ in range(500):
        block = [rng.choice(words).encode() for _ in range(rng.randint(0, 14))]
        want = {(n, len(have) / len(t)) for n, text in texts.items() if (t := {x.encode() for x in text.split()}) and len(have := t & set(block)) >= math.ceil(0.7 * len(t) - 1e-9)}
        assert set(known.match(block)) == want


# HTML


def test_blocks():
    page = """<!doctype html><html><head><title>t</title></head><body class="sidebar-left"><nav>menu</nav><div class='ad x'>buy<div>more</div></div>
    <article><header>H</header><h1>A &amp; B</h1><p>one<br>two&nbsp;three <b>bold<p>next<script>var a="</p>";</script><!-- no --><aside>s</aside>
    <ul><li>i1<li>i2</ul><form>f</form><section class="comments">c</section>tail</article><footer>f</footer></body></html>"""
    assert html_extract.blocks(page) == (["A & B", "one two three bold", "next", "i1", "i2", "tail"], True)
    assert html_extract.blocks("") == ([], False) and html_extract.blocks("a < b &lt; <p>c") == (["a < b <", "c"], False)
    assert html_extract.blocks('<article><p>one<p class="ad">buy<p>real text<p>more</article>') == (["one", "real text", "more"], True)
    assert html_extract.blocks('<div><ul><li>a<li class="share">b</ul>c</div><p>d') == (["a", "c", "d"], False)
    assert html_extract.blocks("<main><p>x <span class=ad>y</span> z</p><div>t <b class=ad>u</main>v") == (["x z", "t"], True)
    assert html_extract.blocks("<article><table><tr><td class=ad>x<td>y<tr><td>z</table><div class=related-work>w</div></span></article>") == (["y", "z", "w"], True)
    assert html_extract.blocks("<article><h1 class=header>Title</h1><p>Let <math><mi>a</mi> = 1</math> be<h2 class=ad>buy</h2><div class=header>menu</div></article>") == (["Title", "Let a = 1 be"], True)
    assert html_extract.blocks("<p>x<div id=cookie-notice>y") == (["x"], False) and html_extract.blocks("<script>x") == ([], False)


@pytest.mark.parametrize(
    "page",
    [
        '<div class="page has-sidebar"><nav>n</nav><article><h1 class="entry-header">T</h1><section id=related-work>W</section></article></div>',
        '<article class="post share-enabled"><h1>T</h1><p>W</article>',
        '<article class="share"><h1>T</h1><p>W<section class=comments>c<article class=comment>d</article></section></article>',
        '<form><nav>n</nav><div class="menu sidebar">m<div class=ad>a</div><main class=comments><h1>T</h1><p>W</main></div></form><footer>f</footer>',
        '<main><div class="related"><article><h1>T</h1>W</article></div></main>',
    ],
)
def test_the_main_text_is_never_dropped(page):
    assert html_extract.blocks(page) == (["T", "W"], True)


def test_pages_without_blocks_go_to_the_suffix_array(spark):
    rows = [(k, f"http://h/{k}", f"<div class=menu><p>these words stand on every page here<p>{k} is own text</div><article></article>") for k in range(3)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == {k: f"{k} is own text" for k in range(3)}


def test_repeated_tokens():
    rng = np.random.default_rng(1)
    for _ in range(20):
        tokens, page = rng.integers(0, 3, 60), np.sort(rng.integers(0, 5, 60))
        want, run = np.zeros(60, bool), 4
        spots = [k for k in range(57) if page[k] == page[k + 3]]
        for a in spots:
            if any(page[b] != page[a] and (tokens[a : a + 4] == tokens[b : b + 4]).all() for b in spots):
                want[a : a + 4] = True
        assert (html_extract.repeated(tokens, page, run) == want).all()


def test_extract(spark):
    bar = "cookies are used on this site for all"
    rows = [(1, "http://h/1", f"<p>{bar}<p>first page text"), (2, "http://h/2", f"<p>{bar}<p>second page text"), (3, "http://g/1", f"<p>{bar}"), (4, None, None), (5, "u", ""), (6, "http://h/3", f"<article>{bar}</article>"), (7, "http://h/1", f"<p>{bar}<p>first page text")]
    pages = spark.createDataFrame([(*r, "x", [1]) for r in rows], "page_id long, url string, html string, text string, blocks array<int>")
    out = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert out == {1: "first page text", 2: "second page text", 3: bar, 4: "", 5: "", 6: bar, 7: "first page text"}
    assert html_extract.extract(pages.where("false")).count() == 0


def test_runs_repeat_over_the_parts_of_a_host(spark):
    rng = random.Random(5)
    rows = [(k, f"http://{'big' if k % 3 else 'other'}/{k}", f"<p>seen on just two pages {k // 6 % 20} it is<p>{prose(rng, 12, 10**6)}" + "<p>on all pages of every host alike") for k in range(120)]
    pages = spark.createDataFrame([*rows, *rows[:5]], "page_id long, url string, html string")
    whole, dealt = ([tuple(r) for r in html_extract.extract(pages, part_pages=n).orderBy("page_id").collect()] for n in (1000, 4))
    assert dealt == whole and not any("alike" in t or "just" in t for _, _, t in whole) and all(len(t.split()) >= 12 for _, _, t in whole)


def test_runs_of_article_pages_count(spark):
    """Pages with an article go through the suffix array too: what they hold beside it tells a run of other pages; their own text stays whole."""
    bar = "these words stand on every page here"
    rows = [(1, "http://h/1", f"<p>{bar}<article><p>an article of its own</article>"), (2, "http://h/2", f"<p>{bar}<p>no article but own text"), (3, "http://g/3", f"<p>{bar}<p>another host"), (4, "http://h/4", f"<article><p>{bar}<p>told again</article><p>beside it")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part_pages in (1000, 1):
        out = {r["page_id"]: (r["text"], r["n_repeated"]) for r in html_extract.judged(pages, part_pages=part_pages).collect()}
        assert out == {1: ("an article of its own", 7), 2: ("no article but own text", 7), 3: (f"{bar}\nanother host", 0), 4: (f"{bar}\ntold again", 7)}
    # no rows are settled before the array: the blocks of all pages are dealt by host
    plan = html_extract.extract(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "FlatMapCoGroupsInPandas" in plan


def test_prefixes_come_back_as_sent():
    rng = np.random.default_rng(2)
    for top, n in ((1 << 32, 50), (1 << 32, 5000), (1 << 17, 3000), (5, 4), (1 << 32, 0)):
        sent = np.unique(np.concatenate((rng.integers(0, top, n), [0, 65536, 131072, 2**32 - 1][: n % 7]))).astype(np.uint32)
        assert (html_extract._unpacked(html_extract._packed(sent)) == sent).all()


def test_articles_equal_their_markup(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", body)]
        assert found[r["page_id"]] == "\n".join(p for p in parts if p)


# language model


def test_base_scores(docs, odd, texts, none):
    low = str.maketrans(decontamination.UPPER, decontamination.LOWER)
    tokens = {k: [*WORD.findall((t or "").translate(low)), ""] for k, t in enumerate(texts)}
    out_of = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    counts = collections.Counter(w for k, ws in tokens.items() if not out_of[k] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for common in (100_000, 3):
        for r in lm_scoring.score(docs, packing.default_tokenizer(), common).collect():
            ws = tokens[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out_of[r["doc_id"]], len(ws), sum(counts[w] > 0 for w in ws), total)
            assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)) and r["score"] <= 0
    assert lm_scoring.score(none, packing.default_tokenizer()).count() == 0
    assert lm_scoring.score(odd, packing.default_tokenizer()).count() == 6


def test_attention_scores_and_learns():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 200, 6000)
    ids[1::2] = (ids[::2] * 3 + 1) % 200
    known = attention.vocabulary(np.bincount(ids, minlength=202), classes=16)
    flat, begins = attention.layout([known.place[ids]], known)
    weights = attention.Weights.initial(known)
    untaught = attention.Scorer(weights, known).score(flat, begins)[0]
    for _ in range(20):
        trainer = attention.Trainer(weights, known)
        trainer.run(flat, begins, batch=8)
        weights = trainer.w
    scorer, wide = attention.Scorer(weights, known), attention.WIDTH
    assert scorer.score(flat, begins)[0] > untaught + 0.1 * len(ids)
    flat, begins = attention.layout([known.place[ids[:n]] for n in (0, 1, attention.NEW, 80)], known)
    got = scorer.score(flat, begins)
    for n, found in zip((0, 1, attention.NEW, 80), got, strict=True):
        want, text = 0.0, known.place[ids[:n]]
        for t in range(n):
            low = t // attention.NEW * attention.NEW - attention.OVERLAP
            seq = [known.start if k <= 0 else text[k - 1] for k in range(low, t + 1)]
            x = weights.inner[seq, :wide] + weights.places[: len(seq), :wide]
            s = (x[-1] @ weights.query[:, :wide]) @ (x @ weights.key[:, :wide]).T / math.sqrt(wide)
            a = np.exp(s - s.max())
            h = np.append(x[-1] + a / a.sum() @ (x @ weights.value[:, :wide]), 1)
            c = known.class_of[text[t]]
            lo, hi = known.cut[c], known.cut[c + 1]
            for scores, k in ((weights.classes @ h, c), (weights.outer[lo:hi] @ h, text[t] - lo)):
                want += (scores[k] - np.log(np.exp(scores).sum())) / math.log(10)
        assert found == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_training_follows_the_gradient():
    rng = np.random.default_rng(1)
    known = attention.vocabulary(rng.integers(0, 50, 40), classes=5)
    flat, begins = attention.layout([rng.integers(0, 40, n).astype(np.int32) for n in (50, 7)], known)
    weights = attention.Weights.initial(known)
    weights.rows[:] += rng.standard_normal(weights.rows.shape).astype(np.float32) * 0.3
    trainer, moved = attention.Trainer(weights, known), np.zeros(weights.rows.shape)

    def note(at, g, used):
        moved[at, : g.shape[1]] += g

    trainer._move = note
    _, first, real = attention.windows(begins)
    trainer.step(flat, first, real)

    def loss(rows):
        return -attention.Scorer(attention.Weights(rows, known), known).score(flat, begins).sum() * math.log(10) / 57

    for name, n in attention.Weights.parts(known):
        at = getattr(weights, f"{name}_at")
        for _ in range(6):
            r, c = at + rng.integers(0, n), rng.integers(0, attention.WIDTH + (name in ("outer", "classes")))
            step = np.zeros(weights.rows.shape)
            step[r, c] = 1e-3
            assert (loss(weights.rows + step) - loss(weights.rows - step)) / 2e-3 == pytest.approx(moved[r, c], abs=2e-3)


def test_common_words_get_their_ids_once(texts):
    """Ids with and without a list of common words are equal, and common words are not sent through the merges again."""
    pieces = word_pieces(packing.default_tokenizer())
    words, codes, _ = split_words(pc.ascii_lower(pa.array(texts, pa.string())))
    common = words.take(pa.array(np.arange(0, len(words), 2))).cast(pa.binary())
    known = lm_scoring._common_ids(common, packing.default_tokenizer(), 7)
    places = pc.fill_null(pc.index_in(words.cast(pa.binary()), common), -1).to_numpy()
    asked = []

    class Counted:
        def of_words(self, some):
            asked.append(len(some))
            return pieces.of_words(some)

    ids, offsets, at = lm_scoring._ids(Counted(), words, places, known)
    got, want = gather(ids, offsets, at[codes]), gather(*pieces.of_words(words), codes)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and asked == [len(words) // 2]


def test_scores_do_not_depend_on_partitions(docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK", attention.NEW * 2)
    monkeypatch.setattr(lm_scoring, "FAN", 3)
    known, tokens = lm_scoring.vocabulary(lm_scoring.word_counts(docs), packing.default_tokenizer())
    pieces = word_pieces(packing.default_tokenizer())
    rows = [(r["doc_id"], bytearray(pieces.of_texts(pa.array([r["text"]], pa.string()))[0].astype("<u2").tobytes())) for r in docs.collect()]
    read = docs.sparkSession.createDataFrame(rows, "doc_id long, ids binary")
    made = [lm_scoring.fit(read.repartition(n, "doc_id"), known, tokens, shard=1000) for n in (1, 6)]
    assert (made[0] == made[1]).all() and not (made[0] == attention.Weights.initial(known).rows).all()


def test_training_helps_on_held_out_texts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def held_out():
        return lm_scoring.score(docs, packing.default_tokenizer()).where("held_out").agg(F.sum("score")).first()[0]

    taught = held_out()
    monkeypatch.setattr(lm_scoring, "fit", lambda training, known, tokens: attention.Weights.initial(known).rows)
    assert taught > 0.8 * held_out()


# Jaccard join


def brute_join(texts):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall(t or "")
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links, up = collections.Counter(), {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {k: (links[k], root(k)) for k in sets}


def test_jaccard_join(docs, texts, odd, none):
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard_join.join(docs).collect()}
    assert got == brute_join(dict(enumerate(texts)))
    assert jaccard_join.join(none).count() == 0
    rows = jaccard_join.join(odd).collect()
    assert sorted(r["n_links"] for r in rows) == [0, 1, 1, 2, 2, 2]
    assert jaccard_join.keep_one(odd).count() == 3
    named = docs.select("doc_id", "text", *[F.lit(k).alias(c) for k, c in enumerate(("row", "__row", "doc", "class", "a.b"))])
    assert {tuple(r)[2:] for r in jaccard_join.keep_one(named).collect()} == {(0, 1, 2, 3, 4)} and jaccard_join.keep_one(named).columns == named.columns
    kept = {r["doc_id"] for r in jaccard_join.keep_one(docs).collect()}
    assert kept == {k for k, (_, c) in got.items() if c == k} and jaccard_join.keep_one(docs).columns == docs.columns


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "CLUSTER_BLOCK", 8)
    rng = random.Random(11)
    base = prose(rng, 150).split(" ")
    texts = {}
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(150)] = f"new{k}"
        texts[k] = " ".join(w)
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard_join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_join(texts)


def test_pruning_table():
    least = jaccard_join.least_matches(0.8, 1e-6)
    assert len(least) == 5 and list(least) == sorted(least)
    # the chance that a pair at the threshold is dropped anywhere
    n, m = jaccard_join.STEP, least[0]
    assert sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m)) < 1e-4


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    up = {}

    def root(k):
        up.setdefault(k, k)
        while up[k] != k:
            k = up[k]
        return k

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: root(k) for a, b in edges if a != b for k in (a, b)}




def test_sample_by_hash_takes_the_lowest(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    want = [r["k"] for r in rows.orderBy(F.xxhash64("k"), "k").limit(20).collect()]
    assert [r["k"] for r in least_hashes(rows, 20, "k").collect()] == want
    assert least_hashes(rows, 900, "k").count() == 900 and least_hashes(rows.where("false"), 5, "k").count() == 0


def test_commonest_words_are_bounded(spark):
    counts = spark.createDataFrame([(b"w%d" % k, 1 + k % 50) for k in range(500)], "word binary, n long")
    got = lm_scoring._commonest(counts, 100).collect()
    assert 0 < len(got) <= 100 and min(r["n"] for r in got) > 40
    assert lm_scoring._commonest(counts, 5).count() == 0 == lm_scoring._commonest(counts.where("false"), 5).count()


def test_every_token_is_trained_once(monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK", attention.NEW * 2)
    words = [" ".join(f"w{k * k % 97} tree" for k in range(n)) for n in (0, 1, 9, 40, 700)]
    tokenizer, met = packing.default_tokenizer(), []
    known = attention.vocabulary(np.zeros(word_pieces(tokenizer).vocabulary + 1, dtype=np.int64))
    ids, offsets = word_pieces(tokenizer).of_texts(pa.array(words))
    batch = pa.RecordBatch.from_arrays([pa.array([ids[a:b].astype(lm_scoring.kind(known.size)).tobytes() for a, b in itertools.pairwise(offsets)], pa.binary())], names=["ids"])
    texts = lm_scoring._places(batch, known)

    class Told:
        value = known

    class Common:
        value = attention.Weights.initial(known).rows

    monkeypatch.setattr(attention.Trainer, "step", lambda self, flat, first, real: met.append(attention._take(flat, first, real)))
    rows = pa.Table.from_batches(lm_scoring._chunks(Told, 3)(iter([batch]))).to_pandas()
    for _, shard in rows.groupby("shard"):
        lm_scoring._train(Told, Common)(shard)
    got = collections.Counter()
    for inputs, some, targets in met:
        for k, target in zip(some.tolist(), targets.tolist(), strict=True):
            got[(*inputs[k // attention.NEW, : attention.OVERLAP + k % attention.NEW + 1].tolist(), target)] += 1
    want = collections.Counter()
    for text in texts:
        for t in range(len(text)):
            low = t // attention.NEW * attention.NEW - attention.OVERLAP
            want[(*[known.start if k <= 0 else text[k - 1] for k in range(low, t + 1)], text[t])] += 1
    assert got == want and sum(got.values()) > 1400
