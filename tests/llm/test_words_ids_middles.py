"""Spelling variants, token files and fill-in-middle against brute force, on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import bytepieces, fim, spelling_variants, token_files
from fathomline.llm.bytepieces import BytePieces, byte_pieces

SCHEMA = "doc_id long, text string, source string, word string, n long, rank long, ids string, output string, form string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def rows(texts, ids=None):
    return [(k if ids is None else ids[k], t, None if k % 3 == 0 else "s", "w", 1, 2, "i", "o", "f") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcÀé×ÿ") for _ in range(rng.randint(4, 8))) for _ in range(150)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    long = ["ab" * n for n in (31, 32, 33, 34, 150)] + ["ab" * 32 + "b", "ab" * 31 + "a", "ab" * 149 + "a", "ab" * 149 + "cab"]
    odd = ["", None, "\n", "\n\n a", "one\ntwo", "one\ntwo\n", "has <P> inside\nx", "<S>", "a<M>b\n", "x" * 3000, "İ ΣΑΣ ſ ß nbsp　wide  em\ttab\r\nend  ", "don't we'll 's 'tis dogs' ’s", "<|endoftext|> and <|endoftext|>x  <|endoftext|>", "слово слово日本語 テスト 🎉 🎉🎉 123 4.5e6", "  lead   gaps  ", "same same", "same same"]
    return prose + [" ".join([w] * 3) for w in long] + odd + ["\n".join(rng.choice(words) for _ in range(4000))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows, a null row."""
    return spark.createDataFrame([*rows(["hello wörld\nb\n"] * 7, [None, None, 3, 3, 3, 4, 4]), (3, "other words here", None, None, None, None, None, None, None), (None,) * 9], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# spelling variants


def counted(pairs, noise=97):
    out = collections.Counter()
    for doc_id, text in pairs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                out[run] += 1
    return out


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(words):
    by_length, out = collections.defaultdict(list), {}
    for w in words:
        by_length[len(w)].append(w)
    for w, n in words.items():
        around = [o for k in (-1, 0, 1) for o in by_length[len(w) + k] if near(w, o)]
        best = min(around, key=lambda o: (-words[o], o), default=None)
        out[w] = (n, len(around), best if best is not None and words[best] >= 2 * n else None)
    for w in words:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w] = (*out[w], words.get(out[w][2]), root)
    return out


def test_words_of_whole_texts(spark, docs, texts, odd, none):
    want = counted(enumerate(texts))
    assert dict(spelling_variants.count_words(docs).collect()) == want
    assert {tuple(r) for r in spelling_variants.count_words(docs, noise=1).where("n > 20").collect()} == {(w, n) for w, n in counted(enumerate(texts), 1).items() if n > 20}
    assert dict(spelling_variants.count_words(odd).collect()) == counted((r["doc_id"], r["text"]) for r in odd.collect())
    assert spelling_variants.count_words(none).count() == 0


def test_forms_equal_all_pairs(spark, docs, texts, none):
    words = {w: n for w, n in counted(enumerate(texts)).items() if n >= 3}
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling_variants.group_variants(spelling_variants.vocabulary(docs)).collect()}
    assert got == grouped(words)
    assert any(len(w) >= 64 and v[1] for w, v in got.items()) and any(v[2] for v in got.values())
    assert spelling_variants.group_variants(spelling_variants.vocabulary(none)).count() == 0
    assert spelling_variants.group_variants(docs.selectExpr("cast(null as string) word", "n")).count() == 0


def test_dense_words_and_paths(spark):
    """Every word over two letters is near many; counts that double make paths of several forms."""
    words = {"".join("ab"[k >> b & 1] for b in range(6)): 1 + k % 7 for k in range(64)} | {"zzzzz" + "y" * k: 3 << k for k in range(9)} | {"q" * k: 5 for k in (62, 63, 64, 65, 66)}
    rng = random.Random(3)
    words |= {"".join(rng.choice("mné") for _ in range(size)): rng.randint(1, 9) for size in (5, 6, 7) for _ in range(80)}
    base = "".join(rng.choice("mné") for _ in range(70))
    words |= {base: 9, base[1:]: 2, base[:40] + "x" + base[41:]: 4, base[:69]: 1, base + "n": 3}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling_variants.group_variants(frame).collect()}
    assert got == grouped(words)
    assert got["zzzzz"][4] == "zzzzz" + "y" * 8
    pairs = [tuple(r) for r in spelling_variants.neighbours(frame).collect()]
    assert sorted(pairs) == sorted((a, b) for a in words for b in words if a != b and near(a, b))


# token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(0, 70_000), max_size=70))
def test_numbers_come_back(numbers):
    control, data = token_files.encode(np.array(numbers, np.uint32))
    assert token_files.decode(control, data, len(numbers)).tolist() == numbers
    assert len(control) == -(-len(numbers) // 4) and len(data) == sum(max(1, (n.bit_length() + 7) // 8) for n in numbers)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab É×.'!?<|>\n\t\r \u0085 　’жЖ中🎉1s"), max_size=12) | st.text(max_size=6), max_size=3))
def test_ids_of_any_text(texts):
    pieces = byte_pieces(token_files.default_tokenizer())
    ids, offsets = pieces.of_texts(pa.array(texts, pa.string()))
    want = [pieces.model.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want
    counts = collections.Counter(i for x in want for i in x)
    got = pieces.counts(pa.array(texts, pa.string()))
    assert {k: n for k, n in enumerate(got.tolist()) if n} == counts


def test_remembered_chunks_do_not_change_ids(texts, monkeypatch):
    """Whatever is remembered, full or not, ids are those of a fresh worker."""
    path = token_files.default_tokenizer()
    column = pa.array([t or "" for t in texts], pa.string())
    want = BytePieces(path).of_texts(column)
    for most in (0, 7, 300, 1 << 17):
        monkeypatch.setattr(bytepieces, "REMEMBERED", most)
        pieces = BytePieces(path)
        for lo in range(0, len(texts), 5):
            pieces.of_texts(column.slice(lo, 5))
            assert len(pieces.held[0]) <= max(most, len(bytepieces.split_chunks(column.slice(lo, 5))[0])) and len(pieces.held[2]) == len(pieces.held[0]) + 1
        got = pieces.of_texts(column)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def wanted(pairs):
    """(doc_id, start, ids) in ascending order of doc_id, null first; pairs without repeated ids."""
    model, start, out = byte_pieces(token_files.default_tokenizer()).model, 0, []
    for doc_id, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, ids))
        start += len(ids)
    return out


def read(frame):
    return [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"]) for r in frame.orderBy("start").collect()]


def test_files_hold_all_ids_in_order(spark, docs, texts, none, tmp_path):
    want = [(*x, len(x[2])) for x in wanted(list(enumerate(texts)))]
    for k, size in enumerate((1 << 30, 1 << 13)):  # one shard, many
        path = str(tmp_path / f"ids{k}")
        token_files.write_ids(docs, path, token_files.default_tokenizer(), shard_bytes=size)
        assert read(token_files.read_ids(spark, path)) == want
    blocks = spark.read.parquet(path + "/ids")
    assert blocks.select("shard").distinct().count() > 3
    counts = collections.Counter(i for _, _, ids, _ in want for i in ids)
    ranks = [tuple(r) for r in spark.read.parquet(path + "/ranks").orderBy("rank").collect()]
    assert ranks == [(k, i, n) for k, (i, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))]
    path = str(tmp_path / "none")
    token_files.write_ids(none, path, token_files.default_tokenizer())
    assert token_files.read_ids(spark, path).count() == 0


def test_blocks_end_at_documents(spark, docs, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 300)
    path = str(tmp_path / "ids")
    token_files.write_ids(docs, path, token_files.default_tokenizer())
    assert read(token_files.read_ids(spark, path)) == [(*x, len(x[2])) for x in wanted(list(enumerate(texts)))]
    assert spark.read.parquet(path + "/ids").count() > 10


def test_texts_get_their_ids_once(texts, tmp_path, monkeypatch):
    """Each slice of text meets the tokenizer in one pass, whatever the ranks wait for."""
    met, of_texts = tmp_path / "met", BytePieces.of_texts

    def counted(self, column):
        with open(met, "a") as file:
            file.write(f"{len(column)}\n")
        return of_texts(self, column)

    monkeypatch.setattr(BytePieces, "of_texts", counted)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t or "" for t in texts], pa.string())], names=["doc_id", "text"])
    monkeypatch.setattr(token_files, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("At", (), {"partitionId": lambda self: 0})())}))
    monkeypatch.setattr(token_files, "BLOCK", 300)
    blocks = list(token_files._encoded(token_files.default_tokenizer(), 2)(iter([batch])))
    assert sum(map(int, met.read_text().split())) == len(texts) and len(blocks) > 10
    # a block's own ranks with its ids by rank give its documents' ids, and its counts are theirs
    flat, times = [], collections.Counter()
    for b in blocks:
        row = b.to_pylist()[0]
        ids = np.frombuffer(row["met"], "<u4")
        flat += ids[token_files.decode(row["control"], row["data"], sum(row["sizes"]))].tolist()
        times.update(dict(zip(ids.tolist(), np.frombuffer(row["times"], "<i8").tolist(), strict=True)))
    want = [i for _, _, ids in wanted(list(enumerate(texts))) for i in ids]
    assert flat == want and times == collections.Counter(want)


def test_repeated_and_null_ids_in_files(spark, odd, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_ids(odd, path, token_files.default_tokenizer(), shard_bytes=64)
    got = read(token_files.read_ids(spark, path))
    assert [x[0] for x in got] == [None] * 3 + [3] * 4 + [4] * 2
    assert [x[1] for x in got] == [sum(y[3] for y in got[:k]) for k in range(len(got))]
    assert sorted((x[0] or -1, x[2]) for x in got) == sorted((r["doc_id"] or -1, wanted([(0, r["text"])])[0][2]) for r in odd.collect())


# fill-in-middle


def turned(doc_id, text):
    text = text or ""
    lines = re.findall("[^\n]*\n|[^\n]+", text)
    n, digest = len(lines), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middles_equal_python_and_come_back(docs, texts, odd, none):
    for frame in (docs, odd):
        given_rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
        got = fim.restore(fim.transform(frame)).collect()
        assert sorted(map(str, [(r["doc_id"], *r[1:6]) for r in got])) == sorted(map(str, [(i, *turned(i, t)) for i, t in given_rows]))
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["restored"]) for r in got) == sorted((i is None, i or 0, t or "") for i, t in given_rows)
    assert {r["form"] for r in fim.transform(docs).collect()} == {"plain", "psm", "spm"}
    assert {r["form"] for r in fim.transform(docs, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.transform(docs, spm_rate=0).collect()} == {"plain", "psm"}
    assert fim.restore(fim.transform(none)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("a\n\r<PSM>é"), max_size=20), max_size=5))
def test_lines_are_the_pattern(texts):
    assert fim.split_lines(pa.array(texts, pa.string())).to_pylist() == [re.findall("[^\n]*\n|[^\n]+", t) for t in texts]
