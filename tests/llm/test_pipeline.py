import pathlib
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fathomline.llm.queries import ORACLES, QUERIES


def test_eleven_queries():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    plain = lambda rows: sorted((tuple("null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)
    assert sorted(names) == columns
    assert plain(tuple(r) for r in frame.select(*columns).collect()) == plain(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns and 0 < docs.count() <= n
            n = docs.count()
    assert docs.select("doc_id").distinct().count() == n


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and user columns that bear the operators' names."""
    text = " ".join(f"word{k % 97} and{k}" for k in range(60))
    other = " ".join(f"other{k % 89} than{k}" for k in range(40_000))
    rows = [(1, text, "en", "s", 5, "kept", "rest", 1.5), (1, text, "en", "s", 5, "kept", "rest", 1.5), (None, text + " more", None, None, None, None, None, None), (2, None, None, None, None, "x", None, 2.0), (3, "", "en", "s", 0, None, "r", None), (9007199254740993, other, None, "s", None, "y", "z", 0.0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, rest string, n_words double"
    for name, frame in (("odd", spark.createDataFrame(rows, schema)), ("none", spark.createDataFrame([], schema))):
        docs = frame
        for stage, f in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{stage}")
            f(spark, docs, sf).write.parquet(path)
            docs = spark.read.parquet(path)
            if stage != "pack":
                assert docs.columns == frame.columns
                held = {(r["doc_id"], r["kept"], r["rest"], r["n_words"]) for r in docs.collect()}
                assert held <= {(r[0], r[5], r[6], r[7]) for r in rows}
        ids = [r["doc_id"] for r in docs.select("doc_id").distinct().collect()]
        assert sorted(ids) == ([1, 9007199254740993] if name == "odd" else [])


def test_packing_holds_little_beside_its_batch():
    """A worker's memory over ids of 16 MB of text: what a pass over the batches' slices adds at most."""
    code = """
import pathlib, re, threading, time
import pyarrow as pa
from fathomline.llm import packing
from fathomline.llm.text import release, slices
from fathomline.llm.wordpieces import word_pieces
held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", pathlib.Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"word{chr(97 + (k * j) % 26)} and{chr(97 + k % 26)}" for j in range(120)) for k in range(10_000)]})
pieces = word_pieces(packing.default_tokenizer())
release()
before, most, on = held(), [0.0], [True]
def watch():
    while on[0]:
        most[0] = max(most[0], held())
        time.sleep(0.002)
thread = threading.Thread(target=watch)
thread.start()
for piece in slices(iter([batch]), "text", packing.SLICE):
    pieces.of_texts(piece.column("text"))
on[0] = False
thread.join()
print(most[0] - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120, cwd=pathlib.Path(corpus_pipeline.__file__).parent)
    assert float(out.stdout) < 50
