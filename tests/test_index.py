"""The index of files brought up to date equals one made anew, and rewrites only what changed."""

import os

from fathomline.sources import index
from fathomline.sources.syntax import syntax_rows


def written(path):
    return {d: max(os.stat(os.path.join(path, "rows", d, f)).st_mtime_ns for f in os.listdir(os.path.join(path, "rows", d))) for d in os.listdir(os.path.join(path, "rows")) if d.startswith("part=")}


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_updates_rewrite_few_partitions(spark, tmp_path):
    path = str(tmp_path / "index")
    text = lambda k, v=0: f"import os\ndef f{k}(x):\n    return os.path.join(x, '{v}')\n" + "y = f(1)\n" * (v * 3)
    files = {f"m{k}.py": text(k) for k in range(200)} | {"broken.py": "def (", "empty.py": None}
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, content string")
    index.create_index(frame(files | {None: "x"}), syntax_rows, path, parts=64)
    assert same(index.read_index(spark, path), syntax_rows(frame(files)))
    before = written(path)
    changed = {"m7.py": text(7, 2), "m9.py": text(9), "new.py": text(1, 1), "broken.py": "ok = 1\n"}
    told = {r["path"]: r["state"] for r in index.update_index(spark, frame(changed), syntax_rows, path, frame({"m3.py": "", "never.py": ""}).select("path"), parts=64).collect()}
    assert told == {"m7.py": "changed", "m9.py": "same", "new.py": "changed", "broken.py": "changed", "m3.py": "removed", "never.py": "removed"}
    files |= changed
    del files["m3.py"]
    assert same(index.read_index(spark, path), syntax_rows(frame(files)))
    after = written(path)
    assert 1 <= sum(after[d] != before.get(d) for d in after) <= 5 and len(before) > 40
    # nothing changes, nothing is written; all of a partition may go
    index.update_index(spark, frame({"m7.py": text(7, 2)}), syntax_rows, path, parts=64)
    assert written(path) == after
    index.update_index(spark, frame({}), syntax_rows, path, frame(files).select("path"), parts=64)
    assert index.read_index(spark, path).count() == 0
    index.update_index(spark, frame({"m1.py": text(1)}), syntax_rows, path, parts=64)
    assert same(index.read_index(spark, path), syntax_rows(frame({"m1.py": text(1)})))
