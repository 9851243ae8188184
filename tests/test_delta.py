"""Updates against full rebuilds, over random edits."""

import random

from pyspark.sql import functions as F

from corvane.operators import delta
from corvane.sources.snapshots import Store

SCHEMA = "path string, lang string, text string"
TABLES = ("files", "chunks", "symbols", "calls", "imports", "resolutions")


def content(rng, names):
    a, b = rng.choice(names), rng.choice(names)
    return rng.choice([
        ("py", "python", f"from {a} import {b}\nimport pkg.{b}\ndef {a}():\n    {b}()\n"), ("nim", "nim", f"import {a}\nproc {b}() =\n  {a}()\n"), ("java", "java", f"import pkg.{a};\nimport pkg.*;\nclass {b} {{ void {a}() {{ {b}(); }} }}\n"),
        ("go", "go", f'import "ex.io/{a}"\nfunc {b}() {{ {a}() }}\n'), ("rs", "rust", f"use crate::{a}::{b};\nfn {b}() {{ {a}(); }}\n"), ("f90", "fortran", f"subroutine {a}\n  use {b}\nend subroutine\n"), ("tf", "hcl", f'module "{a}" {{\n  source = "./{b}"\n}}\n'),
    ])


def test_random_edits_equal_full_rebuilds(spark, tmp_path):
    rng = random.Random(11)
    names = [f"n{i}" for i in range(6)]
    dirs = ["", "pkg/", "src/", "src/main/java/pkg/", "n1/", "n2/"]
    manifests = spark.createDataFrame([("", "ex.io")], "dir string, module string")
    store, tree = Store(spark, str(tmp_path / "s")), {}
    for step in range(3):
        for _ in range(40 if step == 0 else 8):
            ext, lang, text = content(rng, names)
            tree[f"{rng.choice(dirs)}{rng.choice(names)}.{ext}"] = (lang, text)
        for path in rng.sample(sorted(tree), 6 if step else 0):
            del tree[path]
        seen = spark.createDataFrame([(p, *v) for p, v in tree.items()], SCHEMA).withColumn("hash", F.md5("text"))
        before = store.open_or_init()
        now, stats = delta.update(store, seen, 3, 1, manifests=manifests)
        full, _ = delta.update(Store(spark, str(tmp_path / f"full{step}")), seen, 3, 1, manifests=manifests)
        for t in TABLES:
            rows = [sorted(map(repr, s.read(t).select(sorted(s.read(t).columns)).collect())) for s in (now, full)]
            assert rows[0] == rows[1], (step, t)
        s = stats.first()
        assert s.scanned == len(tree) and s.resolved == full.read("resolutions").count() and s.indexed + s.skipped == s.scanned
        if step == 1:  # vectors follow their chunks
            vectors = now.read("chunks").select("chunk_id", F.lit("m").alias("model"))
            store.commit(now, replace={"embeddings": vectors})
        if step > 1:
            left = store.open().read("embeddings")
            assert left.count() == before.read("embeddings").join(now.read("chunks"), "chunk_id", "left_semi").count() > 0


def test_an_empty_tree(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA).withColumn("hash", F.md5("text"))
    snapshot, stats = delta.update(Store(spark, str(tmp_path / "s")), none)
    assert stats.first().scanned == 0 and all(snapshot.read(t).count() == 0 for t in TABLES)
