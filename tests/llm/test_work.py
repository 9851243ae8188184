"""What the operators leave on disk and how much work they do, besides their results."""

import glob
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corvane.llm import line_dedup, toxicity
from corvane.llm.common import connected_components, cut


def shuffle_files(spark):
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    return sum(len(glob.glob(f"{d}/*/shuffle_*")) for d in dirs)


def test_shuffles_behind_a_cut_leave_no_files(spark):
    before, held = shuffle_files(spark), []
    for i in range(3):
        df = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s"))
        held += [df, cut(df)]
    end = time.time() + 20
    while shuffle_files(spark) > before and time.time() < end:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert [x.count() for x in held] == [100] * 6


def test_a_small_graph_takes_few_jobs(spark, monkeypatch):
    edges = cut(spark.createDataFrame([(i * 7919 % 1000, (i + 1) * 7919 % 1000) for i in range(300)] + [(2000, 2001), (5, 5)], "a long, b long"))
    spark.sparkContext.setJobGroup("small graph", "")
    small = {r.node: r.root for r in connected_components(edges).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("small graph")
    spark.sparkContext.setJobGroup("", "")
    monkeypatch.setattr("corvane.llm.common.EDGES_A_TASK", 7)  # many forests, then rounds over them
    assert {r.node: r.root for r in connected_components(edges).collect()} == small
    nodes = {i * 7919 % 1000 for i in range(301)}
    assert small == {x: min(nodes) for x in nodes} | {2000: 2000, 2001: 2000}
    assert len(jobs) <= 10


def test_lines_of_a_kind_are_hashed_together(monkeypatch):
    lines = [" ".join(f"w{i}x{j}" for j in range(24)).encode() for i in range(500)]
    keys = [[{"key": k, "lengths": 255} for k in line_dedup.key_list(x, x.split())] for x in lines]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(lines, pa.binary()), pa.array(keys, line_dedup._SHARED)], names=["lid", "norm", "keys"])
    calls, mix = [], line_dedup._mix
    monkeypatch.setattr(line_dedup, "_mix", lambda x: calls.append(np.size(x)) or mix(x))
    out = pa.Table.from_batches(line_dedup._windows(2)(iter([batch])))
    assert len(set(out.column("lid").to_pylist())) == 500 and len(calls) < 500
    assert out.num_rows == 500  # a row per line, not per key


def near_clusters():
    """Lines in clusters of 2 to 40 near ones, a word or two apart, as rows of a document each."""
    rows = []
    for c, size in enumerate((2, 3, 5, 9, 40)):
        words = [f"c{c}w{j}" for j in range(24)]
        for i in range(size):
            w = list(words)
            w[(7 * i) % 24] = f"x{i}"
            if i % 3 == 1:
                del w[(5 * i) % 24]
            rows.append((c * 100 + i, " ".join(w)))
    return rows


def test_few_lines_of_a_key_are_compared_without_deletions(spark, monkeypatch):
    rows = near_clusters()
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string"))
    split = [(i, t.encode().split()) for i, t in rows]
    expected = {b for b, y in split if any(a < b and line_dedup.near(x, y, line_dedup.bound(max(len(x), len(y)))) for a, x in split)}
    assert len(expected) > 20

    def jobs_and_gone(name, few):
        monkeypatch.setattr(line_dedup, "FEW", few, raising=False)
        spark.sparkContext.setJobGroup(name, "")
        gone = {r.doc_id for r in line_dedup.line_decisions(docs).collect() if r.n_near}
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), gone

    (all_few, a), (some_few, b), (none_few, c) = (jobs_and_gone(f"few {n}", n) for n in (1000, 6, 1))
    assert a == b == c == expected
    assert all_few < some_few and all_few < none_few


def test_an_atom_is_folded_once_a_text(monkeypatch):
    calls, fold = [], toxicity.fold
    monkeypatch.setattr(toxicity, "fold", lambda x: calls.append(x) or fold(x))
    gate, long_atom = toxicity.Gate(["grumbol"]), "ab" * 40
    calls.clear()
    text = f"{long_atom} 77 gr-um bol " * 50
    assert [text[s:e] for s, e in gate.spans(text)] == ["gr-um bol"] * 50
    assert calls.count(long_atom) == 1
    scorer = toxicity.Scorer({"grumbol": 2.0, "grum~": 1.5, "grumbl~": 1.7}, np.zeros(4))
    for w in ("grumbol", "grumbols", "grumbling", "grum", "gru", ""):
        assert scorer.weight(w) == max(scorer.weights.get(t, 0.0) for t in toxicity.terms(w))
