"""Operators 11 to 13 beside brute force, on odd rows and on empty tables."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import divergence, hard_negatives, mixing

EMBED = "vec_id long, embedding array<float>, label int, list int"


def brute_negatives(rows, k=5):
    rows = {i: (np.floor(256 * np.array(v, np.float64)).astype(int), y) for i, v, y in rows}
    out = []
    for a, (q, y) in rows.items():
        if a % 100:
            continue
        s = [(int(q @ v), i, z) for i, (v, z) in rows.items() if i != a and len(v) == len(q)]
        s.sort(key=lambda x: (-x[0], x[1]))
        for p, pid, _ in [x for x in s if x[2] == y][:k]:
            out += [(a, pid, r, n, p, m) for r, (m, n, _) in enumerate([x for x in s if x[2] != y and 80 * p <= 100 * x[0] <= 100 * p][:k], 1)]
    return sorted(out)


def test_hard_negatives_by_rounds_equal_brute_force(spark):
    """Clustered vectors with copies, ties and negative scores: few lists are visited, and none that matters is missed."""
    rng = np.random.default_rng(3)
    mids = rng.normal(size=(12, 6)) * 2
    rows = [(i, (mids[i % 12] + rng.normal(size=6) * 0.05).astype(np.float32).tolist(), int(rng.integers(4))) for i in range(900)]
    rows += [(900 + i, rows[0][1], i % 4) for i in range(120)] + [(1100 + i, [0.5], i % 2) for i in range(9)]
    df = spark.createDataFrame([(*r, 7) for r in rows], EMBED)
    for lists, rounds in ((12, (1, 2)), (40, (1, 8))):
        got = hard_negatives.mine(df, "vec_id", "embedding", F.col("label"), F.col("id") % 100 == 0, lists=lists, rounds=rounds)
        assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_bounds_leave_far_lists_out(spark):
    mids = np.eye(8) * 100
    rows = [(i, (mids[i % 8] + 0.001 * (i // 8)).tolist(), i % 8 * 10 + i // 8 % 2) for i in range(160)]
    index = hard_negatives.prepare(spark.createDataFrame([(*r, 0) for r in rows], EMBED), "vec_id", "embedding", F.col("label"))
    c = hard_negatives.fit(index, 8)
    placed = hard_negatives.invert(index, c)
    radii = {r["list"]: r["r"] for r in placed.groupBy("list").agg(F.max("far").alias("r")).collect()}
    visits = hard_negatives._visits(c, radii, None)
    one = placed.where("id = 0").select(F.col("q").alias("q"), F.array(F.lit(1).cast("long")).alias("lo"), F.array(F.lit(2**62)).alias("hi"), F.lit(0).alias("d"))
    many = one.withColumn("lo", F.array(F.lit(10**8).cast("long")))
    assert len(many.select(visits("q", "lo", "hi", "d").alias("v")).first().v.lists) == 1


def test_hard_negatives_of_odd_rows(spark):
    odd = [(0, [1.0, 0.0], 1, 1), (None, [1.0, 0.0], 1, 1), (1, None, 1, 1), (2, [1.0, None], 1, 1), (3, [float("nan"), 1.0], 2, 1), (4, [float("inf"), 1.0], 2, 1), (5, [1.0, 0.0], None, 1), (6, [], 1, 1), (7, [0.9, 0.0], 2, 1), (7, [0.9, 0.0], 2, 1), (8, [0.95, 0.0], 1, 1), (8, [0.95, 0.0], 1, 1), (100, [], 1, 1), (101, [], 3, 1)]
    mine = lambda df: sorted(map(tuple, hard_negatives.mine(df, "vec_id", "embedding", F.col("label"), F.col("id") % 100 == 0).collect()))
    assert mine(spark.createDataFrame(odd, EMBED)) == [(0, 8, 1, 7, 243 * 256, 230 * 256), (100, 6, 1, 101, 0, 0)]
    assert mine(spark.createDataFrame([], EMBED)) == []
    assert mine(spark.createDataFrame(odd[1:6], EMBED)) == []


def test_scores_beyond_doubles_are_exact():
    x, y = np.array([[2**30, 3]]), np.array([[2**30, 5], [-(2**30), 7]])
    assert hard_negatives.products(x, y).tolist() == [[2**60 + 15, 21 - 2**60]]
    assert hard_negatives.best_in_windows(np.array([5, 7, 7, 3]), np.array([1, 2, 4, 9]), [4, 0], [2**63 - 1, 5], 2) == [(0, 2, 7), (0, 4, 7), (1, 1, 5), (1, 9, 3)]


def poured(sizes, weights=(5, 2, 1)):
    """Targets by dealing the excess anew until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w, left, out = {s: weights[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in out]
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= 2 * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(out.values())


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=3).filter(lambda s: "\0" not in s and not any("\ud800" <= c <= "\udfff" for c in s))), st.integers(0, 5000), min_size=1, max_size=9))
def test_targets_equal_pouring(spark, sizes):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = poured(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_repeats_whole_rows(spark):
    odd = [(1, "a b c", "x", 1), (1, "a b c", "x", 1), (2, "", "x", 2), (None, None, None, None), (3, "\x85   z", "", 3), (4, "w " * 50_000, "y", 4)] + [(10 + i, "one two three", "x", 0) for i in range(400)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, source string, key long")
    plan = mixing.plan(docs).collect()
    assert sorted(map(repr, plan)) == sorted(map(repr, mixing.plan(docs.repartition(3)).collect())) and len(plan) == len(odd)
    by = {r.doc_id: r for r in plan}
    assert by[4].size == 50_000 and by[None].size == 0 and by[3].size == 3 and by[3].source_size == 3 and by[None].copies == 0
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert Counter(map(tuple, out.collect())) == {k: sum(r.copies for r in plan if r.doc_id == k[0]) for k in map(tuple, odd) if by[k[0]].copies}
    taken, source = sum(r.size * r.copies for r in plan if r.source == "x"), by[1]
    assert max(r.copies for r in plan) <= 2 and taken == pytest.approx(source.target, rel=0.15)
    assert mixing.plan(docs.limit(0)).count() == mixing.mix(docs.limit(0)).count() == 0


def test_fair_draws(spark):
    u = [r.u for r in spark.range(4000).select(mixing.draw(F.col("id"), F.lit("s"), F.lit(None).cast("string"), 12).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02 and abs(np.mean(np.array(u) < 0.25) - 0.25) < 0.03


def brute_audit(rows, least, top):
    import re

    n, df, groups = defaultdict(Counter), defaultdict(Counter), {}
    for text, lang, source in rows:
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        g = (lang or "", source or "")
        groups.setdefault(g[0], set()).add(g[1])
        n[g].update(words)
        df[g[0]].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in df[lang].items() if c >= least]
        p = lambda c, all_: 1 + 10**9 * (c + 5) // (all_ + 5 * len(kept))
        sums = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        ps = {s: {t: p(n[lang, s][t], sums[s]) for t in kept} for s in sources}
        q = {t: p(sum(n[lang, s][t] for s in sources), sum(sums.values())) for t in kept}
        for s in sources:
            pair = sorted(((sum(abs(ps[s][t] - ps[o][t]) for t in kept), o) for o in sources - {s}), key=lambda x: (-x[0], x[1].encode()))
            term = sorted(((ps[s][t] - q[t], t) for t in kept if n[lang, s][t] and ps[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, v, r) for part, rows in (("pair", pair), ("term", term)) for r, (v, item) in enumerate(rows, 1)]
    return sorted(out)


def test_audit_equals_brute_force(spark, monkeypatch):
    """Several chunks, several tiles, flushes in the midst, and every odd row; the key column clashes with one of ours."""
    monkeypatch.setattr(divergence, "CHUNK", 5)
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "HELD", 11)
    rng = np.random.default_rng(5)
    words = ["alpha", "Beta", "été", "ÉTÉ", "x", " ", "naïve", "zz", "日本", "q", "\U0001f600", "ab", "don't", "A1b2"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 9))), ["en", "de", None][int(rng.integers(3))], [None, "s1", "s2", "s3", "ü"][int(rng.integers(5))]) for _ in range(300)]
    rows += [(None, "fr", "s1"), ("", "fr", "s2"), ("solo", "it", None), ("x" * 200_000, "en", "s9"), ("alpha alpha", "en", "s1"), ("alpha alpha", "en", "s1")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "text string, lang string, source string, term string").repartition(3)
    for top in (2, 50):
        assert sorted(map(tuple, divergence.audit(docs, least=20, top=top).collect())) == brute_audit(rows, 20, top)
    assert divergence.audit(docs.limit(0)).count() == 0


@given(st.integers(0, 2**50), st.integers(0, 2**50), st.integers(1, 10**6))
def test_probability_is_exact(count, more, kept):
    total = count + more
    assert divergence.probability(np.array([count]), total, kept).tolist() == [1 + 10**9 * (count + 5) // (total + 5 * kept)]
