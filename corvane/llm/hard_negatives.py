"""Hard-negative mining: K-means inverted lists with stored centroid radii, searched exactly.

Vectors become integers, and a score is their inner product. A list's rows lie within its radius r of its centroid c, so
by Cauchy-Schwarz an anchor a scores between a.c - |a| r and a.c + |a| r on them. Each anchor visits lists by upper bound,
skips those that lie outside all its windows, and stops when the bound falls strictly below its kth score.

Visits go in rounds of 1, 8, 64, 512 and then all other lists, so that lists and anchors meet in joins: a round deals rows
and anchors by list, every part of a list's rows meeting every part of its anchors in a group of its own, and each group
sends on k rows for an anchor and window. The lists, of which there are MAX_LISTS at most, are fitted on a bounded sample;
every row is in one.

Rows with a null key, label or vector, or a null or non-finite component take no part. Of rows that share a key the one
of smallest label and components counts. Vectors of other lengths than the anchor's never score; an empty vector scores 0 with
empty ones. Ties go to the smaller key. No rows give no rows, as does an anchor without a row of its own label. Scores
must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows that the centroids are fitted on at most, rounds of fitting, lists at most, and vector lengths that have centroids.
SAMPLE, FITS, MAX_LISTS, LENGTHS = 16_384, 8, 4096, 16
#: Rows and anchors of a list that meet in one group.
BLOCK, ASKED = 8192, 1024
#: Lists that an anchor visits in each round; after these, all that are left.
ROUNDS = (1, 8, 64, 512)
LEAST, MOST = -(2**63), 2**63 - 1


def prepare(vectors: DataFrame, key: str, vector: str, label: Column, scale: int = 256) -> DataFrame:
    """(id, label, q): whole rows with q = floor(scale * x), one per id."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & label.isNotNull() & fit)
    q = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    rows = rows.select(F.col(key).cast("long").alias("id"), label.alias("label"), q.alias("q"))
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.label", "r.q")


def fit(rows: DataFrame, lists: int | None = None) -> dict[int, np.ndarray]:
    """Centroids by vector length: Lloyd's algorithm over at most SAMPLE rows of smallest hashed id.

    lists: by default the square root of the number of rows, MAX_LISTS at most.
    """
    lists = min(lists or max(1, round(rows.count() ** 0.5)), MAX_LISTS)
    got = [r[0] for r in rows.select("q", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).select("q").collect()]
    by: dict[int, list] = {}
    for v in got:
        by.setdefault(len(v), []).append(v)
    out = {}
    for n in sorted(by, key=lambda n: (-len(by[n]), n))[:LENGTHS]:
        x = np.unique(np.array(by[n], float), axis=0) if n else np.zeros((1, 0))
        c = x[np.linspace(0, len(x) - 1, min(len(x), max(1, lists * len(by[n]) // len(got)))).astype(int)]
        for _ in range(FITS):
            own = _nearest(x, c)[0]
            sums, size = np.zeros_like(c), np.bincount(own, minlength=len(c))
            np.add.at(sums, own, x)
            c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        out[n] = c
    return out


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and how far it is."""
    own, far = np.zeros(len(x), int), np.zeros(len(x))
    for a in range(0, len(x), 4096):
        p = x[a : a + 4096]
        own[a : a + 4096] = o = ((c * c).sum(1)[None, :] - 2 * (p @ c.T)).argmin(axis=1)
        far[a : a + 4096] = np.linalg.norm(p - c[o], axis=1)
    return own, far


def _by_length(qs: pd.Series) -> dict[int, np.ndarray]:
    return {n: np.asarray(at) for n, at in qs.groupby(qs.map(len)).indices.items()}


def invert(rows: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """rows with their list and how far they lie from its centroid; list -1 holds lengths without centroids."""
    first = dict(zip(centroids, np.cumsum([0, *map(len, centroids.values())])))
    shared = rows.sparkSession.sparkContext.broadcast((centroids, first))  # MAX_LISTS centroids

    @F.pandas_udf("struct<list int, far double>")
    def place(qs: pd.Series) -> pd.DataFrame:
        cs, start = shared.value
        lists, far = np.full(len(qs), -1), np.zeros(len(qs))
        for n, at in _by_length(qs).items():
            if n in cs:
                own, far[at] = _nearest(np.array(qs.iloc[at].tolist(), float).reshape(len(at), n), cs[n])
                lists[at] = own + start[n]
        return pd.DataFrame({"list": lists.astype("int32"), "far": far})

    return rows.withColumn("p", place("q")).select("id", "label", "q", "p.list", "p.far")


def _visits(centroids: dict[int, np.ndarray], radii: dict[int, float], take: int | None):
    """A UDF: the next lists of an anchor, the place in its order that it has come to, and whether some may be left."""
    directory, start = {}, 0
    for n, c in centroids.items():
        kept = [i for i in range(len(c)) if start + i in radii]
        directory[n] = np.array([start + i for i in kept], int), c[kept], np.array([radii[start + i] for i in kept])
        start += len(c)
    other = -1 in radii

    @F.pandas_udf("struct<lists array<int>, done int, more boolean>")
    def visits(qs: pd.Series, floors: pd.Series, tops: pd.Series, done: pd.Series) -> pd.DataFrame:
        lists, at, more = [], [], []
        for q, low, high, d in zip(qs, floors, tops, done):
            if len(q) not in directory:
                lists.append([-1] if other and d == 0 else [])
                at.append(1)
                more.append(False)
                continue
            a = np.asarray(q, float)
            ids, c, r = directory[len(q)]
            mid, wide = c @ a, np.linalg.norm(a) * r
            slack = 1e-9 * (np.abs(mid) + wide) + 1e-6  # of the floats that the bounds are made with
            order = np.argsort(-(mid + wide + slack), kind="stable")
            up, down = (mid + wide + slack)[order], (mid - wide - slack)[order]
            fits = np.zeros(len(ids), bool)
            for lo, hi in zip(low, high):
                fits |= (down <= float(hi)) & (up >= float(lo))
            left = np.flatnonzero(fits)
            left = left[left >= d]
            now = left if take is None else left[:take]
            lists.append(ids[order[now]].tolist())
            at.append(int(now[-1]) + 1 if len(now) else len(ids))
            more.append(len(left) > len(now))
        return pd.DataFrame({"lists": lists, "done": pd.Series(at, dtype="int32"), "more": more})

    return visits


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: by doubles where every sum stays below 2^53."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    most = int(np.abs(x).max()) * int(np.abs(y).max()) * x.shape[1]
    if most < 2**53:
        return (x.astype(float) @ y.T.astype(float)).astype(np.int64)
    return x @ y.T if most < 2**63 else (x.astype(object) @ y.T.astype(object)).astype(np.int64)


def best_in_windows(scores: np.ndarray, ids: np.ndarray, floors: list[int], tops: list[int], k: int) -> list[tuple[int, int, int]]:
    """(window, id, score): of scores (of rows in order of id) the k highest from floor to top of each window."""
    at = np.flatnonzero(scores >= min(floors, default=MOST))
    at = at[np.argsort(-scores[at], kind="stable")]
    down, out = -scores[at], []
    for w, (lo, hi) in enumerate(zip(floors, tops)):
        i = np.searchsorted(down, -hi, "left") if hi < MOST else 0
        out += [(w, int(ids[j]), int(scores[j])) for j in at[i : i + k] if scores[j] >= lo]
    return out


def _scan(index: DataFrame, asked: DataFrame, sizes: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(a, w, id, score): of every part of a visited list the k best rows for each anchor and window."""
    counts = asked.groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("nq"))
    parts = F.broadcast(sizes.join(counts, "list"))  # a row per list
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(parts, "list").select("list", F.pmod(F.xxhash64("id"), F.col("np")).cast("int").alias("p"), spread("nq").alias("s"), "id", "label", "q")
    right = asked.join(parts, "list").select("list", spread("np").alias("p"), F.pmod(F.xxhash64("a"), F.col("nq")).cast("int").alias("s"), "a", "al", "aq", "floors", "tops")

    def meet(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            rows = rows.sort_by("id")
            ids, labels = rows["id"].to_numpy(), rows["label"].to_pandas().to_numpy()
            widths, wanted = (t.combine_chunks().value_lengths().to_numpy() for t in (rows["q"], anchors["aq"]))
            a, al, floors, tops = (anchors[c].to_pylist() for c in ("a", "al", "floors", "tops"))
            for n in np.intersect1d(widths, wanted):
                i, j = np.flatnonzero(widths == n), np.flatnonzero(wanted == n)
                x, y = (t.take(pa.array(at)).combine_chunks().flatten().to_numpy().reshape(len(at), n) for t, at in ((rows["q"], i), (anchors["aq"], j)))
                for b in range(0, len(j), 64):
                    s = products(y[b : b + 64], x)
                    for m, row in zip(j[b : b + 64], s):
                        ok = (ids[i] != a[m]) & ((labels[i] == al[m]) == same_label)
                        out += [(a[m], *r) for r in best_in_windows(row[ok], ids[i][ok], floors[m], tops[m], k)]
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "w": pa.array(cols[1], pa.int32()), "id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.int64())})

    by = ["list", "p", "s"]
    return left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(meet, "a long, w int, id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, centroids: dict[int, np.ndarray], anchors: DataFrame, k: int, same_label: bool, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """(a, w, id, score, rank): for each anchor (a, al, aq) and window of scores (floors, tops) the first k rows in it."""
    facts = index.groupBy("list").agg(F.max("far").alias("r"), F.ceil(F.count("*") / BLOCK).cast("int").alias("np")).collect()  # a row per list
    radii, spark = {f["list"]: f["r"] for f in facts}, index.sparkSession
    sizes = spark.createDataFrame([(f["list"], f["np"]) for f in facts], "list int, np int")
    state, best = anchors.withColumn("done", F.lit(0)), None
    for take in (*rounds, None):
        state = cut(state.withColumn("v", _visits(centroids, radii, take)("aq", "floors", "tops", "done")))
        asked = state.select("a", "al", "aq", "floors", "tops", F.explode("v.lists").alias("list"))
        found = _scan(index, asked, sizes, k, same_label)
        best = cut(_ranked(found if best is None else best.drop("rank").unionByName(found), k))
        if state.where("v.more").isEmpty():
            break
        full = best.groupBy("a", "w").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
        kth = full.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kth"))  # an entry per window
        risen = F.transform("floors", lambda x, w: F.greatest(x, F.element_at("kth", w)))
        state = state.where("v.more").join(kth, "a", "left").select("a", "al", "aq", F.when(F.col("kth").isNull(), F.col("floors")).otherwise(risen).alias("floors"), "tops", F.col("v.done").alias("done"))
    return best


def mine(vectors: DataFrame, key: str, vector: str, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, lists: int | None = None, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor (is_anchor, over id) has as positives the first rows of its label, and for each of them as negatives the first rows
    of other labels whose score is low to high percent of the positive's: low * p <= 100 * n <= high * p.
    """
    index = cut(prepare(vectors, key, vector, label, scale))
    centroids = fit(index, lists)
    index = cut(invert(index, centroids))
    anchors = index.where(is_anchor).select(F.col("id").alias("a"), F.col("label").alias("al"), F.col("q").alias("aq"))
    one = lambda x: F.array(F.lit(x).cast("long"))
    near = search(index, centroids, anchors.withColumns({"floors": one(LEAST), "tops": one(MOST)}), positives, True, rounds)
    # A window per distinct score; high * p and low * p are divided exactly, away from what they exclude.
    down = lambda x: F.expr(f"cast(floor(cast({x} as decimal(38,0)) * {high} / 100) as long)")
    up = lambda x: F.expr(f"cast(ceil(cast({x} as decimal(38,0)) * {low} / 100) as long)")
    near = near.select("a", F.col("id").alias("positive_id"), F.col("score").alias("p"), up("score").alias("floor"), down("score").alias("top"))
    open_ = near.where("floor <= top").groupBy("a").agg(F.array_sort(F.collect_set(F.struct("floor", "top"))).alias("ws"))  # `positives` at most
    asked = anchors.join(open_, "a").select("a", "al", "aq", F.col("ws.floor").alias("floors"), F.col("ws.top").alias("tops"), "ws")
    asked = cut(asked)
    far = search(index, centroids, asked.drop("ws"), negatives, False, rounds)
    window = asked.select("a", F.posexplode("ws").alias("w", "x")).select("a", "w", "x.floor", "x.top")
    pairs = near.join(window, ["a", "floor", "top"]).join(far, ["a", "w"])
    return pairs.select(F.col("a").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"))
