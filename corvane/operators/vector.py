"""Vector search: exact cosine top-k, for one query or many, and an inverted-file index with exact re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """-1 for empty vectors, other lengths or a zero norm. Sums are double."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norms == 0), F.lit(-1.0)).otherwise(dot(a, b) / norms)


def top_k(vectors: DataFrame, key: str, vector: str, query: list[float], k: int = 10) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, F.round(cosine(F.col(vector), q), 5).alias("score")).orderBy(F.desc("score"), key).limit(k)


def scores(rows: list, queries: list) -> np.ndarray:
    """Cosines of rows (down) and queries (across), rounded; -1 where cosine() says so."""
    as_arrays = lambda vs: [np.asarray([] if v is None else v, float) for v in vs]
    rows, queries = as_arrays(rows), as_arrays(queries)
    out = np.full((len(rows), len(queries)), -1.0)
    for n in {len(v) for v in rows} & {len(v) for v in queries} - {0}:
        i, j = (np.flatnonzero([len(v) == n for v in vs]) for vs in (rows, queries))
        x, y = np.stack([rows[k] for k in i]), np.stack([queries[k] for k in j])
        norms = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None, :]
        out[np.ix_(i, j)] = np.where(norms > 0, np.round(x @ y.T / np.where(norms > 0, norms, 1.0), 5), -1.0)
    return out


def _best(keys: np.ndarray, vectors: list, qkeys: np.ndarray, qvectors: list, k: int) -> list[tuple]:
    """(qkey, key, score) of the k best rows for each query, ties by key; a row is no partner of its own query."""
    order, out = np.argsort(keys, kind="stable"), []
    keys, vectors = keys[order], [vectors[i] for i in order]
    for a in range(0, len(qkeys), 512):
        q = qkeys[a : a + 512]
        s = scores(vectors, qvectors[a : a + 512])
        s[keys[:, None] == q[None, :]] = -np.inf
        top = np.argsort(-s, axis=0, kind="stable")[:k]
        out += [(q[j], keys[i], s[i, j]) for j in range(len(q)) for i in top[:, j] if s[i, j] > -np.inf]
    return out


def _ranked(found: DataFrame, key: str, qkey: str, k: int) -> DataFrame:
    w = Window.partitionBy(qkey).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_batch(vectors: DataFrame, key: str, vector: str, queries: DataFrame, qkey: str, k: int = 3, block: int = 8192) -> DataFrame:
    """Exact best k other rows for each query (qkey, qv): qkey, key, score, rank. Null keys take no part.

    Queries go out in blocks of about `block`, so what is broadcast does not grow with their number; each batch of rows
    sends on its own k best for every query and no other pair.
    """
    spark, kinds = vectors.sparkSession, (queries.schema[qkey].dataType.simpleString(), vectors.schema[key].dataType.simpleString())
    schema = f"{qkey} {kinds[0]}, {key} {kinds[1]}, score double"
    queries, rows = queries.where(F.col(qkey).isNotNull()), vectors.where(F.col(key).isNotNull()).select(key, vector)
    n = max(1, -(-queries.count() // block))
    found = spark.createDataFrame([], schema)
    for b in range(n):
        part = queries.where(F.pmod(F.xxhash64(qkey), F.lit(n)) == b).select(qkey, "qv").collect()
        if not part:
            continue
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in part]), [r[1] for r in part]))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for x in batches:
                yield pd.DataFrame(_best(x[key].to_numpy(), x[vector].tolist(), *shared.value, k), columns=[qkey, key, "score"])

        found = found.unionByName(rows.mapInPandas(run, schema))
    return _ranked(found, key, qkey, k)


def fit_cells(vectors: DataFrame, vector: str, cells: int | None = None, sample: int = 16_384, rounds: int = 12) -> np.ndarray:
    """Unit centroids of an inverted-file index, by spherical k-means over at most `sample` distinct vectors.

    cells: by default the square root of the number of rows, 1024 at most. Copies count once, so no hot vector fills the
    sample. Vectors that are null, empty or zero, or not as long as most, do not take part. No vector gives no centroid.
    """
    h = F.xxhash64(vector)
    taken = vectors.where(F.size(vector) > 0).groupBy(h.alias("h")).agg(F.first(vector).alias("v")).orderBy("h").limit(sample).collect()
    arrays = [np.asarray(r["v"], float) for r in taken if None not in r["v"]]
    lengths = [len(a) for a in arrays]
    x = np.array([a for a in arrays if len(a) == max(set(lengths), key=lambda n: (lengths.count(n), n)) and a.any()])
    if not len(x):
        return np.zeros((0, 0))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = min(len(x), cells or max(1, min(1024, round(vectors.count() ** 0.5))))
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1.0), c)
    return c


def _cells(df: DataFrame, vector: str, centroids: np.ndarray, probes: int, name: str) -> DataFrame:
    """df once for each of the `probes` nearest cells of its vector; cell -1 for vectors that no centroid fits."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)  # at most 1024 centroids

    @F.pandas_udf("array<int>")
    def nearest(vs: pd.Series) -> pd.Series:
        c = shared.value
        fits = [v is not None and len(v) == c.shape[1] > 0 for v in vs]
        out = [[-1]] * len(vs)
        if any(fits):
            x = np.array([v for v, ok in zip(vs, fits) if ok], float)
            near = iter(np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes].tolist())
            out = [next(near) if ok else [-1] for ok in fits]
        return pd.Series(out)

    return df.withColumn(name, F.explode(nearest(F.col(vector))))


def build_index(vectors: DataFrame, key: str, vector: str, centroids: np.ndarray) -> DataFrame:
    """(key, vector, cell): every row under its nearest centroid. Written partitioned by cell, a search reads only cells it probes."""
    return _cells(vectors.select(key, vector), vector, centroids, 1, "cell")


def search_index(index: DataFrame, key: str, vector: str, queries: DataFrame, qkey: str, centroids: np.ndarray, k: int = 10, probes: int | None = None, block: int = 4096) -> DataFrame:
    """Approximate best k other rows for each query (qkey, qv), re-ranked exactly: qkey, key, score, rank.

    A cell of more than `block` rows or queries is split, and every part of its rows meets every part of its queries in a
    group of its own that sends on k rows a query; so a hot cell costs more groups and no larger ones. probes: cells looked
    into for each query, by default three quarters, as vectors without clusters need that for a recall of 0.9.
    """
    probes = probes or -(-3 * len(centroids) // 4)
    kinds = (queries.schema[qkey].dataType.simpleString(), index.schema[key].dataType.simpleString())
    asked = _cells(queries.where(F.col(qkey).isNotNull()).select(qkey, "qv"), "qv", centroids, probes, "cell")
    stored = index.where(F.col(key).isNotNull())
    parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = F.broadcast(parts(stored, "np").join(parts(asked, "nq"), "cell"))  # a row per centroid
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = stored.join(sizes, "cell").select("cell", F.pmod(F.xxhash64(key), F.col("np")).cast("int").alias("p"), spread("nq").alias("q"), key, vector)
    right = asked.join(sizes, "cell").select("cell", spread("np").alias("p"), F.pmod(F.xxhash64(qkey), F.col("nq")).cast("int").alias("q"), qkey, "qv")

    def run(rows: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_best(rows[key].to_numpy(), rows[vector].tolist(), qs[qkey].to_numpy(), qs["qv"].tolist(), k), columns=[qkey, key, "score"])

    by = ["cell", "p", "q"]
    found = left.groupBy(by).cogroup(right.groupBy(by)).applyInPandas(run, f"{qkey} {kinds[0]}, {key} {kinds[1]}, score double")
    return _ranked(found, key, qkey, k)


def backlog(chunks: DataFrame, embeddings: DataFrame, key: str, model: str, force: bool = False) -> DataFrame:
    """Chunks without a vector of the model; all of them with force."""
    return chunks if force else chunks.join(embeddings.where(F.col("model") == model).select(key), key, "left_anti")


def upsert(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    """One vector per (chunk_id, model), the new one where there are two."""
    both = embeddings.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy("chunk_id", "model").orderBy(F.desc("__new"))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__new", "__r")
