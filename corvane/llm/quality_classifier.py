"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Every word type has a sparse random index vector; a word's vector is the sum of the index vectors of its neighbours in
all documents. Types share a fixed number of hash buckets, so the table's size is fixed while its counts cover the whole
corpus. A document is the mean of its tokens' vectors and of their index vectors. The network is fitted on a bounded
sample of labelled rows and its probabilities are calibrated by a temperature on rows kept apart.

Texts are cut into tokens once: one pass writes each document's buckets with their counts, and each partition's sums of
neighbours' index vectors; vectors, network and scores come from that table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, rows_of, scratch

REACH, NONZERO = 2, 4
#: Labelled rows that the network may be fitted on, of each label.
SAMPLE, HIDDEN = 3000, 24
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Tokens whose hashes a worker remembers.
REMEMBER = 1_000_000
#: Tokens that are added up at once.
STEP = 1 << 17


@dataclass(frozen=True)
class Space:
    """Hash buckets of word types and dimensions of their vectors: the driver and each worker hold buckets x dim floats twice."""

    buckets: int = 1 << 15
    dim: int = 64

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """For each bucket the dimensions of its nonzero entries, and their signs."""
        rng = np.random.default_rng(17)
        return rng.integers(0, self.dim, (self.buckets, NONZERO)), rng.choice(np.array([-1, 1], np.int32), (self.buckets, NONZERO))

    def dense(self) -> np.ndarray:
        dims, signs = self.index()
        out = np.zeros((self.buckets, self.dim), np.float32)
        for k in range(NONZERO):
            np.add.at(out, (np.arange(self.buckets), dims[:, k]), signs[:, k].astype(np.float32))
        return out


class _Hashes(dict):
    """Words by their lower case and case shape; runs of one symbol by symbol, whatever their length beyond three."""

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBER:
            self.clear()
        key = token
        if token[0].isalpha():
            key = token.lower() + ("\0" + ("u" if len(token) > 1 and token.isupper() else "t" if token[0].isupper() else ""))
        elif len(set(token)) == 1:
            key = token[0] + "\1" + str(min(len(token), 3))
        h = self[token] = xxhash.xxh32_intdigest(key, 3)
        return h


_hashes = _Hashes()


def buckets(text: str | None, space: Space) -> Iterator[np.ndarray]:
    """The buckets of all tokens of a text, in steps."""
    out: list[int] = []
    for m in _TOKEN.finditer(text or ""):
        out.append(_hashes[m.group()])
        if len(out) == STEP:
            yield np.array(out, np.int64) % space.buckets
            out = []
    yield np.array(out, np.int64) % space.buckets


def tokenised(docs: DataFrame, space: Space) -> DataFrame:
    """Rows of two kinds. (doc_id, ids, counts): each document's buckets, with bucket null. (bucket, v): a partition's sums
    of the index vectors of the bucket's neighbours, with ids null; one row per bucket that the partition has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, signs = space.index()
        total, ids_type = np.zeros(space.buckets * space.dim, np.int32), pa.list_(pa.int32())
        schema = None

        def add(parts: list[np.ndarray]) -> None:
            ids, doc = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            for d in range(1, REACH + 1):
                same = doc[d:] == doc[:-d]
                left, right = ids[:-d][same], ids[d:][same]
                for word, near in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        np.add.at(total, word * space.dim + dims[near, k], signs[near, k])

        for b in batches:
            parts, n, ids, counts = [], 0, [], []
            for t in b.column("text"):
                own: dict[int, int] | None = None
                for part in buckets(t.as_py(), space):
                    parts.append(part)
                    n += len(part)
                    u, c = np.unique(part, return_counts=True)
                    if len(part) < STEP and own is None:
                        break
                    own = own or {}
                    for x, y in zip(u.tolist(), c.tolist()):
                        own[x] = own.get(x, 0) + y
                if own is not None:
                    u, c = np.array(sorted(own), np.int64), np.array([own[x] for x in sorted(own)], np.int64)
                ids.append(u.astype(np.int32))
                counts.append(c.astype(np.int32))
                if n > STEP:
                    add(parts)
                    parts, n = [], 0
            if parts:
                add(parts)
            nulls = pa.nulls(b.num_rows, pa.int32())
            out = rows_of(b, ["doc_id"], {"ids": pa.array(ids, ids_type), "counts": pa.array(counts, ids_type), "bucket": nulls, "v": pa.nulls(b.num_rows, ids_type)})
            schema = out.schema
            yield out
        if schema is not None:
            rows = total.reshape(space.buckets, space.dim)
            used = np.flatnonzero(np.abs(rows).sum(axis=1))
            for i in range(0, len(used), 8192):
                u = used[i : i + 8192]
                n = len(u)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, schema.field("doc_id").type), pa.nulls(n, ids_type), pa.nulls(n, ids_type), pa.array(u.astype(np.int32)), pa.array(list(rows[u]), ids_type)], schema=schema)

    kind, at = docs.schema["doc_id"].dataType.simpleString(), scratch(docs.sparkSession, "tokens")
    # Parquet packs the small numbers that these mostly are; a checkpoint would be larger than the texts.
    docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, counts array<int>, bucket int, v array<int>").write.parquet(at)
    return docs.sparkSession.read.parquet(at)


def word_vectors(tokens: DataFrame, space: Space) -> np.ndarray:
    """buckets x dim sums of neighbours' index vectors over every text, scaled to unit length.

    Rows are summed before they reach the driver, which gets one row per bucket at any size of input.
    """
    sums = tokens.where("bucket is not null").groupBy("bucket").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(space.dim))).alias("v")).collect()
    out = np.zeros((space.buckets, space.dim))
    for r in sums:
        out[r["bucket"]] = r["v"]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Means of the tokens' word vectors and index vectors, and the log length."""
    c = counts.astype(np.float32)
    n = float(counts.sum(dtype=np.int64))
    return np.concatenate([c @ vectors[ids] / max(n, 1.0), c @ index[ids] / max(n, 1.0), [np.log1p(n) / 10]])


class Network:
    """One hidden layer of tanh units and a calibrated logistic output."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature=1.0):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, rounds: int = 300) -> Network:
    """Adam on the logistic loss, then a temperature on every fifth row. Without both labels the share of 1 is constant."""
    rng = np.random.default_rng(5)
    if len(y) == 0 or len(set(y.tolist())) < 2:
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        k = x.shape[1]
        return Network(np.zeros(k), np.ones(k), np.zeros((k, hidden)), np.zeros(hidden), np.zeros(hidden), np.log(p / (1 - p)))
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-6, rng.normal(0, 0.2, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.2, hidden), np.zeros(1))
    a, t = (x[~held] - net.mean) / net.scale, y[~held]
    params = [net.w1, net.b1, net.w2, net.b2]
    m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(rounds):
        order = rng.permutation(len(t))
        for i in range(0, len(t), 512):
            xb, yb = a[order[i : i + 512]], t[order[i : i + 512]]
            h = np.tanh(xb @ net.w1 + net.b1)
            g = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -50, 50))) - yb) / len(yb)
            gh = np.outer(g, net.w2) * (1 - h * h)
            grads = [xb.T @ gh + 1e-4 * net.w1, gh.sum(axis=0), h.T @ g + 1e-4 * net.w2, np.array([g.sum()])]
            step += 1
            for p, q, mi, si in zip(params, grads, m, s):
                mi += 0.1 * (q - mi)
                si += 0.001 * (q * q - si)
                p -= 0.01 * (mi / (1 - 0.9**step)) / (np.sqrt(si / (1 - 0.999**step)) + 1e-8)
    if held.any():
        z, t = net.logits(x[held]), y[held]
        loss = lambda c: float(np.mean(np.logaddexp(0, z / c) - t * z / c))
        net.temperature = min(np.geomspace(0.3, 10, 60), key=loss)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, sample: int = SAMPLE) -> DataFrame:
    """docs with y: about `sample` rows of each label at most, taken by a hash of doc_id. The labels are counted first.

    Null labels are left out; a document with several labels has the smallest one.
    """
    one = labels.where(F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(column).cast("int").alias("y"))
    n = dict(one.groupBy("y").count().where("y in (0, 1)").collect())
    rate = F.when(F.col("y") == 1, min(1.0, sample / n.get(1, 1))).otherwise(min(1.0, sample / n.get(0, 1)))
    some = one.where("y in (0, 1)").where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < rate * 1_000_000)
    if sample <= 100_000:
        some = F.broadcast(some)  # about 2 x sample rows
    return docs.join(some, "doc_id")


def _features(b: pa.RecordBatch, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    x = [pooled(i.values.to_numpy(), c.values.to_numpy(), vectors, index) for i, c in zip(b.column("ids"), b.column("counts"))]
    return np.array(x).reshape(b.num_rows, 2 * vectors.shape[1] + 1)


def fit(tokens: DataFrame, rows: DataFrame, labels: DataFrame, space: Space, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors from all of tokens, and the network from labelled ones among rows, which are some of its documents."""
    vectors = word_vectors(tokens, space)
    shared = tokens.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = space.dense()
        for b in batches:
            x = _features(b, shared.value, index)
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["h", "y", "x"])

    some = labelled_sample(rows, labels, "quality", sample).select(F.col("doc_id").cast("string").alias("h"), "y", "ids", "counts")
    got = some.mapInArrow(run, "h string, y int, x array<double>").collect()
    got.sort(key=lambda r: (xxhash.xxh64_intdigest(r["h"]), r["y"], r["x"]))
    x = np.array([r["x"] for r in got]).reshape(len(got), 2 * space.dim + 1)
    return vectors, train(x, np.array([r["y"] for r in got], float))


def score(tokens: DataFrame, vectors: np.ndarray, net: Network, space: Space) -> DataFrame:
    """(doc_id, score) for each document of tokens. Null and empty texts are scored as texts without words."""
    shared = tokens.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = space.dense()
        vec, model = shared.value
        for b in batches:
            yield rows_of(b, ["doc_id"], {"score": pa.array(model.probabilities(_features(b, vec, index)))})

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.where("bucket is null").select("doc_id", "ids", "counts").mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, space: Space = Space()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels come from rows whose crc32 mod 3 is not 1.

    A null doc_id is not held out and teaches nothing. Repeated rows give repeated results. Empty tables give no rows.
    """
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    tokens = tokenised(docs, space)
    vectors, net = fit(tokens, tokens.where("bucket is null and doc_id is not null").where(~held), labels, space, sample)
    return score(tokens, vectors, net, space).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
