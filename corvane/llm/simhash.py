"""SimHash near-duplicates by pivot distance tables.

Each document gets a 64-bit fingerprint of its word shingles. Copies collapse to distinct fingerprints first. These are
dealt into buckets so that any two within the radius share one (the bits are cut into blocks; with at most 4 differing
bits, at least two of six blocks are equal, and each pair of blocks is a table of buckets). Inside a bucket the distances
of every fingerprint to a set of reference fingerprints stand in a table, whose rows are sorted by the coordinate that
spreads most: by the triangle inequality, two fingerprints whose coordinates differ by more than the radius anywhere
cannot be linked. So each is held only against the run of rows whose first coordinate is near enough, that run is
thinned coordinate by coordinate, and what survives all of them is compared. A bucket yields a spanning forest of its
links, never all its pairs: what has been reached is not looked at again. Buckets of more than `block` fingerprints are
split into blocks and every two blocks meet in a task of their own, so no task holds more than two blocks and no link is
lost. Connected components then run over the links.

Near copies by Jaccard similarity (drop_near_duplicates) lie too many bits apart for any deal of 64 bits: at 0.8 about
ten. There, links within the radius are verified on the shingle sets and only say which pairs need no further look; the
others come from an exact split. Shingles have a global order, and two sets similar enough share one among the first few
of each (prefix filter). Some rounds first hold each document against one hub of those that it shares a shingle with, so
that large groups of copies grow together without their pairs; what shares a shingle and is still apart, and what sizes
and positions allow, is verified pair by pair.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, by_key, connected_components, cut, join_split, packed, rows_of, tasks_for

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLANK = re.compile(rb"[\x20\x09-\x0D]+")
RADIUS, N_PIVOTS, BLOCKS, BLOCK = 4, 16, 6, 50_000
#: Shingles whose bits are counted at once.
_STEP = 1 << 16
#: Least Jaccard similarity of near copies, documents that the order of shingles is found from, shingles it puts last.
SIMILARITY, ORDER_SAMPLE, ORDER_LAST = 0.8, 5_000, 200_000
#: Rounds in which documents are held against hubs alone.
HUB_ROUNDS = 4
#: Bins of a sketch, and bytes of sketches that may be broadcast.
BINS, SKETCHES = 256, 16 << 20
#: For bounds that are whole numbers but for rounding.
_EPS = 1e-9


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; of all words if they are fewer than width; none without words."""
    w = [x for x in _BLANK.split((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)) if x]
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    joined, h = memoryview(b" ".join(w)), xxhash.xxh64_intdigest
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = [0, *ends[: len(w) - width].tolist()]
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())), np.uint64, len(w) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The unsigned 64-bit number of the bits that over half the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _STEP):
        ones += np.unpackbits(hashes[i : i + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = 4) -> int:
    """The unsigned 64-bit fingerprint: a bit is set if it is in over half the shingles' XXH64 (seed 42); 0 without words."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. One row per row; null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column("text")), np.uint64, b.num_rows)
            yield rows_of(b, ["doc_id"], {"fp": pa.array(fp.view(np.int64))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """The reference fingerprints: 0, all ones, and hashes of 2, 3, ..."""
    return np.array([0, 2**64 - 1, *(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 7) for i in range(2, n))][:n], np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def spanning_links(fps: np.ndarray, dist: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions of links that span each component of the graph of fingerprints within the radius."""
    by = np.argsort(-dist.std(axis=0), kind="stable") if len(fps) else np.arange(dist.shape[1])
    order = np.argsort(dist[:, by[0]], kind="stable")
    f, table, left, out = fps[order], np.ascontiguousarray(dist[order][:, by].T), np.ones(len(fps), bool), []
    lo, hi = np.searchsorted(table[0], table[0] - radius, "left"), np.searchsorted(table[0], table[0] + radius, "right")
    for start in range(len(f)):
        frontier = [start] if left[start] else []
        left[start] = False
        while frontier:
            x = frontier.pop()
            near = lo[x] + np.flatnonzero(left[lo[x] : hi[x]])
            for coordinate in table[1:]:
                if near.size < 2:
                    break
                near = near[np.abs(coordinate[near] - coordinate[x]) <= radius]
            near = near[np.bitwise_count(f[near] ^ f[x]) <= radius]
            left[near] = False
            out += [(int(order[x]), int(order[y])) for y in near]
            frontier += near.tolist()
    return out


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Masks, as signed longs, of which two fingerprints within the radius agree on one at least."""
    if not radius < blocks <= 64:
        raise ValueError("blocks must exceed the radius")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    sums = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in sums]


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, n_pivots: int = N_PIVOTS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column fp that span every component."""
    keyed = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(block_masks(radius, blocks))))).alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    rows = keyed.join(sizes, ["t", "key"]).select("t", "key", "fp", own.alias("i"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("j")).select("t", "key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs = pivots(n_pivots)
        a, b = [], []
        for g in by_key(batches, ["t", "key", "i", "j"]):
            fps = g["fp"].to_numpy(np.int64).view(np.uint64)
            for x, y in spanning_links(fps, distance_table(fps, refs), radius):
                a.append(fps[x])
                b.append(fps[y])
            if len(a) > 50_000:
                yield pd.DataFrame({"a": np.array(a, np.uint64).view(np.int64), "b": np.array(b, np.uint64).view(np.int64)})
                a, b = [], []
        yield pd.DataFrame({"a": np.array(a, np.uint64).view(np.int64), "b": np.array(b, np.uint64).view(np.int64)})

    return rows.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most radius bits.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows give repeated results. A null
    doc_id is no candidate for component_id unless its component has no other. Empty tables give no rows.
    """
    fps = cut(fingerprints(docs, width))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    comp = cut(connected_components(links(distinct.select("fp"), radius, blocks)))
    # The smallest doc_id of each component, then of each fingerprint: both tables have a row per distinct fingerprint.
    named = cut(distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    roots = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    roots = cut(roots)
    of = cut(join_split(named.select("fp", "root"), roots.drop("n"), "root", roots).select("fp", "component_id"))
    return join_split(fps, of, "fp", distinct).select("doc_id", "fp", "component_id")


def shingle_order(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that are common in a bounded sample, and their counts. Any order is exact; this one keeps buckets small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = [np.unique(shingle_hashes(t, width)) for t in b["text"]]
            yield pd.DataFrame({"h": np.concatenate([np.empty(0, np.uint64), *h]).view(np.int64)})

    step = max(1, docs.count() // ORDER_SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).select("text")
    got = some.mapInPandas(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(ORDER_LAST).toPandas()
    h, n = got["h"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    by = np.argsort(h)
    return h[by], n[by]


def shingle_sets(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, fp, k, n, prefix, sketch) for each row: a hash of the set of its n shingles, the first of them in shingle_order,
    and how many of them fall into each of BINS bins, 255 at most."""
    shared = docs.sparkSession.sparkContext.broadcast(shingle_order(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for b in batches:
            fp, ks, ns, prefix, sketch = [], [], [], [], []
            for t in b.column("text"):
                h = shingle_hashes(t.as_py(), width)
                fp.append(majority(h))
                s = np.unique(h)
                ks.append(xxhash.xxh64_intdigest(s.tobytes(), 42))
                ns.append(len(s))
                sketch.append(np.minimum(np.bincount((s % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
                n = np.zeros(len(s), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    n = np.where(common[at] == s, counts[at], 0)
                first = len(s) - math.ceil(similarity * len(s) - _EPS) + 1 if len(s) else 0
                prefix.append(s[np.lexsort((s, n))[:first]].view(np.int64))
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield rows_of(b, ["doc_id"], {"fp": long(fp), "k": long(ks), "n": pa.array(ns, pa.int32()), "prefix": pa.array(prefix, pa.list_(pa.int64())), "sketch": pa.array(sketch, pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long, k long, n int, prefix array<long>, sketch binary")


def wanted_sets(docs: DataFrame, distinct: DataFrame, ks: DataFrame, width: int) -> DataFrame:
    """(k, items): the shingle sets of these k, made anew from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), width)) for t in b.column("text")]
            k = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["k", "items"])

    places = bounded_broadcast(cut(distinct.join(ks, "k", "left_semi").select(F.col("first").alias("__id")).distinct()), F.octet_length(F.coalesce(F.col("__id").cast("string"), F.lit(""))) + 40)
    # Rows of one doc_id may differ in text: a set that is none of the ends meets no pair.
    of = docs.select("doc_id", "text").join(places, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text").mapInArrow(run, "k long, items array<long>")
    return cut(of.dropDuplicates(["k"]))


def may_be_similar(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of k whose sketches leave room for the similarity: two sets share at most the lesser count of each bin.

    So nothing similar is lost; a bin that is full says nothing, and its pair stays.
    """

    @F.pandas_udf("boolean")
    def room(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        p, q = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), BINS) for v in (x, y))
        most = np.minimum(p, q).sum(axis=1, dtype=np.int64)
        full = ((p == 255) | (q == 255)).any(axis=1)
        return pd.Series(full | (most >= similarity * (n.to_numpy() + m.to_numpy() - most) - _EPS))

    # Few pairs have few ends, whose sketches are found and joined without a shuffle of all.
    ends = bounded_broadcast(pairs.select(F.explode(F.array("a", "b")).alias("k")), 16)
    ends = bounded_broadcast(cut(distinct.join(ends, "k", "left_semi").select("k", "sketch", "n")), BINS + 48, SKETCHES)
    side = lambda k, x, n: ends.select(F.col("k").alias(k), F.col("sketch").alias(x), F.col("n").alias(n))
    both = pairs.join(side("a", "x", "nx"), "a").join(side("b", "y", "ny"), "b")
    return both.where(room("x", "y", "nx", "ny")).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, distinct: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of k whose sets of shingles have at least this Jaccard similarity; sets are made for these alone."""
    pairs = packed(cut(may_be_similar(pairs, distinct, similarity)))
    sets = wanted_sets(docs, distinct, bounded_broadcast(pairs.select(F.explode(F.array("a", "b")).alias("k")), 16), width)
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("k").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common) - _EPS).select("a", "b")


def _may(n, pos, m, at, similarity: float):
    """Whether sets of n and m shingles that share one at these places of their order can be similar enough."""
    need = similarity / (1 + similarity) * (n + m) - _EPS
    return (F.least(n, m) >= similarity * F.greatest(n, m) - _EPS) & (F.least(n - pos, m - at) >= need)


def hub_pairs(rows: DataFrame, similarity: float, tasks: int) -> DataFrame:
    """(a, b): each k beside one hub of another root that it shares a shingle with, in so many tasks at most. rows as in prefix_pairs."""
    hubs = rows.groupBy("h").agg(F.min(F.struct("root", "k", "n", "pos")).alias("hub"), F.max("root").alias("hi"), F.count("*").alias("n")).where("hub.root <> hi")
    hubs = cut(hubs.coalesce(tasks))
    met = join_split(rows.withColumnRenamed("n", "size"), hubs.select("h", "hub"), "h", hubs).where("root <> hub.root").where(_may(F.col("size"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), similarity))
    one = met.groupBy("k").agg(F.min("hub.k").alias("hub"))
    return one.coalesce(tasks).select(F.least("k", "hub").alias("a"), F.greatest("k", "hub").alias("b")).distinct().coalesce(tasks)


def prefix_pairs(rows: DataFrame, similarity: float, block: int = 2_000) -> DataFrame:
    """(a, b): pairs of k of different roots that may be similar. rows (k, n, root, pos, h): the prefix of each set of n shingles."""
    sizes = rows.groupBy("h").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("c > 1 and lo <> hi").select("h", "c")
    sizes = bounded_broadcast(cut(sizes), 32)
    parts = F.ceil(F.col("c") / block).cast("int")
    own = F.pmod(F.xxhash64("k"), parts).cast("int")
    dealt = rows.join(sizes, "h").select("h", "k", "n", "root", "pos", own.alias("i"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("j")).select("h", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "k", "n", "root", "pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, held = [], [], 0
        frame = lambda: pd.DataFrame({"a": np.concatenate([np.empty(0, np.int64), *a]), "b": np.concatenate([np.empty(0, np.int64), *b])})
        for g in by_key(batches, ["h", "i", "j"]):
            k, n, root, pos = (g[c].to_numpy(np.int64) for c in ("k", "n", "root", "pos"))
            left = n - pos
            for x in range(1, len(k)):
                m, r = n[:x], similarity / (1 + similarity)
                may = (root[:x] != root[x]) & (np.minimum(m, n[x]) >= similarity * np.maximum(m, n[x]) - _EPS) & (np.minimum(left[:x], left[x]) >= r * (m + n[x]) - _EPS)
                y = k[:x][may]
                if y.size:
                    a.append(np.minimum(y, k[x]))
                    b.append(np.maximum(y, k[x]))
                    held += y.size
                if held > 50_000:
                    yield frame()
                    a, b, held = [], [], 0
        yield frame()

    return dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInPandas(run, "a long, b long").distinct()


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id reachable over pairs of at least this Jaccard similarity.

    No pair is missed but by a collision of 64-bit hashes. Texts without words equal each other. Repeated rows and null
    doc_ids are as in near_duplicates.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    sets = cut(shingle_sets(docs, width, similarity))
    distinct = cut(sets.groupBy("k").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")))
    # Fingerprints that are near or equal, by the smallest k of each.
    of = cut(distinct.groupBy("fp").agg(F.min("k").alias("low"), F.count("*").alias("n")))
    near = links(of.select("fp")).withColumnRenamed("b", "__b").join(of.select(F.col("fp").alias("a"), F.col("low").alias("la")), "a").join(of.select(F.col("fp").alias("__b"), F.col("low").alias("lb")), "__b")
    equal = join_split(distinct.select("k", "fp"), of.select("fp", "low"), "fp", of).where("k <> low")
    tried = cut(near.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).unionByName(equal.select(F.col("low").alias("a"), F.col("k").alias("b"))).distinct())
    prefix = distinct.select("k", "n", F.posexplode("prefix").alias("pos", "h"))
    shared = bounded_broadcast(cut(prefix.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")), 16)
    # From here on, only what shares a shingle of its prefix. Tables of few rows stay in few partitions, and are broadcast.
    prefix = cut(prefix.join(shared, "h", "left_semi"))
    tasks = tasks_for(prefix.count())
    prefix, tried = prefix.coalesce(tasks), packed(tried)
    check = lambda pairs: packed(cut(verified(pairs, docs, distinct, width, similarity)))
    components = lambda links: bounded_broadcast(packed(cut(connected_components(links))), 24)
    untried = lambda pairs: packed(cut(pairs.join(bounded_broadcast(tried, 24), ["a", "b"], "left_anti")))
    done = check(tried)
    comp = components(done)

    def rooted() -> DataFrame:
        return prefix.join(comp, prefix["k"] == comp["node"], "left").select("k", "n", F.coalesce("root", "k").alias("root"), "pos", "h")

    for _ in range(HUB_ROUNDS):
        pairs = untried(hub_pairs(rooted(), similarity, tasks))
        more = check(pairs)
        if more.isEmpty():
            break
        tried, done = cut(tried.unionByName(pairs)), cut(done.unionByName(more))
        comp = components(done)
    rest = check(untried(prefix_pairs(rooted(), similarity)))
    comp = components(done.unionByName(rest))
    named = cut(distinct.join(comp, distinct["k"] == comp["node"], "left").select("k", "first", "copies", F.coalesce("root", "k").alias("root")))
    roots = cut(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    ids = cut(join_split(named.select("k", "root"), roots.drop("n"), "root", roots).select("k", "component_id"))
    return join_split(sets.select("doc_id", "k"), ids, "k", named.select("k", F.col("copies").alias("n"))).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each component, the one of smallest doc_id; all columns and its repeated rows stay.

    Rows with a null doc_id stay too: they cannot be told apart.
    """
    gone = similar_documents(docs, width, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
