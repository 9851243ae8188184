"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six characters that part words where a contract says [^\x20\x09-\x0D]+.
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is set, one machine's temporary folder serves a local master alone; a cluster without one is a RuntimeError.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Whether Spark drops the files of a query's shuffles when it has ended; read when a DataFrame is made.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a task may have before a table of narrow rows is dealt to more.
ROWS_A_TASK = 50_000


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder, so that a lost executor costs no more than a reread.

    The shuffles behind them are read no more, and their files go at once.
    """
    conf = df.sparkSession.conf
    shared_dir(df.sparkSession)
    before = conf.get(_FREE, "false")
    conf.set(_FREE, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(_FREE, before)


def packed(df: DataFrame) -> DataFrame:
    """df, which is cut, in as few partitions as its number of rows calls for."""
    return df.coalesce(tasks_for(df.count()))


def tasks_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_TASK))


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, UPPER, LOWER)


#: Bytes that a table may have to be broadcast; beyond that its join is shuffled.
MAX_BROADCAST = 64 << 20


def bounded_broadcast(df: DataFrame, row_bytes: Column | int, max_bytes: int = MAX_BROADCAST) -> DataFrame:
    """df with a broadcast hint if its bytes, summed by row_bytes, are at most max_bytes; else df as it is, to be shuffled."""
    each = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    return F.broadcast(df) if (df.agg(F.sum(each.cast("long"))).first()[0] or 0) <= max_bytes else df


#: Keys that count as hot: those of more than a 100,000th of the rows, so that there are at most 100,000 of them.
HOT_KEYS, HOT_LEAST = 100_000, 256


def join_split(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """rows joined to table on key, which is unique and not null in table; hot keys are not dealt to one task.

    Hot keys are told by their counts (key, n) in rows, which are made if not given. There are at most HOT_KEYS of them at any size
    of input, so their part of table, which must have rows of bounded width, is broadcast, and only the other keys are
    shuffled. All inputs are read more than once: cut them first.
    """
    if counts is None:
        counts = cut(rows.groupBy(key).agg(F.count("*").alias("n")))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max(HOT_LEAST, (total or 0) / HOT_KEYS)
    if (most or 0) <= limit:
        return rows.join(table, key)
    hot = F.broadcast(counts.where(F.col("n") > limit).select(key))
    few = F.broadcast(table.join(hot, key, "left_semi"))
    return rows.join(few, key).unionByName(rows.join(hot, key, "left_anti").join(table, key))


def fresh(df: DataFrame) -> str:
    """A prefix that no column of df starts with, for columns of ours beside it."""
    p = "_"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out here, once per row: nothing is folded through an explode."""
    return df.withColumn(name, F.explode(F.array(value)))


def crc_mod(doc_id: Column, mod: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def by_key(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """One frame per run of equal keys; the rows must come sorted by the keys. Holds one run and one batch at a time."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(batch)]
        for i, j in zip(cuts, cuts[1:]):
            part = batch.iloc[i:j]
            if rest and i == 0 and (rest[0][keys].to_numpy()[0] != k[0]).any():
                yield rest[0] if len(rest) == 1 else pd.concat(rest, ignore_index=True)
                rest = []
            elif rest and i:
                yield rest[0] if len(rest) == 1 else pd.concat(rest, ignore_index=True)
                rest = []
            rest.append(part)
    if rest:
        yield rest[0] if len(rest) == 1 else pd.concat(rest, ignore_index=True)


def arrow_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table per run of equal keys (a long column without nulls); the rows must come sorted by it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if rest and rest[0].column(key)[0].as_py() != k[i]:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(i, j - i))
    if rest:
        yield pa.Table.from_batches(rest)


def rows_of(batch: pa.RecordBatch, kept: Sequence[str], made: dict[str, pa.Array], at: Sequence[int] | np.ndarray | None = None) -> pa.RecordBatch:
    """The kept columns of a batch, at these positions or whole, and made ones after them.

    Kept columns pass as they are in Arrow, so that ids beyond 2^53 beside nulls, and ids of any type, stay exact.
    """
    cols = [batch.column(c) for c in kept]
    if at is not None:
        where = pa.array(at, pa.int64())
        cols = [c.take(where) for c in cols]
    return pa.RecordBatch.from_arrays([*cols, *made.values()], names=[*kept, *made])


#: Edges that one task joins up before any are shuffled.
EDGES_A_TASK = 100_000


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as others of the same components: each node beside the smallest that it reaches, over EDGES_A_TASK edges at a time."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def out() -> pa.RecordBatch:
        nodes = [x for x in up if top(x) != x]
        made = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["u", "v"])
        up.clear()
        return made

    held = 0
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = top(u), top(v)
            up[max(a, b)] = min(a, b)
            held += 1
            if held == EDGES_A_TASK:
                yield out()
                held = 0
    yield out()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b), longs; root is the smallest node of its component.

    Each task first replaces the edges it has by a forest of stars; a graph that one task may hold is done then. Else it
    alternates large-star and small-star steps; each round is written to the shared folder, and only a count and a
    checksum come to the driver. Every step groups with partial aggregation and joins one row per node; a join
    at a node of very many links is left to AQE to split. No edges give no rows; self-links and repeats are ignored. RuntimeError if it does not settle.
    """
    e = cut(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")))
    n = e.count()
    e = cut(e.coalesce(max(1, -(-n // EDGES_A_TASK))).mapInArrow(_forests, "u long, v long"))
    if n > EDGES_A_TASK:
        e = _settled(cut(e.distinct()), max_rounds)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _settled(e: DataFrame, max_rounds: int) -> DataFrame:
    """Large-star and small-star steps over edges (u, v), v the smaller, until nothing changes."""

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(e)
    for _ in range(max_rounds):
        if not now[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        e = cut(pairs.select("p.u", "p.v").where("u <> v").distinct())
        before, now = now, state(e)
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return e
