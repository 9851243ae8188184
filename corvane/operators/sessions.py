"""Session logs: summaries, rollback, permission rules, bursts of events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_regex


def summaries(manifest: DataFrame) -> DataFrame:
    """Steps, distinct paths and the next sequence number of each session."""
    return manifest.groupBy("session").agg(F.count("*").alias("steps"), F.countDistinct("path").alias("paths"), (F.max("seq") + 1).alias("next_seq"))


def rollback(manifest: DataFrame, to: int | None = None) -> DataFrame:
    """What undoing every entry after `to` does to each path: the earliest undone entry decides."""
    m = manifest if to is None else manifest.where(F.col("seq") > to)
    return m.groupBy("session", "path").agg(F.min_by(F.when(F.col("action") == "Create", "remove").otherwise("restore"), "seq").alias("effect"), F.min("seq").alias("seq"))


def verdicts(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule in order that fits each call: tool equal or *, and its pattern, if any, on the argument.

    Without one, and where it says "ask", the verdict is the fallback.
    """
    r = rules.select(F.col("tool").alias("__t"), F.col("pattern").alias("__p"), "action", "ord")
    fits = ((F.col("__t") == "*") | (F.col("__t") == F.col("tool"))) & (F.col("__p").isNull() | F.coalesce(F.expr("arg rlike __rx"), F.lit(False)))
    j = calls.join(F.broadcast(r.withColumn("__rx", glob_regex(F.col("__p")))), fits, "left")
    return j.groupBy("call_id").agg(F.coalesce(F.min_by(F.when(F.col("action") != "ask", F.col("action")).otherwise("fallback"), "ord"), F.lit("fallback")).alias("verdict"))


def bursts(events: DataFrame, key: str, ts_ms: str, gap: int = 600) -> DataFrame:
    """(key, at, n): a window of gap ms opens at an event that no open window holds, and later ones do not extend it.

    One pass over the sorted events of a key, which holds a batch and one open window. Null keys and times take no part.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("k"), F.col(ts_ms).cast("long").alias("t")).where("k is not null and t is not null")
    rows = rows.repartition("k").sortWithinPartitions("k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened, n = None, 0, 0
        for b in batches:
            out: list[tuple] = []
            keys, times = b["k"], b["t"].to_numpy()
            at = 0
            for run_ in pc.run_end_encode(keys).run_ends.to_pylist() if b.num_rows else ():
                k = keys[at].as_py()
                if k != now:
                    if n:
                        out.append((now, opened, n))
                    now, n = k, 0
                while at < run_:
                    if n == 0:
                        opened = int(times[at])
                    end = at + int(np.searchsorted(times[at:run_], opened + gap))
                    n, at = n + end - at, end
                    if at < run_:
                        out.append((now, opened, n))
                        n = 0
            yield _bursts(out, keys.type)
        if n:
            yield _bursts([(now, opened, n)], keys.type)

    return rows.mapInArrow(run, f"k {kind}, at long, n long").withColumnRenamed("k", key)


def _bursts(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    k, at, n = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, kind), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["k", "at", "n"])


def fence_lines(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, part, no, line, state): lines between fences, state 1 in code and 0 outside; fences themselves are left out.

    A line that starts with three backticks toggles, and an open fence runs to the end. Texts are split at their fences
    within the row: part counts the pieces, of which every other is code, and no the lines of a piece.
    """
    t = texts.select(*keys, F.split(F.concat(F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), r"(?<=\n)```[^\n]*(?=\n|\z)").alias("parts"))
    t = t.withColumn("last", F.size("parts") - 1).select(*keys, "last", F.posexplode("parts").alias("part", "p"))
    # A piece starts with the break before its first line and, but for the last one, ends with the break before a fence.
    body = F.when(F.col("part") == F.col("last"), F.col("p")).otherwise(F.left("p", F.length("p") - 1))
    t = t.withColumn("p", body).where("p <> ''")
    return t.select(*keys, "part", (F.col("part") % 2).alias("state"), F.posexplode(F.split(F.expr("substring(p, 2)"), "\n")).alias("no", "line"))


def replay(events: DataFrame, run: str, order: str) -> DataFrame:
    """events with seq, from 0 in each run by order: what a reader that attaches from the start is given."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(run).orderBy(order)) - 1)
