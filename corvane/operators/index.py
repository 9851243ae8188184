"""Index build and incremental update over snapshots of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk

MAX_BYTES, SNIFF = 2 << 20, 4096


def gate(files: DataFrame, content: str = "content") -> DataFrame:
    """files (path, content binary) with text and hash, without those too large, binary or no UTF-8."""
    c = F.col(content)
    ok = files.where(F.octet_length(c) <= MAX_BYTES)
    ok = ok.where(F.expr(f"position(X'00', substring(`{content}`, 1, {SNIFF})) = 0 and is_valid_utf8(cast(`{content}` as string))"))
    return ok.withColumn("path", F.replace("path", F.lit("\\"), F.lit("/"))).withColumn("text", c.cast("string")).withColumn("hash", F.sha2(c, 256)).drop(content)


def diff(seen: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, state): added, changed, same or removed, by path and hash."""
    s, p = seen.select("path", F.col("hash").alias("h")), previous.select("path", F.col("hash").alias("ph"))
    state = F.when(F.col("ph").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.col("h") == F.col("ph"), "same").otherwise("changed")
    return s.join(p, "path", "full").select("path", state.alias("state"))


def without(table: DataFrame, states: DataFrame) -> DataFrame:
    """The rows of a per-path table that an update leaves alone: those of files neither changed nor removed."""
    return table.join(states.where("state in ('changed', 'removed')").select("path"), "path", "left_anti")


def chunks_of(files: DataFrame, window: int = 150, overlap: int = 30) -> DataFrame:
    """Chunks with a content-addressed id: the same id never means another text."""
    c = chunk(files.select("path", "text"), "text", window, overlap)
    return c.select(F.sha2(F.concat_ws("\0", "path", F.col("start_line").cast("string"), "body"), 256).alias("chunk_id"), "path", "start_line", "end_line", F.lit("chunk").alias("kind"), "body")


def update(seen: DataFrame, previous_files: DataFrame, previous_chunks: DataFrame, window: int = 150, overlap: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, chunks, states) after a pass over seen (path, text, hash). Unchanged files are not cut into chunks again."""
    states = diff(seen, previous_files)
    fresh = seen.join(states.where("state in ('added', 'changed')").select("path"), "path", "left_semi")
    return seen.select(previous_files.columns), without(previous_chunks, states).unionByName(chunks_of(fresh, window, overlap)), states


def stats(states: DataFrame, chunks: DataFrame) -> DataFrame:
    s = states.agg(F.count_if(F.col("state") != "removed").alias("scanned"), F.count_if(F.col("state").isin("added", "changed")).alias("indexed"), F.count_if(F.col("state") == "same").alias("skipped"), F.count_if(F.col("state") == "removed").alias("removed"))
    return s.join(F.broadcast(chunks.agg(F.count("*").alias("chunks"))))
