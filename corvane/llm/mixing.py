"""Mixing sources to target weights: sizes per source, repetition rates, and hash-seeded copies.

A document's size is its number of words. Sources by code point, null last, weigh WEIGHTS, repeating; together they share
`share` of all sizes by weight, none more than `most` times its own size, the rest being dealt anew by weight until no
source is above that. A source's rate is its target over its size. Each document is emitted floor(rate) times, and once
more if a hash of it and the seed, read as a number from 0 to 1, lies below the fraction; so reruns agree and no document depends
on another.

A null text has size 0 and, like a text without words, is emitted by its source's rate all the same. A source without words
has rate 0. Rows that agree in doc_id, source and text share their number of copies; a null doc_id is one like any other.
Columns of the input keep their values. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, join_split

#: Fixed by the contract of the query.
WEIGHTS, SHARE, MOST = (5, 2, 1), (3, 2), 2
SEED = 12
WORD = r"[^\x20\x09-\x0D]+"
#: 52 bits of a digest are read as a number.
BITS = 52


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, source: Column, text: Column, seed: int) -> Column:
    """A number from 0 to 1 that follows from the row and the seed."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), doc_id.cast("string"), source, F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.left(digest, F.lit(BITS // 4)), 16, 10).cast("long") / F.lit(float(1 << BITS))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df in a global order, with the sum of each value over the rows before. Rows never meet in one task: every range sums
    its own rows, and ranges, one per partition, are joined to the sums of those before them."""
    ranged = cut(df.withColumns({f"{k}__": v for k, v in sums.items()}).orderBy(*order).withColumn("part__", F.spark_partition_id()))
    totals = ranged.groupBy("part__").agg(*(F.sum(f"{k}__").alias(f"{k}__") for k in sums))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    totals = totals.select("part__", *(F.coalesce(F.sum(f"{k}__").over(before), F.lit(0)).alias(f"{k}_base") for k in sums))
    inside = Window.partitionBy("part__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(totals), "part__")
    return out.select(*df.columns, *((F.col(f"{k}_base") + F.coalesce(F.sum(f"{k}__").over(inside), F.lit(0))).alias(k) for k in sums))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) of sources (source, source_size): one row each.

    By rising cap over weight the sources that are stopped come first: one is stopped if its cap is at most its weight's part of
    what those before it leave. All sums are whole numbers, so a target is rounded once.
    """
    ranked = running(sources, [F.col("source").asc_nulls_last()], {"at": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("long")
    cap = (F.col("source_size") * most * share[1]).cast("decimal(38,0)")
    ranked = cut(ranked.select("source", "source_size", weight.alias("weight")).withColumn("cap", cap))
    total, all_weight = ranked.agg(F.sum(F.col("source_size").cast("decimal(38,0)")) * share[0], F.sum("weight")).first()
    if all_weight is None:
        return ranked.select("source", "source_size", "weight", F.lit(0.0).alias("target"))
    r = running(ranked, [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()], {"caps": F.col("cap"), "weights": F.col("weight")})
    left, rest = F.lit(total).cast("decimal(38,0)") - F.col("caps"), F.lit(all_weight) - F.col("weights")
    r = cut(r.withColumn("stopped", F.col("cap") * rest <= left * F.col("weight")))
    caps, stopped = r.where("stopped").agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    shared = (F.lit(total - int(caps)).cast("decimal(38,0)").cast("double") * F.col("weight").cast("double")) / F.lit(float(max(all_weight - stopped, 1) * share[1]))
    return r.select("source", "source_size", "weight", F.when(F.col("stopped"), (F.col("source_size") * most).cast("double")).otherwise(shared).alias("target"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def measure(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, key, size, u) of each document, kept in the shared folder: texts are read once for the plan."""
    u = draw(F.col("doc_id"), F.col("source"), F.col("text"), seed)
    return cut(docs.select("doc_id", "source", _key(F.col("source")).alias("key"), size_of(F.col("text")).alias("size"), u.alias("u")))


def rates(measured: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """(key, source_size, target, rate, n): a row per source, n its documents."""
    sums = cut(measured.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    t = targets(sums.select("source", "source_size"), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return cut(t.select(_key(F.col("source")).alias("key"), "source_size", "target", rate.alias("rate")).join(sums.select("key", "n"), "key"))


def copies(rate: Column, u: Column) -> Column:
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _joined(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with their source's rate: a broadcast while the sources are few by their bytes, else a shuffle with hot sources split."""
    few = bounded_broadcast(table, F.octet_length("key") + 64)
    return rows.join(few, "key") if few is not table else join_split(rows, table.drop("n"), "key", table.select("key", "n"))


def plan(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): a row per document."""
    d = measure(docs, seed)
    return _joined(d, rates(d, weights, share, most)).select("doc_id", "source", "size", "source_size", "target", copies(F.col("rate"), F.col("u")).alias("copies"))


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: rows of docs, whole, each as often as its copies say."""
    u = draw(F.col("doc_id"), F.col("source"), F.col("text"), seed)
    rows = docs.select(F.struct("*").alias("row"), _key(F.col("source")).alias("key"), u.alias("u"))
    out = _joined(rows, rates(measure(docs, seed), weights, share, most)).withColumn("n", copies(F.col("rate"), F.col("u")))
    return out.where("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("row.*")
