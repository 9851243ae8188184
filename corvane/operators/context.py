"""Evidence for a question: promotion of whole files, assembly under a budget, hand-off, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def promote(hits: DataFrame, sizes: DataFrame, most: int = 3, max_bytes: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(promoted paths with rank, remaining hits). hits: grp, rank, path. The first paths whose file is small enough."""
    w = Window.partitionBy("path").orderBy("grp", "rank")
    first = hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("path", "grp", "rank")
    small = first.join(sizes.where(F.col("bytes") <= max_bytes), "path").orderBy("grp", "rank", "path").limit(most)
    return small.select("path", "grp", "rank", "bytes"), hits.join(small.select("path"), "path", "left_anti")


def assemble(blocks: DataFrame, budget: int, by: str | None = None) -> DataFrame:
    """The ranks kept per group `by`: in order, a block that does not fit is skipped and later ones may still fit.

    blocks: rank, bytes. A few dozen blocks make a context, so the fold over their sorted array stays in one row.
    """
    group = [by] if by else []
    rows = blocks.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rank", "bytes"))).alias("b"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
    fit = F.aggregate("b", start, lambda a, x: F.when(a["used"] + x["bytes"] <= budget, F.struct((a["used"] + x["bytes"]).cast("long").alias("used"), F.concat(a["kept"], F.array(x["rank"].cast("int"))).alias("kept"))).otherwise(a))
    return rows.select(*group, fit["used"].alias("used"), F.array_join(F.transform(fit["kept"], lambda x: x.cast("string")), ",").alias("kept"))


def context_budget(num_ctx: Column, fraction: float = 0.55) -> Column:
    return (F.floor(num_ctx * F.lit(fraction)) * 4).cast("long")


def prompt_bucket(num_ctx: Column, chars: Column) -> Column:
    """The next power of two that holds a quarter of the characters and 2048 more; at least 2048, at most num_ctx."""
    need = F.floor(chars / 4) + 2048
    return F.least(F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2(need.cast("double")))), F.lit(2048.0)).cast("long"), num_ctx.cast("long"))


def handoff(stages: DataFrame, key: str, order: str, name: str, body: str, budget: int) -> DataFrame:
    """(key, tail, n_chars): of all stages' blocks in order as one text per key, the tail within the budget of characters.

    Each block has a header, so that the tail lies in a bounded number of last blocks; only those are put together.
    """
    block = F.concat(F.lit("--- "), F.upper(F.col(name)), F.lit(" ---\n"), F.coalesce(F.col(body), F.lit("")), F.lit("\n"))
    s = stages.select(key, F.col(order).alias("__o"), block.alias("__b")).withColumn("__n", F.length("__b"))
    last = s.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__o")))).where(F.col("__r") <= budget // 10 + 1)
    before = Window.partitionBy(key).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    tail = last.withColumn("__after", F.coalesce(F.sum("__n").over(before), F.lit(0))).where(F.col("__after") < budget)
    tail = tail.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__o", "__b"))).alias("__t"))
    total = s.groupBy(key).agg(F.sum("__n").cast("int").alias("n_chars"))
    return total.join(tail, key).select(key, F.right(F.array_join("__t.__b", ""), F.lit(budget)).alias("tail"), "n_chars")


def slots(models: DataFrame, group: str, size: str, order: str, room: float, fraction: float = 0.7, each: int = 3) -> DataFrame:
    """(group, slots): how many of a group's models fit into a part of the room, smallest first, times the calls of each; one at least.

    Models of no size do not count against the room. Of a large group only as many rows are ranked as can fit.
    """
    least = models.groupBy(group).agg(F.min(size).alias("__least"), F.count("*").alias("__all"))
    fit = F.floor(F.lit(room * fraction) / F.greatest(F.col("__least"), F.lit(1))) + 1
    w = Window.partitionBy(group).orderBy(size, order)
    ranked = models.join(least, group).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= fit)
    ranked = ranked.withColumn("__s", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.groupBy(group).agg((F.greatest(F.lit(1), F.count_if(F.col("__s") <= room * fraction)) * each).cast("long").alias("slots"))


def rendered_plan(plan: Column) -> Column:
    """A plan's steps, one to a line, with a box that is ticked where the step is done; plan is JSON."""
    steps = F.from_json(plan, "struct<steps:array<struct<text:string,status:string>>>")["steps"]
    return F.array_join(F.transform(steps, lambda s: F.concat(F.when(s["status"] == "done", "[x] ").otherwise("[ ] "), s["text"])), "\n")
