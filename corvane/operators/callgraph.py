"""Enclosing spans, callers with a confidence label, and callees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_DEFINITIONS = 50


def symbol_parents(symbols: DataFrame) -> DataFrame:
    """Each symbol with parent: the name of the innermost other one that encloses it; the first wins ties.

    Symbols of identical spans become each other's parents. The join is on file_id, with the containment left over.
    """
    o = symbols.select("file_id", F.col("symbol_id").alias("__o"), F.col("name").alias("__name"), F.col("start_line").alias("__s"), F.col("end_line").alias("__e"))
    inside = symbols.join(o, "file_id").where("__o <> symbol_id and __s <= start_line and end_line <= __e")
    best = inside.groupBy("symbol_id").agg(F.min_by("__name", F.struct(F.col("__e") - F.col("__s"), "__o")).alias("parent"))
    return symbols.drop("parent").join(best, "symbol_id", "left")


def call_owners(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each call with caller_symbol_id: the innermost symbol around its line, null at top level."""
    s = symbols.select("file_id", F.col("symbol_id").alias("__o"), F.col("start_line").alias("__s"), F.col("end_line").alias("__e"))
    inside = calls.join(s, "file_id").where("__s <= line and line <= __e")
    best = inside.groupBy("call_id").agg(F.min_by("__o", F.struct(F.col("__e") - F.col("__s"), "__o")).alias("caller_symbol_id"))
    return calls.drop("caller_symbol_id").join(best, "call_id", "left")


def definitions(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(name, defs, n): of each name its first definitions by path and line, so that common names stay bounded."""
    d = symbols.join(files, "file_id").select("name", "path", "kind", "parent", F.col("start_line").alias("line"))
    # Of a very common name each part keeps its first ones before they meet.
    d = d.withColumn("__part", F.pmod(F.xxhash64("path"), F.lit(64)))
    part, whole = (Window.partitionBy(*by).orderBy("path", "line") for by in (("name", "__part"), ("name",)))
    first = d.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= MOST_DEFINITIONS)
    first = first.withColumn("__r", F.row_number().over(whole)).where(F.col("__r") <= MOST_DEFINITIONS)
    return first.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("path", "line", "kind", "parent"))).alias("defs"))


def callers(calls: DataFrame, symbols: DataFrame, files: DataFrame, imports: DataFrame, resolutions: DataFrame, name: str | None = None) -> DataFrame:
    """Calls (of one name, or all) with the definitions they may mean and how sure that is.

    No definition: NoDefinitionIndexed. Some in the caller's file: LikelySameFile. One: UniqueElsewhere. Else those in
    files that the caller's imports of the name, or wildcards, resolve to: one is ImportResolved, more are Ambiguous among
    them, none is Ambiguous among all. caller: the name of the symbol around the call, where calls have its id.
    """
    if "caller_symbol_id" in calls.columns:
        calls = calls.join(symbols.select(F.col("symbol_id").alias("caller_symbol_id"), F.col("name").alias("caller")), "caller_symbol_id", "left")
    if name is not None:
        calls, symbols = calls.where(F.col("callee_name") == name), symbols.where(F.col("name") == name)
    d = definitions(symbols, files).withColumnRenamed("name", "callee_name")
    c = calls.join(files.select("file_id", "path"), "file_id").join(d, "callee_name", "left")
    i = imports.join(resolutions, "import_id").join(files.select(F.col("file_id").alias("target_id"), F.col("path").alias("target")), "target_id")
    named = i.where("imported_name is not null").groupBy("file_id", F.col("imported_name").alias("callee_name")).agg(F.collect_set("target").alias("__named"))
    wild = i.where("is_wildcard").groupBy("file_id").agg(F.collect_set("target").alias("__wild"))
    none = F.array().cast("array<string>")
    c = c.join(named, ["file_id", "callee_name"], "left").join(wild, "file_id", "left")
    c = c.withColumn("__to", F.concat(F.coalesce("__named", none), F.coalesce("__wild", none)))
    same, told = F.filter("defs", lambda x: x["path"] == F.col("path")), F.filter("defs", lambda x: F.array_contains(F.col("__to"), x["path"]))
    c = c.withColumn("__same", same).withColumn("__told", told)
    kind = F.when(F.col("defs").isNull(), "NoDefinitionIndexed").when(F.size("__same") > 0, "LikelySameFile").when(F.size("defs") == 1, "UniqueElsewhere").when(F.size("__told") == 1, "ImportResolved").otherwise("Ambiguous")
    chosen = F.when(F.size("__same") > 0, F.col("__same")).when((F.size("defs") > 1) & (F.size("__told") > 0), F.col("__told")).otherwise(F.col("defs"))
    return c.select("call_id", *(["caller"] if "caller" in c.columns else []), "callee_name", "path", "line", kind.alias("hint"), F.coalesce(F.array_join(F.array_distinct(F.transform(chosen, lambda x: x["path"])), ","), F.lit("")).alias("def_paths"), F.coalesce(F.size(chosen), F.lit(0)).alias("n_defs"))


def callees(calls: DataFrame, symbols: DataFrame, files: DataFrame, caller: str | None = None, limit: int = 30) -> DataFrame:
    """(caller, path, calls): what each named symbol, or the one given, calls: its first rows by path and line, then one row
    per path with calls in order."""
    s = (symbols if caller is None else symbols.where(F.col("name") == caller)).select(F.col("symbol_id").alias("caller_symbol_id"), F.col("name").alias("caller"))
    order = Window.partitionBy("caller").orderBy("path", "line", "callee_name")
    rows = calls.join(s, "caller_symbol_id").join(files, "file_id").select("caller", "path", "line", "callee_name").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= limit)
    return rows.groupBy("caller", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "callee_name"))), lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["callee_name"])), ",").alias("calls"))
