"""The tables of a code graph from files: symbols, calls, imports and what those resolve to, with ids that follow from content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import extract
from ..sources.shared import cut
from .callgraph import call_owners, symbol_parents
from .resolve import resolve


def _id(*parts: str):
    return F.concat_ws(":", *(F.col(p).cast("string") for p in parts))


def tables(files: DataFrame, manifests: DataFrame | None = None, crates: DataFrame | None = None, paths: DataFrame | None = None) -> dict[str, DataFrame]:
    """files, symbols (with parents), calls (with callers), imports and resolutions of files (path, lang, text).

    A file's id is its path, so rows of files that have not changed keep their ids. Each file is read once, and each table is kept in the
    shared folder, as others are made from it. paths: what imports
    may resolve to, by default these files.
    """
    rows = cut(extract.extract(files)).withColumn("file_id", F.col("path"))
    f = cut(files.select(F.col("path").alias("file_id"), "path", "lang"))
    symbols = rows.where("what = 'symbol'").select(_id("path", "start_line", "name", "kind").alias("symbol_id"), "file_id", "kind", "name", "start_line", "end_line").dropDuplicates(["symbol_id"])
    symbols = cut(symbol_parents(cut(symbols)))
    calls = rows.where("what = 'call'").groupBy("file_id", F.col("name").alias("callee_name"), F.col("start_line").alias("line")).agg(F.count("*").alias("times"))
    calls = cut(call_owners(calls.select(_id("file_id", "line", "callee_name").alias("call_id"), "file_id", "callee_name", "line", "times"), symbols))
    imports = rows.where("what = 'import'").select("file_id", "raw_path", F.col("name").alias("imported_name"), "is_wildcard", "module_prefix", F.col("start_line").alias("line"))
    imports = imports.select(_id("file_id", "line", "raw_path", "imported_name").alias("import_id"), "*").dropDuplicates(["import_id"])
    imports = cut(imports)
    asked = imports.join(f, "file_id").select("import_id", F.col("path").alias("importer"), "lang", "raw_path", "imported_name", "is_wildcard", "module_prefix")
    found = cut(resolve(asked, f.select("path") if paths is None else paths, manifests, crates).select("import_id", F.col("path").alias("target_id")))
    return {"files": f, "symbols": symbols, "calls": calls, "imports": imports, "resolutions": found}
