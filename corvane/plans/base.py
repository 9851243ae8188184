"""Where queries and their SQL are registered, and how tables are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def callers_sql(files: str, syms: str, calls: str, imps: str, res: str, caller: str | None = None) -> str:
    more = f"{caller} AS caller, " if caller else ""
    also = ", caller" if caller else ""
    return f"""WITH files AS (SELECT * FROM {files}), d AS (SELECT s.name, f.path, s.line, row_number() OVER (PARTITION BY s.name ORDER BY f.path, s.line) AS r FROM {syms} s JOIN files f USING (file_id)),
d50 AS (SELECT * FROM d WHERE r <= 50), c AS (SELECT c.*, f.path FROM {calls} c JOIN files f USING (file_id)),
told AS (SELECT DISTINCT i.file_id, i.imported_name, i.is_wildcard, f.path AS target FROM {imps} i JOIN {res} r USING (import_id) JOIN files f ON f.file_id = r.target_id),
j AS (SELECT {more}c.call_id, c.callee_name, c.path, c.line, d.path AS dp, d.line AS dl, d.path = c.path AS same, d.path IS NOT NULL AND EXISTS (SELECT 1 FROM told t WHERE t.file_id = c.file_id AND t.target = d.path AND (t.imported_name = c.callee_name OR t.is_wildcard)) AS ok FROM c LEFT JOIN d50 d ON d.name = c.callee_name),
g AS (SELECT call_id{also}, callee_name, path, line, count(dp) AS n, count(*) FILTER (same) AS ns, count(*) FILTER (ok) AS nt, list(struct_pack(p := dp, l := dl) ORDER BY dp, dl) FILTER (dp IS NOT NULL) AS a, list(struct_pack(p := dp, l := dl) ORDER BY dp, dl) FILTER (same) AS s, list(struct_pack(p := dp, l := dl) ORDER BY dp, dl) FILTER (ok) AS t FROM j GROUP BY ALL),
h AS (SELECT *, CASE WHEN n = 0 THEN 'NoDefinitionIndexed' WHEN ns > 0 THEN 'LikelySameFile' WHEN n = 1 THEN 'UniqueElsewhere' WHEN nt = 1 THEN 'ImportResolved' ELSE 'Ambiguous' END AS hint, CASE WHEN n = 0 THEN [] WHEN ns > 0 THEN s WHEN n > 1 AND nt > 0 THEN t ELSE a END AS chosen FROM g)
SELECT call_id{also}, callee_name, path, line, hint, array_to_string(list_sort(list_distinct(list_transform(chosen, lambda x: x.p))), ',') AS def_paths, CAST(len(chosen) AS INTEGER) AS n_defs FROM h"""
