"""Files of a source tree, walked by its ignore files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..operators.ignore import rules, walk


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, uri, size, mtime_ms) of every file below root, hidden ones too: names, sizes and times alone pass the driver."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(conf)
    base = fs.makeQualified(at).toString().rstrip("/") + "/"
    found, rows = fs.listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        uri = f.getPath().toString()
        rows.append((uri.removeprefix(base), uri, f.getLen(), f.getModificationTime()))
    return spark.createDataFrame(rows, "path string, uri string, size long, mtime_ms long")


def with_content(listed: DataFrame) -> DataFrame:
    """listed (uri, ...) with content, read in tasks; files that cannot be read are left out."""
    schema = StructType([*listed.schema.fields, StructField("content", BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for i in range(len(b)):
                one = b.iloc[i : i + 1].copy()
                try:
                    system, path = fs.FileSystem.from_uri(one["uri"].iloc[0])
                    with system.open_input_stream(path) as f:
                        one["content"] = [f.read()]
                except OSError:
                    continue
                yield one

    return listed.mapInPandas(run, schema)


def read_files(spark: SparkSession, root: str, max_bytes: int = 2 << 20) -> DataFrame:
    """(path, content, mtime_ms) of the files below root that are walked, without those of more than max_bytes."""
    listed = list_files(spark, root)
    ignoring = with_content(listed.where("path rlike '(^|/)[.]gitignore$' or path = '.git/info/exclude'"))
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string"))
    own = F.col("path") == ".git/info/exclude"
    # Rules of the repository's own exclude file come before those of the root.
    ruled = rules(ignoring.where(own).select(F.lit(".gitignore").alias("path"), text.alias("text"))).withColumn("ord", F.col("ord") - 1_000_000)
    ruled = ruled.unionByName(rules(ignoring.where(~own).select("path", text.alias("text"))))
    kept = walk(listed, ruled).where(F.col("size") <= max_bytes)
    return with_content(kept).select("path", "content", "mtime_ms")
