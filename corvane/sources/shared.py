"""The folder that driver and executors share, and what a table's files are."""

from __future__ import annotations

import hashlib
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; unset, a temporary folder for a local master alone, as a cluster's machines would not share it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of path and of the names, sizes and times of its files, whose contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    each = F.xxhash64("path", "length", F.col("modificationTime").cast("double"))
    n, total = f.agg(F.count("*"), F.sum(each.cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{path} {n} {total}".encode()).hexdigest()[:32]


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
