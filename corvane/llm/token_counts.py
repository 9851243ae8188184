"""Token counts with a digest cache.

Stored counts stand in a Parquet table (digest, version, n_tokens). Texts are normalised in ways the tokenizer cannot
see, digested, and joined to the counts of the same tokenizer version; the distinct texts that miss are encoded once each
and appended, and every document takes its count from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_split, scratch
from .tokenizers_ import counter, keeps_white_space, version

SCHEMA = "digest binary, version string, n_tokens long"
#: Bytes of text given to the tokenizer at once.
BATCH = 1 << 20


def normalise(text: Column, collapse: bool) -> Column:
    """A null text is empty; with collapse, runs of ASCII white space become a space."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ") if collapse else text


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none if nothing has been stored yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    cache: a folder that outlives the call, partitioned by tokenizer version; by default one of its own in the shared
    folder. Null and empty texts have 0 bytes and 0 tokens. Copies are encoded once, and so are texts that differ in
    ASCII white space alone if the tokenizer is one that cannot see it. Repeated rows give repeated results; extra columns
    are ignored. Two runs that append the same digest at once do no harm: readers take one row per digest.
    """
    spark, ver = docs.sparkSession, version(tokenizer)
    cache, collapse = cache or scratch(spark, "token-counts"), not keeps_white_space(tokenizer)
    t = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), normalise(F.col("text"), collapse).alias("norm"))
    t = t.withColumn("digest", F.unhex(F.sha2("norm", 256)))
    places = cut(t.select("doc_id", "n_bytes", "digest"))

    def stored() -> DataFrame:
        return read_cache(spark, cache).where(F.col("version") == ver).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    # One text per digest: copies in a partition meet before the shuffle, so a hot text is sent once per partition.
    misses = t.select("digest", "norm").join(stored().select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("norm").alias("norm"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer)
        for b in batches:
            texts, counts, part, size = b["norm"].tolist(), [], [], 0
            for x in texts:
                part.append(x)
                size += len(x)
                if size > BATCH:
                    counts += count(part)
                    part, size = [], 0
            counts += count(part)
            yield pd.DataFrame({"digest": b["digest"], "version": ver, "n_tokens": counts})

    misses.mapInPandas(run, SCHEMA).write.mode("append").partitionBy("version").parquet(cache)
    out = join_split(places, stored(), "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
