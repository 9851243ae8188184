"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next one's docs. All but the last keep the columns of documents. A kept document keeps its
columns; line dedup alone changes text (and n_chars with it). SQL cannot express the first stage: see ORACLE_SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, language_id, line_dedup, packing, simhash
from corvane.llm.common import scratch, table
from corvane.llm.queries import ID_TOKENIZER


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts, texts without a letter and texts that no language fits clearly go."""
    return language_id.keep_identified(docs, language_id.fit(language_id.training_rows(docs)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or nearly equals go; a document left without a word goes with them."""
    out = line_dedup.dedup_lines(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by a Jaccard similarity of 0.8 or more on five words, the document of smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs, width=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, ID_TOKENIZER)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("simhash_dedup", dedup_documents), ("decontamination", drop_benchmark), ("packing", pack)]

#: Compression sizes and token ids have no SQL; tests hold the pipeline against one in plain Python, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
