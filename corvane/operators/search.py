"""Full-text search: BM25 over folded tokens, phrases, term statistics, symbol lookup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once, tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def weight(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _is(word: str) -> Callable[[Column], Column]:
    return lambda x: x == word


def bm25(chunks: DataFrame, key: str, text: str, terms: list[str], limit: int = 10) -> DataFrame:
    """The limit best rows for the terms, joined by OR: key, score (6 places), best first, ties by key.

    Counts of the few query terms are taken inside each row, so nothing is exploded or shuffled but one row of corpus
    statistics and the top rows.
    """
    terms = list(dict.fromkeys(terms))
    t = once(chunks.select(key, text), "t", tokens(F.col(text)))
    rows = t.select(key, F.size("t").alias("len"), *(F.size(F.filter("t", _is(q))).alias(f"f{i}") for i, q in enumerate(terms)))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("average"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + F.when(F.col(f"f{i}") > 0, idf(F.col("n"), F.col(f"d{i}")) * weight(F.col(f"f{i}"), F.col("len"), F.col("average"))).otherwise(0.0)
    any_ = F.greatest(*(F.col(f"f{i}") for i in range(len(terms))), F.lit(0))
    return rows.where(any_ > 0).join(F.broadcast(stats)).select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def phrase(chunks: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """Rows that hold the words next to each other: key, n occurrences."""
    t = once(chunks.select(key, text), "t", tokens(F.col(text)))
    n = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size("t"), F.lit(1))), lambda i: F.slice("t", i, len(words)) == F.array(*map(F.lit, words))))
    return t.select(key, F.when(F.size("t") >= len(words), n).otherwise(0).cast("long").alias("n")).where("n > 0")


def term_stats(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(term, tf, df) over the corpus."""
    t = chunks.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
    return t.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def symbol_like(symbols: DataFrame, name: str, words: list[str], limit: int, order: list[str]) -> DataFrame:
    """Symbols whose name holds a word of three bytes or more, ASCII case folded; earlier words win, then `order`."""
    low = F.translate(F.col(name), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rank = F.lit(None).cast("int")
    for i, w in reversed([(i, w) for i, w in enumerate(words) if len(w.encode()) >= 3]):
        rank = F.when(F.instr(low, w.lower()) > 0, i).otherwise(rank)
    return symbols.withColumn("word", rank).where("word is not null").orderBy("word", *order).limit(limit)
