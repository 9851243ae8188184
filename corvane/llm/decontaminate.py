"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned with windows of document words.

DataFrame functions only. Document windows are joined to benchmark windows on the joined words themselves, so that the
hash lookup's own equality test verifies each hit. The benchmark side is broadcast only after its bytes are summed and
found within max_broadcast_bytes; beyond that the same join is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, held

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Window starts per piece of a document: bounds what one row holds, however long the text is.
PIECE = 4096


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(key, len, items): each distinct window of the items, with the sorted ids (as strings) of the items it is in.

    An item of fewer than size words, but not none, is one window. Null texts have no windows; a null item_id counts as
    the id "null"; repeated items count once.
    """
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("w"))
    n = F.size("w")
    grams = F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, size), " "))).otherwise(F.array(F.array_join("w", " ")))
    rows = w.where(n > 0).select("item", F.least(n, F.lit(size)).alias("len"), F.explode(grams).alias("key"))
    return rows.groupBy("key", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, max_broadcast_bytes: int = 256 << 20) -> DataFrame:
    """(doc_id, h, n_words, n_hit, spans, items, copies) for each document.

    spans: merged word ranges [start, end) covered by benchmark windows; items: sorted ids of the items found. Null and
    empty texts have no words and so no hits. Rows with the same doc_id and text give one row, with their number as copies
    and xxhash64(text) as h; extra columns are ignored.
    """
    found = benchmark_windows(benchmark, size)
    bytes_, lens = found.agg(F.sum(F.octet_length("key") + 64 + 24 * F.size("items")), F.collect_set("len")).first()
    side = found.select("key", "items")
    if (bytes_ or 0) <= max_broadcast_bytes:
        side = F.broadcast(side)
    w = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    n, most = F.size("w"), max([size, *lens])
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / PIECE).cast("int")), lambda c: F.struct((c * PIECE).alias("base"), F.slice("w", c * PIECE + 1, PIECE + most - 1).alias("ws")))
    p = w.select("doc_id", "h", n.alias("n"), F.explode(pieces).alias("p")).select("doc_id", "h", "n", "p.base", "p.ws")

    def grams(k: int) -> Column:
        starts = F.least(F.lit(PIECE), F.size("ws") - k + 1)
        return F.when(starts > 0, F.transform(F.sequence(F.lit(1), F.greatest(starts, F.lit(1))), lambda i: F.struct(F.array_join(F.slice("ws", i, k), " ").alias("key"), (F.col("base") + i - 1).alias("pos"), F.lit(k).alias("len")))).otherwise(F.array().cast("array<struct<key:string,pos:int,len:int>>"))

    # One row more for each document, under a key that no window has, brings its word count through the same join.
    own = F.when(F.col("base") == 0, F.array(F.struct(F.concat(F.lit("\n"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"), F.lit(-1).alias("pos"), F.lit(0).alias("len")))).otherwise(F.array().cast("array<struct<key:string,pos:int,len:int>>"))
    rows = p.select("doc_id", "h", "n", F.explode(F.concat(own, *(grams(k) for k in sorted(lens)))).alias("g")).select("doc_id", "h", "n", "g.key", "g.pos", "g.len")
    hits = rows.join(side, "key", "left").where("items is not null or pos = -1")
    spans = F.array_sort(F.collect_list(F.when(F.col("items").isNotNull(), F.struct("pos", (F.col("pos") + F.col("len")).alias("end")))))
    # The marker row comes once for each repeated row.
    out = hits.groupBy("doc_id", "h", "n").agg(spans.alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count_if(F.col("pos") == -1).alias("copies"))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda x: F.sequence(x["pos"], x["end"] - 1)))))
    out = held(out, "at", places)
    first = F.filter("at", lambda p, i: F.coalesce(F.get("at", i - 1) != p - 1, F.lit(True)))
    last = F.filter("at", lambda p, i: F.coalesce(F.get("at", i + 1) != p + 1, F.lit(True)))
    merged = F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
    return out.select("doc_id", "h", F.col("n").cast("long").alias("n_words"), F.size("at").cast("long").alias("n_hit"), merged.alias("spans"), "items", "copies")


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row; see find_hits for the edge cases."""
    hits = find_hits(docs, benchmark, size)
    hits = hits.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "documents") -> DataFrame:
    """docs without benchmark passages, all columns kept.

    remove="documents" drops each document with a hit. remove="spans" keeps every document; a text with hits becomes its
    normalised words without the covered ones, joined by spaces, and other texts stay as they are. A repeated row is
    treated as its twin is. Null texts stay null.
    """
    p = fresh(docs)
    hit = find_hits(docs, benchmark, size).where("n_hit > 0").select(F.col("doc_id").alias(f"{p}hit_id"), F.col("h").alias(f"{p}hit_h"), F.col("spans").alias(f"{p}hit_spans"))
    on = F.col("doc_id").eqNullSafe(F.col(f"{p}hit_id")) & (F.xxhash64("text") == F.col(f"{p}hit_h"))
    if remove == "documents":
        return docs.join(hit, on, "left_anti")
    if remove != "spans":
        raise ValueError(f"remove: {remove}")
    out = held(docs.join(hit, on, "left"), f"{p}words", F.when(F.col(f"{p}hit_spans").isNotNull(), words(F.col("text"))))
    gone = F.flatten(F.transform(f"{p}hit_spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size(f"{p}words") - 1), gone)
    cleaned = F.when(F.col(f"{p}hit_spans").isNotNull(), F.array_join(F.transform(left, lambda i: F.get(f"{p}words", i)), " ")).otherwise(F.col("text"))
    return out.select(*(cleaned.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
