"""Full-text search over a stored index: posting blocks in Parquet, read by term, skipped by their best score.

Documents are dealt into ranges. A block holds the postings of one term in one range: keys, term
frequencies, lengths and positions, and beside them what bounds the weight of any of its postings: the highest frequency
and the lowest length for one occurrence. Blocks lie in folders by a hash of the term, sorted by term, so that a search
opens the folders of its terms and the row groups that hold them. As the blocks of all terms share their ranges, the sum of
a range's bounds is the most that a document in it can score: a search looks into the ranges of highest bound, takes the
kth score found there, and then into those ranges alone whose bound reaches it.

An index is a table of a snapshot store: each append adds a segment, and merge makes one of all, less keys to be dropped.
Keys are unique over all segments. Scores are those of search.bm25 over all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import query_words, tokens
from ..sources.shared import cut
from ..sources.snapshots import Snapshot, Store
from .search import B, K1, LEAST_IDF, idf, weight

#: Folders by hash of the term; documents and words in a range at most, but for a longer document; tasks that a folder is written by.
FOLDERS, RANGE, MOST_WORDS, WRITERS = 32, 2048, 4_000_000, 8
#: Ranges that are looked into first, to find a kth score.
FIRST = 8
#: Bytes that the ranges of a merge, with the keys that they lose, may have to be broadcast.
MAX_BROADCAST = 64 << 20


def folder_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def blocks_of(docs: DataFrame, key: str, text: str, per_range: int = RANGE) -> DataFrame:
    """(folder, term, range, n, occurrences, most_tf, least_ratio, keys, tfs, lens, positions): one row per term and range.

    A range is a run of documents of one task, so that texts are not shuffled and a range's blocks are built at once. A row
    without a term holds a range's documents, with their lengths.
    """
    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("t"))
    schema = f"term string, range long, n int, occurrences long, most_tf int, least_ratio double, keys array<{kind}>, tfs array<int>, lens array<int>, positions array<array<int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows, words = TaskContext.get().partitionId() << 32, [], 0, 0
        for b in batches:
            ends = np.cumsum(b["t"].value_lengths().to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_WORDS - words)) + 1
                to = max(at + 1, min(b.num_rows, at + per_range - rows, most))
                held.append(b.slice(at, to - at))
                rows, words, at = rows + to - at, words + int(ends[to - 1] - (ends[at - 1] if at else 0)), to
                if rows >= per_range or words >= MOST_WORDS:
                    yield _blocks(held, number)
                    number, held, rows, words = number + 1, [], 0, 0
        if held:
            yield _blocks(held, number)

    return d.mapInArrow(run, schema).withColumn("folder", folder_of(F.col("term")))


def _blocks(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
    """The blocks of one range."""
    t = pa.Table.from_batches(parts).sort_by("key").combine_chunks()
    keys = t["key"].combine_chunks()
    lists = t["t"].combine_chunks()
    lens = lists.value_lengths().to_numpy()
    words = lists.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(lens)), lens)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(lens) - lens, lens)
    ids = words.indices.to_numpy()
    order = np.lexsort((place, doc, ids))
    ids, doc, place = ids[order], doc[order], place[order]
    new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (doc[1:] != doc[:-1])]) if len(ids) else np.zeros(0, int)  # of postings
    tf = np.diff(np.r_[new, len(ids)])
    of, at = ids[new], doc[new]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)  # of terms
    each = lambda f, x, kind: f.reduceat(x, first).astype(kind) if len(first) else np.zeros(0, kind)
    size = lens[at]
    # Documents come last, as postings of no term.
    n = np.r_[np.diff(np.r_[first, len(of)]), len(lens)]
    bounds = pa.array(np.r_[0, np.cumsum(n)], pa.int32())
    whole = lambda x: pa.ListArray.from_arrays(bounds, x)
    positions = pa.ListArray.from_arrays(pa.array(np.r_[new, np.full(len(lens) + 1, len(ids))], pa.int32()), pa.array(place, pa.int32()))
    with_docs = lambda x, y: pa.array(np.r_[x, y], pa.int32())
    made = {
        "term": pa.concat_arrays([words.dictionary.take(pa.array(of[first])), pa.nulls(1, words.dictionary.type)]), "range": pa.array(np.full(len(n), number), pa.int64()), "n": pa.array(n, pa.int32()),
        "occurrences": pa.array(np.r_[each(np.add, tf, np.int64), lens.sum()], pa.int64()), "most_tf": with_docs(each(np.maximum, tf, np.int32), 0), "least_ratio": pa.array([*each(np.minimum, size / tf, float), None], pa.float64()),
        "keys": whole(pa.concat_arrays([keys.take(pa.array(at)), keys])), "tfs": whole(with_docs(tf, np.zeros(len(lens), int))), "lens": whole(with_docs(size, lens)), "positions": whole(positions),
    }
    return pa.RecordBatch.from_arrays(list(made.values()), names=list(made))


def _laid_out(blocks: DataFrame, documents: int, per_range: int) -> DataFrame:
    """Tasks by folder, a folder's by several where there are many ranges, as a very common term fills it; sorted by term within each."""
    writers = min(WRITERS, max(1, documents // per_range // 16))
    return blocks.repartition(FOLDERS * writers, "folder", F.pmod(F.xxhash64("range"), F.lit(writers))).sortWithinPartitions("folder", "term", "range")


def append(store: Store, docs: DataFrame, key: str = "key", text: str = "text", per_range: int = RANGE) -> Snapshot:
    """A segment of docs, whose keys must be in no other. Null keys take no part; a null text counts as a document of no words."""
    base = store.open_or_init()
    docs = docs.where(F.col(key).isNotNull())
    n = docs.count()
    blocks = _laid_out(blocks_of(docs, key, text, per_range), n, per_range)
    return store.commit(base, add={"blocks": blocks}, partition_by={"blocks": ["folder"]})


def documents(blocks: DataFrame) -> DataFrame:
    """(key, len) of every document."""
    here = blocks.where((F.col("folder") == folder_of(F.lit(None).cast("string"))) & F.col("term").isNull())
    return here.select(F.inline(F.arrays_zip("keys", "lens"))).withColumnsRenamed({"keys": "key", "lens": "len"})


def _parts(snapshot: Snapshot) -> DataFrame:
    """The blocks of every segment, with its number."""
    return reduce(DataFrame.unionByName, [p.withColumn("segment", F.lit(i)) for i, p in enumerate(snapshot.parts("blocks"))])


def merge(store: Store, drop: DataFrame | None = None, per_range: int = RANGE) -> Snapshot:
    """One segment of all, without the keys of drop (key). Texts are not read again, and blocks stay whole: a range goes as it is, less
    what it loses, into a range that may hold others, of fewer than per_range documents before it."""
    base = store.open()
    blocks = _parts(base)
    here = blocks.where((F.col("folder") == folder_of(F.lit(None).cast("string"))) & F.col("term").isNull())
    # A row per range, of which there is one for some thousand documents.
    filled = F.sum(F.greatest(F.col("n") / per_range, F.col("occurrences") / MOST_WORDS)).over(Window.orderBy("segment", "range").rowsBetween(Window.unboundedPreceding, -1))
    to = here.select("segment", "range", "n", F.floor(F.coalesce(filled, F.lit(0))).cast("long").alias("to"))
    none = F.array().cast(blocks.schema["keys"].dataType)
    if drop is None:
        to = to.withColumn("gone", none)
    else:
        lost = here.select("segment", "range", F.explode("keys").alias("key")).join(drop.select("key").distinct(), "key", "left_semi")
        to = to.join(lost.groupBy("segment", "range").agg(F.collect_list("key").alias("gone")), ["segment", "range"], "left").withColumn("gone", F.coalesce("gone", none))
    # Ranges that stay by themselves, which most are where segments are large, need no grouping: their blocks are only laid out.
    to = cut(to.withColumn("shared", F.count("*").over(Window.partitionBy("to")) > 1))
    n, bytes_ = to.agg(F.sum(F.col("n") - F.size("gone")), F.sum(F.lit(48) + 24 * F.size("gone"))).first()
    to = F.broadcast(to) if (bytes_ or 0) <= MAX_BROADCAST else to
    entries = F.arrays_zip("keys", "tfs", "lens", "positions")
    left = F.when(F.size("gone") == 0, entries).otherwise(F.filter(entries, lambda x: ~F.array_contains("gone", x["keys"])))
    b = blocks.join(to.drop("n"), ["segment", "range"]).select("term", F.col("to").alias("range"), "shared", left.alias("e")).where(F.size("e") > 0)
    grouped = b.where("shared").groupBy("term", "range").agg(F.array_sort(F.flatten(F.collect_list("e"))).alias("e"))
    b = b.where("not shared").select("term", "range", "e").unionByName(grouped)
    ratio = F.array_min(F.transform(F.filter("e", lambda x: x["tfs"] > 0), lambda x: x["lens"] / x["tfs"]))
    counted = F.when(F.col("term").isNull(), F.col("e.lens")).otherwise(F.col("e.tfs"))
    b = b.select(
        "term", "range", F.size("e").alias("n"), F.aggregate(counted, F.lit(0).cast("long"), lambda a, x: a + x).alias("occurrences"), F.array_max("e.tfs").alias("most_tf"), ratio.alias("least_ratio"),
        "e.keys", "e.tfs", "e.lens", "e.positions", folder_of(F.col("term")).alias("folder"),
    )
    return store.commit(base, replace={"blocks": _laid_out(b, n or 0, per_range)}, partition_by={"blocks": ["folder"]})


@dataclass(frozen=True)
class Index:
    """An open index: its blocks, of every segment, with the number of documents and their average length."""

    spark: SparkSession
    blocks: DataFrame
    n: int
    average: float


def open_index(snapshot: Snapshot) -> Index:
    blocks = _parts(snapshot)
    here = blocks.where((F.col("folder") == folder_of(F.lit(None).cast("string"))) & F.col("term").isNull())
    n, words = here.agg(F.sum("n"), F.sum("occurrences")).first()
    return Index(snapshot.spark, blocks, n or 0, (words or 0) / n if n else 0.0)


def of_terms(index: Index, terms: list[str]) -> DataFrame:
    """The blocks of a few terms: folders and terms are literals, so that the scan skips by folder and by row group."""
    spark = index.spark
    folders = sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(folder_of(F.col("term"))).collect()})
    return index.blocks.where(F.col("folder").isin(folders) & F.col("term").isin(terms))


def _bound(index: Index) -> Column:
    """The most that any posting of a block can weigh."""
    return (K1 + 1) / (1 + K1 * ((1 - B) / F.col("most_tf") + B * F.col("least_ratio") / F.lit(index.average)))


def _postings(blocks: DataFrame, *kept: str) -> DataFrame:
    return blocks.select(*kept, "term", F.inline(F.arrays_zip("keys", "tfs", "lens"))).withColumnsRenamed({"keys": "key", "tfs": "tf", "lens": "len"})


def _weighed(index: Index, postings: DataFrame) -> Column:
    return weight(F.col("tf"), F.col("len"), F.lit(index.average))


def bm25(index: Index, terms: list[str], limit: int = 10, first: int = FIRST) -> DataFrame:
    """The limit best documents for the terms, joined by OR: key, score (6 places), best first, ties by key."""
    terms = list(dict.fromkeys(terms))
    schema = f"key {index.blocks.schema['keys'].dataType.elementType.simpleString()}, score double"
    blocks = of_terms(index, terms)
    facts = blocks.groupBy("term").agg(F.sum("n").alias("df")).collect() if terms else []  # a row per term asked for
    if not facts:
        return index.spark.createDataFrame([], schema)
    idfs = {f["term"]: max(math.log((index.n - f["df"] + 0.5) / (f["df"] + 0.5)), LEAST_IDF) for f in facts}
    rare = F.element_at(F.create_map(*(F.lit(x) for t, v in idfs.items() for x in (t, v))), F.col("term"))
    place = F.struct("segment", "range")
    bounds = blocks.groupBy(place.alias("place")).agg(F.sum(rare * _bound(index)).alias("bound"))

    def scored(rows: DataFrame) -> DataFrame:
        p = _postings(rows)
        return p.groupBy("key").agg(F.round(F.sum(rare * _weighed(index, p)), 6).alias("score")).orderBy(F.desc("score"), "key").limit(limit)

    most = bounds.orderBy(F.desc("bound"), "place").limit(first).collect()

    def inside(segment: Column, number: Column) -> Column:
        any_ = F.lit(False)
        for r in most:
            any_ = any_ | ((segment == r.place.segment) & (number == r.place.range))
        return any_

    top = scored(blocks.where(inside(F.col("segment"), F.col("range")))).collect()  # `limit` rows
    found = index.spark.createDataFrame(top, schema)
    least = top[-1]["score"] - 1e-6 if len(top) == limit else -math.inf
    rest = bounds.where(F.col("bound") >= least).select("place").where(~inside(F.col("place.segment"), F.col("place.range")))
    if len(most) < first or rest.isEmpty():
        return found.orderBy(F.desc("score"), "key")
    return scored(blocks.withColumn("place", place).join(rest, "place", "left_semi")).unionByName(found).orderBy(F.desc("score"), "key").limit(limit)


def bm25_batch(index: Index, queries: DataFrame, qid: str, qtext: str, limit: int = 5, first: int = FIRST) -> DataFrame:
    """(qid, key, score, rank): the limit best documents for each query.

    Terms, their blocks and each query's ranges meet in joins; of a query's ranges the best `first` give its kth score, and
    only those ranges are looked into besides whose bound reaches it.
    """
    q = queries.select(qid, F.explode(F.array_distinct(tokens(F.col(qtext)))).alias("term")).withColumn("folder", folder_of(F.col("term")))
    terms = q.select("folder", "term").distinct()
    blocks = index.blocks.join(terms, ["folder", "term"], "left_semi")
    dfs = blocks.groupBy("term").agg(F.sum("n").alias("df")).select("term", idf(F.lit(index.n), F.col("df")).alias("idf"))
    q = q.drop("folder").join(dfs, "term")
    bounds = blocks.select("term", "segment", "range", _bound(index).alias("b")).join(q, "term").groupBy(qid, "segment", "range").agg(F.sum(F.col("idf") * F.col("b")).alias("bound"))
    order = Window.partitionBy(qid).orderBy(F.desc("bound"), "segment", "range")
    ranked = bounds.withColumn("r", F.row_number().over(order))
    best = Window.partitionBy(qid).orderBy(F.desc("score"), "key")

    def scored(places: DataFrame) -> DataFrame:
        p = _postings(blocks.join(q, "term").join(places, [qid, "segment", "range"], "left_semi"), qid, "idf")
        s = p.groupBy(qid, "key").agg(F.round(F.sum(F.col("idf") * _weighed(index, p)), 6).alias("score"))
        return s.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)

    top = scored(ranked.where(F.col("r") <= first).select(qid, "segment", "range"))
    top = cut(top)
    least = top.where(F.col("rank") == limit).select(qid, (F.col("score") - 1e-6).alias("least"))
    rest = ranked.where(F.col("r") > first).join(least, qid, "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    both = top.unionByName(scored(rest.select(qid, "segment", "range"))).drop("rank")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select(qid, "key", "score", "rank")


def phrase(index: Index, words: list[str]) -> DataFrame:
    """(key, n, len): documents that hold the words next to each other, n times, from the positions of the words' blocks.

    Only ranges in which every word occurs are looked into.
    """
    blocks = of_terms(index, words)
    wanted = len(set(words))
    both = blocks.groupBy("segment", "range").agg(F.count("*").alias("k")).where(F.col("k") == wanted).select("segment", "range")
    rows = blocks.join(both, ["segment", "range"], "left_semi").select("term", F.inline(F.arrays_zip("keys", "lens", "positions")))
    places = F.create_map(*(x for w in dict.fromkeys(words) for x in (F.lit(w), F.array(*(F.lit(i) for i, v in enumerate(words) if v == w)))))
    rows = rows.select("keys", "lens", F.explode(F.element_at(places, F.col("term"))).alias("i"), "positions").select("keys", "lens", F.explode(F.transform("positions", lambda p: p - F.col("i"))).alias("start"))
    starts = rows.groupBy("keys", "lens", "start").agg(F.count("*").alias("k")).where(F.col("k") == len(words))
    return starts.groupBy(F.col("keys").alias("key"), F.col("lens").alias("len")).agg(F.count("*").alias("n"))


def match(index: Index, query: str, limit: int = 10) -> DataFrame:
    """The limit best documents for a search string: each of its words is a phrase, and phrases are joined by OR.

    Words part at all but letters, digits and _, and count from two bytes on; a phrase's tokens are those of the index, so
    that foo_bar asks for foo and bar next to each other. A phrase's frequency is its number of occurrences. Without a
    word there is no row. Strings of single-token words go by block bounds alone.
    """
    spark = index.spark
    asked = spark.createDataFrame([(query,)], "q string").select(F.transform(query_words(F.col("q")), tokens).alias("p")).first()["p"]
    phrases = list(dict.fromkeys(tuple(p) for p in asked if p))
    if all(len(p) == 1 for p in phrases):
        return bm25(index, [p[0] for p in phrases], limit)
    rows = None
    for i, p in enumerate(phrases):
        one = phrase(index, list(p)).select(F.lit(i).alias("p"), "key", F.col("n").alias("tf"), "len")
        rows = one if rows is None else rows.unionByName(one)
    rows = cut(rows)
    dfs = rows.groupBy("p").agg(F.count("*").alias("df"))  # a row per phrase of the query
    w = idf(F.lit(index.n), F.col("df")) * weight(F.col("tf"), F.col("len"), F.lit(index.average))
    return rows.join(F.broadcast(dfs), "p").groupBy("key").agg(F.round(F.sum(w), 6).alias("score")).orderBy(F.desc("score"), "key").limit(limit)


def term_stats(index: Index) -> DataFrame:
    """(term, tf, df), from the blocks' heads alone."""
    return index.blocks.where("term is not null").groupBy("term").agg(F.sum("occurrences").alias("tf"), F.sum("n").alias("df"))


def postings(index: Index, terms: list[str]) -> DataFrame:
    """(term, key, tf, positions) of a few terms."""
    p = of_terms(index, terms).select("term", F.inline(F.arrays_zip("keys", "tfs", "positions")))
    return p.withColumnsRenamed({"keys": "key", "tfs": "tf"})
