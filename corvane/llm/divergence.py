"""Source divergence audit: how far the sources of a language lie apart in their words, and which words set each apart.

Integer-dictionary encoding: a language's kept terms, sorted by their UTF-8 bytes, are dealt into chunks of CHUNK; a task
holds one chunk's sorted array, finds ids by searchsorted and counts them by bincount into a row per source. Ids keep the order of the
terms, so dense vectors line up and ties go to the smaller id. A task works on TILE sources at most, pairs of tiles on two.

Texts are counted once, per batch of rows, by (lang, source, term); Spark sums the counts, so neither a hot source nor a very
common term is ever gathered. Nulls in text, lang and source are ''. Every (lang, source) of a row is a group, also one without
terms; a language without kept terms has distances of 0 and no terms. Repeated rows count as often as they come; no
documents give no rows. All arithmetic is on integers; the quotient is taken by long division and holds up to totals of 9 * 10^15.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut
from .mixing import running

#: Letters and all that is not ASCII, as bytes of UTF-8; lower() changes A-Z alone in bytes.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Fixed by the contract of the query: documents that a kept term is in, the scale and the smoothing of p, ranks of terms.
LEAST_DOCS, SCALE, SMOOTH, TOP = 30, 10**9, 5, 50
CHUNK, TILE = 4096, 256
#: Distinct (lang, source, term) that a task holds before it sends on what it has counted.
HELD = 200_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, df, n): partial counts of rows (lang, source, text)."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = [(k[0], k[1], t, df[t], c) for k, (df, n) in held.items() for t, c in n.items()]
        lang, source, term, df, n = zip(*rows)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(source), pa.array([t.decode("utf-8", "replace") for t in term]), pa.array(df, pa.int64()), pa.array(n, pa.int64())], names=["lang", "source", "term", "df", "n"])

    for b in batches:
        for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].cast(pa.binary())):
            df, n = held.setdefault((lang, source), (Counter(), Counter()))
            found = Counter(TERM.findall(text.as_py().lower()))
            size -= len(n)
            n.update(found)
            df.update(found.keys())
            size += len(n)
            if size >= HELD:
                yield flush()
                size = 0
    if size:
        yield flush()


def count(docs: DataFrame) -> DataFrame:
    """(lang, source, term, df, n): documents that hold the term and its occurrences, by group."""
    d = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    part = d.mapInArrow(_counted, "lang string, source string, term string, df long, n long")
    return part.groupBy("lang", "source", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def probability(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), digits taken three at a time."""
    rest, under = count.astype(np.int64) + SMOOTH, np.asarray(total, np.int64) + SMOOTH * kept
    out = rest // under
    for _ in range(3):
        rest = rest % under * 1000
        out = out * 1000 + rest // under
    return out + 1


def _filled(rows: pa.Table, terms: np.ndarray, sources: int, position: str) -> np.ndarray:
    """Counts of (source, term) as a dense table: ids by searchsorted, one bincount."""
    out = np.zeros(sources * len(terms), np.int64)
    if rows.num_rows and len(terms):
        words = np.array([t.encode() for t in rows["term"].to_pylist()], object)
        flat = rows[position].to_numpy() * len(terms) + np.searchsorted(terms, words)
        out += np.bincount(flat, rows["n"].to_numpy(), len(out)).astype(np.int64)  # each cell once: exact below 2^53
    return out.reshape(sources, len(terms))


def vocabulary(cells: DataFrame, least: int) -> DataFrame:
    """(lang, term, chunk, total): kept terms, and the chunk of those that follow each other in the order of their bytes."""
    kept = cells.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total")).where(F.col("df") >= least).drop("df")
    ranked = cut(running(kept, [F.col("lang"), F.col("term")], {"at": F.lit(1).cast("long")}))
    first = ranked.groupBy("lang").agg(F.min("at").alias("first"))
    return ranked.join(first, "lang").select("lang", "term", "total", F.floor((F.col("at") - F.col("first")) / CHUNK).cast("int").alias("chunk"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    cells = cut(count(docs))
    vocab = cut(vocabulary(cells, least))
    # Groups by their place among the sources of their language, kept terms and words of each.
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    ranked = cut(running(every, [F.col("lang"), F.col("source")], {"at": F.lit(1).cast("long")}))
    first = ranked.groupBy("lang").agg(F.min("at").alias("first"))
    langs = cut(first.join(vocab.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("words")), "lang", "left").na.fill(0, ["kept", "words"]))
    counted = cut(cells.select("lang", "source", "term", "n").join(vocab.select("lang", "term", "chunk"), ["lang", "term"]))
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("all"))
    place = F.col("at") - F.col("first")
    groups = ranked.join(langs.drop("words"), "lang").join(totals, ["lang", "source"], "left")
    groups = cut(groups.select("lang", "source", "kept", F.coalesce("all", F.lit(0)).alias("all"), F.floor(place / TILE).cast("int").alias("tile"), (place % TILE).cast("int").alias("pos")))
    tiles = groups.groupBy("lang", "tile").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "all"))).alias("g"))  # TILE at most
    tiles = cut(tiles.select("lang", "tile", F.col("g.source").alias("sources"), F.col("g.all").alias("alls")))
    arrays = vocab.groupBy("lang", "chunk").agg(F.array_sort(F.collect_list(F.struct("term", "total"))).alias("t"))  # CHUNK at most
    arrays = langs.select("lang", "kept", "words").join(arrays, "lang", "left").select("lang", F.coalesce("chunk", F.lit(0)).alias("chunk"), "kept", "words", F.col("t.term").alias("terms"), F.col("t.total").alias("lang_counts"))
    arrays = cut(arrays)
    few = bounded_broadcast(groups.select("lang", "source", "tile", "pos"), F.octet_length("lang") + F.octet_length("source") + 32)
    placed = cut(counted.join(few, ["lang", "source"]).select("lang", "chunk", "tile", "pos", "term", "n"))

    # Terms: each chunk's first ones of each group, then the first of those.
    def telling(rows: pa.Table, facts: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for f in facts.to_pylist():
            terms = np.array([t.encode() for t in f["terms"] or ()], object)
            if not len(terms):
                continue
            c = _filled(rows, terms, len(f["sources"]), "pos")
            q = probability(np.array(f["lang_counts"]), f["words"], f["kept"])
            for i, source in enumerate(f["sources"]):
                gap = np.where(c[i] > 0, probability(c[i], f["alls"][i], f["kept"]) - q, 0)
                at = np.flatnonzero(gap > 0)
                at = at[np.argsort(-gap[at], kind="stable")][:top]
                out += [(f["lang"], source, f["terms"][j], int(gap[j])) for j in at]
        return _table(out)

    facts = arrays.join(tiles, "lang")
    by = ["lang", "chunk", "tile"]
    words = placed.groupBy(by).cogroup(facts.groupBy(by)).applyInArrow(telling, "lang string, source string, item string, value long")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    words = words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # Pairs: a task for each chunk and pair of tiles sums the distances of its terms.
    def distances(rows: pa.Table, facts: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for f in facts.to_pylist():
            terms = np.array([t.encode() for t in f["terms"] or ()], object)
            sides = []
            for tile, sources, alls in ((f["a"], f["a_sources"], f["a_alls"]), (f["b"], f["b_sources"], f["b_alls"])):
                own = rows.filter(pa.array(rows["tile"].to_numpy() == tile)) if rows.num_rows else rows
                sides.append((sources, probability(_filled(own, terms, len(sources), "pos"), np.array(alls)[:, None], f["kept"]) if len(terms) else np.zeros((len(sources), 0), np.int64)))
            (left, p), (right, q) = sides
            for i, x in enumerate(left):
                d = np.abs(q - p[i]).sum(axis=1).tolist()
                for j in range(i + 1 if f["a"] == f["b"] else 0, len(right)):
                    out += [(f["lang"], x, right[j], d[j]), (f["lang"], right[j], x, d[j])]
        return _table(out)

    b = tiles.select("lang", F.col("tile").alias("b"), F.col("sources").alias("b_sources"), F.col("alls").alias("b_alls"))
    pairs = tiles.select("lang", F.col("tile").alias("a"), F.col("sources").alias("a_sources"), F.col("alls").alias("a_alls")).join(b, "lang").where("a <= b")
    met = pairs.select(*(F.col(c).alias(c) for c in ("lang", "a", "b")), F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    sent = placed.join(bounded_broadcast(met, F.octet_length("lang") + 24), ["lang", "tile"])
    by = ["lang", "chunk", "a", "b"]
    apart = sent.groupBy(by).cogroup(arrays.join(pairs, "lang").groupBy(by)).applyInArrow(distances, "lang string, source string, item string, value long")
    apart = apart.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    cols = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return cols(apart, "pair").unionByName(cols(words, "term"))


def _table(rows: list[tuple]) -> pa.Table:
    lang, source, item, value = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"lang": pa.array(lang, pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})
