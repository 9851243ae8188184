"""Best-fit packing by best-two-fit.

Documents become token ids with an end id; longer ones are cut into full pieces after a first, shorter one. Pieces are
dealt into groups by a hash of their place, and each group is packed by itself: a sequence takes the longest piece left, then
the longest that fits, until none does; then its smallest piece is replaced by two unpacked ones that fit the gap so
expanded more tightly. Only lengths take part, in a histogram, so a group costs a few steps per sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_groups, cut, rows_of
from .tokenizers_ import id_encoder

LENGTH, END, GROUP = 1024, 2, 2048


def cut_points(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the rest."""
    first = n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))] if n else []


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row; a null text is empty and so only the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = id_encoder(tokenizer)
        for b in batches:
            at, out = [], []
            for r, text in enumerate(b.column("text")):
                ids = np.append(ids_of(text.as_py() or ""), np.uint32(end)).astype("<u4")
                own = [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut_points(len(ids), length))]
                at += [r] * len(own)
                out += own
            cols = np.array(out, np.int64).reshape(-1, 4).T
            made = {"piece": pa.array(cols[0].astype(np.int32)), **{c: pa.array(x) for c, x in zip(("start", "length", "ids_crc32"), cols[1:])}}
            yield rows_of(b, ["doc_id"], made, at)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, capacity: int = LENGTH) -> list[list[int]]:
    """Positions of the items in each sequence. Lengths are 1 to capacity."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        stacks[lengths[i]].append(i)
    have = np.array([len(s) for s in stacks])
    sizes = np.arange(capacity + 1)
    left, bins = len(lengths), []

    def best() -> np.ndarray:
        """For each room, the longest length left that fits it; 0 if none."""
        return np.maximum.accumulate(np.where(have > 0, sizes, 0))

    while left:
        room, taken = capacity, []
        fit = best()
        while x := int(fit[room]):
            taken.append(x)
            have[x] -= 1
            room -= x
            if not have[x]:
                fit = best()
        if room and len(taken) > 1:
            small = taken[-1]  # pieces come longest first
            wide = room + small
            a = sizes[1 : wide + 1]
            b = np.minimum(fit[wide - a], a)
            b = np.where((b == a) & (have[b] < 2), fit[np.maximum(b - 1, 0)], b)
            total = np.where((have[a] > 0) & (b > 0), a + b, 0)
            k = int(total.argmax())
            if total[k] > small:
                have[small] += 1
                taken[-1:] = [int(a[k]), int(b[k])]
                for x in taken[-2:]:
                    have[x] -= 1
        bins.append([stacks[x].pop() for x in taken])
        left -= len(taken)
    return bins


def pack(pieces_: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset. Groups hold about `group` pieces each, whatever the input's size.

    Pieces are dealt by their place in the written table, so that repeated rows and null ids spread like any others.
    """
    p = cut(pieces_)
    n = max(1, -(-p.count() // group))
    kind = p.schema["doc_id"].dataType.simpleString()
    dealt = p.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in arrow_groups(batches, "g"):
            lens, base = g.column("length").to_numpy(), g.column("g")[0].as_py() << 32
            seq, off = np.empty(len(lens), np.int64), np.empty(len(lens), np.int64)
            for k, b in enumerate(best_two_fit(lens, length)):
                at = 0
                for i in b:
                    seq[i], off[i] = base + k, at
                    at += lens[i]
            yield from g.drop_columns("g").append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off)).to_batches()

    rows = dealt.repartition("g").sortWithinPartitions("g", "doc_id", "piece", "ids_crc32")
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row.

    Null and empty texts are one piece of the end id. Repeated rows are packed as often as they come. Empty tables give
    no rows; extra columns are ignored.
    """
    return pack(pieces(docs, tokenizer, length, end), length, group)
