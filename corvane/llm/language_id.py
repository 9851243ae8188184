"""Language ID by compression: a zstandard raw-content dictionary per language; the smallest encoding wins.

Texts are reduced to their letters and compressed in chunks, each from scratch with a language's dictionary, so that the
dictionary and not the text itself is what helps, and so that memory does not grow with the text. All chunks count. A few
zero bytes follow each chunk: they compress to the same everywhere, and make sure that a chunk of some letters is encoded
at all, not stored. So one rule serves all lengths. The dictionaries are the one thing fitted, on a bounded sample of
labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, rows_of

#: Bytes of each language's dictionary, and the labelled rows it may be cut from.
DICT_BYTES, SAMPLE = 128 << 10, 400
CHUNK, PADDING = 2048, bytes(48)
#: Matches of three bytes count, or short texts would tie.
LEVEL, MIN_MATCH = 9, 3
#: A text is rejected if the second-best encoding is larger by no more than this share of the best, a tie included.
MARGIN = 0.004
MAX_LANGS = 200
_RUN = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case words of letters alone, a space between them."""
    return _RUN.sub(" ", (text or "").lower()).strip()


def fit(docs: DataFrame, sample: int = SAMPLE, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary per language. docs: the rows one may learn from, with text and lang; null ones are left out.

    Of each language about `sample` rows are taken by a hash of their text, and pieces of each fill dict_bytes. Ties and
    repeated rows change nothing: equal texts count once. A ValueError if there are more than MAX_LANGS languages, so that
    the driver collects no more than about 180 MB of pieces.
    """
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError("too many languages")
    if not counts:
        return {}
    rate = F.lit(0.0)
    for k, n in counts.items():
        rate = F.when(F.col("lang") == k, min(1.0, sample / n)).otherwise(rate)
    piece = 2 * dict_bytes // sample + 256
    # Some piece of each sampled text, from a place that its hash picks; the sample is bounded, the scored texts are whole.
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - piece, F.lit(1))).cast("int") + 1
    taken = rows.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < rate * 1_000_000).select("lang", "h", F.substring("text", start, F.lit(piece)).alias("t")).distinct().collect()
    out = {}
    for k in sorted(counts):
        parts = [letters(r["t"]) for r in sorted((r for r in taken if r["lang"] == k), key=lambda r: (r["h"], r["t"]))]
        out[k] = " ".join(p for p in parts if p).encode()[:dict_bytes]
    return {k: v for k, v in out.items() if v}


class Classifier:
    """Compressors for the dictionaries; made once per worker and task."""

    def __init__(self, dicts: dict[str, bytes], chunk: int = CHUNK):
        import zstandard as z

        self.langs, self.chunk = sorted(dicts), chunk
        params = z.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.tools = [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(dicts[k], dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params) for k in self.langs]

    def sizes(self, text: str) -> np.ndarray:
        data = text.encode("utf-8", "surrogatepass")
        out = np.zeros(len(self.langs))
        for i in range(0, len(data), self.chunk):
            part = data[i : i + self.chunk] + PADDING
            out += [len(t.compress(part)) for t in self.tools]
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). und, 0 and rejected for a text without a letter, or if nothing has been learned."""
        t = letters(text)
        if not t or not self.langs:
            return "und", 0.0, True
        sizes = self.sizes(t)
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        gap = sizes[order[1]] - best if len(order) > 1 else math.inf
        score = 1 / float(np.exp(-(np.minimum(sizes - best, 60.0)) / 2).sum())
        return self.langs[order[0]], score, bool(gap <= MARGIN * best)


def predict(docs: DataFrame, dicts: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row; only the text is looked at. Repeated rows give repeated results.

    rejected: null texts, texts without a letter, and texts whose margin is narrow, ties above all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dicts)  # at most MAX_LANGS x DICT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(shared.value)
        for b in batches:
            got = [c.predict(t.as_py()) for t in b.column("text")]
            yield rows_of(b, ["doc_id"], {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64()), "rejected": pa.array([g[2] for g in got], pa.bool_())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(crc_mod(F.col("doc_id"), 4) != 2, F.lit(False)))


def keep_identified(docs: DataFrame, dicts: dict[str, bytes]) -> DataFrame:
    """docs without the rows that are rejected, all columns as they are.

    One pass: verdicts are made where the rows are, so no join is needed and repeated rows share their fate.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dicts)

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        c = _classifier(shared.value)
        return pd.Series([not c.predict(t)[2] for t in texts])

    return docs.where(accepted(F.col("text")))


_made: list = []


def _classifier(dicts: dict[str, bytes]) -> Classifier:
    """The worker's classifier for these dictionaries."""
    if not _made or _made[0] is not dicts:
        _made[:] = [dicts, Classifier(dicts)]
    return _made[1]
