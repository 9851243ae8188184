"""Toxicity by noisy-channel deobfuscation.

Spans that may be disguised (letters mixed with look-alike digits and signs, letters spaced out, letters repeated) become
a lattice of characters: each observed character may stand for itself or for a letter it resembles, a separator for a word
boundary or for nothing, a repetition for itself or for nothing. Viterbi decoding under a character trigram model of the
whole corpus restores them; any other span has one path through its lattice and stays. The restored text is scored by
words whose presence tells labelled toxic rows from others.

Whole texts are not decoded: a span is if it mixes letters and look-alikes, spaces letters out singly or repeats one three
times, or if its letters, with look-alikes folded, separators left out and repetitions cut, are those of a telling word
(doubled letters, words in two or three parts). What is decoded is still for the language model to say.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, rows_of
from .quality_classifier import labelled_sample

#: Labelled rows of each label that the scorer may be fitted on, and the words it may keep.
SAMPLE, LEXICON = 4000, 5000
#: A telling word's toxic rows at least, and the likelihood ratio statistic of its counts.
LEAST_ROWS, LEAST_RATIO = 3, 20.0
#: Decoded spans that a worker remembers, if they are no longer than this.
REMEMBER, SHORT = 200_000, 48
#: Look-alikes and the letters they stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = " .-_*~"
_WORD = re.compile(r"[^\W\d_]+")
_L = r"[A-Za-z]"
_X = r"0-9@$!|+(€"
#: Mixed letters and look-alikes; single characters with separators between them; a letter three times or more. Each
#: branch starts at the start of a run alone, so that a search is linear in the text; none starts after a letter, which is asked first.
_MIXED = rf"(?<![\w{_X}])(?:[{_X}]+{_L}|{_L}+[{_X}])[A-Za-z{_X}]*|(?<![\w@$])[A-Za-z{_X}](?:[ .\-_*~]{{1,2}}[A-Za-z{_X}])+(?![\w@$])"
_SUSPECT = re.compile(rf"(?<![A-Za-z])(?=[A-Za-z{_X}])(?:{_MIXED}|(?=[A-Za-z]*?([A-Za-z])\1\1)[A-Za-z]+)")
#: The same for texts in which no letter comes three times on end.
_SUSPECT_MIXED = re.compile(rf"(?<![A-Za-z])(?=[A-Za-z{_X}])(?:{_MIXED})")
_TRIPLES = [x * 3 for x in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_ATOM = re.compile(rf"([A-Za-z{_X}]+)")
_RUN = re.compile(r"(.)\1{3,}", re.S)
_FOLD = str.maketrans({k: v[0] for k, v in LEET.items()} | {"|": "i"})
#: Parts that a word may be cut into, repetitions included.
PARTS = 24
SYMBOLS = 28  # 0: boundary, 1-26: a-z, 27: any other letter


def _table() -> np.ndarray:
    t = np.full(0x250, 27, np.uint8)
    t[:128] = 0
    t[97:123] = np.arange(1, 27)
    t[65:91] = np.arange(1, 27)
    return t


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams in every text of docs, words bounded by 0. At most 28^3 rows reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, total = _table(), np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            for t in b["text"]:
                if t:
                    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                    for i in range(0, len(c), 1 << 18):
                        s = table[np.minimum(c[max(0, i - 2) : i + (1 << 18)], 0x24F)].astype(np.int64)
                        s = np.concatenate([[0, 0], s, [0]]) if i == 0 else np.concatenate([s, [0]])
                        total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"g": used.astype(np.int32), "n": total[used]})

    rows = docs.select("text").mapInPandas(run, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3)
    for r in rows:
        out[r["g"]] = r["n"]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class Decoder:
    """Viterbi decoding of a span's lattice; states are the last two symbols."""

    def __init__(self, counts: np.ndarray):
        c = counts + 0.1
        self.lm = np.log(c / c.sum(axis=2, keepdims=True)).tolist()
        self.known: dict[tuple[str, float], str] = {}

    def __call__(self, span: str, stay: float = -2.0) -> str:
        if len(span) > SHORT:
            return self.decode(span, stay)
        got = self.known.get((span, stay))
        if got is None:
            if len(self.known) > REMEMBER:
                self.known.clear()
            got = self.known[span, stay] = self.decode(span, stay)
        return got

    def decode(self, span: str, stay: float = -2.0) -> str:
        """stay: the log probability of a look-alike or separator that is meant as it stands."""
        # Beyond three, repetitions of a character change no path but by the same constant.
        span = _RUN.sub(lambda m: m.group(1) * 3, span.lower())
        lm = self.lm
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        last, times = "", 0
        for o in span:
            times = times + 1 if o == last else 1
            # (symbol, log probability, character written); no symbol: the character stands for nothing.
            options: list[tuple[int, float, str]] = []
            if "a" <= o <= "z":
                options.append((ord(o) - 96, 0.0 if times < 3 else -3.0, o))
                if times > 1:
                    options.append((-1, -3.0 if times < 3 else -0.1, ""))
            elif o in LEET:
                options += [(ord(x) - 96, -0.7, x) for x in LEET[o]]
                options.append((0, stay, o))
            elif o in SEPARATORS:
                options += [(-1, 0.0, ""), (0, stay, o)]
            else:
                options.append((27 if o.isalpha() else 0, 0.0, o))
            if o not in SEPARATORS:
                last = o
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (s, path) in states.items():
                for x, p, c in options:
                    if x < 0:
                        key, v, way = (a, b), s + p, path
                    else:
                        key, v, way = (b, x), s + p + lm[a][b][x], (path, c)
                    if key not in new or new[key][0] < v:
                        new[key] = (v, way)
            states = new
        path = max(((s + lm[a][b][0], w) for (a, b), (s, w) in states.items()), key=lambda e: e[0])[1]
        out = []
        while path:
            path, c = path
            out.append(c)
        return "".join(reversed(out))


def fold(span: str) -> str:
    """Look-alikes as letters, all else left out, repetitions cut to one."""
    return re.sub(r"(.)\1+", r"\1", re.sub("[^a-z]", "", span.lower().translate(_FOLD)))


class Gate:
    """Spans of one to PARTS runs of letters and look-alikes, up to two separators apart, whose folded letters are a telling word's."""

    def __init__(self, words: Iterable[str]):
        self.plain = {w for w in words if len(w) > 3 and w.isascii()}
        self.folded = {fold(w) for w in self.plain}
        self.starts = {w[:i] for w in self.folded for i in range(1, len(w) + 1)}
        self.known: dict[str, str] = {}

    def _folded(self, atom: str) -> str:
        got = self.known.get(atom)
        if got is None:
            got = fold(atom)
            if len(atom) <= SHORT:
                if len(self.known) > REMEMBER:
                    self.known.clear()
                self.known[atom] = got
        return got

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        if not self.folded:
            return
        parts = _ATOM.split(text)  # what parts atoms, and atoms, in turn
        names, gaps = parts[1::2], parts[::2]
        known, starts, folded = self.known, self.starts, self.folded
        each = {x: known.get(x) or self._folded(x) for x in set(names)}
        first = {x for x, y in each.items() if y in starts}
        if not first:
            return
        ends: list[int] = []
        free = 0  # the first atom that is in no span
        for i in [k for k, x in enumerate(names) if x in first]:
            if i < free:
                continue
            whole = each[names[i]]
            end = i + 1 if whole in folded else 0
            for j in range(i + 1, min(i + PARTS, len(names))):
                nxt = each[names[j]]
                whole = whole + (nxt[1:] if nxt[:1] == whole[-1:] else nxt)
                if whole not in starts or len(gaps[j]) > 2 or gaps[j].strip(SEPARATORS):
                    break
                if whole in folded:
                    end = j + 1
            if end and not (end == i + 1 and names[i].lower() in self.plain):
                ends = ends or list(accumulate(map(len, parts)))
                yield ends[2 * i], ends[2 * end - 1]
            free = max(end, i + 1)


def restore(text: str | None, decode: Decoder, gate: Gate | None = None) -> str:
    """The text in lower case with its spans that may be disguised decoded."""
    text = text or ""
    spans = [(s, e, -8.0) for s, e in gate.spans(text)] if gate else []
    # What is left of the others beside the gate's, in which a look-alike is likelier a letter.
    free = zip([0, *(e for _, e, _ in spans)], [*(s for s, _, _ in spans), len(text)])
    find = _SUSPECT if any(x in text for x in _TRIPLES) else _SUSPECT_MIXED
    spans += [(*m.span(), -2.0) for s, e in list(free) for m in find.finditer(text, s, e)]
    out, at = [], 0
    for s, e, stay in sorted(spans):
        out += [text[at:s], decode(text[s:e], stay)]
        at = e
    return "".join([*out, text[at:]]).lower()


def word_set(text: str) -> set[str]:
    return set(_WORD.findall(text))


def terms(word: str) -> list[str]:
    """The word, and its beginnings of four to six letters, by which compounds and inflected forms share what they tell."""
    return [word, *(word[:k] + "~" for k in (4, 5, 6) if len(word) > k)]


def features(weights: Iterable[float]) -> list[float]:
    """Of the weights of a text's telling words: the largest, their sum, and how many there are."""
    w = sorted(x for x in weights if x > 0)
    return [1.0, w[-1] if w else 0.0, min(sum(w), 60.0) / 3, math.log1p(len(w))]


class Scorer:
    """Logistic score of how many telling words a text has and how telling they are."""

    def __init__(self, weights: dict[str, float], coef: np.ndarray):
        self.weights, self.coef = weights, coef
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > REMEMBER:
                self.known.clear()
            got, n, of = self.weights.get(word, 0.0), len(word), self.weights.get
            for k in (4, 5, 6):  # as terms() has them, without a list
                if n > k and (x := of(word[:k] + "~")) is not None and x > got:
                    got = x
            if len(word) <= SHORT:
                self.known[word] = got
        return got

    def score(self, words: set[str]) -> float:
        get, weight = self.known.get, self.weight
        told = [x if (x := get(w)) is not None else weight(w) for w in words]
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, float(np.dot(features(told), self.coef))))))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


def _ratio(d1: float, d0: float, n1: int, n0: int) -> float:
    """The likelihood ratio statistic of a word in d1 of n1 toxic rows and d0 of n0 others; 0 if it is no commoner in them."""
    n, d = n1 + n0, d1 + d0
    if not d or d1 * n <= d * n1:
        return 0.0
    g = lambda o, e: o * math.log(o / e) if o > 0 else 0.0
    return 2 * (g(d1, d * n1 / n) + g(d0, d * n0 / n) + g(n1 - d1, (n - d) * n1 / n) + g(n0 - d0, (n - d) * n0 / n))


def _weight(d1: float, d0: float, n1: int, n0: int) -> float:
    """How much the word tells; 0 if it is not telling."""
    if d1 < LEAST_ROWS or _ratio(d1, d0, n1, n0) < LEAST_RATIO:
        return 0.0
    return math.log((d1 + 0.5) / (n1 + 1)) - math.log((d0 + 0.5) / (n0 + 1))


def fit(docs: DataFrame, rows: DataFrame, labels: DataFrame, sample: int = SAMPLE, lexicon: int = LEXICON) -> tuple[np.ndarray, Scorer]:
    """The trigram counts of all of docs, and a scorer from about `sample` labelled rows of each label among rows.

    Near copies in the sample, told by the smallest hash of their word shingles, count once: else their words would seem
    to tell. A word tells if LEAST_ROWS toxic rows have it and its likelihood ratio is clear; there is no least share, so
    that words of a language with few toxic rows count too. The `lexicon` clearest are kept. The logistic score is fitted
    on weights that leave the row itself out of the counts: a word known from that row alone must not seem to tell.
    """
    counts = trigram_counts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = Decoder(shared.value)
        for b in batches:
            w, low = [], []
            for t in b["text"]:
                r = restore(t, decode)
                seq = _WORD.findall(r)
                low.append(min((xxhash.xxh64_intdigest(" ".join(seq[i : i + 5])) >> 1 for i in range(max(1, len(seq) - 4))), default=0))
                w.append(sorted(set(seq)))
            yield pd.DataFrame({"doc": b["doc_id"].astype(str), "y": b["y"], "low": low, "w": pd.Series(w, dtype=object)})

    got = labelled_sample(rows.where("text is not null").select("doc_id", "text"), labels, "toxic", sample).mapInPandas(words, "doc string, y int, low long, w array<string>")
    got = cut(got.groupBy("low").agg(F.min(F.struct("doc", "y", "w")).alias("r")).select("r.doc", "r.y", "r.w"))
    n = dict(got.groupBy("y").count().collect())
    n1, n0 = n.get(1, 0), n.get(0, 0)
    d1, d0 = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    prefixes = [F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("~"))) for k in (4, 5, 6)]
    each = got.select("doc", "y", F.explode("w").alias("word")).select("doc", "y", F.explode(F.array("word", *prefixes)).alias("term")).where("term is not null").distinct()
    df = each.groupBy("term").agg(d1.alias("d1"), d0.alias("d0")).where(F.col("d1") >= LEAST_ROWS).where(F.col("d1") * n0 > F.col("d0") * n1)
    most = df.orderBy(F.desc(F.col("d1") / (F.col("d0") + 1)), F.desc("d1"), "term").limit(4 * lexicon).collect()
    seen = {r["term"]: (r["d1"], r["d0"]) for r in most}
    clear = sorted((-_ratio(*d, n1, n0), t) for t, d in seen.items() if _weight(*d, n1, n0) > 1)[:lexicon]
    weights = {t: _weight(*seen[t], n1, n0) for _, t in clear}
    told = docs.sparkSession.sparkContext.broadcast({t: seen[t] for t in weights})

    def rows_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = []
            for y, w in zip(b["y"], b["w"]):
                own = ([told.value[t] for t in terms(word) if t in told.value] for word in w)
                x.append(features(max((_weight(d1 - y, d0 - 1 + y, n1 - y, n0 - 1 + y) for d1, d0 in o), default=0.0) for o in own))
            yield pd.DataFrame({"doc": b["doc"], "y": b["y"], "x": pd.Series(x, dtype=object)})

    found = got.mapInPandas(rows_features, "doc string, y int, x array<double>").orderBy("doc", "y", "x").collect()
    coef = logistic(np.array([r["x"] for r in found]), np.array([r["y"] for r in found], float)) if found else np.zeros(4)
    return counts, Scorer(weights, coef)


def score(docs: DataFrame, counts: np.ndarray, scorer: Scorer) -> DataFrame:
    """(doc_id, score) for each row; null and empty texts are scored as texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast((counts, scorer.weights, scorer.coef))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, w, coef = shared.value
        decode, s, gate = Decoder(c), Scorer(w, coef), Gate(x for x in w if not x.endswith("~"))
        for b in batches:
            yield rows_of(b, ["doc_id"], {"score": pa.array([s.score(word_set(restore(t.as_py(), decode, gate))) for t in b.column("text")], pa.float64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels come from rows whose crc32 mod 5 is not 0.

    A null doc_id is not held out and teaches nothing. Repeated rows give repeated results; without labels every score is
    0.5. Empty tables give no rows.
    """
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    counts, s = fit(docs, docs.where("doc_id is not null").where(~held), labels, sample)
    out = score(docs, counts, s)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
