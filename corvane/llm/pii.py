"""Personal data by weak supervision.

Base patterns with their validity tests give spans outright. Wider patterns give candidates, on which labelers vote: the
strict pattern, validity, a gazetteer of cue words, one of domains and prefixes, and the context around the span.
Expectation-maximisation over the vote patterns of the whole corpus estimates each labeler's reliability without labels;
a logistic span classifier trained on the resulting probabilities decides on the candidates that are no base span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of
from .toxicity import logistic

KINDS = ("email", "ip", "card", "phone")
_AT_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

#: Wider patterns. Each is anchored so that a search is linear in the text.
_WIDE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}|<at>| at ) ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>| dot ) ?)[A-Za-z0-9-]{2,63})+", re.I),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9.])[0-9]{1,3}(?:(?: ?[.] ?|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9]|[.][0-9])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{3,6}){2,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+])(?:\(?[0-9]{2,5}\)?[ .-]{1,2})(?:[0-9]{2,4}[ .-]){1,3}[0-9]{2,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])00[0-9]{8,13}(?![0-9A-Za-z])"),
}
#: Gazetteers: cue words in the four languages, and well-known domain endings and prefixes.
CUES = {
    "email": frozenset("email e-mail mail contact courriel correo kontakt mailto".split()),
    "ip": frozenset("ip address host server addr adresse ipv4 ipv6 dirección".split()),
    "card": frozenset("card visa mastercard amex credit debit carte karte tarjeta".split()),
    "phone": frozenset("phone tel call mobile fax telefon téléphone teléfono ring cell handy".split()),
}
_ENDINGS = frozenset("com org net edu gov io de fr es uk eu info".split())
_NUMERIC = re.compile(r"[0-9]")
LABELERS = ("strict", "valid", "cue", "known", "context")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start. Leftmost, non-overlapping per kind; failing matches are dropped."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        # A local part is the run of its characters right before the sign, from the last match's end at the earliest.
        s = at
        while s > done and text[s - 1] in _LOCAL_CHARS:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append(("email", s, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40:
            d = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m:
            if 9 <= len(_NUMERIC.findall(m.group())) <= 15:
                out.append(("phone", *m.span()))
            at = text.find("+", m.end())
        else:
            at = text.find("+", at + 1)
    return out


def _votes(kind: str, text: str, s: int, e: int, strict: bool) -> tuple[int, ...]:
    """-1 (no), 0 (abstains) or 1 (yes) of each of LABELERS."""
    span = text[s:e]
    before = re.findall(r"[^\W\d_][\w-]*", text[max(0, s - 48) : s].lower())[-4:]
    digits = "".join(_NUMERIC.findall(span))
    cue = 1 if CUES[kind].intersection(before) else -1 if any(CUES[k].intersection(before) for k in KINDS if k != kind) else 0
    if kind == "email":
        end = re.split(r"[^A-Za-z0-9]+", span)[-1].lower()
        valid, known = (1 if 2 <= len(end) <= 24 and end.isalpha() else -1), 1 if end in _ENDINGS else -1
    elif kind == "ip":
        parts = re.split(r"[^0-9A-Fa-f]+", span)
        valid = 1 if len(parts) == 8 or len(parts) == 4 and all(p.isdigit() and int(p) <= 255 and str(int(p)) == p for p in parts) else -1
        known = 1 if ":" in span or span.startswith(("10.", "192.168.", "172.16.", "127.")) else 0
    elif kind == "card":
        valid, known = (1 if 13 <= len(digits) <= 19 and luhn(digits) else -1), 1 if digits[:1] in ("3", "4", "5", "6") else -1
    else:
        valid, known = (1 if 9 <= len(digits) <= 15 else -1), 1 if span.startswith(("00", "(")) or "555" in span or strict else 0
    # Part of a longer number, date, path or hexadecimal string: against; on its own: for.
    l, r = text[s - 1 : s], text[e : e + 1]
    around = -1 if l.isalnum() or r.isalnum() or l in ("/", "=", '"', "#", "_") or re.fullmatch(r"(?:19|20)\d\d[-./ ]\d\d[-./ ]\d\d.*", span) else 1
    return (1 if strict else -1, valid, cue, known, around)


def disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans; those that overlap go as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def overlaps(spans: list[tuple[int, int]], s: int, e: int) -> bool:
    """Whether s to e overlaps any of the spans, which are sorted and disjoint; takes their number's logarithm of steps."""
    i = bisect_left(spans, (e,)) - 1
    return i >= 0 and spans[i][1] > s


def candidates(text: str) -> list[tuple[str, int, int, bool, tuple[int, ...]]]:
    """(kind, start, end, base, votes): the base spans, and wider matches that overlap none of them."""
    base = base_spans(text)
    out = [(k, s, e, True, _votes(k, text, s, e, True)) for k, s, e in base]
    taken = disjoint([(s, e) for _, s, e in base])
    has_digit = _NUMERIC.search(text) is not None
    for kind in KINDS:
        if kind != "email" and not has_digit:
            continue
        if kind == "email" and not re.search(r"\bat\b", text, re.I):
            continue
        for m in _WIDE[kind].finditer(text):
            s, e = m.span()
            if not overlaps(taken, s, e):
                out.append((kind, s, e, False, _votes(kind, text, s, e, False)))
    return out


def vote_patterns(docs: DataFrame) -> DataFrame:
    """(kind, base, votes, n): how often each pattern of votes comes in all texts. As many rows as there are patterns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: dict[tuple, int] = {}
            for t in b["text"]:
                if t:
                    for kind, _, _, base, votes in candidates(t):
                        k = (kind, base, ",".join(map(str, votes)))
                        rows[k] = rows.get(k, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["kind", "base", "votes", "n"])

    found = docs.select("text").mapInPandas(run, "kind string, base boolean, votes string, n long")
    return found.groupBy("kind", "base", "votes").agg(F.sum("n").alias("n"))


def estimate(votes: np.ndarray, n: np.ndarray, prior: float = 0.5, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for two classes: (probability of each pattern, P(vote | class) as [class, labeler, vote], share of spans).

    Labelers are taken as independent given the class. It starts from the votes' mean, which also fixes which class is
    which; counts are smoothed so that a vote never seen is never impossible.
    """
    p = 1 / (1 + np.exp(-votes.sum(axis=1)))
    rel = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        for c, w in ((0, n * (1 - p)), (1, n * p)):
            for v in range(3):
                rel[c, :, v] = ((votes == v - 1) * w[:, None]).sum(axis=0) + 1.0
        rel /= rel.sum(axis=2, keepdims=True)
        prior = float(((n * p).sum() + 1) / (n.sum() + 2))
        log = np.stack([np.log(rel[c][np.arange(votes.shape[1]), votes + 1]).sum(axis=1) for c in (0, 1)])
        new = 1 / (1 + np.exp(-np.clip(log[1] - log[0] + np.log(prior / (1 - prior)), -30, 30)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return p, rel, prior


def features(votes: np.ndarray) -> np.ndarray:
    """The span classifier looks at every labeler but the strict pattern, which base spans have by their making."""
    v = votes[:, 1:].astype(float)
    return np.concatenate([np.ones((len(v), 1)), v, v[:, :1] * v[:, 1:2], v[:, :1] * v[:, 3:4]], axis=1)


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    """The span classifier's weights for each kind, from every candidate of docs and what EM makes of its votes."""
    out = {}
    rows = vote_patterns(docs).collect()  # at most 4 x 2 x 3^5 rows
    for kind in KINDS:
        own = sorted((r["votes"], r["n"]) for r in rows if r["kind"] == kind)
        if not own:
            continue
        votes, n = np.array([[int(x) for x in v.split(",")] for v, _ in own]), np.array([c for *_, c in own], float)
        p, _, _ = estimate(votes, n)
        # Soft labels: each pattern counts as spans and as none, in proportion; 2000 rows' weight at most, so that the ridge holds.
        w = np.maximum(1, np.round(2000 * n / n.sum())).astype(int)
        ones, x = np.round(w * p).astype(int), features(votes)
        out[kind] = logistic(np.repeat(np.concatenate([x, x]), np.concatenate([ones, w - ones]), axis=0), np.repeat([1.0, 0.0], [ones.sum(), (w - ones).sum()]), l2=1.0)
    return out


def accepted(model: dict[str, np.ndarray], kind: str, votes: tuple[int, ...]) -> bool:
    """Whether the classifier takes a candidate that is no base span; a kind that the corpus never has takes none."""
    return kind in model and float((features(np.array([votes])) @ model[kind])[0]) > 0


def find_spans(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, base, spans) for each row: arrays of (kind, start, end), by kind as listed, then start.

    Positions are code points, ends exclusive. spans holds the base spans and the candidates that the classifier accepts.
    Null and empty texts have none. Repeated rows give repeated results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        order = {k: i for i, k in enumerate(KINDS)}
        known: dict[tuple, bool] = {}

        def accepts(kind: str, votes: tuple[int, ...]) -> bool:
            if (kind, votes) not in known:
                known[kind, votes] = accepted(m, kind, votes)
            return known[kind, votes]

        for b in batches:
            base, spans = [], []
            for t in b.column("text"):
                found = candidates(t.as_py()) if t.is_valid else []
                base.append([f"{k}:{s}:{e}" for k, s, e, is_base, _ in found if is_base])
                kept: list[tuple[int, int, int]] = []
                added: list[tuple[int, int]] = []  # candidates overlap no base span, but one another across kinds
                for k, s, e, is_base, votes in found:
                    if is_base:
                        kept.append((order[k], s, e))
                    elif accepts(k, votes) and not overlaps(added, s, e):
                        kept.append((order[k], s, e))
                        insort(added, (s, e))
                spans.append([f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(kept)])
            texts = pa.list_(pa.string())
            yield rows_of(b, ["doc_id"], {"base": pa.array(base, texts), "spans": pa.array(spans, texts)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base array<string>, spans array<string>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans of each row."""
    s = find_spans(docs, fit(docs))
    count = lambda k: F.size(F.filter("base", lambda x: x.startswith(k + ":"))).cast("long").alias(f"n_{k}")
    return s.select("doc_id", *(count(k) for k in KINDS), F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


def redact(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets; overlapping ones go as one. Nulls stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            cut_ = []
            for k, s, e, is_base, v in candidates(t) if t else []:
                if is_base or accepted(shared.value, k, v):
                    cut_.append((s, e, k))
            at, parts = 0, []
            for s, e, k in sorted(cut_):
                if s >= at:
                    parts += [t[at:s], f"<{k}>"]
                at = max(at, e)
            out.append(t if t is None else "".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", clean(F.col("text")))


def digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
