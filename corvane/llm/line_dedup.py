"""Line dedup by a deletion-neighbourhood join, in words.

Lines are normalised and taken as distinct by digest. An edit is a word replaced, left out or put in. Two lines within two
edits are the same text once at most two words are left out of each, so each line emits its deletions as hashed keys, in
forms that make equal keys say all: under a key of two replaced words (with their places), or of one word left out
anywhere, every two lines are near; under a key of a word left out and one replaced, or of two left out, a longer line is
near every shorter one. A link to the earliest line of a key is thus enough, and no pairs are made. The links' edit
distance is then verified on the texts. A line goes if an earlier one is equal to it or near it; the earliest stays.

A line of hundreds of words has tens of thousands of such deletions, so only those are emitted that can meet another's.
By the pigeonhole principle two near lines share their first, middle or last third (their first or last half, where one
edit is the bound); those keys are counted for all lines, with the lengths of the lines under them. The lines left are cut into segments, more for longer lines,
and again counted outside of each segment, of each two neighbours, and of each two others; deletions are emitted inside
the segments outside of which a line equals another. Both filters lose no pair, whatever the line's length.

Most thirds and halves have few lines, whose deletions would cost more than the pairs: up to FEW lines of a key are compared
with each other at once. Segments and deletions are for the pairs under the other keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import accumulate
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, bounded_broadcast, cut, fresh, held, join_split, packed, rows_of

#: The bound: at most MAX_EDITS words, and at most one word in WORDS_PER_EDIT of the longer line.
MAX_EDITS, WORDS_PER_EDIT = 2, 10
#: Lines under a third or half that are compared with each other; where there are more, it goes by their deletions.
FEW = 16
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_Q = 1 << 20


def normalise(line: str | bytes) -> bytes:
    """A-Z in lower case; words, parted by the six ASCII blanks, a space between them."""
    data = line if isinstance(line, bytes) else line.encode("utf-8", "surrogatepass")
    return b" ".join(data.lower().split())  # of bytes, both know ASCII alone


def bound(words: int, max_edits: int = MAX_EDITS) -> int:
    """The edits within which a line is near, by the number of words of the longer one."""
    return min(max_edits, words // WORDS_PER_EDIT)


def near(a: list, b: list, k: int) -> bool:
    """Whether the word lists are within k edits. After equal words, each of the three edits is tried."""
    if abs(len(a) - len(b)) > k:
        return False
    n = min(len(a), len(b))
    i = next((x for x in range(n) if a[x] != b[x]), n)
    a, b = a[i:], b[i:]
    if not a or not b:
        return len(a) + len(b) <= k
    return k > 0 and (near(a[1:], b[1:], k - 1) or near(a[1:], b, k - 1) or near(a, b[1:], k - 1))


def _rounded(v: int) -> int:
    """v cut to its three leading bits, so that lines of nearly equal length mostly have the same."""
    shift = max(0, v.bit_length() - 3)
    return v >> shift << shift


@lru_cache(1 << 14)
def _plan(n: int, max_edits: int) -> list[tuple[int, int, int, list[tuple[int, str, int]]]]:
    """(seed, first word, end, meanings) of the parts that a line of n words is filed under.

    A meaning is (m, part, length): m words has the longer line of a pair.
    """
    plan: dict[tuple[int, int], list[tuple[int, str, int]]] = {}
    for m in range(n, n + max_edits + 1):
        k = bound(m, max_edits)
        if not k or m - n > k:
            continue
        size = _rounded(m // (k + 1))
        parts = [("p", 0), ("s", n - size)]
        if k == 2:  # one edit on either side: the middle is moved by one at most
            parts += [("m", size + d) for d in (-1, 0, 1)]
        for part, at in parts:
            plan.setdefault((part, at, at + size), []).append((m, part, size))
    return [("psm".index(part), a, b, meant) for (part, a, b), meant in plan.items()]


def key_list(norm: bytes, w: list[bytes], max_edits: int = MAX_EDITS) -> list[int]:
    """Hashes of thirds or halves."""
    plan = _plan(len(w), max_edits)
    if not plan:
        return []
    at, digest = list(accumulate(map(len, w), initial=0)), xxhash.xxh3_64_intdigest  # word x starts at at[x] + x
    return [digest(norm[at[a] + a : at[b] + b - 1], seed) - (1 << 63) for seed, a, b, _ in plan]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_KINDS = [_mix(np.array([kind], np.uint64)) for kind in range(7)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_BASE, 4096)
_MOVES = {i: _U(pow(_BASE if i > 0 else _INVERSE, abs(i), 1 << 64)) for i in range(-2, 3)}


class Sums:
    """Running sums of a polynomial hash modulo 2^64 over the words' hashes, for lines of n words each, a row per line: any
    range of words, moved anywhere, is one difference."""

    def __init__(self, codes: np.ndarray):
        self.n = n = codes.shape[1]
        self.p = np.zeros((len(codes), n + 1), np.uint64)
        np.cumsum(_mix(codes) * (_POWERS[:n] if n <= len(_POWERS) else _powers(_BASE, n)), axis=1, out=self.p[:, 1:])

    def moved(self, x, y, by: int):
        """The hash of words x to y, as if they stood `by` places further."""
        return (self.p[:, y] - self.p[:, x]) * _MOVES[by]


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


@lru_cache(1 << 14)
def _segments(m: int) -> np.ndarray:
    s = max(6, isqrt(m))
    return np.arange(s + 1) * m // s


def _tag(over: int, d: int, shift: int, q1: np.ndarray, q2: np.ndarray) -> np.ndarray:
    return (((over * 3 + d) * 3 + shift + 1) * _Q + q1) * _Q + q2


def _salt(m: int, d: int, kind: int, q1: np.ndarray, q2: np.ndarray) -> np.ndarray:
    return _mix(_tag(0, d, kind, q1, q2).astype(np.uint64) ^ _mix(np.array([m], np.uint64)))


def met(norm: bytes, w: list[bytes], shared: dict[int, int], max_edits: int = MAX_EDITS) -> dict[tuple[int, int], set[tuple[str, int]]]:
    """For (m, d), the (part, length) that the line shares with one that makes such a pair with it.

    m is the words of the pair's longer line and d how many more they are. shared: the line's first keys under which there
    are others, each with the lengths modulo 8 of all lines under it, as a set of bits; keys without a bit are left out.
    """
    n, out = len(w), {}
    for h, (*_, meant) in zip(key_list(norm, w, max_edits), _plan(n, max_edits)):
        if lengths := shared.get(h):
            for m, part, size in meant:
                for d in range(bound(m, max_edits) + 1) if m == n else (m - n,):
                    if lengths >> ((m - d if m == n else m) % 8) & 1:
                        out.setdefault((m, d), set()).add((part, size))
    return out


def window_keys(sums: Sums, shared: dict[tuple[int, int], set[tuple[str, int]]], max_edits: int = MAX_EDITS) -> tuple[np.ndarray, np.ndarray]:
    """(keys, tags) of all but one or two segments, for the pairs that met() leaves: a row of keys per line, under one row of tags.

    A pair's longer line, of m words, cuts the segments; the other is d words shorter, and between two segments it is
    moved by `shift`. The tag holds m - n, d, shift and the segments' numbers.
    """
    n, keys, tags = sums.n, [np.empty((len(sums.p), 0), np.uint64)], [np.empty(0, np.int64)]
    for (m, d), parts in sorted(shared.items()):
        find = _windows_of if m < 256 else _windows_of.__wrapped__  # what is remembered stays small
        for s, x, y, e, by, salt, tag in find(n, m, d, bound(m, max_edits), frozenset(parts)):
            rest = sums.p[:, s] + sums.moved(e, [n], m - n)
            if x is not None:
                rest = rest + sums.moved(x, y, by)
            keys.append(_mix(rest ^ salt))
            tags.append(tag)
    return np.concatenate(keys, axis=1), np.concatenate(tags)


@lru_cache(1 << 12)
def _windows_of(n: int, m: int, d: int, k: int, parts: frozenset) -> list[tuple]:
    """(end of the start, middle's start and end or none, start of the end, middle's move, salt, tag), arrays over windows."""
    at = _segments(m)
    q = np.arange(len(at) - 1)

    def may(first: np.ndarray, last: np.ndarray, last_start: np.ndarray, first_end: np.ndarray) -> np.ndarray:
        """Whether edits in windows from first to last leave some shared part alone, each window having one."""
        ok = np.zeros(len(first), bool)
        for p, size in parts:
            ok |= first_end >= size if p == "p" else last_start <= m - size if p == "s" else (first <= size) & (last >= 2 * size)
        return ok

    q1, q2 = (np.concatenate([q, q[:-1]]), np.concatenate([q, q[1:]])) if k == 2 else (q, q)
    s, e = at[q1], at[q2 + 1]
    ok = may(s, e, s, e) & (e + n - m >= s)
    q1, q2, s, e = q1[ok], q2[ok], s[ok], e[ok]
    out = [(s, None, None, e + n - m, 0, _salt(m, d, 0, q1, q2), _tag(m - n, d, 0, q1, q2))]
    if k == 2:
        a, b = _far_pairs(len(q))
        ok = may(at[a], at[b + 1], at[b], at[a + 1])
        a, b = a[ok], b[ok]
        for shift in ((-1, 0, 1) if d == 0 else (0,) if m == n else (-1, 0) if d == 1 else (-1,)):
            x, y, end = at[a + 1] + shift, at[b] + shift, at[b + 1] + n - m
            ok = (x >= at[a]) & (y >= x) & (end >= y)
            out.append((at[a][ok], x[ok], y[ok], end[ok], -shift, _salt(m, d, 1, a, b)[ok], _tag(m - n, d, shift, a, b)[ok]))
    return out


@cache
def _far_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 2)


def _useful(found: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(m - n, d, shift, q1, q2) of the tags, less those of two segments that meet no line which one of them alone does not.

    found: (tag, a hash of the set of lines under its key).
    """
    split = []
    for t, x in found:
        rest, q2 = divmod(t, _Q)
        kind, q1 = divmod(rest, _Q)
        split.append((kind // 9, kind // 3 % 3, kind % 3 - 1, q1, q2, x))
    one = {(o, d, a): x for o, d, _, a, b, x in split if a == b}
    return [(o, d, s, a, b) for o, d, s, a, b, x in split if a == b or x not in (one.get((o, d, a)), one.get((o, d, b)))]


def _spots(n: int, over: int, k: int, shift: int, q1: int, q2: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a window in a line of n words, and the pairs of two of them in which two edits may lie."""
    at = _segments(n + over)
    if q2 > q1 + 1:
        w1, w2 = np.arange(at[q1], at[q1 + 1] + shift), np.arange(at[q2] + shift, at[q2 + 1] - over)
        return np.concatenate([w1, w2]), np.repeat(w1, len(w2)), np.tile(w2, len(w1))
    own = np.arange(at[q1], at[q2 + 1] - over)
    i, j = np.triu_indices(len(own), 1) if k == 2 else (own[:0], own[:0])
    return own, own[i], own[j]


_remembered_spots = lru_cache(1 << 12)(_spots)


def deletion_keys(sums: Sums, windows: list[tuple[int, int, int, int, int]], max_edits: int = MAX_EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, roles) of the deletions inside the windows, a row per line, and which of them are a line's first of their kind.
    Role 0: all lines under the key are near each other; 1 and 2: each of role 1 is near each of role 2."""
    n, p = sums.n, sums.p
    keys, roles = [], []

    def add(kind: int, role: int, rest: np.ndarray, *places: np.ndarray) -> None:
        key = _mix(rest ^ _KINDS[kind])
        for x in places:
            key = _mix(key + _mix(x.astype(np.uint64) + _U(0x51)))
        keys.append(key)
        roles.append(np.full(key.shape[1], role, np.int8))

    def less(i: np.ndarray) -> np.ndarray:
        return p[:, i] + sums.moved(i + 1, [n], -1)

    # Windows of one kind are hashed together: a line has many, and most are short.
    kinds: dict[tuple[int, int, int], list] = {}
    find = _remembered_spots if n < 256 else _spots  # what is remembered stays small
    for over, d, shift, q1, q2 in windows:
        kinds.setdefault((over, d, shift), []).append(find(n, over, bound(n + over, max_edits), shift, q1, q2))
    for (over, d, shift), spots in kinds.items():
        k = bound(n + over, max_edits)
        own, i, j = (np.concatenate(x) for x in zip(*spots))
        own = np.unique(own)
        if k == 1:
            if d == 0:
                add(1, 0, less(own), own)
            elif over == 0:
                add(2, 1, less(own))
            else:
                add(2, 2, p[:, -1:])
            continue
        i, j = np.divmod(np.unique(i * (n + 1) + j), n + 1)
        rest = p[:, i] + sums.moved(i + 1, j, -1) + sums.moved(j + 1, [n], -2)
        if d == 0:
            if shift == 0:
                add(3, 0, rest, i, j)
            add(4, 0, less(own))
        elif d == 1 and over == 0:  # one of the two is left out, the other replaced, whose place in the shorter line counts
            add(5, 1, rest, j - 1)
            add(5, 1, rest, i)
        elif d == 1:
            add(5, 2, less(own), own)
        elif over == 0:
            add(6, 1, rest)
        else:
            add(6, 2, p[:, -1:])
    key, role = np.concatenate([np.empty((len(p), 0), np.uint64), *keys], axis=1), np.concatenate([np.empty(0, np.int8), *roles])
    told = key + role.astype(np.uint64)
    by = np.argsort(told, axis=1)
    told, new = np.take_along_axis(told, by, 1), np.ones(key.shape, bool)
    new[:, 1:] = told[:, 1:] != told[:, :-1]
    return np.take_along_axis(key, by, 1), role[by], new


_SHARED = pa.list_(pa.struct([("key", pa.int64()), ("lengths", pa.int32())]))


def _lines(max_edits: int):
    """A row per line with a word: its place, digest and first keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            at, nos, lids, ns, keys, ends = [], [], [], [], [], [0]

            def out() -> pa.RecordBatch:
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(keys, np.int64, len(keys))))
                return rows_of(b, ["doc_id", "h"], {"no": pa.array(nos, pa.int32()), "lid": pa.array(lids, pa.binary()), "n": pa.array(ns, pa.int32()), "keys": lists}, at)

            for r, text in enumerate(b.column("text").cast(pa.binary())):
                for no, line in enumerate((text.as_py() or b"").lower().split(b"\n")):
                    w = line.split()
                    if w:
                        at.append(r)
                        nos.append(no)
                        ns.append(len(w))
                        norm = b" ".join(w)
                        lids.append(digest(norm))
                        keys += key_list(norm, w, max_edits)
                        ends.append(len(keys))
                if len(nos) > 50_000:
                    yield out()
                    at, nos, lids, ns, keys, ends = [], [], [], [], [], [0]
            yield out()

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The compared lines of each document, with the keys that they share."""
    for b in batches:
        at, nos, lids, norms, keys = [], [], [], [], []
        for r, (text, where) in enumerate(zip(b.column("text").cast(pa.binary()), b.column("where"))):
            ls = (text.as_py() or b"").split(b"\n")
            for x in where.as_py():
                at.append(r)
                nos.append(x["no"])
                lids.append(x["lid"])
                norms.append(normalise(ls[x["no"]]))
                keys.append(x["keys"])
        made = {"no": pa.array(nos, pa.int32()), "lid": pa.array(lids, pa.binary()), "norm": pa.array(norms, pa.binary()), "keys": pa.array(keys, _SHARED)}
        yield rows_of(b, ["doc_id", "h"], made, at)


def _parts(lists: pa.ListArray) -> Iterator[list[list]]:
    """The fields of each list of structs, as lists: no object is made for a struct."""
    fields = [x.to_pylist() for x in lists.flatten().flatten()]
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    for a, b in zip([0, *ends], ends):
        yield [x[a:b] for x in fields]


def _alike(kinds: Iterable[tuple], words: list[list[bytes]]) -> Iterator[tuple[tuple, Sums, np.ndarray]]:
    """(kind, sums, positions) of the lines of one kind, which have equally many words, bounded in words."""
    groups: dict[tuple, list[int]] = {}
    for r, kind in enumerate(kinds):
        groups.setdefault(kind, []).append(r)
    for kind, own in groups.items():
        n = len(words[own[0]])
        step = max(1, _WORDS // n)
        for x in range(0, len(own), step):
            rows = own[x : x + step]
            yield kind, Sums(_codes([w for r in rows for w in words[r]]).reshape(len(rows), n)), np.array(rows)


#: Rows that are grouped by kind, and words of lines that are hashed at once.
_ROWS, _WORDS = 4096, 1 << 14


def _lists(sizes: list[np.ndarray], values: list[np.ndarray]) -> pa.ListArray:
    """Lists of these sizes of the values: a row per line, as a row per key takes many times the room and the time."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], *sizes]).cumsum(), pa.int32()), pa.array(np.concatenate(values), pa.int64()))


def _windows(max_edits: int):
    """(lid, keys, tags) of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(0, b.num_rows, _ROWS):
                part = b.slice(x, _ROWS)
                norms = part.column("norm").to_pylist()
                words = [norm.split() for norm in norms]
                kinds = []
                for norm, w, (shared, lengths) in zip(norms, words, _parts(part.column("keys"))):
                    found = met(norm, w, dict(zip(shared, lengths)), max_edits)
                    kinds.append((len(w), frozenset((pair, frozenset(parts)) for pair, parts in found.items())))
                at, sizes, keys, tags = [], [], [], []
                for (_, found), sums, rows in _alike(kinds, words):
                    key, tag = window_keys(sums, dict(found), max_edits)
                    at.append(rows)
                    sizes.append(np.full(len(rows), len(tag)))
                    keys.append(key.ravel().view(np.int64))
                    tags.append(np.tile(tag, len(rows)))
                yield rows_of(part, ["lid"], {"keys": _lists(sizes, keys), "tags": _lists(sizes, tags)}, np.concatenate(at))

    return run


def _deletions(max_edits: int):
    """(lid, keys) of each line; the two low bits of a key are its role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(0, b.num_rows, _ROWS):
                part = b.slice(x, _ROWS)
                words = [norm.split() for norm in part.column("norm").to_pylist()]
                kinds = [(len(w), tuple(sorted(_useful(list(zip(*found)))))) for w, found in zip(words, _parts(part.column("found")))]
                at, sizes, keys = [], [], []
                for (_, windows), sums, rows in _alike(kinds, words):
                    key, role, new = deletion_keys(sums, windows, max_edits)
                    at.append(rows)
                    sizes.append(new.sum(axis=1))
                    keys.append((key[new] & ~_U(3) | role[new].astype(np.uint64)).view(np.int64))
                yield rows_of(part, ["lid"], {"keys": _lists(sizes, keys)}, np.concatenate(at))

    return run


def _verified(max_edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("norm"), b.column("__norm")):
                x, y = x.as_py().split(), y.as_py().split()
                ok.append(near(x, y, bound(max(len(x), len(y)), max_edits)))
            yield pa.RecordBatch.from_arrays([b.column("lid").filter(pa.array(ok, pa.bool_()))], names=["lid"])

    return run


def _compared(max_edits: int):
    """The lines that are near an earlier one of their key; rows come sorted by key, then place, with at most FEW lines a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for b in batches:
            gone = []
            for k, lid, norm in zip(b.column("key").to_pylist(), b.column("lid").to_pylist(), b.column("norm").to_pylist()):
                w = norm.split()
                if k != key:
                    key, own = k, []
                elif any(near(x, w, bound(max(len(x), len(w)), max_edits)) for x in own):
                    gone.append(lid)
                own.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.binary())], names=["lid"])

    return run


def near_lines(docs: DataFrame, lines: DataFrame, kind: str, max_edits: int) -> DataFrame:
    """(doc_id, h, no): the lines that are near an earlier one. docs: doc_id, h and text; lines: distinct ones at their first places."""
    # A line that comes from repeated rows, or has a key twice, meets itself here; that costs a look and makes no link.
    keyed = lines.select("lid", *_PLACE, F.expr("shiftleft(1, n % 8)").alias("bit"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c"), F.bit_or("bit").alias("lengths")).where("c > 1")
    shared = cut(shared.select("key", F.when(F.col("c") > FEW, F.col("lengths")).otherwise(0).alias("lengths")))  # 0: its lines are few
    some = keyed.join(bounded_broadcast(shared, 24), "key").groupBy("lid", *_PLACE).agg(F.collect_set(F.struct("key", "lengths")).alias("keys"))
    places = some.groupBy("doc_id", "h").agg(F.collect_list(F.struct("no", "lid", "keys")).alias("where"))
    places = cut(places.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "where"))
    places = bounded_broadcast(places, F.lit(40) + F.aggregate("where", F.lit(0), lambda a, x: a + F.lit(64) + 16 * F.size(x["keys"])))
    texts = docs.join(places, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))).select("doc_id", "h", "text", "where")
    texts = texts.mapInArrow(_texts, f"doc_id {kind}, h long, no int, lid binary, norm binary, keys array<struct<key:long,lengths:int>>")
    # Repeated rows give a line's first place more than once.
    texts = cut(texts.dropDuplicates(["lid"]).select("lid", _place().alias("place"), "norm", "keys"))
    few = texts.select("lid", "place", "norm", F.explode(F.filter("keys", lambda x: x["lengths"] == 0)["key"]).alias("key"))
    near_ = few.repartition("key").sortWithinPartitions("key", "place").select("key", "lid", "norm").mapInArrow(_compared(max_edits), "lid binary")
    if not shared.where("lengths <> 0").isEmpty():
        near_ = near_.unionByName(_near_by_deletions(texts.where(F.exists("keys", lambda x: x["lengths"] != 0)), max_edits))
    near_ = cut(near_.distinct())
    return texts.join(bounded_broadcast(near_, 40), "lid", "left_semi").select("place.doc_id", "place.h", "place.no")


def _near_by_deletions(texts: DataFrame, max_edits: int) -> DataFrame:
    """(lid): the lines of texts, which is cut, that are near an earlier one with which they share a key of many lines."""
    # Most keys have one line: those go first, and only the rest is looked at closely.
    tagged = cut(_dealt(texts.select("lid", "norm", "keys")).mapInArrow(_windows(max_edits), "lid binary, keys array<long>, tags array<long>"))
    # Of lines that differ in length, a key needs a longer one and a shorter one.
    over, d = F.floor(F.col("tag") / (9 * _Q * _Q)), F.floor(F.col("tag") / (3 * _Q * _Q)) % 3
    tagged = tagged.select("lid", "tags", F.posexplode("keys").alias("at", "key")).select("lid", "key", F.get("tags", F.col("at")).alias("tag"))
    tagged = _shared(tagged.withColumn("role", F.when(d == 0, 0).when(over > 0, 2).otherwise(1)))
    # A low half counts the longer ones, a high one the shorter ones.
    half, mine = 1 << 32, F.xxhash64("lid")
    common = tagged.groupBy("key").agg(F.sum(F.when(F.col("role") == 2, F.lit(half)).otherwise(F.lit(1)).cast("long")).alias("n"), F.bit_xor(mine).alias("x"))
    found = tagged.join(common.select("key", F.xxhash64("n", "x").alias("who")), "key").groupBy("lid").agg(F.collect_set(F.struct("tag", "who")).alias("found"))
    var = cut(_dealt(cut(texts.select("lid", "norm").join(found, "lid"))).mapInArrow(_deletions(max_edits), "lid binary, keys array<long>"))
    var = _shared(var.select("lid", F.explode("keys").alias("of")).select("lid", F.expr("of & ~3L").alias("key"), F.expr("of & 3L").alias("role")))
    var = var.join(texts.select("lid", "place"), "lid")
    who = F.struct("place", "lid")
    of = lambda r: F.when(F.col("role") == r, who)
    best = var.groupBy("key").agg(F.min(of(0)).alias("m0"), F.max(of(0)).alias("x0"), F.min(of(1)).alias("m1"), F.min(of(2)).alias("m2")).where("m0 <> x0 or (m1 is not null and m2 is not null)")
    to = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = var.join(best, "key").select("lid", to.alias("to"), "place").where(F.col("to.place") < F.col("place")).select("lid", F.col("to.lid").alias("__lid")).distinct()
    norms = texts.select("lid", "norm")
    ends = pairs.join(norms, "lid").join(norms.select(F.col("lid").alias("__lid"), F.col("norm").alias("__norm")), "__lid")
    return ends.select("lid", "norm", "__norm").mapInArrow(_verified(max_edits), "lid binary")


def _dealt(df: DataFrame) -> DataFrame:
    """df, which is made from what is cut, dealt evenly: each row makes hundreds."""
    return packed(df).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows of keyed, made from what is cut, under whose key two lines may be near: two of role 0, or one of role 1 and one of role 2."""
    mine = F.xxhash64("lid")  # a line of repeated words may have a key more than once
    keys = keyed.groupBy("key").agg(F.min(mine).alias("a"), F.max(mine).alias("b"), F.bit_or(F.expr("shiftleft(1, int(role))")).alias("roles"))
    keys = cut(keys.where("a <> b and (roles & 1 = 1 or roles & 6 = 6)").select("key"))
    return cut(keyed.join(bounded_broadcast(keys, 16), "key", "left_semi"))


_PLACE = ("doc_id", "h", "no")


def _place():
    """What "earliest" goes by: doc_id, null ones last, then rows of one doc_id by a hash of their text, then line number."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "no")


def line_decisions(docs: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(doc_id, h, gone, n_near): the numbers (from 0) of the lines that go, and how many of them for a near match.

    h is xxhash64(text): rows are told apart by doc_id and text, and repeated rows share their fate. Lines without a word
    are never compared and stay; every other line is compared for equality, and for nearness if bound() of the longer one
    is not 0 (10 words; 20 for two edits). "Earliest" is by doc_id, null ones last, then line number. max_edits is 0, 1
    or 2. A null text has no lines. A row that loses no line has an empty list or none.
    """
    if max_edits not in (0, 1, 2):
        raise ValueError("max_edits must be 0, 1 or 2")
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    lines = cut(own.mapInArrow(_lines(max_edits), f"doc_id {kind}, h long, no int, lid binary, n int, keys array<long>"))
    # Only lines that come more than once are looked for among all: no line's copies are joined to each other or sorted.
    several = cut(lines.groupBy("lid").agg(F.count("*").alias("n")).where("n > 1"))
    copies = _beside(lines.select("lid", *_PLACE), several.select("lid"), several, 40)
    first = cut(copies.groupBy("lid").agg(F.min(_place()).alias("first")))
    rows = _beside(lines.select("lid", *_PLACE), first, several, 96).where(~_place().eqNullSafe(F.col("first"))).select(*_PLACE, F.lit(False).alias("near"))
    if max_edits:
        own_first = lines.where(F.size("keys") > 0).join(bounded_broadcast(first, 96), "lid", "left").where(F.col("first").isNull() | _place().eqNullSafe(F.col("first")))
        rows = rows.unionByName(near_lines(own, own_first, kind, max_edits).withColumn("near", F.lit(True)))
    per = rows.groupBy("doc_id", "h").agg(F.collect_set("no").alias("gone"), F.collect_set(F.when(F.col("near"), F.col("no"))).alias("near"))
    return per.select("doc_id", "h", F.array_sort("gone").alias("gone"), F.size("near").cast("long").alias("n_near"))


def _beside(lines: DataFrame, table: DataFrame, counts: DataFrame, row_bytes: int) -> DataFrame:
    """lines joined to table on lid; without a shuffle while table is small, and else with hot lids, told by counts, apart."""
    few = bounded_broadcast(table, row_bytes)
    return join_split(lines, table, "lid", counts) if few is table else lines.join(few, "lid")


def _bare(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{BLANKS}]")


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS, detail: bool = False, drop_emptied: bool = False) -> DataFrame:
    """docs with the lines that an earlier line equals or nearly equals cut out of text; see line_decisions.

    With detail, n_lines, n_removed and n_near follow. With drop_emptied, rows that are left without a word go; rows that
    had none before stay. Null texts stay null, other columns as they are.
    """
    p = fresh(docs)
    d = line_decisions(docs, max_edits).where(F.size("gone") > 0).select(F.col("doc_id").alias(f"{p}id"), F.col("h").alias(f"{p}h"), F.col("gone").alias(f"{p}gone"), F.col("n_near").alias(f"{p}near"))
    # Few documents lose lines: while their line numbers fit, the texts are not shuffled.
    d = bounded_broadcast(cut(d), F.lit(48) + 4 * F.size(f"{p}gone"))
    j = docs.join(d, F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & (F.xxhash64("text") == F.col(f"{p}h")), "left")
    j = held(j, f"{p}lines", F.when(F.col(f"{p}gone").isNotNull(), F.split("text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size(f"{p}lines") - 1), F.col(f"{p}gone"))
    left = F.when(F.col(f"{p}gone").isNotNull(), F.array_join(F.transform(stay, lambda i: F.get(f"{p}lines", i)), "\n")).otherwise(F.col("text"))
    j = j.withColumn(f"{p}left", left)
    if drop_emptied:
        j = j.where(~_bare(F.col(f"{p}left")) | _bare(F.col("text")))
    cols = [F.col(f"{p}left").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if detail:
        n = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
        cols += [n.cast("long").alias("n_lines"), F.coalesce(F.size(f"{p}gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(f"{p}near", F.lit(0)).cast("long").alias("n_near")]
    return j.select(*cols)
