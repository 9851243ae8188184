"""Snapshot store and stored search index."""

import math
import re

import pytest
from pyspark.sql import functions as F

from corvane.operators import search, stored_search
from corvane.sources.snapshots import Conflict, Missing, Store, clear


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"))


def test_readers_hold_their_version_and_one_of_two_writers_wins(spark, store):
    with pytest.raises(Missing):
        store.open()
    empty = store.open_or_init()
    assert (empty.version, empty.tables) == (0, {}) and store.open_or_init().version == 0
    one = store.commit(empty, replace={"t": spark.range(3)})
    two = store.commit(one, add={"t": spark.range(3, 5)})
    assert rows(store.open().read("t")) == [(i,) for i in range(5)] and rows(store.open(1).read("t")) == [(i,) for i in range(3)]
    with pytest.raises(Conflict):
        store.commit(one, replace={"t": spark.range(9)})
    # Two writers that both saw version 2 before either published: the rename decides.
    other = Store(spark, store.root)
    other.versions = lambda: [0, 1, 2]
    three = store.commit(two, replace={"t": spark.range(1)})
    with pytest.raises(Conflict):
        other.commit(two, replace={"t": spark.range(7)})
    assert rows(store.open().read("t")) == [(0,)] == rows(three.read("t"))
    assert not [n for n, _ in store._names("_log") if not n.isdigit() and not n.endswith(".crc")]


def test_a_killed_write_leaves_the_version_before(spark, store):
    one = store.commit(store.open_or_init(), replace={"t": spark.range(3)})
    boom = spark.range(8).select(F.when(F.col("id") == 7, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        store.commit(one, replace={"t": boom})
    store.write(spark.range(4))  # data without a manifest
    assert store.versions() == [0, 1] and rows(store.open().read("t")) == [(0,), (1,), (2,)]
    assert store.vacuum(older_than_s=3600) == 0
    assert store.vacuum(older_than_s=-60) >= 1 and store.versions() == [1]
    assert rows(store.open().read("t")) == [(0,), (1,), (2,)]


def test_clear_spares_captured_output(spark, store):
    chunks = spark.createDataFrame([(1, "chunk"), (2, "tool_output"), (3, "symbol")], "id int, kind string")
    store.commit(store.open_or_init(), replace={"chunks": chunks, "files": spark.range(2), "runs": spark.range(1)})
    left = clear(store)
    assert rows(left.read("chunks")) == [(2, "tool_output")] and set(left.tables) == {"chunks", "runs"}


TEXTS = [(i, " ".join(["the"] * (i % 7) + ["rare"] * (i % 41 == 0) + ["foo", "bar"] * (i % 5 == 0) + [f"w{i % 97}"] * (1 + i % 3) + ["bar foo"] * (i % 11 == 0))) for i in range(600)] + [(1000, None), (1001, ""), (1002, "Café FOO_BAR foo-bar"), (1003, "x" * 100_000 + " the")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "key long, text string")


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("i") / "s"))
    for part in range(3):  # three segments
        snapshot = stored_search.append(store, texts.where(F.col("key") % 3 == part), per_range=16)
    return store, stored_search.open_index(snapshot)


@pytest.mark.parametrize("terms", [["the"], ["rare", "w5"], ["foo", "the", "w3", "foo"], ["none"], [], ["cafe", "w1", "w2", "w3", "w4"]])
def test_stored_search_equals_a_scan(texts, index, terms):
    for first in (1, 8, 1000):
        got = stored_search.bm25(index[1], terms, 10, first).collect()
        assert [tuple(r) for r in got] == ([tuple(r) for r in search.bm25(texts, "key", "text", terms, 10).collect()] if terms else [])


def test_batches_equal_single_searches(spark, index):
    qs = [(1, "rare w5"), (2, "the foo bar"), (3, "nothing here"), (4, None), (5, "cafe the the")]
    got = rows(stored_search.bm25_batch(index[1], spark.createDataFrame(qs, "q int, t string"), "q", "t", 5, first=2))
    want = sorted((q, *r, i) for q, t in qs if t for i, r in enumerate(map(tuple, stored_search.bm25(index[1], re.findall(r"\w+", t), 5).collect()), 1))
    assert got == want


def phrase_counts(words):
    n = len(words)
    toks = {k: re.findall(r"[^\W_]+", (t or "").lower().replace("é", "e")) for k, t in TEXTS}
    return {k: c for k, t in toks.items() if (c := sum(t[i : i + n] == words for i in range(len(t) - n + 1)))}, {k: len(t) for k, t in toks.items()}


def test_phrases_by_position(index):
    for words in (["foo", "bar"], ["bar", "foo"], ["the", "the", "the"], ["none", "foo"], ["the"]):
        assert {r.key: r.n for r in stored_search.phrase(index[1], words).collect()} == phrase_counts(words)[0]


def test_phrases_joined_by_or(index):
    query = "foo_bar, x Café rare! é"
    n, average = len(TEXTS), None
    score = {}
    for words in (["foo", "bar"], ["cafe"], ["rare"], ["e"]):
        found, lens = phrase_counts(words)
        average = sum(lens.values()) / n
        idf = max(math.log((n - len(found) + 0.5) / (len(found) + 0.5)), 1e-6) if found else 0
        for k, f in found.items():
            score[k] = score.get(k, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lens[k] / average))
    want = sorted(((k, round(s, 6)) for k, s in score.items()), key=lambda x: (-x[1], x[0]))[:12]
    assert [tuple(r) for r in stored_search.match(index[1], query, 12).collect()] == want
    assert stored_search.match(index[1], "a . -", 5).count() == 0


def test_merge_equals_an_index_of_what_is_left(spark, texts, index, tmp_path):
    store = index[0]
    merged = stored_search.open_index(stored_search.merge(store, drop=texts.where("key % 4 = 0").select("key"), per_range=50))
    left = texts.where("key % 4 <> 0")
    assert merged.n == left.count() and len(store.open().tables["blocks"]) == 1
    assert rows(stored_search.term_stats(merged)) == rows(search.term_stats(left, "key", "text"))
    assert rows(stored_search.bm25(merged, ["the", "w3"], 7)) == rows(search.bm25(left, "key", "text", ["the", "w3"], 7))
    assert stored_search.open_index(store.open(3)).n == len(TEXTS)


def test_the_scan_is_pruned_by_folder_and_term(index):
    plan = stored_search.of_terms(index[1], ["rare"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    files = stored_search.of_terms(index[1], ["rare"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({re.search(r"folder=\d+", r.f)[0] for r in files}) == 1


def test_an_empty_index(spark, store, texts):
    none = stored_search.open_index(stored_search.append(store, texts.limit(0)))
    assert (none.n, none.average) == (0, 0.0)
    assert stored_search.bm25(none, ["the"]).count() == stored_search.phrase(none, ["the", "x"]).count() == stored_search.match(none, "foo_bar the").count() == 0


def test_merge_sends_no_posting_by_itself(spark, texts, tmp_path):
    """Blocks are shuffled whole: what a merge sends between tasks is far fewer rows than there are postings."""
    store = Store(spark, str(tmp_path / "whole"))
    many = texts.select("key", F.concat_ws(" ", "text", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("q"), i.cast("string")))).alias("text"))
    for part in (0, 1):
        stored_search.append(store, many.where(F.col("key") % 2 == part))
    status = spark.sparkContext._jsc.sc().statusStore()

    def sent():
        it, out = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator(), {}
        while it.hasNext():
            s = it.next()
            out[s.stageId()] = s.shuffleWriteRecords()
        return out

    before = sent()
    merged = stored_search.open_index(stored_search.merge(store, drop=many.where("key % 4 = 0").select("key")))
    rows_sent = sum(v for k, v in sent().items() if k not in before)
    left = many.where("key % 4 <> 0")
    assert merged.n == left.count()
    assert rows(stored_search.term_stats(merged)) == rows(search.term_stats(left, "key", "text"))
    assert rows_sent < 60 * merged.n / 2
