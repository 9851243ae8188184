"""The watch source over a tree that changes, debounced bursts against the batch form, and re-indexing on changes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.operators import delta, logs, sessions
from corvane.sources.snapshots import Store
from corvane.streaming import watch


def run_once(df, at, name, **options):
    q = df.writeStream.format("parquet").option("path", str(at / name)).option("checkpointLocation", str(at / f"{name}-ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_watch_source_yields_differences_across_restarts(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "src").mkdir(parents=True)
    (tree / "target").mkdir()
    (tree / "src" / "a.py").write_text("a")
    (tree / "b.py").write_text("b")
    events = lambda: watch.watch(spark, str(tree), str(tmp_path / "state"))
    seen = set()

    def new():
        run_once(watch.relevant(events()), tmp_path, "out")
        got = {(r.kind, r.path) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        fresh = got - seen
        seen.update(got)
        return fresh

    assert new() == {("create", "src/a.py"), ("create", "b.py")}
    (tree / "b.py").write_text("bb")
    (tree / "src" / "a.py").unlink()
    (tree / "target" / "c.py").write_text("c")
    assert new() == {("modify", "b.py"), ("remove", "src/a.py")}
    assert new() == set()


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_debounce_equals_the_batch_form(spark, tmp_path, rocks):
    times = [0, 100, 599, 600, 650, 1300, 1301, 5000, 5599, 5600, 9000]
    rows = [(k, f"p{t % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=t)) for k in ("x", "y") for t in (times if k == "x" else times[3:])]
    rows.append(("z", "end", dt.datetime(2024, 1, 2)))  # time moves on past all bursts
    src = tmp_path / "in"
    for i, part in enumerate((rows[:4], rows[4:9], rows[9:])):  # three batches, so that bursts lie in more than one
        spark.createDataFrame(part, "key string, path string, ts timestamp").coalesce(1).write.mode("append").parquet(str(src))
        run_once(watch.debounced(spark.readStream.schema("key string, path string, ts timestamp").parquet(str(src)), late="10 seconds"), tmp_path, "bursts")
        del i
    got = sorted((r.key, r.opened_ms, r.n) for r in spark.read.parquet(str(tmp_path / "bursts")).collect() if r.key != "z")
    batch = spark.createDataFrame(rows, "key string, path string, ts timestamp").where("key <> 'z'")
    want = sorted(map(tuple, sessions.bursts(batch.select("key", F.unix_millis("ts").alias("t")), "key", "t").collect()))
    assert got == want


def test_changes_lead_to_one_update(spark, tmp_path):
    tree, store = tmp_path / "tree", Store(spark, str(tmp_path / "store"))
    tree.mkdir()
    passes = []

    def act(paths, number):
        rows = [(p.name, "python", p.read_text()) for p in sorted(tree.glob("*.py"))]
        seen = spark.createDataFrame(rows, "path string, lang string, text string").withColumn("hash", F.md5("text"))
        passes.append(delta.update(store, seen)[1].first().indexed)

    for name in ("a.py", "b.py"):
        (tree / name).write_text(f"def {name[0]}():\n    pass\n")
        q = watch.on_bursts(watch.watch(spark, str(tree), str(tmp_path / "state")), act, "1 second", str(tmp_path / "ck"), once=True)
        q.awaitTermination(180)
        assert q.exception() is None
    assert passes == [1, 1] and store.open().read("symbols").count() == 2


def test_fragments_split_at_any_byte(spark):
    text = 'data: {"choices":[{"delta":{"content":"héé\\nllo","tool_calls":[{"index":1,"id":"b","function":{"name":"ru","arguments":"{\\"x\\""}},{"index":0,"function":{"name":"ls"}}]}}]}\r\n: note\ndata:\n\ndata: {"choices":[{"delta":{"content":" there","reasoning_content":"hm","tool_calls":[{"index":1,"function":{"name":"n","arguments":":1}"}}]},"finish_reason":"stop"}]}\ndata: {"choices":[{"delta":{"content":"late"}}]}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"later"}}]}'
    b = text.encode()
    rows = [(n, i, bytearray(b[k : k + n])) for n in (1, 2, 7, 1000) for i, k in enumerate(range(0, len(b), n))]
    chunks = spark.createDataFrame(rows, "s int, seq int, data binary").repartition(3)
    got = logs.replies(logs.records(chunks, "s", "seq", "data"), "s").collect()
    assert len(got) == 4
    for r in got:
        assert (r.content, r.thinking) == ("héé\nllo there", "hm")
        assert [tuple(c) for c in r.calls] == [(0, None, "ls", "{}"), (1, "b", "run", '{"x":1}')]


def test_summaries_of_odd_logs(spark):
    rows = [(1, "", True), (2, None, False), (3, "\n".join(f"line {i}" for i in range(60)), False), (4, "\n".join([*(f"FAILED t{i}" for i in range(30)), " 3 passed "]), False)]
    got = {r.id: r.summary for r in logs.summarized(spark.createDataFrame(rows, "id int, text string, ok boolean"), "id", "text", "ok").collect()}
    bare = "\n(no recognizable summary line — raw output tail)\n"
    assert got[1] == "TESTS PASSED\n" + bare and got[2] == "TESTS FAILED\n" + bare
    assert got[3] == "TESTS FAILED\n" + bare + "\n".join(f"line {i}" for i in range(20, 60))
    assert got[4] == "TESTS FAILED\n3 passed\n\nfailing:\n" + "\n".join(f"FAILED t{i}" for i in range(20)) + "\n"
