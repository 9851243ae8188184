import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import languages
from corvane.functions import text as T
from corvane.operators import context, index, sessions


def model_chunks(text, window, overlap):
    ls = re.sub(r"\r?\n\Z", "", text)
    ls = re.split(r"\r?\n", ls) if text else []
    out, start = [], 0
    while ls:
        end = min(start + window, len(ls))
        out.append((start + 1, end, "\n".join(ls[start:end])))
        if end == len(ls):
            break
        start += window - overlap
    return out


def test_chunks_follow_the_model(spark):
    rng = random.Random(1)
    texts = ["", "a", "a\n", "a\r\nb", *("\n".join(rng.choice("xyz") for _ in range(rng.randint(1, 40))) for _ in range(30))]
    df = T.chunk(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", 8, 3)
    got = sorted((r.id, r.start_line, r.end_line, r.body) for r in df.collect())
    assert got == sorted((i, *c) for i, t in enumerate(texts) for c in model_chunks(t, 8, 3))


def test_strings(spark):
    row = spark.range(1).select(
        T.fold(F.lit("CAFÉ Über")).alias("fold"), T.html_to_text(F.lit("<p>a &amp;lt; b</p><script>x</p></script><i>c")).alias("html"), T.camel_to_snake(F.lit("HTTPServer")).alias("snake"),
        T.percent_encode(F.lit("a b*~é")).alias("enc"), T.percent_decode(F.lit("a+b%2A%zz%C3%A9")).alias("dec"), T.strip_ansi(F.lit("\x1b[31mred\x1b[0m")).alias("ansi"), T.fold_path(F.lit("a/./b/../c")).alias("path"), T.fold_path(F.lit("../x")).alias("out"),
    ).first()
    assert tuple(row) == ("cafe uber", "a < b c", "http_server", "a+b%2A~%C3%A9", "a b*%zzé", "red", "a/c", None)


def test_globs(spark):
    rows = [("git *", "git status", True), ("git *", "git", False), ("*.py", "a.py", True), ("a.c", "abc", False), ("*", "", True), ("a*b*c", "aXbYc", True)]
    df = spark.createDataFrame(rows, "p string, t string, want boolean").withColumn("rx", T.glob_regex(F.col("p"))).selectExpr("t rlike rx as got", "want")
    assert all(r.got == r.want for r in df.collect())


def test_language_tags(spark):
    rows = {"a.rs": "rust", "Dockerfile.dev": "dockerfile", "x/Makefile": "makefile", "noext": "text", "A.PY": "python"}
    got = languages.tag(spark.createDataFrame([(k,) for k in rows], "path string"))
    assert {r.path: r.lang for r in got.collect()} == rows


def test_budget_skips_and_goes_on(spark):
    b = spark.createDataFrame([(i, n) for i, n in enumerate((60, 50, 30, 20, 10), 1)], "rank int, bytes long")
    assert tuple(context.assemble(b, 100).first()) == (100, "1,3,5")


def test_gates_and_update_twice(spark):
    rows = [("a\\b.txt", bytearray(b"x\ny")), ("bin", bytearray(b"a\0b")), ("bad", bytearray(b"\xff\xfe")), ("empty", bytearray(b""))]
    seen = index.gate(spark.createDataFrame(rows, "path string, content binary"))
    assert {r.path for r in seen.collect()} == {"a/b.txt", "empty"}
    none = seen.limit(0).select("path", "hash")
    files, chunks, states = index.update(seen, none, index.chunks_of(seen.limit(0)))
    assert {r.state for r in states.collect()} == {"added"} and chunks.count() == 1
    _, again, states = index.update(seen, files.select("path", "hash"), chunks)
    assert {r.state for r in states.collect()} == {"same"} and sorted(again.collect()) == sorted(chunks.collect())


def test_bursts_are_anchored(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 500, 900, 1000, 1600)], "k int, t long")
    assert sorted((r["at"], r.n) for r in sessions.bursts(df, "k", "t", 600).collect()) == [(0, 2), (900, 2), (1600, 1)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=12), st.integers(1, 120))
def test_assembly_follows_the_model(spark, sizes, budget):
    used, kept = 0, []
    for i, n in enumerate(sizes):
        if used + n <= budget:
            used, kept = used + n, [*kept, str(i)]
    df = spark.createDataFrame(list(enumerate(sizes)), "rank int, bytes long")
    assert tuple(context.assemble(df, budget).first()) == (used, ",".join(kept))
