"""Columns of the input that are called what an operator calls its own keep their values."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from corvane.llm import decontaminate, language_id, line_dedup, mixing, simhash

NAMES = "_ __ ___ __id __h __gone __near __lines __left __hit_id __hit_h __hit_spans __words _id _h _gone _hit_id _words h key keys n no lid fp row u copies count part items spans pos w at size rate target lang_pred rejected component_id root a b term df lang source n_chars where place".split()
WORDS = [f"word{i}" for i in range(60)]
TEXTS = [" ".join(WORDS[:30]) + "\nthe same long line of ten or more words stands here twice\nEnd.", "the same long line of ten or more words stands here twice\n" + " ".join(WORDS[10:50]), " ".join(WORDS[5:45]), "only a few words of plain english text are here and there", None, ""]
BENCH = [(1, " ".join(WORDS[40:50]))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *(f"{c}-{i}" for c in NAMES)) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in NAMES)]))
    return df.withColumn("n_chars", F.lit(7).cast("long"))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def kept(df, docs):
    """Ids of the rows of df, all of whose own columns are those of their row in docs."""
    assert df.columns == docs.columns
    rows = df.collect()
    for r in rows:
        assert all(r[c] == f"{c}-{r.doc_id}" for c in NAMES if c != "n_chars")
    return sorted(r.doc_id for r in rows), {r.doc_id: r.text for r in rows}


def test_line_dedup(docs):
    ids, texts = kept(line_dedup.dedup_lines(docs), docs)
    assert ids == list(range(len(TEXTS))) and texts[0] == TEXTS[0] and texts[1] == TEXTS[1].split("\n")[1] and texts[4] is None
    assert kept(line_dedup.dedup_lines(docs, drop_emptied=True), docs)[0] == ids


def test_decontamination(docs, bench):
    assert kept(decontaminate.decontaminate(docs, bench), docs)[0] == [0, 2, 3, 4, 5]
    _, texts = kept(decontaminate.decontaminate(docs, bench, remove="spans"), docs)
    assert texts[1] == " ".join([*TEXTS[1].split("\n")[0].split(), *WORDS[10:40]]) and texts[2] == TEXTS[2]


def test_near_duplicates_language_and_mix(docs):
    assert kept(simhash.drop_near_duplicates(docs), docs)[0] == [0, 1, 2, 3, 4]  # an empty text is a copy of a null one
    training = docs.withColumn("lang", F.lit("en"))
    fitted = language_id.fit(language_id.training_rows(training))
    assert set(kept(language_id.keep_identified(docs, fitted), docs)[0]) <= {0, 1, 2, 3}
    assert set(kept(mixing.mix(docs), docs)[0]) <= set(range(len(TEXTS)))


def test_stages_keep_all_columns(spark, docs, bench, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in cp.STAGES[1:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert all(r["__gone"] == f"__gone-{r.doc_id}" and r["key"] == f"key-{r.doc_id}" for r in out.collect())
    packed = cp.STAGES[4][1](spark, docs, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len(TEXTS)
