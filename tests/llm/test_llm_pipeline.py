"""Every stage of the pipeline on rows that break jobs, and on no rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, label int, size long"


def rows():
    rng = random.Random(5)
    good = [(i, " ".join(rng.choices(["the", "sea", "was", "calm", "and", "blue", "with", "gulls"], k=40)), "en", rng.choice(["a", "b", None])) for i in range(80)]
    junk = [(i, " ".join(rng.choices(["$$%%", "BUY!!", "||##"], k=40)), "en", "a") for i in range(80, 120)]
    odd = [(200, None, None, None), (201, "", "en", "a"), (202, " \n\t", None, "b"), (None, "the sea was calm and blue", "en", "a"), (203, "the sea " * 20_000, "en", "b"), (204, good[3][1], "en", "a"), (204, good[3][1], "en", "a"), (205, good[7][1] + " mail a.b@c.de", None, None)]
    return [(*r, len(r[1]) if r[1] is not None else None, "x", 1, 2, 3) for r in good + junk + odd]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame([(i, int(i < 80), 0) for i in range(120)] + [(None, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def through(spark, made, folder, tmp_path):
    """docs before each stage, and the last result."""
    out = [made]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], folder).write.parquet(f"{tmp_path}/{name}")
        out.append(spark.read.parquet(f"{tmp_path}/{name}"))
    return out


def test_stages_keep_what_they_should(spark, folder, tmp_path):
    made = spark.createDataFrame(rows(), COLUMNS)
    docs, good, distinct, private, mixed, packed = through(spark, made, folder, tmp_path)
    for frame in (good, distinct, private, mixed):
        assert frame.columns == docs.columns
    ids = lambda frame: {r["doc_id"] for r in frame.select("doc_id").collect()}
    assert set(range(80)) <= ids(good) and not ids(good) & set(range(80, 120))
    assert {3, 7} <= ids(distinct) and not ids(distinct) & {204}
    assert private.count() == distinct.count() and private.where("text LIKE '%a.b@c.de%'").count() == 0
    plan = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix_plan(private).collect()}
    assert mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(plan.values())
    ends = packed.groupBy("doc_id").agg(F.sum(F.when(F.col("start") + F.col("length") == F.col("doc_tokens"), 1)).alias("n"))
    assert {r["doc_id"]: r["n"] for r in ends.collect()} == {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}


def test_stages_of_no_rows(spark, folder, tmp_path):
    for frame in through(spark, spark.createDataFrame([], COLUMNS), folder, tmp_path):
        assert frame.count() == 0
