"""Stages and operators on tables whose other columns have the names that the code would use."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm.decontaminate import decontaminate
from vellum.llm.linededup import dedup_lines
from vellum.llm.nearcopies import drop_near_copies
from vellum.llm.toxicity import drop_toxic

NAMES = (
    "_id _drops _new _gone _held key drops new gone held part low high parts other size keys s0 a b node code component "
    "class band least n first last fp word choice bucket piece start block words shard place slot target source_size taken "
    "digest score predicted held_out GONE_ a.b"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a line that is long enough\nand another line of text here", "en", "s", 5), (2, "a line that is long enough\nother", "en", None, 5),
            (3, None, None, None, None), (None, "", "en", "s", 0), (4, "one two three four five six seven", "en", "t", 2), (5, "one two three four five six seven", "en", "t", 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return table.select("*", *[F.lit(name).alias(name) for name in NAMES if name != "source"])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, "x"), (4, 1, "y")], "doc_id long, toxic int, text string")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one two three four five six seven", 3)], "item_id long, text string, doc_id long")


def test_filters_keep_the_columns(docs, labels, items):
    for out, ids in (
        (drop_near_copies(docs), {1, 2, 3, 4, None}),
        (decontaminate(docs, items), {1, 2, 3, None}),
        (drop_toxic(docs, labels), {1, 2, 3, 4, 5, None}),
    ):
        assert out.columns == docs.columns
        rows = out.collect()
        assert {r["doc_id"] for r in rows} == ids
        assert all(r["_gone"] == "_gone" and r["a.b"] == "a.b" for r in rows)


def test_line_dedup_keeps_the_columns(docs):
    out = dedup_lines(docs)
    assert set(out.columns) == {*docs.columns, "n_lines", "n_dropped"}
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[2]["text"] == "other" and rows[2]["_drops"] == "_drops" and rows[2]["_new"] == "_new" and rows[2]["a.b"] == "a.b"


def test_stages_return_the_columns_of_documents(spark, docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        assert {1, 2, 3, 4, None} <= {r["doc_id"] for r in out.collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
