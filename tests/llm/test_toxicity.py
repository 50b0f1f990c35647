"""The classifier on rows it never saw, and its edge cases; then the pipeline."""

import math
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from vellum.llm import toxicity
from vellum.llm.toxicity import drop_toxic, fit_toxicity, label_posterior, score_toxicity, shared_weight


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = table(spark, sf_dir, "labels")
    rows = score_toxicity(table(spark, sf_dir, "documents"), labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    y, rank = rows["toxic"] == 1, rows["score"].rank()
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc >= 0.9
    assert (y & (rows["predicted"] == 1)).sum() >= 0.9 * (rows["predicted"] == 1).sum()


def test_held_out_labels_are_never_used(spark):
    docs = spark.createDataFrame([(k, f"text {'idiot scum' if k % 2 else 'fine day'} {k}") for k in range(300)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    out = score_toxicity(docs, labels)
    held = out.filter("held_out").select("doc_id")
    other = labels.join(held, "doc_id", "left_anti").unionByName(labels.join(held, "doc_id").selectExpr("doc_id", "1 - toxic as toxic"))
    again = score_toxicity(docs, other)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in out.collect()}
    assert out.filter("held_out and predicted <> doc_id % 2").count() == 0


def test_edge_rows(spark):
    schema = "doc_id long, text string, score double, predicted int, label int, toxic string"
    docs = spark.createDataFrame([(1, None, None, None, None, "t"), (2, "", 0.1, 1, 1, "t"), (None, "idiot", 0.2, 0, 0, None), (3, "x" * 200_000, 0.3, 0, 0, None), (3, "idiot", 0.0, 0, 0, None)], schema)
    for rows in ([], [(1, None), (None, 1), (2, 5), (3, 1), (3, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        out = score_toxicity(docs, labels).collect()
        assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
        assert score_toxicity(docs.limit(0), labels).count() == 0
        assert drop_toxic(docs, labels).columns == docs.columns


def test_label_model_corrects_wrong_labels():
    rng = np.random.default_rng(0)
    truth = rng.random(2000) < 0.3
    votes = np.stack([np.where(truth, rng.random(2000) < 0.6, rng.random(2000) < 0.02) for _ in range(8)], axis=1)
    given = np.where(rng.random(2000) < 0.05, ~truth, truth).astype(int)
    post = label_posterior(votes, given)
    assert ((post > 0.5) == truth).mean() > 0.98 > (given == truth).mean()


def test_voters_that_fire_together_count_once(monkeypatch):
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    own = np.stack([np.where(truth, rng.random(4000) < 0.6, rng.random(4000) < 0.1) for _ in range(4)], axis=1)
    one = np.where(truth, rng.random(4000) < 0.7, rng.random(4000) < 0.3)
    copies = np.concatenate([own, np.repeat(one[:, None], 8, axis=1)], axis=1)
    none = np.full(4000, -1)
    alone, many = label_posterior(np.c_[own, one], none), label_posterior(copies, none)
    shared = np.abs(alone - many).mean()
    post = np.where(truth, 1.0, 0.0)
    rate = [copies[truth].mean(axis=0), copies[~truth].mean(axis=0)]
    weight = shared_weight(copies.astype(float), np.ones(4000), post, rate)
    assert np.allclose(weight[4:], 1 / 8, atol=0.02) and (weight[:4] > 0.9).all()
    monkeypatch.setattr(toxicity, "shared_weight", lambda votes, *_: np.ones(votes.shape[1]))
    assert shared < 0.05 and np.abs(alone - label_posterior(copies, none)).mean() > 3 * shared


def plain_scores(model):
    """The score of a text by the model's weights, spelled out."""
    weight = dict(zip(model.names, model.weights, strict=True))

    def score(text):
        words = {w for w in re.findall(r"[^\W\d_]+", text.lower())}
        stems = {w: {s for s in [w, w[:4], w[:5], w[:6]] if s in weight and (s == w or len(w) > len(s))} for w in words}
        fired = set().union(*stems.values()) | {n for n, p in (("/exclaiming", "!{3}"), ("/masked", "[A-Za-z][*@#$]{2}"), ("/shouting", "[A-Z]{4}")) if re.search(p, text)}
        telling = sum(bool(s) for s in stems.values())
        fired |= {n for n, k in (("/words2", 2), ("/words4", 4), ("/words7", 7)) if telling >= k}
        return 1 / (1 + math.exp(-max(-30, min(30, model.bias + sum(weight[f] for f in fired)))))

    return score


def test_score_is_that_of_the_models_weights(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    plain = plain_scores(fit_toxicity(docs, labels))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in score_toxicity(docs, labels).collect():
        assert r["score"] == pytest.approx(plain(texts[r["doc_id"]]), abs=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= 0.7)


def test_scores_without_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = score_toxicity(docs, labels.limit(0)).join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    y, found = rows["toxic"] == 1, rows["predicted"] == 1
    assert (y & found).sum() >= 0.9 * found.sum() > 0


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = list(corpus_pipeline.COLUMNS)
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf_dir)
        assert out.columns == columns, name
        ids = {r["doc_id"] for r in out.collect()}
        assert ids <= {r["doc_id"] for r in seen.collect()}
        assert len(ids) >= 0.6 * seen.count(), name
        seen = out
    last = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in seen.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_stages_catch_planted_documents(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    item = items.orderBy("item_id").first()["text"]
    plain = "a harmless remark about the weather in spring that nobody has written before today in this form"
    rows = [(90_000, f"{plain} {item} {plain}", "en", "s", 1), (90_001, plain, "en", "s", 1), (90_002, plain, "en", "s", 1), (90_003, None, None, None, None)]
    more = spark.createDataFrame(rows, docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"] for r in stages["decontamination"](spark, more, sf_dir).collect()}
    assert kept == {90_001, 90_002, 90_003}
    assert {r["doc_id"] for r in stages["near_dedup"](spark, more, sf_dir).collect()} == {90_000, 90_001, 90_003}
    lines = {r["doc_id"]: r["text"] for r in stages["line_dedup"](spark, more, sf_dir).collect()}
    assert lines[90_001] == plain and lines[90_002] == "" and lines[90_003] == ""
    assert stages["toxicity"](spark, more.limit(0), sf_dir).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, more.limit(0), sf_dir).count() == 0
