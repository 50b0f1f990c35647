"""Files, versions, search, statistics, samples, releases and streams."""

import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.functions import arrays
from vellum.operators import goldset, history, ranking, relations, releases, resampling, sampling, search, statistics
from vellum.sinks import versions
from vellum.sources import records
from vellum.storage import with_positions
from vellum.streaming import events as streams
from vellum.streaming.marks import held_back, without_unknown


# -- sources and sinks ----------------------------------------------------------------------------
def bundle(spark):
    rows = {
        "documents": [{"key": "d1", "kind": "k", "title": "One", "source": {"title": "s", "url": None}, "attributes": {"a": "1"}}],
        "sections": [{"key": "s1", "document_key": "d1", "heading": "h", "context_path": ["p"], "ordinal": 1, "start_page": 1, "end_page": 2, "retrieval": "full", "blocks": [{"kind": "prose", "markdown": "text", "start_page": 1, "end_page": 1, "table_key": None}]}],
        "glossary": [{"term": "T", "case_sensitive": True, "expansions": ["e"], "aliases": [], "category": "c"}],
        "mappings": [{"key": "m", "aliases": ["x"], "visual_sign": "", "product_names": [], "section_keys": ["s1"]}],
    }
    return {n: spark.createDataFrame(r, records.SCHEMAS[n]) for n, r in rows.items()}


def test_bundle_round_trip(spark, tmp_path):
    b = bundle(spark)
    path = f"file://{tmp_path}/b"
    manifest = versions.write_bundle(b, path)
    assert manifest.count() >= 4
    read = records.read_bundle(spark, path)
    assert read["sections"].drop("_corrupt").collect() == b["sections"].collect()
    assert all(read[n].count() == b[n].count() for n in b)
    bad = b | {"sections": b["sections"].unionByName(b["sections"].withColumn("document_key", F.lit("none")))}
    with pytest.raises(ValueError, match="section_key|unknown"):
        versions.write_bundle(bad, path)


def test_bundle_folder_with_problems(spark, tmp_path):
    good = {"key": "s1", "document_key": "d1", "blocks": [{"kind": "prose", "markdown": "x", "start_page": 5, "end_page": 2}]}
    (tmp_path / "documents.jsonl").write_text('{"key": "d1", "title": " "}\n\n{"key": "d1"}\nbroken\n')
    (tmp_path / "sections.jsonl").write_text(json.dumps(good) + "\n" + json.dumps(good | {"key": "s2", "document_key": "d9", "blocks": []}) + "\n")
    (tmp_path / "glossary.json").write_text('[{"term": "a"}, {"term": " A "}]')
    (tmp_path / "mappings.json").write_text('[{"key": "m", "section_keys": ["s1", "zz"]}, {"key": "n", "section_keys": ["s1"]}]')
    found = records.bundle_findings(records.read_bundle(spark, f"file://{tmp_path}"))
    got = {(r["check"], r["id"]) for r in found.collect()}
    assert {("document_json", None), ("document_key", "d1"), ("document", "s2"), ("block_pages", "s1"), ("section_text", "s2"), ("document_title", "d1"),
            ("term", "a"), ("one_mapping", "s1"), ("section", "m")} <= got
    lines = records.bad_lines(spark, f"file://{tmp_path}/documents.jsonl", records.SCHEMAS["documents"]).collect()
    assert [r["id"].split(":")[-1] for r in lines] == ["4"]
    (tmp_path / "manifest.json").write_text('{"glossary.json": "0", "gone.json": "1"}')
    state = {r["id"]: r["message"] for r in records.manifest_findings(spark, f"file://{tmp_path}").collect()}
    assert state == {"glossary.json": "changed", "gone.json": "missing", "documents.jsonl": "unexpected", "sections.jsonl": "unexpected", "mappings.json": "unexpected"}


def test_sealed_records(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 0.5)], "k string, n int, x double")
    versions.append_sealed(df, path)
    versions.append_sealed(df.withColumn("n", F.col("n") + 10), path)
    assert sorted(r["n"] for r in records.read_sealed(spark, path, "k string, n int, x double").collect()) == [1, 2, 11, 12]
    part = next(p for p in (tmp_path / "log").glob("*.json") if '"n":1,' in p.read_text())
    (part.parent / f".{part.name}.crc").unlink()
    part.write_text(part.read_text().replace('"n":1,', '"n":3,') + '{"k": "torn')
    assert sorted(r["n"] for r in records.read_sealed(spark, path, "k string, n int, x double").collect()) == [2, 11, 12]


def test_vectors(spark, tmp_path):
    path = f"file://{tmp_path}/vectors"
    rows = [("m/1", "h1", [1.0, 2.0]), ("m/1", "h2", [3.0, float("nan")]), ("other", "h1", [1.0])]
    df = spark.createDataFrame(rows, "model string, embedding_text_sha256 string, vector array<float>")
    versions.write_vectors(df, path)
    got = records.read_vectors(spark, path, "m/1", 2).collect()
    assert [(r[0], r[1]) for r in got] == [("h1", [1.0, 2.0])]
    for bad in (("m/1", "h1", [0.0, 0.0]), ("other", "h3", [1.0, 2.0])):
        with pytest.raises(ValueError, match="repeated keys"):
            versions.write_vectors(df.unionByName(spark.createDataFrame([bad], df.schema)), path)


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    first = versions.publish_version(spark.range(3).toDF("x"), root)
    versions.publish_version(spark.range(5).toDF("x"), root)
    assert versions.read_version(spark, root).count() == 5
    assert versions.read_version(spark, root, first).count() == 3


def test_candidates_and_judgments(spark, tmp_path):
    hits = spark.createDataFrame([("q1", "text", 1, "c1", 0.5, "doc", "s", 1), ("q1", "text", 2, "c2", 0.4, "doc2", "s", 2)],
                                 "query_id string, query string, retrieval_rank int, chunk_id string, retrieval_score double, document_text string, section_id string, chunk_index int")
    versions.write_candidates(hits, f"file://{tmp_path}/c")
    each, found = records.read_candidates(spark, f"file://{tmp_path}/c")
    assert each.count() == 2 and found.count() == 0
    line = next((tmp_path / "c").glob("part*")).read_text()
    (tmp_path / "bad.json").write_text(line.replace('"doc2"', '"doc3"').replace('"query":"text"', '"query":"other"'))
    assert {r["check"] for r in records.read_candidates(spark, f"file://{tmp_path}/bad.json")[1].collect()} == {"query_hash", "document_hash"}
    (tmp_path / "j.json").write_text('{"query_id": "q", "intents": [{"section_id": "s", "intent": "i", "accepted_chunk_ids": ["a", "b"]}]}')
    assert records.read_judgments(spark, f"file://{tmp_path}/j.json").count() == 2
    (tmp_path / "q.json").write_text('{"query_id": "b", "query": "x"}\n{"query_id": "a", "query": "y"}\n{"query_id": "c", "query": " "}\n')
    assert [r["query_id"] for r in records.read_queries(spark, f"file://{tmp_path}/q.json", 1).collect()] == ["a"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.html").write_text("<h1>x</h1>")
    assert records.read_pages(spark, f"file://{tmp_path}/p").count() == 1
    log = f"file://{tmp_path}/latest.json"
    (tmp_path / "latest.json").write_text('{"k": 1, "t": 1, "v": "a"}\n{"k": 1, "t": 2, "v": "b"}\n')
    assert records.read_latest(spark, log, "k int, t int, v string", ["k"], "t").first()["v"] == "b"


# -- search ---------------------------------------------------------------------------------------
def test_dense_search_odd_vectors(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [2.0, 0.0]), (None, [1.0, 0.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 0.0]), (12, None), (13, [5.0])], "query_id long, embedding array<double>")
    got = [(r["query_id"], r["id"], r["rank"]) for r in search.dense_search(asked, base, 5).orderBy("query_id", "rank").collect()]
    assert got == [(10, 1, 1), (10, 6, 2), (13, 4, 1)]
    assert search.dense_search(asked.limit(0), base, 5).count() == 0


def test_dense_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(90)]
    base = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    asked = base.withColumnRenamed("id", "query_id").filter("query_id % 3 = 0")
    whole = {tuple(r) for r in search.dense_search(asked, base, 4).collect()}
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    assert {tuple(r) for r in search.dense_search(asked, base, 4).collect()} == whole


def test_pack(spark):
    rng = np.random.default_rng(1)
    rows = [(int(q), int(i), float(rng.integers(5)), sorted((int(x) for x in rng.integers(1, 900, 3)), reverse=True)) for q in range(20) for i in range(8)]
    out = search.pack_evidence(spark.createDataFrame(rows, "request long, id long, score double, sizes array<long>"), 1500).collect()
    got = {q: sorted((r["place"], r["id"], r["form"], r["size"]) for r in out if r["request"] == q) for q in range(20)}
    for q in range(20):
        left, want = 1500, []
        for _, i, _, sizes in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])):
            form = next((k for k, s in enumerate(sizes) if s <= left), None)
            if form is not None:
                want.append((len(want) + 1, i, form + 1, sizes[form]))
                left -= sizes[form]
        assert got[q] == want


def test_hydrate_and_strategy(spark):
    chunks = spark.createDataFrame([("s", k, f"c{k}") for k in range(1, 6)], "section string, ordinal int, chunk string")
    hits = spark.createDataFrame([(1, "s", 3, "full_section", 0), (2, "s", 1, "chunk_window", 1), (3, "s", 1, "search_only", 1)], "hit int, section string, ordinal int, strategy string, radius int")
    counts = {r["hit"]: r["count"] for r in search.hydrate(hits, chunks).groupBy("hit").count().collect()}
    assert counts == {1: 5, 2: 2}
    df = spark.createDataFrame([("index_only", 1), ("x", 16_001), ("x", 16_000)], "m string, n int")
    assert [r[0] for r in df.select(search.strategy_of(F.col("m"), F.col("n"))).collect()] == ["search_only", "chunk_window", "full_section"]


def gold(spark, **over):
    row = dict(query_id=1, mode="single", granularity="section", gold_section="a", gold_sections=["a"], gold_chunks=["c9"], gold_index=5, judged=None) | over
    return spark.createDataFrame([tuple(row.values())], "query_id int, mode string, granularity string, gold_section string, gold_sections array<string>, gold_chunks array<string>, gold_index int, judged map<string,array<string>>")


RESULTS = [("b", "c1", 1), ("a", "c2", 7), ("a", "c3", 6), ("c", "c9", None)]


@pytest.mark.parametrize(
    ("over", "first", "ndcg"),
    [
        ({}, 2, 1 / np.log2(3)),
        ({"granularity": "chunk_window"}, 3, 0.5),
        ({"granularity": "chunk_window", "gold_index": -1}, None, 0),
        ({"granularity": "chunk_exact"}, 4, 1 / np.log2(5)),
        ({"mode": "any_acceptable", "gold_sections": ["c", "b"]}, 1, 1),
        ({"judged": {"a": ["c1"]}}, 1, 1),
        ({"mode": "multi_required", "gold_sections": ["a", "z"]}, 2, 1 / np.log2(3) / (1 + 1 / np.log2(3))),
        ({"mode": "multi_required", "gold_sections": ["a", "z"], "judged": {"z": ["c9"]}}, 2, (1 / np.log2(3) + 1 / np.log2(5)) / (1 + 1 / np.log2(3))),
    ],
)
def test_ranking_modes(spark, over, first, ndcg):
    results = spark.createDataFrame([(1, k + 1, *r) for k, r in enumerate(RESULTS)], "query_id int, rank int, section string, chunk string, chunk_index int")
    got = ranking.score_rankings(gold(spark, **over), results).first()
    assert got["mrr"] == pytest.approx(1 / first if first else 0)
    assert got["ndcg_10"] == pytest.approx(ndcg)
    assert (got["hit_3"], got["hit_5"]) == (int(bool(first) and first <= 3), int(bool(first)))
    if over.get("mode") == "multi_required":
        both = "judged" in over
        assert (got["multi_recall_3"], got["multi_recall_5"], got["multi_all_5"]) == (0.5, 1.0 if both else 0.5, int(both))
    none = ranking.score_rankings(gold(spark, **over), results.limit(0)).first()
    assert none["mrr"] == 0 and none["hit_30"] == 0


# -- statistics -----------------------------------------------------------------------------------
def test_intervals(spark):
    df = spark.createDataFrame([("a", 1)] * 10 + [("b", k % 2) for k in range(10)], "g string, x int")
    got = {r["g"]: (round(r["low"], 4), round(r["high"], 4)) for r in statistics.share_summary(df, ["g"], F.col("x")).collect()}
    assert got == {"a": (0.7225, 1.0), "b": (0.2366, 0.7634)}
    tests = spark.createDataFrame([(1, 0.04), (2, 0.01), (3, 0.03), (4, None)], "t int, p_value double")
    assert [r["adjusted"] for r in statistics.holm(tests.withColumn("f", F.lit(1)), ["f"]).orderBy("t").collect()] == [pytest.approx(0.06), pytest.approx(0.03), pytest.approx(0.06), None]
    same = spark.createDataFrame([("x", "x"), ("x", "x")], "a string, b string")
    assert tuple(statistics.agreement(same, "a", "b").first()) == (2, 1.0, 1.0, 1.0)
    few = spark.createDataFrame([(0.5, 1.0)], "j double, h double")
    assert statistics.ppi(few, "j", "h").first()["estimate"] is None
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert statistics.spearman(flat, "a", "b").first()["rho"] is None


def test_resampling(spark):
    rng = np.random.default_rng(2)
    rows = [(g, k, float(rng.normal(m, 1))) for g, m in (("zero", 0), ("one", 0.5)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, id int, x double")
    out = {r["g"]: r for r in statistics.paired_test(df.withColumn("key", F.concat("g", "id")), ["g"], "key", "x", 400).collect()}
    for g, r in out.items():
        values = np.array([x for a, _, x in rows if a == g])
        half = 1.96 * values.std() / 20
        assert r["mean"] == pytest.approx(values.mean()) and abs(r["high"] - r["low"] - 2 * half) < 0.6 * half
    assert out["one"]["p_value"] < 0.01 < 0.05 < out["zero"]["p_value"] or abs(out["zero"]["mean"]) > 0.08
    again = statistics.bootstrap_mean(df.repartition(7).withColumn("key", F.concat("g", "id")), ["g"], "key", "x", 400)
    assert {r["g"]: round(r["low"], 9) for r in again.collect()} == {g: round(r["low"], 9) for g, r in out.items()}
    alone = statistics.bootstrap_mean(df, [], "id", "x", 100).first()
    assert alone["n"] == 800 and alone["low"] < alone["mean"] < alone["high"]


@pytest.mark.parametrize("leaf", [65_536, 10])
def test_resamples_have_n_draws(spark, monkeypatch, leaf):
    """Also where the draws are split over a tree of many leaves, and whatever the partitions are."""
    monkeypatch.setattr(resampling, "LEAF", leaf)
    rng = np.random.default_rng(1)
    rows = [(g, f"{g}{k}", float(rng.normal()), 1.0 if k == 0 else 0.0) for g, n in (("a", 300), ("b", 7), (None, 41)) for k in range(n)]
    rows += [("a", "null", None, 0.0), ("b", "nan", float("nan"), 0.0), ("empty", "x", None, 0.0)]
    df = spark.createDataFrame(rows, "g string, id string, x double, first double")
    out = [resampling.resampled_sums(d, ["g"], "id", ["x", "first"], 200, seed=3).collect() for d in (df, df.repartition(5, "x"))]
    assert {(r["g"], r["resample"]): (r["draws"], round(r["x"], 9)) for r in out[0]} == {(r["g"], r["resample"]): (r["draws"], round(r["x"], 9)) for r in out[1]}
    for g, n in (("a", 300), ("b", 7), (None, 41)):
        own = [r for r in out[0] if r["g"] == g]
        values = np.array([x for h, _, x, _ in rows if h == g and x is not None and x == x])
        assert len(own) == 200 and {r["draws"] for r in own} == {n}
        means = np.array([r["x"] for r in own]) / n
        error = values.std() / np.sqrt(n)
        assert abs(means.mean() - values.mean()) < 5 * error / np.sqrt(200) and abs(means.std() / error - 1) < 0.3
        times = np.array([r["first"] for r in own])  # of one row: about Poisson
        assert abs(times.mean() - 1) < 0.5 and 0.3 < times.var() < 2
    assert not [r for r in out[0] if r["g"] == "empty"]


def test_bootstrap_intervals_cover(spark):
    """Of 60 tables' 95 % intervals nearly all hold the true mean; one shared run."""
    rng = np.random.default_rng(9)
    rows = [(t, k, float(rng.normal(1.0, 2.0))) for t in range(60) for k in range(80)]
    df = spark.createDataFrame(rows, "t int, id int, x double").withColumn("key", F.concat_ws("-", "t", "id"))
    out = statistics.bootstrap_mean(df, ["t"], "key", "x", 500).collect()
    assert len(out) == 60 and 50 <= sum(r["low"] <= 1.0 <= r["high"] for r in out) <= 60
    both = statistics.paired_bootstrap(df.withColumn("zero", F.lit(0.0)), ["t"], "key", "zero", "x", 500).collect()
    assert {r["t"]: r["low"] for r in both} == {r["t"]: r["low"] for r in out}


def test_interval_at_places_rounded_down(spark):
    draws = spark.createDataFrame([("a", float(k) if k < 41 else float("nan")) for k in range(50)] + [("b", None)], "g string, v double")
    assert [tuple(r) for r in resampling.interval(draws, ["g"], F.col("v"), floor=True).collect()] == [("a", 1.0, 39.0)]
    assert [tuple(r) for r in resampling.interval(draws, ["g"], F.col("v")).collect()] == [("a", 1.0, 39.0)]
    rows = spark.createDataFrame([(k, float(k % 2), 1.0) for k in range(100)], "id int, right double, all double")
    share = statistics.bootstrap_statistic(rows, [], "id", ["right", "all"], F.col("right") / F.col("all"), 400).first()
    assert 0.38 < share["low"] < 0.44 and 0.56 < share["high"] < 0.62


# -- samples --------------------------------------------------------------------------------------
def test_positions_of_a_hot_group(spark):
    df = spark.range(500).selectExpr("id", "case when id % 3 = 0 then null when id < 400 then 'hot' else 'cold' end as g", "id % 7 as v")
    got = with_positions(df.repartition(9), [F.col("v"), F.col("id")], ("g",)).collect()
    groups = {}
    for r in sorted(df.collect(), key=lambda r: (r["v"], r["id"])):
        groups.setdefault(r["g"], []).append(r["id"])
    assert {r["id"]: (r["position"], r["group_rows"]) for r in got} == {i: (k + 1, len(ids)) for ids in groups.values() for k, i in enumerate(ids)}


def test_targets():
    assert sampling.weighted_targets({"a": 1, "b": 1, "c": 1}, 4) == {"a": 2, "b": 1, "c": 1}
    assert sampling.filled_quotas({"a": 98, "b": 1, "c": 1}, 5) == {"a": 3, "b": 1, "c": 1}


def test_samples(spark):
    df = spark.range(1000).selectExpr("id", "case when id < 700 then 'a' when id < 990 then 'b' else null end as s")
    got = sampling.stratified_sample(df, "s", "id", 50, 1)
    assert {r["s"]: r["count"] for r in got.groupBy("s").count().collect()} == {"a": 35, "b": 14, None: 1}
    assert {r["id"] for r in sampling.stratified_sample(df.repartition(5), "s", "id", 50, 1).collect()} == {r["id"] for r in got.collect()}
    few = sampling.spread_pick(df, ("s",), [F.col("id")], 3).orderBy("id").collect()
    assert [r["id"] for r in few] == [0, 233, 466, 700, 796, 893, 990, 993, 996]


# -- gold, history, releases ----------------------------------------------------------------------
def test_gold_helpers(spark):
    df = spark.createDataFrame([(1, "q", "A"), (2, "q", "A"), (3, "q", "A"), (4, "q", "B")], "id int, query string, label string")
    got = [r["query"] for r in goldset.suffixed_questions(df, "label", "id").orderBy("id").collect()]
    assert got[0] == "q" and len(set(got)) == 4 and "q (A)" in got and "q (B)" in got
    lines = spark.createDataFrame([("s", 1, 1, "# Dose"), ("s", 1, 2, "x"), ("s", 2, 1, "more"), ("s", 2, 2, "Risks:"), ("s", 3, 1, "y")], "section_id string, chunk_no int, line_no int, line string")
    out = {r["chunk_no"]: r["intents"] for r in goldset.carried_intents(lines, {"dose": "dosage", "risks": "risk"}).collect()}
    assert out == {1: ["dosage"], 2: ["dosage", "risk"], 3: ["risk"]}
    tags = spark.range(1).select(goldset.eval_tags({"b": F.lit(True), "a": F.lit(True), "c": F.lit(False)})).first()[0]
    assert tags == ["a", "b"]


def test_history_lists(spark):
    cites = spark.createDataFrame([("m", 2, "c1", "d"), ("m", 1, "c2", "d")], "message_id string, place int, chunk_id string, x string")
    chunks = spark.createDataFrame([("c1", "d1", "one"), ("c2", "d2", "two")], "chunk_id string, document_id string, text string")
    docs = spark.createDataFrame([("d1", "T1"), ("d2", "T2")], "document_id string, title string")
    got = history.citation_lists(cites, chunks.drop("text"), docs).first()["citations"]
    assert [(c["place"], c["title"]) for c in got] == [(1, "T2"), (2, "T1")]
    blocks = spark.createDataFrame([("x", ["c2", "c1", "c2"])], "citation_id string, chunk_ids array<string>")
    assert history.block_texts(blocks, chunks).first()["block"] == "two\n\none\n\ntwo"


def test_release_cycle(spark):
    schema = "release_id string, collection_id string, number long, status string, digest string, chunker string, model string, published_at timestamp"
    r = spark.createDataFrame([], schema)
    current = spark.createDataFrame([], "collection_id string, release_id string")
    for name in ("r1", "r2", "r3"):
        r = releases.staged(r, spark.createDataFrame([(name, "c", f"d-{name}", "k", "m")], "release_id string, collection_id string, digest string, chunker string, model string"))
        r = releases.marked_ready(r, spark.createDataFrame([(name, 5, 5)], "release_id string, expected int, indexed int"))
        r, current = releases.published(r, current, spark.createDataFrame([(name,)], "release_id string"), F.lit(f"2024-01-0{name[1]}").cast("timestamp"))
    assert [(x["release_id"], x["number"], x["status"]) for x in r.orderBy("number").collect()] == [("r1", 1, "ready"), ("r2", 2, "ready"), ("r3", 3, "ready")]
    assert current.first()["release_id"] == "r3" and releases.rollback_targets(r, current).first()["release_id"] == "r2"
    old = releases.to_retire(r, current, 1)
    assert [x["release_id"] for x in old.collect()] == ["r1"]
    r = releases.retired(r, old)
    bridge = spark.createDataFrame([("r1", "a"), ("r2", "a"), ("r1", "b"), ("r3", "c")], "release_id string, chunk_id string")
    members = releases.memberships(bridge, r)
    points = spark.createDataFrame([("a", ["r1"]), ("b", ["r1"]), ("c", ["r3"])], "id string, release_ids array<string>")
    now = releases.with_memberships(points, members)
    assert {x["id"]: x["release_ids"] for x in now.collect()} == {"a": ["r2"], "c": ["r3"]}
    assert {x["release_id"]: x["n"] for x in releases.release_counts(now).collect()} == {"r2": 1, "r3": 1}
    assert releases.reindexed(now, r, "m").count() == 2 and releases.reindexed(now, r, "other").count() == 0
    wanted = spark.createDataFrame([("c", "d-r3", "k", "m"), ("c", "d-r2", "k", "m"), ("c", "d-r1", "k", "m")], "collection_id string, digest string, chunker string, model string")
    assert {x["digest"]: x["decision"] for x in releases.import_decision(wanted, r, current).collect()} == {"d-r3": "no_change", "d-r2": "reused", "d-r1": "imported"}


# -- streams --------------------------------------------------------------------------------------
def test_marks():
    assert held_back("text [1") == "[1" and held_back("text [") == "[" and held_back("[1] done") == ""
    assert without_unknown("a [1] b [7]", 3) == "a [1] b "


def test_message_parts(spark, tmp_path):
    rows = [(1, 1, "text", "See [", 2), (1, 2, "text", "1] and [9] x", 2), (1, 3, "end", None, 2), (2, 1, "end", None, 2), (3, 1, "text", "open [2", 2), (3, 2, "end", None, 2)]
    schema = "run long, seq long, kind string, text string, known int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/deltas.parquet")
    out = streams.run_to_end(streams.stream_parts(streams.read_stream(spark, str(tmp_path), "deltas")), "parts")
    got = [(r["run"], r["part"], r["text"]) for r in out.orderBy("run", "seq", F.when(F.col("part") == "open", 0).when(F.col("part") == "delta", 1).otherwise(2)).collect()]
    assert got == [(1, "open", ""), (1, "delta", "See "), (1, "delta", "[1] and  x"), (1, "close", ""), (3, "open", ""), (3, "delta", "open "), (3, "delta", "[2"), (3, "close", "")]


def test_late_rows_and_state_over_batches(spark, tmp_path):
    path = f"{tmp_path}/events.parquet"
    for k, (first, at) in enumerate([(0, "10:00"), (100, "12:00"), (200, "09:00")]):
        part = spark.range(first, first + 10).selectExpr("id as event_id", f"timestamp_ntz '2024-01-01 {at}:00' as ts", "id % 2 as user_id", f"'{'purchase' if k == 1 else 'view'}' as event_type", "1.0D as value")
        part.coalesce(1).write.mode("append").parquet(path)
    stream = streams.read_stream(spark, str(tmp_path), "events", files_per_batch=1)
    due = streams.run_to_end(streams.due_every(stream, "user_id", 4), "due")
    assert sorted((r["user_id"], r["reached"]) for r in due.collect()) == [(u, n) for u in (0, 1) for n in (4, 8, 12)]
    counted = streams.run_to_end(streams.tumbling(stream, "1 hour", "10 minutes", [], [F.count("*").alias("n")]), "late")
    assert 10 in {r["n"] for r in counted.collect()}


def test_cosine_of_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(arrays.cosine(F.col("a"), F.col("b"))).collect()] == [None, 1.0]


def test_nearest_overlap_pairs_spans_not_rows(spark, monkeypatch):
    a = [(k, k % 3, k % 40, k % 40 + k % 7) for k in range(400)] + [(400, 0, None, 5), (401, 1, 9, 3), (402, None, 1, 2)]
    b = [(k, k % 3, k % 50, k % 50 + k % 5) for k in range(300)] + [(-1, 0, None, None)]
    met, plain = [], relations.overlapping
    monkeypatch.setattr(relations, "overlapping", lambda a, b, *x: (met.append((a.count(), b.count())), plain(a, b, *x))[1])
    frames = [spark.createDataFrame(r, "id long, doc long, start long, end long") for r in (a, b)]
    have = {(r["id"], r["b_id"]) for r in relations.nearest_overlap(*frames, "doc", "id").collect()}
    want = set()
    for i, doc, s, e in a:
        s, e = s or 0, e or 0
        hits = [(abs(s - (t or 0)), j) for j, d, t, u in b if doc == d and s <= e and s <= (u or 0) and (t or 0) <= e]
        want |= {(i, min(hits)[1])} if hits else set()
    assert have == want
    spans = [len({(d, s or 0, e or 0) for _, d, s, e in rows}) for rows in (a, b)]
    assert met == [tuple(spans)]


def test_overlapping_rows_pairs_spans_once(spark, monkeypatch):
    a = [(k, k % 3, k % 20, k % 20 + k % 4) for k in range(300)] + [(400, 0, None, 5), (401, 1, 9, 3), (402, None, 1, 2)]
    b = [(k, k % 3, k % 30 * 9, k % 30 * 9 + k % 3) for k in range(200)] + [(-1, 0, None, None)]
    frames = [spark.createDataFrame(r, "id long, doc long, start long, end long") for r in (a, b)]
    met, plain = [], relations.overlapping
    want = sorted(map(tuple, plain(*frames, "doc").collect()))
    monkeypatch.setattr(relations, "overlapping", lambda a, b, *x: (met.append((a.count(), b.count())), plain(a, b, *x))[1])
    for small in (relations.SMALL_ROWS, 0):
        out = relations.overlapping_rows(*frames, "doc", small)
        assert out.columns == ["id", "doc", "start", "end", "b_id", "b_start", "b_end"]
        assert sorted(map(tuple, out.select(*plain(*frames, "doc").columns).collect())) == want
    spans = [len({(d, s or 0, e or 0) for _, d, s, e in rows}) for rows in (a, b)]
    assert want and met == [tuple(spans)] * 2


def test_overlapping_rows_come_by_span(spark):
    """In a task the rows of one span follow each other, so their equal lists of partners do too; none is lost."""
    a = spark.range(3000).select("id", (F.col("id") % 4).alias("doc"), (F.col("id") % 40).alias("start"), (F.col("id") % 40 + 3).alias("end")).repartition(3)
    b = spark.range(200).select("id", (F.col("id") % 4).alias("doc"), (F.col("id") % 50).alias("start"), (F.col("id") % 50 + 6).alias("end"))
    out = relations.overlapping_rows(a, b, "doc").select("id", "b_id")
    tasks = [[r["id"] for r in rows] for rows in out.rdd.glom().collect() if rows]
    assert len(tasks) == 3 and sum(map(len, tasks)) == relations.overlapping(a, b, "doc").count()
    for rows in tasks:
        spans = [k % 40 for k in rows]
        assert sum(x != y for x, y in zip(spans, spans[1:])) + 1 == len(set(spans))


def test_candidates_repeated_in_and_across_lines(spark, tmp_path):
    """Pairs are counted in lines that may repeat one only; hashes are no part of what is shuffled."""
    schema = "query_id string, query string, retrieval_rank int, chunk_id string, retrieval_score double, document_text string, section_id string, chunk_index int"
    rows = [("q1", "a", 1, "c1"), ("q1", "a", 2, "c1"), ("q2", "a", 1, "c1"), ("q2", "b", 1, "c1"), ("q2", "b", 2, "c2"), ("q3", "a", 1, "c1"), ("q3", "a", 2, "c2")]
    hits = spark.createDataFrame([(*r, 0.5, "doc", "s", 1) for r in rows], schema)
    versions.write_candidates(hits, f"file://{tmp_path}/c", "gzip")
    assert list((tmp_path / "c").glob("part*.json.gz"))
    _, found = records.read_candidates(spark, f"file://{tmp_path}/c")
    assert sorted((r["check"], r["id"], r["message"]) for r in found.collect()) == [("chunk", "q1/c1", "2 rows"), ("chunk", "q2/c1", "2 rows"), ("query", "q2", "2 rows")]
    kept, _ = records.read_candidates(spark, f"file://{tmp_path}/c")
    assert {r["document_hash"] for r in kept.collect()} == {hashlib.sha256(b"doc").hexdigest()}


HITS = "query_id string, query string, retrieval_rank int, chunk_id string, retrieval_score double, document_text string, section_id string, chunk_index int"


def test_candidates_whole_check(spark, tmp_path):
    """Ranks, scores, ids, texts and lacking hashes are checked, pairs by both columns, lines and candidates against the manifest."""
    def line(query_id, *candidates, **other):
        fields = ("chunk_id", "retrieval_score", "retrieval_rank", "document_text", "document_hash")
        each = [{**dict(zip(fields, c[:4])), "document_hash": c[3] and hashlib.sha256(c[3].encode()).hexdigest(), **c[4]} for c in candidates]
        return json.dumps({"query_id": query_id, "query": "q", "query_hash": hashlib.sha256(b"q").hexdigest(), "candidates": each} | other)

    good = ("c", 0.5, 1, "text", {})
    lines = {
        "fine": line("fine", good, ("d", 0.4, 2, "text", {})), "a": line("a", ("b/c", 0.5, 1, "text", {})), "a/b": line("a/b", good), "none": line("none"),
        "rank": line("rank", ("c", 0.5, 0, "text", {}), ("d", 0.5, None, "text", {})), "score": line("score", ("c", None, 1, "text", {}), ("d", float("inf"), 2, "text", {})),
        "text": line("text", ("c", 0.5, 1, None, {"document_hash": None})), "hash": line("hash", ("c", 0.5, 1, "text", {"document_hash": None})), "chunk": line("chunk", ("", 0.5, 1, "text", {})),
        "forged": line("forged", good, query_hash=None), "blank": line("blank", good, query=" \n", query_hash=hashlib.sha256(b"\n").hexdigest()), "list": line("list", candidates=None),
    }
    (tmp_path / "c.json").write_text("\n".join(lines.values()) + "\n")
    found = records.read_candidates(spark, f"file://{tmp_path}/c.json")[1].collect()
    assert sorted((r["check"], r["id"]) for r in found) == [
        ("candidates", "list"), ("chunk_id", "chunk/"), ("document_hash", "hash/c"), ("document_text", "text/c"), ("query_hash", "forged"),
        ("query_text", "blank"), ("rank", "rank/c"), ("rank", "rank/d"), ("score", "score/c"), ("score", "score/d"),
    ]

    hits = spark.createDataFrame([(f"q{k % 5}", "q", k, f"c{k}", 0.5, "text", "s", 1) for k in range(1, 21)], HITS).repartition(3)
    path = tmp_path / "folder"
    versions.write_candidates(hits, f"file://{path}")
    assert json.loads((path / records.MANIFEST).read_text()) == {"record_count": 5, "pair_count": 20}
    each, found = records.read_candidates(spark, f"file://{path}")
    assert each.count() == 20 and found.count() == 0
    part = next(p for p in path.glob("part*") if p.stat().st_size)
    (path / f".{part.name}.crc").unlink()
    whole = part.read_text().splitlines(keepends=True)
    part.write_text("".join(whole[1:]))
    assert {(r["check"], r["message"]) for r in records.read_candidates(spark, f"file://{path}")[1].collect()} == {
        ("record_count", "4, not 5 as in the manifest"), ("pair_count", "16, not 20 as in the manifest")}
    for p in path.glob("part*"):
        p.unlink()
    assert {r["check"] for r in records.read_candidates(spark, f"file://{path}")[1].collect()} == {"record_count", "pair_count"}
    (path / records.MANIFEST).unlink()
    assert {r["check"] for r in records.read_candidates(spark, f"file://{path}")[1].collect()} == {"manifest"}
    versions.write_candidates(hits.limit(0), f"file://{path}")
    assert json.loads((path / records.MANIFEST).read_text()) == {"record_count": 0, "pair_count": 0}
    assert records.read_candidates(spark, f"file://{path}")[1].count() == 0


def test_bm25_scores_as_plain_code():
    texts = [["a", "b", "a"], None, [], ["c", "d"], ["d", "d", "b", "z"]]
    postings = [("a", 1.5, np.array([0, 2])), ("b", 0.7, np.array([1])), ("d", 0.2, np.array([0, 1, 2])), ("q", 9.0, np.array([1]))]
    want = np.zeros((3, 5))
    for at, words in enumerate(texts):
        for term, weight, asking in postings:
            n = (words or []).count(term)
            want[asking, at] += weight * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words or []) / 2.5))
    column = pa.array([["a"], *texts], pa.list_(pa.string())).slice(1)
    have = search.bm25_scores(column, pa.array([p[0] for p in postings]), postings, 3, 2.5)
    assert np.allclose(have, want)
    assert search.bm25_scores(column.slice(0, 0), pa.array(["a"]), postings[:1], 3, 2.5).shape == (3, 0)
