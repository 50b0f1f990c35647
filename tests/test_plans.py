"""The physical plans have what the queries rely on."""

import re

import pytest

from pyspark.sql import functions as F

from vellum import plans
from vellum.operators import sampling, statistics
from vellum.storage import shared_dir

JOINS = [
    "hydrate_window", "page_overlaps", "best_overlap", "unique_prefix", "title_pairs", "blocked_matches", "token_overlap_match",
    "glossary_matches", "relevance_judgments", "bm25_topk", "first_rule", "customers_without_big_orders", "nation_sides",
]


def plan_of(spark, sf_dir, name):
    return plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOINS)
def test_no_cross_joins(spark, sf_dir, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan_of(spark, sf_dir, name))


def test_anti_join_and_keyset_filters(spark, sf_dir):
    assert "LeftAnti" in plan_of(spark, sf_dir, "customers_without_big_orders")
    assert "Or(LessThan(o_orderdate" in plan_of(spark, sf_dir, "keyset_next")
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan_of(spark, sf_dir, "keyset_next")


@pytest.mark.parametrize("name", ["dense_topk", "bm25_topk", "page_of_each", "brands_in_turn"])
def test_top_k_is_cut_before_the_shuffle(spark, sf_dir, name):
    assert plan_of(spark, sf_dir, name).count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["reindexed_points", "release_points", "chunk_memberships"])
def test_release_ids_are_not_broadcast(spark, sf_dir, name):
    assert "BroadcastExchange" not in plan_of(spark, sf_dir, name)


@pytest.mark.parametrize("name", ["glossary_matches", "corpus_mentions"])
def test_word_runs_meet_a_small_glossary_where_they_are(spark, sf_dir, name):
    assert re.search(r"BroadcastHashJoin \[name#", plan_of(spark, sf_dir, name))


def test_only_wanted_columns_are_read(spark, sf_dir):
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan_of(spark, sf_dir, "wilson_by_lang")


def test_no_shared_folder_is_an_error_on_a_cluster():
    class Conf(dict):
        pass

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            shared_dir(Session(spark_master=master))
    assert shared_dir(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y")) == "hdfs://x/y"


def test_samples_are_cut_without_gathering_a_stratum(spark):
    df = spark.range(40_000).withColumn("s", F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("b"), F.col("id") % 4)))
    for most in (500, 5000):
        out = sampling.per_group_sample(df, ["s"], "id", most, 1)
        plan = out._jdf.queryExecution().executedPlan().toString()
        windows = re.findall(r"Window \[row_number\(\).*?, \[(.*?)\]", plan)
        assert "WindowGroupLimit" in plan if most == 500 else windows and all("_slice" in w for w in windows)
        assert out.groupBy("s").count().agg(F.min("count"), F.max("count")).first() == (most, most)
    few, many = ({r["id"] for r in sampling.stratified_sample(df, "s", "id", n, 2).collect()} for n in (900, 5000))
    assert len(few) == 900 and len(many) == 5000 and len(few - many) < 20
    slots = spark.createDataFrame([(k, "a") for k in range(3)], "slot int, s string")
    got = sampling.disjoint_samples(df, slots, ["s"], "id", 1500, 3).select("slot", "id").collect()
    assert len({r["id"] for r in got}) == 4500 and {sum(r["slot"] == k for r in got) for k in range(3)} == {1500}


def test_percentiles_of_a_large_group(spark):
    df = spark.range(1001).select((F.col("id") % 7 == 0).alias("g"), (F.col("id") * F.lit(1.5)).alias("x"))
    want = df.groupBy("g").agg(F.count("x"), F.percentile("x", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.0), F.lit(1.0)))).collect()
    got = {r["g"]: r for r in statistics.interpolated(df, ["g"], "x", (0.5, 0.95, 0.0, 1.0)).collect()}
    for g, n, points in want:
        assert got[g]["n"] == n and [got[g][c] for c in ("p50", "p95", "p0", "p100")] == pytest.approx(points)
    assert statistics.interpolated(df.limit(0), ["g"], "x", (0.5,)).count() == 0
