"""Kept indexes over ``documents`` and ``embeddings``: built, added to by release, searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import postings, vectors
from vellum.operators.search import dense_search
from vellum.plans.registry import query
from vellum.plans.retrieval import BM25_SQL
from vellum.storage import new_path, read_table, saved, spread


_BM25 = BM25_SQL.replace("{k}", "10")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "n_chars"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("with " + _BM25 + "select query_id, id, score, rank from bm25")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item by BM25, from postings."""
    path = new_path(spark, "postings")
    postings.add_release(spark, path, 1, _documents(spark, sf_dir))
    return postings.search_index(spark, path, _items(spark, sf_dir), 10)


_SECOND = """later as (select doc_id, case when text like '%e the%' then text || ' ' || source || ' ' || source else text end as text
              from documents where n_chars >= 400 or text like '%e the%'), """
_LATER = _BM25.replace("from documents", "from later")


@query(
    f"""select 1 as release, * from (with {_BM25} select query_id, id, score, rank from bm25)
    union all select 2, * from (with {_SECOND}{_LATER} select query_id, id, score, rank from bm25)"""
)
def bm25_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as of two releases: the second one adds to some texts and deletes short documents."""
    docs, path = _documents(spark, sf_dir), new_path(spark, "postings")
    grows = F.col("text").contains("e the")
    postings.add_release(spark, path, 1, docs)
    more = docs.filter(grows).select("id", F.concat_ws(" ", "text", "source", "source").alias("text"))
    postings.add_release(spark, path, 2, more, docs.filter((F.col("n_chars") < 400) & ~grows).select("id"))
    found = [
        postings.search_index(spark, path, _items(spark, sf_dir), 10, upto=n).select(F.lit(n).alias("release"), "query_id", "id", "score", "rank")
        for n in (1, 2)
    ]
    return found[0].unionByName(found[1])


@query("select count(*) as n_queries, count(*) * 10 as n_found, true as recalled, 0::bigint as wrong from embeddings where vec_id % 20 = 0")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the approximate index against the exact search: whether it reaches 0.95 of the ten nearest.

    ``wrong`` counts scores that differ from the exact ones.
    """
    base = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = base.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    path = new_path(spark, "vectors")
    vectors.create(spark, path, vectors.fit(base))
    vectors.add_release(spark, path, 1, base)
    near = vectors.search_vectors(spark, path, asked, 10).select("query_id", "id", F.col("score").alias("near"))
    exact = saved(dense_search(asked, base, 10), "exact")
    both = saved(exact.join(near, ["query_id", "id"], "full_outer"), "both")
    held = F.count_if(F.col("score").isNotNull() & F.col("near").isNotNull())
    return both.agg(
        F.count_distinct("query_id").alias("n_queries"),
        F.count("near").alias("n_found"),
        (held >= 0.95 * F.count("score")).alias("recalled"),
        F.count_if(F.abs(F.col("score") - F.col("near")) > 1.5e-6).alias("wrong"),
    )
