"""Search over ``embeddings`` and ``documents``: dense, BM25, fusion, pools, reranking, evidence.

Dense queries are the vectors whose id is divisible by 20, against all vectors; text queries are
the benchmark items.  A document has the vector of its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.arrays import cosine
from vellum.operators import search
from vellum.plans.registry import query
from vellum.storage import read_table, saved, spread

_DENSE = """
with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 20 = 0),
s as (select query_id, vec_id as id,
             round(list_dot_product(q, embedding::double[])
                   / sqrt(list_dot_product(q, q) * list_dot_product(embedding::double[], embedding::double[])), 6) as score
      from q, embeddings),
dense as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s
          qualify rank <= {k})
"""


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    asked = vectors.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    return search.dense_search(asked, vectors, k)


@query(_DENSE.format(k=10) + "select query_id, id, score, rank from dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each query vector."""
    return _dense(spark, sf_dir, 10)


#: BM25 of the benchmark items over ``documents``, in SQL, of the ``{k}`` best.
BM25_SQL = """
words as (select doc_id as id, unnest(regexp_extract_all(lower(text), '\\p{L}+|\\p{N}+')) as term from documents),
sizes as (select count(*) as n, avg(len(regexp_extract_all(lower(text), '\\p{L}+|\\p{N}+'))) as mean from documents),
lens as (select id, count(*) as length from words group by id),
tf as (select id, term, count(*) as tf from words group by id, term),
df as (select term, count(*) as df from tf group by term),
qterms as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '\\p{L}+|\\p{N}+')) as term from benchmark),
bm as (select query_id, tf.id,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score
       from qterms join tf using (term) join df using (term) join lens on lens.id = tf.id, sizes
       group by query_id, tf.id),
bm25 as (select *, row_number() over (partition by query_id order by score desc, id) as rank from bm qualify rank <= {k})
"""


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    items = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25_search(items, docs, k)


_FUSED = (
    _DENSE.format(k=50)
    + ", "
    + BM25_SQL.replace("{k}", "50")
    + """, both_ranks as (select query_id, id, rank from dense union all select query_id, id, rank from bm25),
f as (select query_id, id, round(sum(1.0::double / (2 + rank)), 6) as score from both_ranks group by query_id, id),
fused as (select *, row_number() over (partition by query_id order by score desc, id) as rank from f qualify rank <= 30)
"""
)


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuse_ranks([_dense(spark, sf_dir, 50), _bm25(spark, sf_dir, 50)], 30)


@query(_FUSED + "select query_id, id, score, rank from fused")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of the fifty best of both kinds."""
    return _fused(spark, sf_dir)


#: Queries of a request: five neighbours; scores of a reranker as an input table.
_REQUEST = "cast(floor(query_id / 100) as bigint)"
_SCORE = "((request * 31 + id * 17) % 1000) / 1000.0"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, 10).select(
        F.floor(F.col("query_id") / 100).cast("long").alias("request"),
        (F.col("query_id") % 100).alias("query_pos"), "rank", "id", "score",
    )


_POOL = (
    _DENSE.format(k=10)
    + f""", hits as (select {_REQUEST} as request, query_id % 100 as query_pos, rank, id, score from dense),
pool as (select request, id, max(score) as score, min(struct_pack(r := rank, p := query_pos)) as first,
                string_agg(distinct query_pos::varchar, ',' order by query_pos::varchar) as queries from hits group by request, id),
picked as (select *, row_number() over (partition by request order by first.r, first.p) as rank from pool qualify rank <= 20)
"""
)


@query(_POOL + "select request, id, score, queries from pool")
def merged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per request and vector over the request's queries."""
    out = search.merge_hits(_hits(spark, sf_dir))
    listed = F.array_join(F.array_sort(F.transform("queries", lambda q: q.cast("string"))), ",")
    return out.select("request", "id", "score", listed.alias("queries"))


@query(_POOL + "select request, id, score, rank from picked")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty candidates of each request, its queries in turn."""
    return search.candidate_pool(_hits(spark, sf_dir), 20).select("request", "id", "score", "rank")


_RERANK = (
    _POOL
    + f""", scored as (select request, id, rank as fused_rank, case when id % 7 = 0 then 2.0 when id % 5 > 0 then {_SCORE} end as rerank_score,
          score, id % 7 = 0 as reused from picked),
top as (select request, id, fused_rank, rerank_score, coalesce(rerank_score, score) as final_score, reused,
        row_number() over (partition by request order by coalesce(rerank_score, score) desc, reused desc, fused_rank, id) as rank
        from scored qualify rank <= 8)
"""
)


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = saved(candidate_pool(spark, sf_dir), "pool")
    made = pool.select("request", "id", F.expr(_SCORE).cast("double").alias("rerank_score"))
    known = pool.filter("id % 7 = 0").select("request", "id", F.lit(2.0).alias("rerank_score"))
    return search.rerank(pool, made.filter("id % 5 > 0"), known, 8)


@query(_RERANK + "select request, id, fused_rank, rerank_score::double as rerank_score, final_score::double as final_score, reused, rank from top")
def reranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best eight by reranker score, known scores first, unscored candidates by their own."""
    return _reranked(spark, sf_dir)


@query(
    """with big as (select l_orderkey, l_linenumber, l_partkey from lineitem where l_quantity >= 49),
    h as (select row_number() over () as n, * from big)
    select b.l_orderkey as section, b.l_linenumber as ordinal, b.l_partkey as hit, l.l_linenumber as chunk_ordinal, l.l_partkey as chunk
    from big b join lineitem l on b.l_orderkey = l.l_orderkey and abs(b.l_linenumber - l.l_linenumber) <= 1"""
)
def hydrate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines next to each large line of an order: a range join within the order."""
    lines = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("section"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("chunk"), "l_quantity"
    )
    hits = lines.filter("l_quantity >= 49").select(
        "section", "ordinal", F.col("chunk").alias("hit"), F.lit("chunk_window").alias("strategy"), F.lit(1).alias("radius")
    )
    out = search.hydrate(hits, lines.drop("l_quantity"))
    return out.select("section", "ordinal", "hit", "chunk_ordinal", "chunk")


@query(
    _RERANK
    + """, e as (select request, id, final_score, n_chars from top join documents on doc_id = id),
    sizes as (select request, sum(n_chars) as chars, count(*) as n from e group by request)
    select request, n, least(chars, 1000000000)::bigint as chars from sizes"""
)
def evidence_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the documents that a request's best candidates stand for."""
    top = _reranked(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return top.join(docs, "id").groupBy("request").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    _RERANK.replace("with ", "with recursive ", 1)
    + """, e as (select request, id, row_number() over (partition by request order by final_score desc, id) as k, n_chars as a, least(n_chars, 1000) as b, least(n_chars, 80) as c from top join documents on doc_id = id),
    p(request, k, remaining, id, form, size, place) as (
      select distinct request, 0::bigint, 4000::bigint, null::bigint, null::bigint, null::bigint, 0::bigint from e
      union all
      select e.request, e.k, p.remaining - coalesce(case when a <= remaining then a when b <= remaining then b when c <= remaining then c end, 0), e.id,
        case when a <= remaining then case when true then 1 end when b <= remaining then case when b = a then 1 else 2 end when c <= remaining then case when c = b then 2 else 3 end end,
        case when a <= remaining then a when b <= remaining then b when c <= remaining then c end,
        p.place + case when c <= remaining then 1 else 0 end
      from p join e on e.request = p.request and e.k = p.k + 1)
    select request, id, form::int as form, size, place from p where size is not null"""
)
def packed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the candidates fits 4000 characters: whole text, its first 1000 characters or title.

    A greedy choice that depends on all before it.
    """
    top = _reranked(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    sizes = F.array("n_chars", F.least("n_chars", F.lit(1000)), F.least("n_chars", F.lit(80)))
    items = top.join(docs, "id").select("request", "id", F.col("final_score").alias("score"), sizes.alias("sizes"))
    return search.pack_evidence(items, 4000)


@query(
    _POOL
    + """, rounds as (select request, cast(query_pos // 40 as bigint) as round, id, score as fusion,
                 case when id % 3 = 0 then null else (id % 50) / 50.0 end as rerank, 'q' || query_pos as query from hits),
    uses as (select request, id, query, min(round) as first_use from rounds group by all),
    qs as (select request, id, string_agg(query, ',' order by first_use, query) as queries from uses group by all),
    best as (select request, id, max(fusion) as fusion, max(rerank)::double as rerank, min(round) as found_in, max(round) as last_round from rounds group by all)
    select request, id, fusion, rerank, found_in, last_round, queries,
           'E' || row_number() over (partition by request order by found_in, id) as ref
    from best join qs using (request, id)"""
)
def evidence_over_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence merged over the rounds of a request: best scores, queries in order, number."""
    hits = _hits(spark, sf_dir).select(
        "request", F.floor(F.col("query_pos") / 40).alias("round"), "id", F.col("score").alias("fusion"),
        F.when(F.col("id") % 3 != 0, (F.col("id") % 50) / 50).alias("rerank"),
        F.concat(F.lit("q"), "query_pos").alias("query"),
    )
    return search.merge_rounds(hits).withColumn("queries", F.array_join("queries", ","))


@query(
    """with points as (select l_partkey as id, l_suppkey % 3 as collection_id, list_sort(list(distinct l_suppkey % 7)) as release_ids
                      from lineitem group by 1, 2)
    select id, collection_id, array_to_string(release_ids, ',') as releases from points
    where list_contains(release_ids, collection_id + 2)"""
)
def release_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose release list holds the current release of their collection."""
    points = read_table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 3).alias("collection_id")
    ).agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 7)).alias("release_ids"))
    current = spark.range(3).select(F.col("id").alias("collection_id"), (F.col("id") + 2).alias("release_id"))
    return search.release_scope(points, current).select("id", "collection_id", F.array_join("release_ids", ",").alias("releases"))


@query(
    """select a.vec_id as first, b.vec_id as second,
              round(list_dot_product(a.embedding::double[], b.embedding::double[])
              / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[])), 6) as cosine
       from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"""
)
def neighbour_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector and the one of the next number, all in the JVM."""
    v = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("second"), F.col("embedding").alias("e"))
    both = v.join(nxt, "vec_id")
    return both.select(F.col("vec_id").alias("first"), "second", F.round(cosine(F.col("embedding"), F.col("e")), 6).alias("cosine"))
