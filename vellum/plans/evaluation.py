"""Evaluation: ranking metrics, breakdowns, intervals, tests, agreement, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import ranking, resampling, sampling, statistics
from vellum.plans.registry import query
from vellum.plans.retrieval import _DENSE, dense_topk
from vellum.storage import read_table, saved


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows: a query's section is its label; the mode and granularity follow from its number."""
    v = read_table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    turn = F.col("query_id") / 20 % 4
    mode = F.when(turn == 1, "any_acceptable").when(turn == 2, "multi_required").otherwise("single")
    second = (F.col("label") + 1).cast("string")
    return v.select(
        "query_id",
        mode.alias("mode"),
        F.when(turn == 3, "chunk_window").otherwise("section").alias("granularity"),
        F.col("label").cast("string").alias("gold_section"),
        F.array(F.col("label").cast("string"), second).alias("gold_sections"),
        F.array().cast("array<string>").alias("gold_chunks"),
        (F.col("query_id") % 50).alias("gold_index"),
        F.when(turn == 2, F.create_map(second, F.array(F.col("query_id").cast("string")))).alias("judged"),
        F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("difficulty"),
    )


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return dense_topk(spark, sf_dir).join(labels, "id").select(
        "query_id", "rank", F.col("label").cast("string").alias("section"),
        F.col("id").cast("string").alias("chunk"), (F.col("id") % 50).alias("chunk_index"),
    )


_SCORED = (
    _DENSE.format(k=10)
    + """, gold as (select vec_id as query_id, label, (vec_id // 20) % 4 as turn from embeddings where vec_id % 20 = 0),
r as (select d.query_id, d.rank, d.id, e.label as section, g.label, g.turn,
        case when turn in (1, 2) then e.label in (g.label, g.label + 1) or (turn = 2 and d.id = d.query_id)
             when turn = 3 then e.label = g.label and abs(d.id % 50 - d.query_id % 50) <= 1
             else e.label = g.label end as relevant,
        case when turn = 2 then case when e.label in (g.label, g.label + 1) then e.label::varchar
                                     when d.id = d.query_id then (g.label + 1)::varchar end end as munit
      from dense d join embeddings e on e.vec_id = d.id join gold g on g.query_id = d.query_id),
u as (select query_id, case when turn = 2 then munit when relevant then 'answer' end as unit, min(rank) as rank from r group by 1, 2),
us as (select query_id, sum(1 / log2(rank + 1)) as dcg, min(rank) as urank from u where unit is not null group by query_id),
p1 as (select query_id, min(case when section = label then rank end) as ra,
              min(case when section = label + 1 or id = query_id then rank end) as rb from r where turn = 2 group by query_id),
fr as (select query_id, min(case when relevant then rank end) as first from r group by query_id),
scored as (select g.query_id, g.turn, case when g.label % 2 = 0 then 'even' else 'odd' end as difficulty,
    coalesce((first <= 3)::int, 0) as hit_3, coalesce((first <= 5)::int, 0) as hit_5, coalesce((first <= 10)::int, 0) as hit_10,
    coalesce((first <= 30)::int, 0) as hit_30, coalesce(1.0::double / first, 0) as mrr,
    coalesce(dcg, 0) / case when turn = 2 then 1 + 1 / log2(3) else 1 end as ndcg_10, coalesce(1.0::double / urank, 0) as mrr_10,
    case when turn = 2 then (coalesce((ra <= 5)::int, 0) + coalesce((rb <= 5)::int, 0)) / 2.0::double end as multi_recall_5,
    case when turn = 2 then (coalesce(ra <= 5, false) and coalesce(rb <= 5, false))::int end as multi_all_5
  from gold g left join fr using (query_id) left join us using (query_id) left join p1 using (query_id))
"""
)


@query(
    _SCORED
    + """select query_id, hit_3, hit_5, hit_10, round(mrr, 6) as mrr, round(ndcg_10, 6) as ndcg_10, round(mrr_10, 6) as mrr_10,
    round(multi_recall_5, 6) as multi_recall_5, multi_all_5 from scored"""
)
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each query's dense results, with all modes of gold rows."""
    scored = ranking.score_rankings(_gold(spark, sf_dir), _results(spark, sf_dir))
    rounded = [F.round(m, 6).alias(m) for m in ("mrr", "ndcg_10", "mrr_10", "multi_recall_5")]
    return scored.select("query_id", "hit_3", "hit_5", "hit_10", *rounded, "multi_all_5")


@query(
    _SCORED
    + """select case when grouping(turn) = 0 then 'turn' when grouping(difficulty) = 0 then 'difficulty' else 'all' end as dimension,
      coalesce(case when grouping(turn) = 0 then turn::varchar when grouping(difficulty) = 0 then difficulty end, '') as value,
      count(*) as queries, count(*) filter (where turn = 2) as multi,
      round(avg(hit_3), 6) as hit_3, round(avg(hit_10), 6) as hit_10, round(avg(mrr), 6) as mrr, round(avg(ndcg_10), 6) as ndcg_10,
      round(coalesce(avg(multi_recall_5), 0), 6) as multi_recall_5
    from scored group by grouping sets ((), (turn), (difficulty))"""
)
def rank_metrics_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics over all queries, by mode of the gold row and by difficulty, in one pass."""
    gold = _gold(spark, sf_dir).withColumn("turn", (F.col("query_id") / 20 % 4).cast("int").cast("string"))
    scored = ranking.score_rankings(gold, _results(spark, sf_dir))
    out = ranking.metric_breakdown(scored, ("turn", "difficulty"))
    rounded = [F.round(m, 6).alias(m) for m in ("hit_3", "hit_10", "mrr", "ndcg_10", "multi_recall_5")]
    return out.select("dimension", "value", "queries", "multi", *rounded)


@query(
    _SCORED
    + """, other as (select query_id, mrr * 0.5 as mrr from scored where query_id % 60 = 0)
    select coalesce(a.query_id, b.query_id) as query_id, round(b.mrr - a.mrr, 6) as difference,
           case when b.query_id is null then 'right' end as missing
    from scored a full join other b on a.query_id = b.query_id"""
)
def compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' reciprocal ranks side by side; queries that one lacks are named."""
    one = saved(ranking.score_rankings(_gold(spark, sf_dir), _results(spark, sf_dir)).select("query_id", "mrr"), "run")
    other = one.filter("query_id % 60 = 0").withColumn("mrr", F.col("mrr") * 0.5)
    out = ranking.compare_runs(one, other, "mrr")
    return out.select("query_id", F.round("difference", 6).alias("difference"), "missing")


@query(
    _DENSE.format(k=10)
    + """, b as (select query_id, id, case when query_id % 40 = 0 then score else -score end as other from dense),
    o as (select query_id, max(abs(dense.score - b.other)) as largest_gap,
                 list(id order by dense.score desc, id) = list(id order by b.other desc, id) as same_order
          from dense join b using (query_id, id) group by query_id)
    select query_id, round(largest_gap, 6) as largest_gap, 0::bigint as unpaired, same_order from o"""
)
def score_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two scorings order each query's results alike, and the largest difference."""
    base = saved(dense_topk(spark, sf_dir).select("query_id", "id", "score"), "scores")
    other = base.withColumn("score", F.when(F.col("query_id") % 40 == 0, F.col("score")).otherwise(-F.col("score")))
    out = ranking.rank_agreement(base, other)
    return out.select("query_id", F.round("largest_gap", 6).alias("largest_gap"), "unpaired", "same_order")


# -- answers --------------------------------------------------------------------------------------
def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as answers: flags stand for modes, numbers for recall and citations."""
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_returnflag") == "A", "grounded").when(F.col("l_returnflag") == "N", "abstain").alias("answer_mode"),
        F.when(F.col("l_linestatus") == "O", "grounded").otherwise("abstain").alias("expected"),
        F.when(F.col("l_linenumber") % 3 == 0, "unanswerable").when(F.col("l_linenumber") % 3 == 1, "injection").otherwise("answerable").alias("category"),
        (F.col("l_suppkey") % 2 == 0).alias("followed"),
        (F.col("l_suppkey") % 3 == 0).alias("declined"),
        (F.col("l_partkey") % 5 / 4).alias("nugget_recall"),
        (F.col("l_partkey") % 11 == 0).alias("contradiction"),
        F.array(F.struct((F.col("l_suppkey") % 4).cast("string").alias("section"), F.col("l_suppkey").cast("string").alias("chunk"))).alias("citations"),
        F.array(F.lit("0"), F.lit("1")).alias("gold_sections"),
        F.array().cast("array<string>").alias("accepted"),
    )


_ANSWERS = """
with a as (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  case l_returnflag when 'A' then 'grounded' when 'N' then 'abstain' end as mode,
  case l_linestatus when 'O' then 'grounded' else 'abstain' end as expected,
  case l_linenumber % 3 when 0 then 'unanswerable' when 1 then 'injection' else 'answerable' end as category,
  (l_partkey % 5) / 4.0 as recall from lineitem),
b as (select *, case when mode = expected then true when mode is null then false
                     when category = 'injection' then l_suppkey % 2 <> 0
                     when category = 'unanswerable' then l_suppkey % 3 = 0 else false end as correct from a)
"""


@query(
    _ANSWERS
    + """select category, correct, count(*) as n,
      count(*) filter (where expected = 'grounded' and coalesce(mode, '') <> 'grounded') as refused,
      round(avg(case when expected = 'grounded' then (l_suppkey % 4 < 2)::int end), 6) as precision,
      coalesce(case when category = 'unanswerable' then case when correct then 'perfect' else 'incorrect' end
           when expected <> 'grounded' then null when l_partkey % 11 = 0 then 'incorrect'
           when coalesce(mode, '') <> 'grounded' or recall = 0 then 'missing' when recall >= 1 then 'perfect' else 'acceptable' end, 'none') as label
    from b group by all"""
)
def answer_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour, refusals, citation precision and class of answers, counted."""
    precision, _ = ranking.citation_scores()
    each = _answers(spark, sf_dir).select(
        "category", ranking.behaviour_correct().alias("correct"), precision.alias("p"),
        F.coalesce(ranking.answer_class(), F.lit("none")).alias("label"), ranking.over_refusal().alias("refusal"),
    )
    return each.groupBy("category", "correct", "label").agg(
        F.count("*").alias("n"), F.count_if(F.col("refusal") == 1).alias("refused"), F.round(F.avg("p"), 6).alias("precision")
    )


@query(
    """select o_orderkey, case when o_custkey % 3 = 0 then 'retrieval' when o_custkey % 3 = 1 then 'citation' else 'answer' end as stage,
       round(least(1.0, round_even((o_custkey % 5) / 4.0 * (o_custkey % 4), 0) / (1 + o_custkey % 6))::double, 6) as cited_share from orders"""
)
def error_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where answers went wrong, and their cited share with rounding to even."""
    k = F.col("o_custkey")
    stage = ranking.error_stage(k % 3 != 0, k % 3 != 1)
    share = ranking.cited_share(k % 5 / 4, k % 4, 1 + k % 6)
    return read_table(spark, sf_dir, "orders").select("o_orderkey", stage.alias("stage"), F.round(share, 6).alias("cited_share"))


# -- statistics -----------------------------------------------------------------------------------
_WILSON = """round(greatest(0, (p + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt(p * (1 - p) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n)), 6) as low,
round(least(1, (p + 3.841458820694124 / (2 * n) + 1.959963984540054 * sqrt(p * (1 - p) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n)), 6) as high"""


@query(
    f"""with g as (select lang, count(*)::double as n, avg(toxic) as p from documents join labels using (doc_id) group by lang)
    select lang, n::bigint as n, round(p, 6) as share, {_WILSON} from g"""
)
def wilson_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of toxic documents by language with its Wilson interval."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = docs.join(read_table(spark, sf_dir, "labels"), "doc_id")
    out = statistics.share_summary(rows, ["lang"], F.col("toxic"))
    return out.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("share", "low", "high")])


@query(
    """with c as (select count(*)::double as n, avg((quality = toxic)::int) as o, avg(quality) as q, avg(toxic) as t from labels),
    e as (select *, q * t + (1 - q) * (1 - t) as ek, (q + t) / 2 as s from c)
    select n::bigint as n, round(o, 6) as agreement, round((o - ek) / (1 - ek), 6) as kappa,
           round((o - 2 * s * (1 - s)) / (1 - 2 * s * (1 - s)), 6) as ac1 from e"""
)
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement, Cohen's kappa and Gwet's AC1 of the two labels."""
    out = statistics.agreement(read_table(spark, sf_dir, "labels"), "quality", "toxic")
    return out.select(F.col("n").cast("long").alias("n"), *[F.round(c, 6).alias(c) for c in ("agreement", "kappa", "ac1")])


@query(
    """with j as (select doc_id, (n_chars % 100) / 100.0::double as judge, case when doc_id % 5 = 0 then quality::double end as human
                  from documents left join labels using (doc_id)),
    s as (select count(*) as n_all, count(human) as n, avg(judge) - avg(judge - human) as estimate,
                 var_samp(judge) / count(*) + var_samp(judge - human) / count(human) as v from j)
    select n, round(estimate, 6) as estimate, round(estimate - 1.959963984540054 * sqrt(v), 6) as low,
           round(estimate + 1.959963984540054 * sqrt(v), 6) as high from s"""
)
def ppi_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction-powered mean: a judge on all documents, people on some."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 100 / 100).alias("judge"))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("human"))
    rows = docs.join(labels, "doc_id", "left").withColumn("human", F.when(F.col("doc_id") % 5 == 0, F.col("human")))
    out = statistics.ppi(rows, "judge", "human")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("estimate", "low", "high")])


@query(
    """with c as (select o_custkey, count(*)::double as orders, sum(o_totalprice) as spent from orders group by o_custkey),
    x as (select orders as a, c_acctbal as b from customer join c on o_custkey = c_custkey),
    r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra,
                 rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from x)
    select count(*) as n, round(corr(ra, rb), 6) as rho from r"""
)
def spearman_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of customers' order counts and balances, with average ranks."""
    counts = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("a"))
    rows = read_table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey")).select("a", F.col("c_acctbal").alias("b"))
    return statistics.spearman(rows, "a", "b").select("n", F.round("rho", 6).alias("rho"))


@query(
    """select l_returnflag, count(*) as n, round(avg(abs(l_discount - l_tax)), 6) as mean_gap,
              round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.95), 4) as p95
       from lineitem group by l_returnflag"""
)
def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated percentiles, and the mean absolute difference of two columns."""
    lines = read_table(spark, sf_dir, "lineitem")
    gap = lines.groupBy("l_returnflag").agg(F.round(F.avg(F.abs(F.col("l_discount") - F.col("l_tax"))), 6).alias("mean_gap"))
    cut = statistics.interpolated(lines, ["l_returnflag"], "l_extendedprice", (0.5, 0.95))
    return cut.join(gap, "l_returnflag").select("l_returnflag", "n", "mean_gap", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@query(
    """with t as (select n_regionkey as family, n_nationkey as test, (n_nationkey * 7 % 25 + 1) / 250.0::double as p_value from nation),
    r as (select *, row_number() over (partition by family order by p_value) as k, count(*) over (partition by family) as m from t)
    select family, test, round(p_value, 6) as p_value, round(max(least(1, (m - k + 1) * p_value)) over (partition by family order by k), 6) as adjusted from r"""
)
def holm_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm-adjusted p-values within families of tests."""
    tests = read_table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("family"), F.col("n_nationkey").alias("test"), ((F.col("n_nationkey") * 7 % 25 + 1) / 250).alias("p_value")
    )
    out = statistics.holm(tests, ["family"])
    return out.select("family", "test", F.round("p_value", 6).alias("p_value"), F.round("adjusted", 6).alias("adjusted"))


@query()
def bootstrap_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of the mean price by return flag.  Random numbers: tested for coverage."""
    lines = read_table(spark, sf_dir, "lineitem").withColumn("row", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return statistics.bootstrap_mean(lines, ["l_returnflag"], "row", "l_extendedprice", resamples=200)


@query(
    """select l_returnflag, count(*) as n, 50::bigint as resamples, count(*) as least, count(*) as most, 50::bigint as within
    from lineitem group by l_returnflag"""
)
def bootstrap_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of each resample of a group's lines: as many as the group has; ``within`` counts the resamples whose
    mean is within eight standard errors of the group's."""
    lines = read_table(spark, sf_dir, "lineitem").withColumn("row", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    draws = resampling.resampled_sums(lines, ["l_returnflag"], "row", ["l_quantity"], resamples=50)
    own = lines.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("deviation"))
    near = F.abs(F.col("l_quantity") / F.col("draws") - F.col("mean")) <= 8 * F.col("deviation") / F.sqrt("n")
    return draws.join(own, "l_returnflag").groupBy("l_returnflag", "n").agg(
        F.count("*").alias("resamples"), F.min("draws").alias("least"), F.max("draws").alias("most"), F.count_if(near).alias("within")
    )


@query()
def sign_flip_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-flip test of the difference of discount and tax by return flag."""
    lines = read_table(spark, sf_dir, "lineitem").withColumn("row", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    gap = lines.withColumn("gap", F.col("l_discount") - F.col("l_tax"))
    return statistics.paired_test(gap, ["l_returnflag"], "row", "gap", resamples=200)


@query()
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric by mode: Wilson intervals of hit shares, bootstrap intervals of reciprocal ranks."""
    scored = saved(ranking.score_rankings(_gold(spark, sf_dir), _results(spark, sf_dir)), "scored")
    return statistics.metric_summaries(scored, ["mode"], "query_id", ["hit_3", "hit_10"], ["mrr", "ndcg_10"])


# -- samples --------------------------------------------------------------------------------------
_QUOTAS = """
with c as (select lang as stratum, count(*) as rows from documents group by lang),
t as (select *, sum(rows) over () as every, 100 * rows // sum(rows) over () as floor from c),
q as (select *, row_number() over (order by (100 * rows - floor * every) desc, stratum) as place, 100 - sum(floor) over () as lacking from t),
quotas as (select stratum, rows, (floor + (place <= lacking)::int)::bigint as quota from q)
"""


@query(_QUOTAS + "select stratum, rows, quota from quotas")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred rows shared over the languages by largest remainder."""
    counts = read_table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("rows"))
    return sampling.quotas(counts, "stratum", 100).select("stratum", "rows", "quota")


@query(_QUOTAS + "select stratum as lang, quota as n from quotas where quota > 0")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a stratified sample of a hundred documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.stratified_sample(docs, "lang", "doc_id", 100, 7).groupBy("lang").agg(F.count("*").alias("n"))


@query(
    """with p as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) - 1 as pos,
                    count(*) over (partition by o_orderpriority) as n from orders),
    i as (select unnest(range(20)) as i)
    select distinct o_orderpriority, o_orderkey, pos + 1 as position from p join i on (n > 20 and pos = i * n // 20) or n <= 20"""
)
def spread_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty orders of each priority, evenly spaced by price."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = sampling.spread_pick(orders, ("o_orderpriority",), [F.col("o_totalprice"), F.col("o_orderkey")], 20)
    return out.select("o_orderpriority", "o_orderkey", "position")


@query(
    """with p as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos, count(*) over () as n from orders)
    select o_orderkey, pos + 1 as position from p where pos % ceil(n / 50.0)::bigint = 0 and pos // ceil(n / 50.0)::bigint < 50"""
)
def every_nth_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every n-th order, at most fifty."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey")
    return sampling.every_nth(orders, [F.col("o_orderkey")], 50).select("o_orderkey", "position")


@query(
    """with p as (select c_custkey, row_number() over (order by c_acctbal, c_custkey) - 1 as pos, count(*) over () as n from customer),
    s as (select *, pos * 10 // n as stratum from p),
    b as (select *, (stratum * n + 9) // 10 as low, ((stratum + 1) * n + 9) // 10 as high from s)
    select c_custkey, stratum from b where pos = (low + high - 1) // 2"""
)
def middle_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle customer of each tenth by balance."""
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    out = sampling.middle_of_strata(customers, [F.col("c_acctbal"), F.col("c_custkey")], 10)
    return out.select("c_custkey", "stratum")


@query(
    """with e as (select min(n_chars) as low, (max(n_chars) - min(n_chars)) / 8.0 as width from documents),
    p as (select doc_id, n_chars, least(7, floor((n_chars - low) / width))::int as bin from documents, e),
    o as (select *, row_number() over (partition by bin order by n_chars, doc_id) - 1 as pos, count(*) over (partition by bin) as n from p),
    i as (select unnest(range(5)) as i)
    select distinct doc_id, bin from o join i on (n > 5 and pos = i * n // 5) or n <= 5"""
)
def length_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents from each eighth of the range of lengths."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return sampling.length_strata(docs, "n_chars", "doc_id", 5).select("doc_id", "bin")


@query(
    """with r as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as turn from part)
    select p_brand, p_partkey, turn from r where turn <= 3"""
)
def brands_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the brands in turn, three rounds."""
    parts = read_table(spark, sf_dir, "part")
    return sampling.in_turns(parts, "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "turn")


@query("select source, least(count(*), 10)::bigint as n from documents group by source")
def sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a sample of ten documents per source."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    out = sampling.per_group_sample(docs, ["source"], "doc_id", 10, 3)
    return out.groupBy("source").agg(F.count("*").alias("n"))


@query(
    """with s as (select n_nationkey as slot, n_regionkey as region, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as turn from nation),
    c as (select n_regionkey as region, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1)
    select slot, greatest(0, least(4, n - 4 * turn))::bigint as n from s join c using (region) where n > 4 * turn"""
)
def disjoint_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four customers of the region for each nation, no customer twice: sample sizes."""
    nation = read_table(spark, sf_dir, "nation")
    customers = read_table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    slots = nation.select(F.col("n_nationkey").alias("slot"), F.col("n_regionkey").alias("region"))
    rows = customers.select("c_custkey", F.col("n_regionkey").alias("region"))
    out = sampling.disjoint_samples(rows, slots, ["region"], "c_custkey", 4, 1)
    return out.groupBy("slot").agg(F.count("*").alias("n"))


@query(
    """with d as (select l_orderkey, count(distinct l_partkey) as n from lineitem group by 1) select l_orderkey, least(2, n // 2)::bigint as pairs from d where n >= 2"""
)
def sampled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two pairs of different parts of each order: numbers of pairs."""
    lines = read_table(spark, sf_dir, "lineitem")
    return sampling.pairs_in_group(lines, "l_orderkey", "l_partkey", 2, 5).groupBy("l_orderkey").agg(F.count("*").alias("pairs"))


