"""Joins, set algebra, versions, constraints, runs and pages over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.arrays import cursor
from vellum.operators import digests, goldset, history, releases, relations
from vellum.plans.registry import query
from vellum.storage import new_path, read_table, saved, spread


# -- joins ----------------------------------------------------------------------------------------
@query("select o_orderkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)")
def orders_with_large_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left-semi join: orders that have a large line."""
    keys = read_table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return relations.pick_rows(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), keys, ["o_orderkey"])


@query("select c_custkey, count(o_orderkey) as n_orders from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'F' group by c_custkey")
def customers_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left outer join to counts; none counts as 0."""
    orders = read_table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return relations.with_counts(read_table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "n_orders")


@query(
    """select p_partkey, array_to_string(list_sort(list(distinct l_suppkey)), ',') as suppliers from part join lineitem on p_partkey = l_partkey
       where p_size > 25 group by p_partkey"""
)
def part_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of large parts as sorted lists."""
    parts = read_table(spark, sf_dir, "part").filter("p_size > 25").select("p_partkey")
    links = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    out = relations.members(relations.pick_rows(links, parts, ["p_partkey"]), "p_partkey", "l_suppkey", "s")
    return out.select("p_partkey", F.array_join("s", ",").alias("suppliers"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def customers_without_big_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left-anti join: NOT EXISTS."""
    big = read_table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return relations.orphans(read_table(spark, sf_dir, "customer").select("c_custkey"), big, "c_custkey")


@query(
    """select n_nationkey, coalesce(c.n, 0) as customers, coalesce(s.n, 0) as suppliers from nation
       full join (select c_nationkey, count(*) as n from customer where c_acctbal > 9000 group by 1) c on n_nationkey = c_nationkey
       full join (select s_nationkey, count(*) as n from supplier group by 1) s on n_nationkey = s_nationkey"""
)
def nation_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer join of three counted tables."""
    c = read_table(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = read_table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    out = read_table(spark, sf_dir, "nation").select("n_nationkey").join(c, "n_nationkey", "full_outer").join(s, "n_nationkey", "full_outer")
    return out.select("n_nationkey", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query(
    """with r(place, status, label, lo) as (values (1, 'F', 'late', 0), (2, 'P', 'part', 0), (3, 'F', 'never', 0), (4, 'O', 'open', 0))
    select o_orderkey, (select label from r where status = o_orderstatus order by place limit 1) as label from orders"""
)
def first_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule of a list whose keys hold the row's."""
    rules = spark.createDataFrame(
        [(1, ["F"], "late"), (2, ["P"], "part"), (3, ["F", "P"], "never"), (4, ["O"], "open")], "place int, keys array<string>, label string"
    )
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return relations.first_match(rows, rules, "status", "keys", "place").select("o_orderkey", "rule.label")


_SPANS = """
with a as (select l_suppkey % 100 as doc, l_orderkey % 300 as s, l_partkey as id, l_orderkey as o, l_linenumber as ln from lineitem),
b as (select s_suppkey % 100 as doc, s_suppkey % 300 as s, s_suppkey as id from supplier)
"""


@query(
    _SPANS
    + """select a.doc, a.id, a.o, a.ln, b.id as b_id from a join b on a.doc = b.doc and a.s <= b.s + 20 and b.s <= a.s + 5"""
)
def page_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join within documents: spans of pages that meet."""
    a = read_table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 100).alias("doc"), (F.col("l_orderkey") % 300).alias("start"),
        (F.col("l_orderkey") % 300 + 5).alias("end"), F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"),
    )
    b = read_table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") % 100).alias("doc"), (F.col("s_suppkey") % 300).alias("start"),
        (F.col("s_suppkey") % 300 + 20).alias("end"), F.col("s_suppkey").alias("id"),
    )
    return relations.overlapping_rows(spread(a), b, "doc").select("doc", "id", "o", "ln", "b_id")


@query(
    _SPANS
    + """, m as (select a.doc, a.id, a.o, a.ln, a.s, b.id as b_id, abs(a.s - b.s) as gap from a join b on a.doc = b.doc and a.s <= b.s + 20 and b.s <= a.s + 5)
    select doc, id, o, ln, b_id from m qualify row_number() over (partition by doc, id, o, ln, s order by gap, b_id) = 1"""
)
def best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the overlapping spans: the nearest start, then the smaller id."""
    a = read_table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 100).alias("doc"), (F.col("l_orderkey") % 300).alias("start"),
        (F.col("l_orderkey") % 300 + 5).alias("end"), F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"),
    ).distinct()
    b = read_table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") % 100).alias("doc"), (F.col("s_suppkey") % 300).alias("start"),
        (F.col("s_suppkey") % 300 + 20).alias("end"), F.col("s_suppkey").alias("id"),
    )
    return relations.nearest_overlap(a, b, "doc", "id").select("doc", "id", "o", "ln", "b_id")


@query(
    """with k as (select distinct substr(p_name, 1, 1 + p_partkey % 12) as key from part),
    n as (select distinct p_type as name from part),
    m as (select key, max(case when key = name then name end) as exact, count(*) as c, min(name) as one
          from k join n on starts_with(name, key) or starts_with(key, name) group by key)
    select k.key, coalesce(exact, case when c = 1 then one end) as matched from k left join m using (key)"""
)
def unique_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only name that the key is a prefix of, or that is a prefix of it."""
    part = read_table(spark, sf_dir, "part")
    keys = part.select(F.substring(F.col("p_name"), F.lit(1), (1 + F.col("p_partkey") % 12).cast("int")).alias("key")).distinct()
    return relations.only_match(keys, part.select("p_type"), "key", "p_type").select("key", "matched")


@query(
    """select a.p_brand as title, a.p_partkey as first, b.p_partkey as second from part a join part b on a.p_brand = b.p_brand and a.p_partkey <> b.p_partkey
       where (a.p_size, b.p_size) in ((1, 2), (3, 4), (5, 5))"""
)
def title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts of one brand whose sizes are a listed pair: self-join through a pair table."""
    rows = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("title"), F.col("p_size").alias("category"))
    pairs = spark.createDataFrame([(1, 2), (3, 4), (5, 5)], "first_category int, second_category int")
    return relations.same_title_pairs(rows, pairs, "p_partkey").select("title", "first", "second")


@query(
    """with e as (select o_orderkey as key, o_orderstatus as d from orders where o_orderkey % 3 <> 0),
    a as (select o_orderkey as key, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as d from orders where o_orderkey % 4 <> 0)
    select coalesce(e.key, a.key) as key, case when a.key is null then 'missing' when e.key is null then 'unexpected' when e.d <> a.d then 'changed' else 'same' end as status
    from e full join a on e.key = a.key"""
)
def listing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings compared: missing, unexpected, changed, same."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("d"))
    want = o.filter("key % 3 <> 0")
    have = o.filter("key % 4 <> 0").withColumn("d", F.when(F.col("key") % 5 == 0, "X").otherwise(F.col("d")))
    return relations.listing_changes(want, have, "key", "d")


@query(
    """select a.s_suppkey as left_id, b.c_custkey as right_id from supplier a join customer b
       on a.s_nationkey = b.c_nationkey and a.s_suppkey % 500 = b.c_custkey % 500"""
)
def blocked_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal word sets met by their least word."""
    def sets(t: str, k: str, n: str, name: str) -> DataFrame:
        words = F.array(F.concat(F.lit("n"), n), F.concat(F.lit("k"), F.col(k) % 500))
        return read_table(spark, sf_dir, t).select(F.col(k).alias(name), words.alias("words"))

    left = sets("supplier", "s_suppkey", "s_nationkey", "left_id")
    right = sets("customer", "c_custkey", "c_nationkey", "right_id")
    return goldset.blocked_matches(left, right)


@query(
    """with j as (select o_orderkey as query_id, o_orderstatus as section_id, l_partkey as chunk_id from orders
       join lineitem on o_orderkey = l_orderkey and o_orderpriority[1:1]::int = l_linenumber)
    select query_id, section_id, count(distinct chunk_id) as n, min(chunk_id) as first from j group by all"""
)
def relevance_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted chunks per gold row by (slug, intent), as sorted lists."""
    gold = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("query_id"), F.col("o_orderstatus").alias("section_id"),
        F.col("o_orderkey").alias("slug"), F.substring("o_orderpriority", 1, 1).cast("int").alias("intent"),
    )
    accepted = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("slug"), F.col("l_linenumber").alias("intent"), F.col("l_partkey").alias("chunk_id")
    )
    out = goldset.judgments(gold, accepted)
    return out.select("query_id", "section_id", F.size("chunk_ids").cast("long").alias("n"), F.array_min("chunk_ids").alias("first"))


# -- aggregates and runs --------------------------------------------------------------------------
@query(
    """select l_returnflag, l_linestatus, grouping(l_returnflag)::int as all_flags, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n
       from lineitem group by cube (l_returnflag, l_linestatus)"""
)
def revenue_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by both flags, each, and all: one aggregate over grouping sets."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return read_table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(
        F.grouping("l_returnflag").cast("int").alias("all_flags"), F.round(F.sum(price), 2).alias("revenue"), F.count("*").alias("n")
    )


@query(
    """select 'status' as field, o_orderstatus as value, count(*) as n from orders group by 2 union all
       select 'priority', o_orderpriority, count(*) from orders group by 2"""
)
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by several fields in one pass."""
    o = read_table(spark, sf_dir, "orders").select(
        F.explode(
            F.array(
                F.struct(F.lit("status").alias("field"), F.col("o_orderstatus").alias("value")),
                F.struct(F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value")),
            )
        ).alias("x")
    )
    return o.groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


@query("select c_mktsegment, sum(case when c_acctbal < 0 then 1 else 0 end)::bigint as negative, count(distinct c_nationkey) as nations, bool_or(c_acctbal > 9990) as rich from customer group by 1")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts, distinct counts and any."""
    return read_table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count_distinct("c_nationkey").alias("nations"), F.bool_or(F.col("c_acctbal") > 9990).alias("rich")
    )


@query(
    """with d as (select distinct l_suppkey, l_orderkey as x from lineitem),
    i as (select *, x - row_number() over (partition by l_suppkey order by x) as island from d)
    select l_suppkey, min(x) as first, max(x) as last, count(*) as n,
      case when min(x) = max(x) then min(x)::varchar else min(x) || '-' || max(x) end as label from i group by l_suppkey, island"""
)
def number_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and islands: runs of consecutive order numbers per supplier, with labels."""
    out = relations.runs(read_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey")
    return out.withColumn("label", relations.run_label(F.col("first"), F.col("last")))


@query(
    """with d as (select distinct l_suppkey, l_orderkey as x from lineitem),
    n as (select *, lead(x) over (partition by l_suppkey order by x) as nx from d)
    select l_suppkey, x + 1 as first, nx - 1 as last from n where nx > x + 1"""
)
def number_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that lack between a group's first and last."""
    return relations.lacking_numbers(read_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey")


@query("select p_partkey, p_name || case when n > 1 then printf(':part-%03d', n) else '' end as unique_name from (select *, row_number() over (partition by p_brand order by p_partkey) as n from (select p_partkey, p_brand, p_brand as p_name from part))")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated names numbered from the second on."""
    return relations.numbered_repeats(read_table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "unique_name")


@query(
    """with t as (select 'a' || (l_partkey % 97) as term, l_suppkey as section from lineitem)
    select term, count(distinct section) as n, min(section) as first from t group by term having count(distinct section) > 1"""
)
def shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted index: terms that several sections have."""
    rows = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("section_id"), F.array(F.concat(F.lit("a"), F.col("l_partkey") % 97)).alias("terms")
    )
    out = goldset.shared_terms(rows, "terms")
    return out.select("term", F.col("n").cast("long").alias("n"), F.array_min("section_ids").alias("first"))


@query("select o_custkey, o_orderdate, count(*) as n from orders group by all having count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that several rows share."""
    return relations.repeated_keys(read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate"), ["o_custkey", "o_orderdate"])


@query(
    """select o_orderkey, o_custkey, sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row)::decimal(18,2)::double as rolling
       from orders"""
)
def rolling_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A moving sum over the last three orders of each customer."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    rows = read_table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", "o_custkey", F.round(F.sum("o_totalprice").over(w), 2).alias("rolling"))


@query(
    """with o as (select o_custkey, o_orderkey, o_totalprice, o_orderdate from orders),
    s as (select *, sum(o_totalprice) over (partition by o_custkey order by o_orderkey) as spent from o)
    select o_orderkey, round(spent, 2) as spent, spent <= 500000 as allowed from s"""
)
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running cost against a budget."""
    rows = read_table(spark, sf_dir, "orders")
    out = history.within_budget(rows, "o_custkey", "o_orderkey", "o_totalprice", 500_000)
    return out.select("o_orderkey", F.round("spent", 2).alias("spent"), "allowed")


@query(
    """select l_suppkey as key, count(*) as n, greatest(count(*) - 30, 0)::bigint as over from lineitem group by 1 having count(*) <> 30"""
)
def quota_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose number of rows isn't the wanted one."""
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"))
    wanted = lines.distinct().withColumn("wanted", F.lit(30).cast("long"))
    out = relations.quota_gaps(lines, wanted, ["key"])
    return out.select("key", F.col("found").alias("n"), F.greatest(F.col("found") - 30, F.lit(0)).alias("over"))


# -- set algebra and upserts ----------------------------------------------------------------------
@query(
    """select distinct l_partkey as key, case when l_partkey % 3 = 0 then 'cached' when l_partkey % 5 = 0 then 'bundled' else 'compute' end as origin from lineitem"""
)
def embedding_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted keys split into cached, bundled and still to compute."""
    wanted = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"))
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    return relations.three_way(wanted, parts.filter("key % 3 = 0"), parts.filter("key % 5 = 0"), "key")


@query(
    """select o_orderkey, case when o_orderkey % 10 = 0 then o_totalprice * 2 else o_totalprice end as price from orders
       union all select -o_orderkey - 1, 0 from orders where o_orderkey % 100 = 0"""
)
def upserted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows merged by key: new versions replace old ones, new keys are added."""
    old = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    new = old.filter("o_orderkey % 10 = 0").withColumn("price", F.col("price") * 2)
    more = old.filter("o_orderkey % 100 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit(0.0).alias("price"))
    return relations.upserted(old, new.unionByName(more), ["o_orderkey"])


@query("select o_orderkey, o_totalprice as price from orders union all select -o_orderkey - 1, 0 from orders where o_orderkey % 100 = 0")
def inserted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows merged by key where old ones stay."""
    old = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    more = old.filter("o_orderkey % 100 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit(0.0).alias("price"))
    return relations.upserted(old, old.withColumn("price", F.lit(-1.0)).unionByName(more), ["o_orderkey"], replace=False)


@query(
    """select o_orderkey as key, o_totalprice as v, coalesce(o_orderkey % 2 = 0 and o_orderkey % 6 = 0, false) as conflict from orders where o_orderkey % 2 = 0
       union all select o_orderkey, o_totalprice, false from orders where o_orderkey % 3 = 0 and o_orderkey % 2 <> 0"""
)
def merged_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two caches merged; keys with different values are marked."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("v"))
    new = o.filter("key % 3 = 0").withColumn("v", F.when(F.col("key") % 2 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return relations.merged(o.filter("key % 2 = 0"), new, ["key"], ["v"])


@query(
    """select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'P' union all select o_orderkey + 1000000, 'N' from orders where o_orderstatus = 'P'"""
)
def replaced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind of rows replaced by new ones."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    is_old = F.col("o_orderstatus") == "P"
    new = o.filter(is_old).select((F.col("o_orderkey") + 1_000_000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"))
    return relations.replaced(o, is_old, new)


@query(
    """select c_nationkey as k from customer where c_acctbal > 0 intersect select s_nationkey from supplier where s_acctbal > 5000
       union all (select n_nationkey + 1000 from nation except select c_nationkey + 1000 from customer where c_acctbal > 9900)"""
)
def key_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and difference of key sets."""
    c, s = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    both = c.filter("c_acctbal > 0").select(F.col("c_nationkey").alias("k")).intersect(s.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")))
    lack = read_table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000).alias("k")).subtract(
        c.filter("c_acctbal > 9900").select((F.col("c_nationkey") + 1000).alias("k"))
    )
    return both.unionByName(lack)


@query(
    """with recursive d as (select sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') as d, count(*) as n from orders group by 1),
    size as (select sum(n)::bigint as n_rows, case when sum(n) <= 1024 then 0 when sum(n) <= 16384 then 1 when sum(n) <= 262144 then 2 when sum(n) <= 4194304 then 3 else 4 end as depth from d),
    up(prefix, h) as (
      select substr(d, 1, depth), sha256(string_agg(d || 'x' || n, ',' order by d || 'x' || n)) from d, size group by 1
      union all
      select substr(prefix, 1, length(prefix) - 1), sha256(string_agg(prefix || ':' || h, ',' order by prefix || ':' || h)) from up where prefix <> '' group by 1)
    select h as digest, n_rows from up, size where prefix = ''"""
)
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of a table that doesn't depend on the order of its rows: the root of its tree."""
    return digests.table_digest(read_table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus"])


@query(
    """with old as (select o_orderkey as k, o_orderstatus as s, o_totalprice as p from orders),
    new as (select k, case when p > 490000 then 'X' else s end as s, p from old where p >= 10000
            union all select -c_custkey, 'N', c_acctbal from customer where c_acctbal > 9900)
    select coalesce(old.k, new.k) as o_orderkey, case when old.k is null then 'added' when new.k is null then 'removed' else 'changed' end as status
    from old full join new on old.k = new.k where old.s is distinct from new.s or old.p is distinct from new.p"""
)
def tree_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which two kept versions of a table differ, found by comparing their digest trees."""
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    old = read_table(spark, sf_dir, "orders").select(*columns)
    status = F.when(F.col("o_totalprice") > 490000, "X").otherwise(F.col("o_orderstatus"))
    more = read_table(spark, sf_dir, "customer").filter("c_acctbal > 9900").select(
        (-F.col("c_custkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.col("c_acctbal").alias("o_totalprice")
    )
    new = old.filter("o_totalprice >= 10000").withColumn("o_orderstatus", status).unionByName(more)
    paths = [new_path(spark, "tree"), new_path(spark, "tree")]
    for version, path in zip((old, new), paths, strict=True):
        digests.write_tree(version, ["o_orderkey"], columns, path)
    return digests.tree_differences(spark, *paths, ["o_orderkey"])[0]


# -- constraints ----------------------------------------------------------------------------------
_BROKEN = """
select 'blocking' as severity, 'part' as check, l_partkey::varchar as id, 'unknown ' || l_partkey as message from lineitem
  where l_partkey not in (select p_partkey from part where p_size < 40)
union all select 'blocking', 'quantity', l_orderkey::varchar, 'too many' from lineitem where l_quantity >= 50
union all select 'suspect', 'dates', o_orderkey::varchar, 'no date' from orders where o_orderdate is null
union all select 'blocking', 'lines', l_orderkey::varchar, count(*) || ' rows from ' || min(l_linenumber) || ' to ' || max(l_linenumber)
  from lineitem group by l_orderkey having not (min(l_linenumber) = 1 and max(l_linenumber) = count(*) and count(distinct l_linenumber) = count(*))
union all select 'blocking', 'customer', o_custkey::varchar, count(*) || ' rows' from orders group by o_custkey having count(*) > 1
"""


@query(_BROKEN)
def constraint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference, domain, uniqueness and contiguity rules as one table of findings."""
    lines, orders = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    parts = read_table(spark, sf_dir, "part").filter("p_size < 40").select(F.col("p_partkey").alias("l_partkey"))
    return relations.all_findings(
        [
            relations.not_found(lines, parts, "part", "l_partkey", "l_partkey"),
            relations.breaks(lines, "quantity", "l_orderkey", F.col("l_quantity") >= 50, "too many"),
            relations.finding(orders.filter("o_orderdate is null"), "dates", "o_orderkey", F.lit("no date"), "suspect"),
            relations.not_contiguous(lines, "lines", "l_orderkey", "l_linenumber"),
            relations.not_unique(orders, "customer", "o_custkey"),
        ]
    )


# -- pages and latest -----------------------------------------------------------------------------
@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 21")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page and one row more."""
    return history.page_after(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 20)


@query(
    """select o_orderkey, o_orderdate from orders where o_orderdate < timestamp '1997-06-01' or (o_orderdate = timestamp '1997-06-01' and o_orderkey < 500)
       order by o_orderdate desc, o_orderkey desc limit 21"""
)
def keyset_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a given row; the condition reaches the scan."""
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    after = (F.lit("1997-06-01").cast("timestamp_ntz"), 500)
    return history.page_after(rows, "o_orderdate", "o_orderkey", 20, after)


@query(
    """select o_orderkey, rtrim(replace(replace(to_base64(encode('{"t":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '","id":"' || o_orderkey || '"}')), '+', '-'), '/', '_'), '=') as cursor from orders"""
)
def page_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opaque page mark of each order."""
    return read_table(spark, sf_dir, "orders").select("o_orderkey", cursor(F.col("o_orderdate"), F.col("o_orderkey")).alias("cursor"))


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user: an append log's current state."""
    events = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return relations.latest(events, ["user_id"], "ts", "event_id").drop("ts")


@query(
    """with r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as age, count(*) over (partition by o_custkey) as n from orders)
    select o_custkey, o_orderkey, (least(n, 3) - age + 1)::bigint as place, n > 3 as more from r where age <= 3"""
)
def page_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest orders of each customer, oldest first."""
    rows = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return history.page_of_each(rows, "o_custkey", "o_orderdate", "o_orderkey", 3).select("o_custkey", "o_orderkey", "place", "more")


@query("select l_orderkey, l_partkey, l_extendedprice from lineitem order by l_discount desc, l_extendedprice desc, l_partkey, l_orderkey limit 20")
def worst_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty worst rows by several keys: a top-k report."""
    rows = read_table(spark, sf_dir, "lineitem")
    return rows.orderBy(F.desc("l_discount"), F.desc("l_extendedprice"), "l_partkey", "l_orderkey").limit(20).select("l_orderkey", "l_partkey", "l_extendedprice")


# -- releases -------------------------------------------------------------------------------------
_RELEASES = """
with releases as (select o_orderkey as release_id, o_custkey as collection_id, row_number() over (partition by o_custkey order by o_orderkey) as number,
   case o_orderstatus when 'F' then 'ready' when 'O' then 'staged' else 'retired' end as status, o_orderpriority as digest,
   o_orderdate as published_at from orders),
current as (select collection_id, max(release_id) as release_id from releases where status = 'ready' group by 1)
"""


def _releases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    number = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    r = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("release_id"), F.col("o_custkey").alias("collection_id"), number.alias("number"),
        F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "staged").otherwise("retired").alias("status"),
        F.col("o_orderpriority").alias("digest"), F.lit("chunks-1").alias("chunker"), F.lit("m").alias("model"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"),
    )
    r = saved(r, "releases")
    return r, r.filter("status = 'ready'").groupBy("collection_id").agg(F.max("release_id").alias("release_id"))


@query(
    _RELEASES
    + """, w as (select distinct collection_id, digest from releases),
    f as (select w.collection_id, w.digest, max_by(release_id, number) filter (where status <> 'retired') as release_id from w join releases using (collection_id, digest) group by 1, 2)
    select f.collection_id, digest, f.release_id, case when f.release_id is null then 'imported' when f.release_id = c.release_id then 'no_change' else 'reused' end as decision
    from f left join current c using (collection_id)"""
)
def import_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a bundle changes nothing, is an old release again, or is imported."""
    r, current = _releases(spark, sf_dir)
    wanted = r.select("collection_id", "digest", "chunker", "model").distinct()
    return releases.import_decision(wanted, r, current).select("collection_id", "digest", "release_id", "decision")


@query(
    _RELEASES
    + """, p as (select r.collection_id, r.release_id, r.number, r.published_at from releases r join current c using (collection_id)
        join releases n on n.release_id = c.release_id where r.status = 'ready' and r.published_at < n.published_at)
    select collection_id, release_id from p qualify row_number() over (partition by collection_id order by published_at desc, number desc) = 1"""
)
def rollback_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each collection goes back to."""
    return releases.rollback_targets(*_releases(spark, sf_dir))


@query(
    _RELEASES
    + """, o as (select collection_id, release_id, number from releases where status <> 'retired' and release_id not in (select release_id from current))
    select * from o qualify row_number() over (partition by collection_id order by number desc) > 2"""
)
def releases_to_retire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases beyond the current one and the two newest others."""
    r, current = _releases(spark, sf_dir)
    return releases.to_retire(r, current, 2)


@query(
    _RELEASES
    + """, live as (select l_partkey as chunk_id, l_orderkey as release_id from lineitem join releases on l_orderkey = release_id where status <> 'retired')
    select chunk_id, array_to_string(list_sort(list(distinct release_id)), ',') as release_ids from live group by chunk_id"""
)
def chunk_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live releases of each chunk."""
    r, _ = _releases(spark, sf_dir)
    bridge = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("chunk_id"), F.col("l_orderkey").alias("release_id"))
    return releases.memberships(bridge, r).withColumn("release_ids", F.array_join("release_ids", ","))


@query(
    _RELEASES
    + """, live as (select distinct l_partkey as chunk_id from lineitem join releases on l_orderkey = release_id where status = 'ready' and l_quantity < 3),
    dead as (select p_partkey as chunk_id from part where p_partkey not in (select chunk_id from live))
    select count(*) filter (where chunk_id % 3 <> 0) as deleted, count(*) filter (where chunk_id % 3 = 0) as kept from dead"""
)
def purge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of no live release: those that go and those that citations keep."""
    r, _ = _releases(spark, sf_dir)
    lines = read_table(spark, sf_dir, "lineitem").filter("l_quantity < 3")
    bridge = lines.select(F.col("l_partkey").alias("chunk_id"), F.col("l_orderkey").alias("release_id"))
    chunks = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"))
    return releases.purge_report(chunks, bridge, r.filter("status = 'ready'"), chunks.filter("chunk_id % 3 = 0"))


@query(
    _RELEASES
    + """, c as (select release_id from releases where collection_id % 3 = 0)
    select r.release_id, case when c.release_id is not null and status = 'ready' then coalesce(published_at, timestamp '2030-01-01') else published_at end as published_at,
    status from releases r left join c using (release_id)"""
)
def published_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases after publishing some: the first date of publication stays."""
    r, current = _releases(spark, sf_dir)
    out, _ = releases.published(r, current, r.filter("collection_id % 3 = 0"), F.lit("2030-01-01").cast("timestamp"))
    return out.select("release_id", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "status")


@query(
    _RELEASES
    + """, b as (select collection_id, max(release_id) + 10000000 as release_id from releases group by 1)
    select b.release_id, collection_id, (max(number) + 1)::bigint as number, 'staged' as status from b join releases r using (collection_id) group by all"""
)
def staged_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next release of each collection."""
    r, _ = _releases(spark, sf_dir)
    new = r.groupBy("collection_id").agg((F.max("release_id") + 10_000_000).alias("release_id"))
    bundle = new.withColumns({"digest": F.lit("d"), "chunker": F.lit("chunks-1"), "model": F.lit("m")})
    out = releases.staged(r, bundle).filter("release_id >= 10000000")
    return out.select("release_id", "collection_id", "number", "status")


@query("select event_id from events where ts < timestamp '2024-01-10' - interval 3 day and user_id not in (select user_id from events where event_type = 'signup' and ts >= timestamp '2024-01-29')")
def expired_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows past their lifetime that nothing refers to."""
    events = read_table(spark, sf_dir, "events")
    old = releases.expired(events, "ts", F.lit("2024-01-10").cast("timestamp_ntz"), 3 * 86_400)
    signed = events.filter("event_type = 'signup' and ts >= timestamp_ntz '2024-01-29'").select("user_id")
    return releases.unreferenced(old, [(signed, "user_id")], "user_id").select("event_id")


@query("select 'orders' as table_name, count(*) as n_rows from orders union all select 'part', count(*) from part")
def snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of a snapshot's tables."""
    return releases.snapshot_stats({t: read_table(spark, sf_dir, t) for t in ("orders", "part")})


@query(
    """with v as (select o_orderkey as id, o_totalprice as a, o_orderpriority as p from orders),
    n as (select id, case when id % 9 = 0 then a + 1 else a end as a, case when id % 4 = 0 then 'x' else p end as p from v where id % 11 <> 0)
    select coalesce(v.id, n.id) as id, case when n.id is null then 'drop' when v.a <> n.a then 'answer' when v.p <> n.p then 'judge' else 'keep' end as action
    from v left join n on v.id = n.id"""
)
def gold_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new version of a gold set asks to redo."""
    old = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a"), F.col("o_orderpriority").alias("p"))
    new = old.filter("id % 11 <> 0").withColumns(
        {"a": F.when(F.col("id") % 9 == 0, F.col("a") + 1).otherwise(F.col("a")), "p": F.when(F.col("id") % 4 == 0, "x").otherwise(F.col("p"))}
    )
    return goldset.changed_items(old, new, "id", ["a"], ["p"])
