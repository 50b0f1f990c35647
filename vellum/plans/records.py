"""Records written and read back, tables in text, labels and arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import arrays, labels, lattice, text
from vellum.operators import chunking, corpus, goldset, history, relations, releases, search, snapshot
from vellum.plans.registry import query
from vellum.plans.relational import _RELEASES, _releases
from vellum.sinks import versions
from vellum.sources import ranges, records
from vellum.storage import new_path, read_table, saved, spread


#: Lines of orders with a number of their own: the given line numbers repeat.
_LINES = """
with lines as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as n from lineitem)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return read_table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order))


# -- round trips ----------------------------------------------------------------------------------
def _bundle(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = read_table(spark, sf_dir, "documents").filter("trim(text) <> ''")
    key = F.col("doc_id").cast("string")
    block = F.struct(
        F.lit("prose").alias("kind"), F.col("text").alias("markdown"), F.lit(1).alias("start_page"), F.lit(2).alias("end_page"),
        F.lit(None).cast("string").alias("table_key"),
    )
    return {
        "documents": docs.select(
            F.concat(F.lit("d"), key).alias("key"), F.lit("text").alias("kind"), F.concat_ws(" ", "lang", key).alias("title"),
            F.struct(F.col("source").alias("title"), F.lit(None).cast("string").alias("url")).alias("source"),
            F.create_map(F.lit("lang"), F.col("lang")).alias("attributes"),
        ),
        "sections": docs.select(
            F.concat(F.lit("s"), key).alias("key"), F.concat(F.lit("d"), key).alias("document_key"), F.col("source").alias("heading"),
            F.array("lang").alias("context_path"), F.lit(1).alias("ordinal"), F.lit(1).alias("start_page"), F.lit(2).alias("end_page"),
            F.lit("full").alias("retrieval"), F.array(block).alias("blocks"),
        ),
        "glossary": spark.createDataFrame([("a", False, ["x"], ["y"], "c"), ("b", True, [], [], "c")], records.SCHEMAS["glossary"]),
        "mappings": spark.createDataFrame([("m", ["a"], "sign", ["p"], [])], records.SCHEMAS["mappings"]),
    }


@query(
    """select 's' || doc_id as key, lang || ' ' || doc_id as title, lang, source as heading, 1::bigint as n_blocks, md5(text) as digest
       from documents where trim(text) <> ''"""
)
def bundle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a checked bundle of JSON lines, written and read back."""
    path = new_path(spark, "bundle")
    versions.write_bundle(_bundle(spark, sf_dir), path)
    read = records.read_bundle(spark, path)
    docs = read["documents"].select(F.col("key").alias("document_key"), "title", F.col("attributes")["lang"].alias("lang"))
    return read["sections"].join(docs, "document_key").select(
        "key", "title", "lang", "heading", F.size("blocks").cast("long").alias("n_blocks"), F.md5(F.col("blocks")[0]["markdown"]).alias("digest")
    )


@query("select term, len(aliases)::bigint as n from (values ('a', ['y']), ('b', [])) t(term, aliases) union all select 'm', 1")
def bundle_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The glossary and the mappings of a written bundle, which are JSON arrays."""
    path = new_path(spark, "bundle")
    versions.write_bundle(_bundle(spark, sf_dir), path)
    read = records.read_bundle(spark, path)
    terms = read["glossary"].select("term", F.size("aliases").cast("long").alias("n"))
    return terms.unionByName(read["mappings"].select(F.col("key").alias("term"), F.size("aliases").cast("long").alias("n")))


@query(
    """select 'section_ordinal' as check_name, count(*) as n from (select o_custkey from orders group by 1 having count(*) > 1)
       union all select 'section_pages', count(*) from orders where o_orderkey % 7 = 0
       union all select 'section_text', count(*) from orders where o_orderpriority like '1%'
       union all select 'document', count(*) from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)
       union all select 'document_title', count(*) from customer where c_acctbal > 0 and c_mktsegment = 'BUILDING'"""
)
def bundle_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a bundle with faults, by check."""
    customers = read_table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    docs = customers.select(
        F.concat(F.lit("c"), "c_custkey").alias("key"), F.lit("k").alias("kind"),
        F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_name")).alias("title"), F.lit(None).cast("string").alias("_corrupt"),
    )
    orders = read_table(spark, sf_dir, "orders")
    body = F.when(F.col("o_orderpriority").startswith("1"), " ").otherwise("body")
    block = F.struct(F.lit("prose").alias("kind"), body.alias("markdown"), F.lit(1).alias("start_page"), F.lit(1).alias("end_page"), F.lit(None).cast("string").alias("table_key"))
    sections = orders.select(
        F.concat(F.lit("o"), "o_orderkey").alias("key"), F.concat(F.lit("c"), "o_custkey").alias("document_key"), F.lit(1).alias("ordinal"),
        F.when(F.col("o_orderkey") % 7 == 0, 3).otherwise(1).alias("start_page"), F.lit(2).alias("end_page"), F.array(block).alias("blocks"),
        F.lit(None).cast("string").alias("_corrupt"),
    )
    lists = _bundle(spark, sf_dir)
    bundle = {"documents": docs, "sections": sections, "glossary": lists["glossary"], "mappings": lists["mappings"]}
    return records.bundle_findings(bundle).groupBy(F.col("check").alias("check_name")).agg(F.count("*").alias("n"))


@query("select sha256('v' || vec_id) as sha, len(embedding)::bigint as dims, embedding[1]::double as first_part, embedding[64]::double as last_part from embeddings where label % 2 = 0")
def vector_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as base64 lines in a folder per model; one model's read back."""
    path = new_path(spark, "vectors")
    rows = read_table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("m"), F.col("label") % 2).alias("model"), F.sha2(F.concat(F.lit("v"), "vec_id"), 256).alias("embedding_text_sha256"), F.col("embedding").alias("vector")
    )
    versions.write_vectors(rows, path)
    out = records.read_vectors(spark, path, "m0", 64)
    return out.select(
        F.col("embedding_text_sha256").alias("sha"), F.size("vector").cast("long").alias("dims"), F.col("vector")[0].cast("double").alias("first_part"), F.col("vector")[63].cast("double").alias("last_part")
    )


@query("select o_orderkey, o_orderstatus, o_totalprice from orders")
def sealed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended with the digest of their content; altered ones are left out on reading."""
    path = new_path(spark, "sealed")
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    versions.append_sealed(rows.filter("o_orderkey % 2 = 0"), path)
    versions.append_sealed(rows.filter("o_orderkey % 2 = 1"), path)
    forged = rows.withColumn("o_orderkey", -F.col("o_orderkey")).withColumn("sha256", F.sha2(F.col("o_orderstatus"), 256))
    forged.write.mode("append").json(path)
    return records.read_sealed(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double")


@query("select o_custkey, max(o_orderkey) as o_orderkey from orders group by o_custkey")
def log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append log's last record of each key."""
    path = new_path(spark, "log")
    read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").write.mode("append").json(path)
    return records.read_latest(spark, path, "o_custkey bigint, o_orderkey bigint", ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")



@query(
    _LINES
    + """select l_orderkey::varchar as query_id, l_orderkey || '/' || n as chunk_id, n as retrieval_rank, l_quantity as retrieval_score,
       sha256('part ' || l_partkey) as document_hash, sha256('order ' || l_orderkey) as query_hash from lines"""
)
def candidates_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked candidates, one line per query, read back one per row and checked."""
    path = new_path(spark, "candidates")
    hits = _lines(spark, sf_dir).select(
        F.col("l_orderkey").cast("string").alias("query_id"), F.concat(F.lit("order "), "l_orderkey").alias("query"), F.concat_ws("/", "l_orderkey", "n").alias("chunk_id"),
        F.col("l_quantity").alias("retrieval_score"), F.col("n").alias("retrieval_rank"), F.concat(F.lit("part "), "l_partkey").alias("document_text"),
        F.lit("s").alias("section_id"), F.col("n").alias("chunk_index"),
    )
    versions.write_candidates(hits, path, "gzip")
    each, found = records.read_candidates(spark, path)
    lacking = ("query_id", "query_text", "chunk_id", "document_text", "score")  # what the table itself lacks is no fault of the trip
    faults = found.filter(~F.col("check").isin(*lacking)).select("check", F.split_part("id", F.lit("/"), F.lit(1)).alias("query_id"))
    bad = saved(faults.distinct(), "bad")
    lost = [r["check"] for r in bad.filter(F.col("check").isin("record_count", "pair_count", "manifest")).collect()]
    if lost:
        raise ValueError(f"{path} isn't whole: {', '.join(lost)}")
    bad = F.broadcast(bad) if bad.count() <= relations.SMALL_ROWS else bad  # rows are shuffled only for many faults
    return each.join(bad, "query_id", "left_anti").select("query_id", "chunk_id", F.col("retrieval_rank").cast("long").alias("retrieval_rank"), "retrieval_score", "document_hash", "query_hash")


@query("select l_orderkey::varchar as query_id, l_returnflag as section_id, 'i' || l_returnflag as intent, 'c' || l_linenumber as chunk_id from lineitem")
def judgments_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments by intent, read back one row per accepted chunk."""
    path = new_path(spark, "judgments")
    chunk = F.sort_array(F.collect_list(F.concat(F.lit("c"), "l_linenumber"))).alias("accepted_chunk_ids")
    by_intent = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(chunk)
    item = F.struct(F.col("l_returnflag").alias("section_id"), F.concat(F.lit("i"), "l_returnflag").alias("intent"), "accepted_chunk_ids")
    by_intent.groupBy(F.col("l_orderkey").cast("string").alias("query_id")).agg(F.collect_list(item).alias("intents")).write.json(path)
    return records.read_judgments(spark, path)


@query("select o_orderkey::varchar as query_id, 'order ' || o_orderkey as query from orders where o_orderstatus <> 'F' order by o_orderkey::varchar limit 50")
def queries_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gold queries by id among those with a text."""
    path = new_path(spark, "queries")
    shown = F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.concat(F.lit("order "), "o_orderkey"))
    read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("query_id"), shown.alias("query")).write.json(path)
    return records.read_queries(spark, path, 50).select("query_id", "query")


# -- tables in text -------------------------------------------------------------------------------
def _order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_id``, ``text``: a caption and the pipe table of each order's lines."""
    row = F.concat_ws(" ", F.lit("|"), F.col("n"), F.lit("|"), F.col("l_returnflag"), F.lit("|"))
    listed = F.array_sort(F.collect_list(F.struct("n", row.alias("row"))))["row"]
    rows = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("order_id")).agg(listed.alias("rows"))
    return rows.select(
        "order_id", F.concat(F.lit("Intro.\n\nTable "), "order_id", F.lit(": lines\n\n| line | flag |\n|---|---|\n"), F.array_join("rows", "\n"), F.lit("\n\nEnd.")).alias("text")
    )


@query(
    _LINES
    + """, t as (select l_orderkey as page_id, '| line | flag |' || chr(10) || '|---|---|' || chr(10) ||
         string_agg('| ' || n || ' | ' || l_returnflag || ' |', chr(10) order by n) as markdown, count(*) as c from lines group by 1)
    select page_id, 5::bigint as first_line, c + 2 as n_lines, markdown, 'Table ' || page_id || ': lines' as caption,
      case when page_id < 100 then 'front_matter_table' else 'clinical_table' end as kind from t"""
)
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe tables of texts that list the lines of orders, with captions and class."""
    found = corpus.pipe_tables(_order_tables(spark, sf_dir), "order_id")
    words = {"front": ["authors"], "index": ["index"], "appendix": ["appendix"], "clinical": ["flag"]}
    kind = corpus.table_kind(F.col("order_id"), F.lit(None).cast("string"), F.col("caption"), F.col("markdown"), words, 100)
    return found.select(F.col("order_id").alias("page_id"), F.col("first_line").cast("long").alias("first_line"), "n_lines", "markdown", "caption", kind.alias("kind"))


@query("select l_orderkey as order_id, 3::bigint as line_no, l_orderkey::varchar as number from lineitem group by 1")
def table_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that caption a table."""
    lines = corpus.page_lines(_order_tables(spark, sf_dir), "order_id")
    return corpus.captions(lines, "order_id").select("order_id", F.col("line_no").cast("long").alias("line_no"), "number")


@query(
    _LINES
    + """select l_orderkey as order_id, count(*) * 2 + 2 as n_cells, count(*) + 1 as n_rows, count(*) filter (where n >= 10) as n_values,
       max(l_returnflag) as last_cell from lines group by 1"""
)
def table_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, rows and rows of values of each table."""
    md = F.regexp_extract("text", r"(?s)(\| line.*)\n\nEnd", 1)
    tables = _order_tables(spark, sf_dir).select("order_id", md.alias("md")).withColumn("rows", text.table_rows(F.col("md")))
    rows = F.col("rows")
    return tables.select(
        "order_id", F.size(text.table_cells(F.col("md"))).cast("long").alias("n_cells"), F.size(rows).cast("long").alias("n_rows"),
        F.size(F.filter(rows, lambda r: text.is_data_row(r))).cast("long").alias("n_values"),
        F.array_max(F.filter(F.transform(text.padded_rows(F.transform(F.slice(rows, 2, 1_000_000), text.row_cells)), lambda r: F.element_at(r, 2)), lambda c: c != "")).alias("last_cell"),
    )


@query(
    _LINES
    + """, f as (select l_orderkey as doc, n as page, 'T ' || l_returnflag as caption from lines),
    g as (select *, page - lag(page) over w as step, caption <> lag(caption) over w as other from f window w as (partition by doc order by page)),
    k as (select *, sum(case when step = 1 and not other then 0 else 1 end) over (partition by doc order by page) as grp from g)
    select doc, grp::bigint as group_no, count(*) as n_parts, min(page)::bigint as first_page, max(page)::bigint as last_page,
      count(*) - 1 as merges from k group by doc, grp"""
)
def merged_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table fragments, one a page, put together where captions agree."""
    cells = F.concat_ws(" ", F.lit("| 10 |"), F.col("n"), F.lit("|"))
    none = F.lit(None).cast("string")
    fragments = _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc"), F.col("n").alias("page"), F.lit(1).alias("place"), F.col("n").alias("table_id"), cells.alias("markdown"),
        F.concat(F.lit("T "), "l_returnflag").alias("caption"), F.lit("h").alias("context"), F.array().cast("array<string>").alias("flags"), none.alias("forced"),
    )
    out = corpus.merged_tables(fragments, "doc")
    return out.select(
        "doc", F.col("group").cast("long").alias("group_no"), "n_parts", F.col("first_page").cast("long").alias("first_page"), F.col("last_page").cast("long").alias("last_page"),
        F.size("reasons").cast("long").alias("merges"),
    )


# -- chunks ---------------------------------------------------------------------------------------
@query(
    """with t as (select l_orderkey, count(*) as n from lineitem group by 1), k(kind, per_part) as (values ('table', 2), ('list', 3))
    select 'o-' || l_orderkey || '-' || kind as section_key, p::bigint as ordinal, least(per_part, n - (p - 1) * per_part) as n_rows,
      case kind when 'table' then 24 else -1 end + least(per_part, n - (p - 1) * per_part) * 10 as chars
    from t, k, unnest(range(1, 20)) u(p) where (p - 1) * per_part < n"""
)
def chunked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of one table or one list each, cut into chunks that repeat the header or keep entries whole."""
    number = lambda n: F.lpad(n.cast("string"), 5, "0")
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("n"))
    row = F.transform("n", lambda n: F.concat(F.lit("| "), number(n), F.lit(" |")))
    entry = F.transform("n", lambda n: F.concat(F.lit("E"), F.lpad(number(n), 8, "0")))
    rows = lines.select("l_orderkey", F.array_join(row, "\n").alias("rows"), F.array_join(entry, "\n").alias("entries"))
    kinds = F.explode(F.create_map(F.lit("table"), F.concat(F.lit("| line head |\n|--------|\n"), "rows"), F.lit("list"), F.col("entries"))).alias("kind", "markdown")
    block = F.struct("kind", "markdown", F.lit(1).alias("start_page"), F.lit(1).alias("end_page"), F.lit(None).cast("string").alias("table_key"))
    sections = rows.select("l_orderkey", kinds).select(
        F.concat_ws("-", F.lit("o"), "l_orderkey", "kind").alias("section_key"), F.lit("t").alias("title"), F.lit("h").alias("heading"), F.array(F.lit("h")).alias("context_path"),
        F.array().cast("array<string>").alias("aliases"), F.lit(1).alias("start_page"), F.lit(1).alias("end_page"), "kind", F.array(block).alias("blocks"),
    )
    out = chunking.chunk_sections(sections, None, F.when(F.col("kind") == "table", 46).otherwise(29))
    held = F.regexp_count("chunk_text", F.lit(r"[0-9]{5}"))
    return out.select("section_key", F.col("ordinal").cast("long").alias("ordinal"), held.cast("long").alias("n_rows"), F.length("chunk_text").cast("long").alias("chars"))


@query(
    """with v as (select p_partkey, sha256(p_name || chr(31) || p_brand) as d from part),
    u as (select p_partkey, sha1(unhex('34eae8989b715fb992cdb2d9fdeec512') || encode('chunk' || chr(31) || d)) as h from v)
    select p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
      substr('89ab', (('0x' || substr(h, 17, 1))::int % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from u"""
)
def version_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that follow from content."""
    return read_table(spark, sf_dir, "part").select("p_partkey", arrays.version_id("chunk", F.col("p_name"), F.col("p_brand")).alias("id"))


@query(
    """with s as (select o_orderkey, o_custkey, case when o_orderkey % 3 = 0 then 'brand_page' else 'monograph' end as t,
         case when o_orderkey % 2 = 0 then 'leaflet:' else 'doc:' end || o_orderkey as id from orders)
    select id as section_id from s where t = 'brand_page' and id like 'leaflet:%'"""
)
def leaflet_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that leaflet questions are asked of."""
    kind = F.when(F.col("o_orderkey") % 3 == 0, "brand_page").otherwise("monograph")
    name = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "leaflet:").otherwise("doc:"), F.col("o_orderkey"))
    return read_table(spark, sf_dir, "orders").select(name.alias("section_id")).where(goldset.is_leaflet_section(kind, name))


@query(
    """with c as (select l_orderkey || '/' || l_linenumber as chunk_id, case when l_linenumber > 2 then l_partkey end as k, l_orderkey as section_id,
        case l_returnflag when 'A' then 'chunk_window' else 'full_section' end as s, case l_linestatus when 'O' then 'table' else 'paragraph' end as t, case when l_quantity < 5 then 'appendix_list' end as r from lineitem),
    j as (select chunk_id, section_id, coalesce(k, 0) as k from c join orders on o_orderkey = section_id and o_orderstatus <> 'P'
        where s in ('chunk_window', 'search_only') or t = 'table' or r in ('table', 'index_entry', 'appendix_list'))
    select chunk_id, section_id, row_number() over (order by k, chunk_id) as position from j"""
)
def chunk_risk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that retrieval may miss, with their sections, in order."""
    chunks = read_table(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("chunk_id"), F.when(F.col("l_linenumber") > 2, F.col("l_partkey")).alias("chunk_key"), F.col("l_orderkey").alias("section_id"),
        F.when(F.col("l_returnflag") == "A", "chunk_window").otherwise("full_section").alias("hydrate_strategy"),
        F.when(F.col("l_linestatus") == "O", "table").otherwise("paragraph").alias("chunk_content_type"), F.when(F.col("l_quantity") < 5, "appendix_list").alias("chunk_role"),
    )
    sections = read_table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("section_id"))
    return goldset.chunk_risk_candidates(chunks, sections).select("chunk_id", "section_id", "position")


# -- labels and arrays ----------------------------------------------------------------------------
@query(
    """with t as (select doc_id, substr(text, 1, 80) as t, text from documents)
    select doc_id, trim(regexp_replace(lower(translate(strip_accents(t), 'đĐÐ', 'dDD')), '[^a-z0-9]+', ' ', 'g'), ' ') as matched,
      trim(regexp_replace(lower(translate(strip_accents(t), 'đĐÐ', 'dDD')), '[^a-z0-9]+', '-', 'g'), '-') as slug,
      trim(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '_') as plain_slug,
      round(coalesce(length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 0), 0), 6) as upper_share,
      len(regexp_extract_all(text, '(?m)^#{1,6}[ \\t]+\\S')) as n_headings from t"""
)
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match keys, slugs, capitals and headings of documents."""
    t, head = F.col("text"), F.substring("text", 1, 80)
    return spread(read_table(spark, sf_dir, "documents")).select(
        "doc_id", text.match_key(head).alias("matched"), text.slug(head).alias("slug"), text.ascii_slug(head, "_").alias("plain_slug"),
        F.round(text.upper_share(t), 6).alias("upper_share"), F.size(text.headings(t)).cast("long").alias("n_headings"),
    )


@query(
    """with p as (select p_partkey, p_name as n, p_size as s, upper(p_name) as u from part)
    select p_partkey, 'page ' || s || '-' || (s + 1) as pages, s || '-' || (s + 1) as bare, n || ' for use' as first_name, n as second_name,
      length(u) between 3 and 90 as titled, 'part.' || lower(n) || '.h' as section_id, case when s > 9 then 2 else 1 end as depth,
      regexp_replace(n, '^(\\w+) ', '\\1 MG ') as repaired, s || 'x ' || s || ' mg' as spaced from p"""
)
def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page labels, names in titles, title lines, section ids, heading depths and repairs."""
    n, s = F.col("p_name"), F.col("p_size")
    names = labels.names_in_title(F.concat(n, F.lit(" (x) for use")), ["for"])
    from vellum.operators.relations import run_label

    return read_table(spark, sf_dir, "part").select(
        "p_partkey", labels.page_label(s, s + 1).alias("pages"), run_label(s, s + 1).alias("bare"), names[0].alias("first_name"), names[1].alias("second_name"),
        labels.is_title(F.upper(n), ["none"]).alias("titled"), labels.section_id(F.lit("Part"), n, F.lit("H"), F.lit(None).cast("array<string>")).alias("section_id"),
        text.numbered_depth(F.when(s > 9, "1.2 name").otherwise("1. name")).alias("depth"), labels.replaced_all(n, [(r"^(\w+) ", "$1 mg "), (" mg ", " MG ")]).alias("repaired"),
        text.spaced_numbers(F.concat(s, F.lit("x "), s, F.lit("mg"))).alias("spaced"),
    )


@query(
    """select p_partkey, case when lower(p_brand) = lower(p_type) then p_brand else p_brand || '/' || p_type end as folded, p_brand || '/' || p_type as legacy,
       replace(p_name, ' ', '/') as parts, p_size::bigint as total, p_size || '-' || (p_size + 1) as pairs, p_brand || '#E' as respelled, true as same_parts from part"""
)
def part_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists without repeats, with a legacy entry, from joined text; sums, pairs and spellings."""
    brand, kind, size = F.col("p_brand"), F.col("p_type"), F.col("p_size")
    folded = arrays.distinct_folded(F.array(F.concat(F.lit(" "), brand, F.lit("  ")), F.lower(brand), F.lit(""), kind))
    parts = arrays.text_or_list(F.lit(None).cast("array<string>"), F.concat(F.replace("p_name", F.lit(" "), F.lit("|")), F.lit("|")))
    pairs = arrays.adjacent_pairs(F.array(size, size + 1, size + 2))
    counts = F.create_map(F.lit("a"), size.cast("long"), F.lit("b"), F.lit(None).cast("long"))
    words = labels.respelled(F.array(F.concat(brand, F.lit("xe"))), [("x", "#E")])
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(folded, "/").alias("folded"), F.array_join(arrays.with_legacy(F.array(kind), brand), "/").alias("legacy"), F.array_join(parts, "/").alias("parts"),
        arrays.sum_values(counts).alias("total"), F.concat_ws("-", pairs[0]["first"], pairs[0]["second"]).alias("pairs"), words[0].alias("respelled"),
        labels.same_parts(F.array(F.array(brand, F.lit("salt")), F.array(kind)), F.array(F.array(kind), F.array(brand)), ["salt"]).alias("same_parts"),
    )


@query("""select event_id, '{"k":' || json_extract_string(props, '$.k') || '}' as body, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') as seal from events""")
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON and the seal of records."""
    return read_table(spark, sf_dir, "events").select(
        "event_id", arrays.canonical_json("props").alias("body"), arrays.sealed(F.struct("event_type", "event_id")).alias("seal")
    )


# -- evidence and citations -----------------------------------------------------------------------
@query(
    _LINES
    + """select l_orderkey as message_id, count(*) as n, string_agg(p_brand, ',' order by n) as titles
       from lines join part on l_partkey = p_partkey group by 1"""
)
def citation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citations of each message with their documents' titles."""
    cites = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("message_id"), F.col("n").alias("place"), F.col("l_partkey").alias("chunk_id"))
    part = read_table(spark, sf_dir, "part")
    chunks = part.select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("document_id"))
    docs = part.select(F.col("p_brand").alias("document_id"), F.col("p_brand").alias("title")).distinct()
    out = history.citation_lists(cites, chunks, docs)
    return out.select("message_id", F.size("citations").cast("long").alias("n"), F.array_join("citations.title", ",").alias("titles"))


@query(_LINES + "select l_orderkey as citation_id, string_agg(p_name, chr(10) || chr(10) order by n) as block from lines join part on l_partkey = p_partkey group by 1")
def citation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each citation's chunks in order."""
    listed = F.array_sort(F.collect_list(F.struct("n", "l_partkey")))["l_partkey"]
    cites = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("citation_id")).agg(listed.alias("chunk_ids"))
    return history.block_texts(cites, read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("text")))


@query(_LINES + "select l_orderkey as request, n as place, p_name from lines join part on p_partkey = l_partkey where l_quantity > 25")
def used_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence behind the numbers that answers use."""
    lines = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("request"), F.col("n").alias("index"), "l_partkey", "l_quantity")
    named = lines.join(read_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    used = lines.filter("l_quantity > 25").select("request", F.col("index").alias("place"), "index")
    unknown = used.withColumn("index", F.col("index") + 1000)
    out = snapshot.citations(named.select("request", "index", "p_name"), used.unionByName(unknown))
    return out.select("request", F.col("place").cast("long").alias("place"), "p_name")


@query(
    """with g as (select l_orderkey as query_id, count(*) filter (where p_size is null or p_size < 5) as lacking from lineitem left join part on l_partkey = p_partkey group by 1)
    select query_id from g where lacking = 0"""
)
def usable_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows all of whose sections exist."""
    gold = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.collect_set("l_partkey").alias("gold_sections"))
    sections = read_table(spark, sf_dir, "part").filter("p_size >= 5").select(F.col("p_partkey").alias("section_id"))
    return snapshot.usable(gold, sections).select("query_id")


@query("select doc_id, regexp_matches(text, '[\\p{L}\\p{N}]') as held, regexp_matches(text, '[\\p{L}\\p{N}]') and length(text) > 16000 as windowed from documents")
def section_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a section has a body, and how much of it a hit brings."""
    t = F.col("text")
    plan = search.strategy_of(F.when(snapshot.has_body(F.concat(F.lit("# Head\n"), t)), "full").otherwise("index_only"), F.length(t))
    return read_table(spark, sf_dir, "documents").select("doc_id", snapshot.has_body(F.concat(F.lit("# Head\n"), t)).alias("held"), (plan == "chunk_window").alias("windowed"))


@query(
    """with w as (select distinct unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as w from documents), t(term) as (values ('The'), ('nowhere-land'), ('and'), ('Xyzzyq'))
    select term, lower(term) in (select w from w) as found from t"""
)
def corpus_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which terms the corpus holds."""
    texts = spread(read_table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "text")
    return snapshot.mentions(texts, spark.createDataFrame([("The",), ("nowhere-land",), ("and",), ("Xyzzyq",)], "term string"))


# -- releases -------------------------------------------------------------------------------------
@query(_RELEASES + "select release_id, case when status = 'staged' and release_id % 2 = 0 then 'ready' else status end as status from releases")
def ready_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged releases whose points are all indexed become ready."""
    r, _ = _releases(spark, sf_dir)
    counts = r.select("release_id", F.lit(5).alias("expected"), F.when(F.col("release_id") % 2 == 0, 5).otherwise(4).alias("indexed"))
    return releases.marked_ready(r, counts).select("release_id", "status")


@query(
    _RELEASES
    + """, o as (select collection_id, release_id, number from releases where status <> 'retired' and release_id not in (select release_id from current)),
    g as (select release_id from o qualify row_number() over (partition by collection_id order by number desc) > 2)
    select release_id, case when release_id in (select release_id from g) then 'retired' else status end as status from releases"""
)
def retired_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases after those beyond the newest are retired."""
    r, current = _releases(spark, sf_dir)
    return releases.retired(r, releases.to_retire(r, current, 2)).select("release_id", "status")


@query(
    _RELEASES
    + """, live as (select distinct l_partkey as id, l_orderkey as release_id from lineitem join releases on l_orderkey = release_id where status <> 'retired')
    select release_id, count(*) as n from live group by 1"""
)
def release_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points per live release after their lists are renewed."""
    r, _ = _releases(spark, sf_dir)
    bridge = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("chunk_id"), F.col("l_orderkey").alias("release_id"))
    points = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(None).cast("array<bigint>").alias("release_ids"))
    return releases.release_counts(releases.with_memberships(points, releases.memberships(bridge, r)))


@query(
    _RELEASES
    + """select distinct l_partkey as id from lineitem join releases on l_orderkey = release_id where status <> 'retired'"""
)
def reindexed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that a rebuild of the index takes."""
    r, _ = _releases(spark, sf_dir)
    bridge = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("chunk_id"), F.col("l_orderkey").alias("release_id"))
    points = saved(releases.memberships(bridge, r).withColumnRenamed("chunk_id", "id"), "points")
    return releases.reindexed(points, r, "m").select("id")


# -- building a corpus ----------------------------------------------------------------------------
@query("select r_regionkey, r_name from region union all select r_regionkey + 100, r_name from region union all select r_regionkey + 200, lower(r_name) from region")
def published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published twice: the first version by name, the current one, and what a third would be."""
    root = new_path(spark, "regions")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    first = versions.publish_version(region, root)
    versions.publish_version(region.withColumn("r_name", F.lower("r_name")), root)
    old = versions.read_version(spark, root, first)
    again = old.withColumn("r_regionkey", F.col("r_regionkey") + 100)
    now = versions.read_version(spark, root).withColumn("r_regionkey", F.col("r_regionkey") + 200)
    return old.unionByName(again).unionByName(now)


@query(
    _LINES
    + """select l_orderkey, n as line_id, row_number() over (partition by l_orderkey order by case when l_quantity + 10 < 30 then 0 else 1 end, round(l_extendedprice, 1), round(l_quantity, 1), n) as place from lines"""
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two-column pages in reading order."""
    lines = _lines(spark, sf_dir).select(
        "l_orderkey", F.col("n").alias("line_id"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 20).alias("x1"), F.col("l_extendedprice").alias("y0"), F.lit(60.0).alias("width")
    )
    return corpus.reading_order(lines, "l_orderkey", "width").select("l_orderkey", "line_id", "place")


@query("select page_id, 1::bigint as n, url from pages where url is not null and not regexp_matches(url, '[<\\s]')")
def site_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of site maps, each once."""
    loc = F.concat(F.lit("<url><loc> "), "url", F.lit(" </loc></url>"))
    pages = read_table(spark, sf_dir, "pages").filter(~F.col("url").rlike(r"[<\s]"))
    found = corpus.locations(F.concat(F.lit("<urlset>"), loc, loc, F.lit("</urlset>")))
    return pages.select("page_id", F.size(found).cast("long").alias("n"), found[0].alias("url"))


@query(
    """select page_id, nullif(trim(regexp_replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '|', '|'), '\\s+', ' ', 'g')), '') as title from pages
       where contains(html, '<h1>') and not regexp_matches(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<')"""
)
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages by their first heading."""
    h1 = F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)
    pages = read_table(spark, sf_dir, "pages").filter(F.contains("html", F.lit("<h1>")) & ~h1.rlike("<"))
    return pages.select("page_id", corpus.page_title(F.col("html")).alias("title"))


@query(
    """with s as (select doc_id as section, text, lang from documents),
    m as (select w.section, w.text || coalesce(chr(10) || chr(10) || p.text, '') as text from s w left join s p on p.section = w.section + 1 where w.section % 2 = 0
          union all select section, text from s x where section % 2 = 1 and section - 1 not in (select section from s))
    select section, md5(case when section % 5 = 0 then 'fixed' else text end) as digest from m"""
)
def merged_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their listed parts appended, then with overrides."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section"), "text")
    ids = docs.select("section")
    pairs = ids.filter("section % 2 = 0").select(F.col("section").alias("whole"), (F.col("section") + 1).alias("part"))
    pairs = pairs.join(ids.select(F.col("section").alias("part")), "part", "left_semi")
    merged = corpus.merged_pairs(docs, pairs)
    fixed = ids.filter("section % 5 = 0").withColumn("text", F.lit("fixed"))
    return corpus.with_overrides(merged, fixed, "section", ["text"]).select("section", F.md5("text").alias("digest"))


@query(
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents)
    select doc_id, count(*) as n, min(line_no) as first_line from l where not (line_no between 2 and 3 and doc_id % 2 = 0) group by doc_id"""
)
def lines_outside_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents outside the ranges that are listed by hand."""
    docs = spread(read_table(spark, sf_dir, "documents"))
    ranges = docs.filter("doc_id % 2 = 0").select("doc_id", F.lit(2).alias("first"), F.lit(3).alias("last"))
    kept = corpus.without_line_ranges(corpus.lines_of(docs, "doc_id"), ranges, "doc_id")
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("line_no").cast("long").alias("first_line"))


@query(
    _LINES
    + """select l_orderkey as section_id, string_agg(p_name, chr(10) || chr(10) order by n) as text, count(*) as n_blocks, array_to_string(list_sort(list(distinct l_returnflag)), ',') as flags
    from lines join part on p_partkey = l_partkey group by 1"""
)
def rejoined_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections again from their blocks, with their flags."""
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("text"))
    blocks = _lines(spark, sf_dir).join(part, "l_partkey").select(F.col("l_orderkey").alias("section_id"), F.col("n").alias("place"), F.col("n").alias("block_id"), "text", F.array("l_returnflag").alias("flags"))
    out = corpus.rejoined(blocks, "section_id", "place")
    return out.select("section_id", "text", "n_blocks", F.array_join("flags", ",").alias("flags"))


@query(
    _LINES
    + """, o as (select l_orderkey, 'Order ' || l_orderkey || chr(10) || string_agg(case when n <= 2 then n || ' ' || l_returnflag else 'free text ' || n end, chr(10) order by n) as text, count(*) as c from lines group by 1)
    select l_orderkey as section_id, least(c, 2) as n_removed from o"""
)
def repeated_table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sections that a table of theirs repeats."""
    lines = _lines(spark, sf_dir)
    shown = F.when(F.col("n") <= 2, F.concat_ws(" ", "n", "l_returnflag")).otherwise(F.concat(F.lit("free text "), "n"))
    row = F.when(F.col("n") <= 2, F.concat(F.lit("| "), "n", F.lit(" | "), "l_returnflag", F.lit(" |")))
    listed = lambda c, name: F.array_join(F.array_sort(F.collect_list(F.struct("n", c.alias("x"))))["x"], "\n").alias(name)
    both = lines.groupBy(F.col("l_orderkey").alias("section_id")).agg(listed(shown, "lines"), listed(row, "rows"))
    sections = both.select("section_id", F.concat(F.lit("Order "), "section_id", F.lit("\n"), "lines").alias("text"))
    tables = both.select("section_id", F.concat(F.lit("| line | flag |\n|---|---|\n"), "rows").alias("markdown"))
    return corpus.without_repeated_lines(sections, tables, "section_id").select("section_id", F.col("n_removed").cast("long").alias("n_removed"))


@query(
    """with s as (select doc_id as id, source as document_key, lang as title, text, n_chars from documents where trim(text) <> '')
    select id, document_key, row_number() over (partition by document_key order by n_chars, id) as ordinal, 1::bigint as n_blocks, md5(text) as digest from s"""
)
def exported_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of built documents as those of a bundle: blocks of their texts, numbered."""
    built = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("document_key"), F.col("lang").alias("title"), F.col("source").alias("heading"),
        F.array().cast("array<string>").alias("context_path"), snapshot.text_blocks(F.col("text")).alias("blocks"), F.col("n_chars").alias("place"),
    )
    _, sections = snapshot.exported(built, "place")
    return sections.select("id", "document_key", F.col("ordinal").cast("long").alias("ordinal"), F.size("blocks").cast("long").alias("n_blocks"), F.md5(F.col("blocks")[0]["markdown"]).alias("digest"))


@query(
    """select 'documents' as table_name, count(*) as n from documents where trim(text) <> '' union all select 'sections', count(*) from documents where trim(text) <> ''
       union all select 'revisions', count(*) from documents where trim(text) <> ''"""
)
def snapshot_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a snapshot's tables but the chunks."""
    snap = snapshot.snapshot(_bundle(spark, sf_dir), "c")
    parts = [snap[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name in ("documents", "sections", "revisions")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    _LINES
    + """, h as (select l_orderkey, n, case l_returnflag when 'A' then 'dosage' when 'R' then 'warnings' end as i from lines),
    c as (select l_orderkey, n, last_value(i ignore nulls) over (partition by l_orderkey order by n rows between unbounded preceding and current row) as i from h)
    select l_orderkey as section_id, n as chunk_no, coalesce(i, '') as intents from c"""
)
def chunk_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intents that are in force in each chunk."""
    shown = F.when(F.col("l_returnflag") == "A", "## Dosage:").when(F.col("l_returnflag") == "R", "# Warnings").otherwise("plain words")
    lines = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("section_id"), F.col("n").cast("long").alias("chunk_no"), F.lit(1).alias("line_no"), shown.alias("line"))
    out = goldset.carried_intents(lines, {"dosage": "dosage", "warnings": "warnings"})
    return out.select("section_id", "chunk_no", F.array_join("intents", ",").alias("intents"))


@query(
    """with q as (select p_partkey as id, p_name as query, row_number() over (partition by p_name order by p_partkey) as k from part)
    select id, case when k > 1 then query || ' (' || brand || ')' else query end as first_try from (select q.*, p_brand as brand from q join part on p_partkey = id)"""
)
def suffixed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated questions get their label; those that repeat even so get more, which is cut off here."""
    rows = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("query"), F.col("p_brand").alias("label"))
    out = goldset.suffixed_questions(rows, "label", "id")
    return out.select("id", F.regexp_extract("query", r"^([^(]*?(?: \(Brand#[0-9]+\))?)(?: \([0-9]+\))?(?: #[0-9]+)?$", 1).alias("first_try"))


@query("select o_orderkey, array_to_string(list_sort(list_filter([case when o_totalprice > 200000 then 'dear' end, case when o_orderstatus = 'O' then 'open' end, 'all'], lambda x: x is not null)), ',') as tags from orders")
def row_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the conditions that hold."""
    tags = goldset.eval_tags({"dear": F.col("o_totalprice") > 200_000, "open": F.col("o_orderstatus") == "O", "all": F.lit(True)})
    return read_table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(tags, ",").alias("tags"))


@query("select p_brand as term, count(distinct p_type) as n, array_to_string(list_sort(list(distinct p_type)), ',') as section_ids from part group by 1")
def term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of each term."""
    rows = read_table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("section_id")).agg(F.collect_set("p_brand").alias("terms"))
    out = goldset.term_sections(rows, "terms")
    return out.select("term", F.col("n").cast("long").alias("n"), F.array_join("section_ids", ",").alias("section_ids"))


@query("""select conv_id, turn, regexp_matches(text, '(?i)étre') as known, md5(regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ', '_', 'g')) as folded,
    len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}]+|[\\p{N}]+'))) as grams from conversations""")
def message_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that contain a word, their folded form and their one-word grams."""
    t = F.col("text")
    return spread(read_table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", (text.tokens_inside(F.lower(t), F.array(F.lit("étre"))) > 0).alias("known"), F.md5(F.replace(text.query_key(t), F.lit(" "), F.lit("_"))).alias("folded"),
        F.size(text.word_grams(t, 1)).cast("long").alias("grams"),
    )


@query(
    """select p_partkey, case when p_size > 20 then 'use' else 'dose' end as label, 3::bigint as parts, p_name || chr(10) || 'end' as plain, p_name || ' and more' as preview, true as repaired from part"""
)
def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of heading lines, inline headings, layout tables, previews and joined syllables."""
    n = F.col("p_name")
    line = F.when(F.col("p_size") > 20, F.concat(F.lit("**How To Use**: "), n)).otherwise("## Dosage")
    label = labels.canonical_label(line, {"use": ["how to use"], "dose": ["dosage", "dose"]})
    inline = labels.inline_headings(F.concat(F.lit("x **Dose** "), n, F.lit(" **Use** y")), ["dose", "use"])
    layout = labels.flattened_layout(F.concat(F.lit("|"), n, F.lit("|\n|---|\n|end|")))
    joined = lattice.joined_syllables(["station"])(F.concat(F.lit("sta ti on "), n))
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", label.alias("label"), F.size(inline).cast("long").alias("parts"), F.regexp_replace(layout, r"\s*\n\s*", "\n").alias("plain"),
        text.without_marks(F.concat(F.lit("## **"), n, F.lit("** and `more`"))).alias("preview"), (joined == F.concat(F.lit("station "), n)).alias("repaired"),
    )


@query(
    """with g as (select n_regionkey as region, count(*) as n, avg(n_nationkey * 0.25) as m from nation group by 1),
    t(line_no, line) as (values (1, '| dimension | value | queries | mrr |'), (2, '| --- | --- | --- | --- |'))
    select line_no::bigint as line_no, line from t
    union all select 2 + row_number() over (order by region::varchar), '| region | ' || region || ' | ' || n || ' | ' || printf('%.4f', m) || ' |' from g"""
)
def metrics_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of published metrics, line by line."""
    path = new_path(spark, "metrics")
    scored = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_regionkey").cast("string").alias("value"), (F.col("n_nationkey") * 0.25).cast("double").alias("mrr"))
    breakdown = scored.groupBy(F.lit("region").alias("dimension"), "value").agg(F.count("*").alias("queries"), F.avg("mrr").alias("mrr"))
    versions.publish_metrics(scored, breakdown, ["mrr"], path)
    lines = records.numbered_lines(spark, f"{path}/report.md")
    return lines.select(F.col("line_no").cast("long").alias("line_no"), F.col("value").alias("line"))


_DOSE = r"[0-9]+(?:[.,][0-9]+)?\s*(?:mg|ml|g)\b"


@query("select p_partkey, case when p_size % 5 = 0 then null when p_size % 2 = 0 then p_name || '/' || lower(p_type) else p_name end as names from part")
def compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the composition blocks of leaflets list."""
    size, name = F.col("p_size"), F.col("p_name")
    listed = F.when(size % 5 == 0, "40 mg").when(size % 2 == 0, F.concat(F.lit("Contains: "), name, F.lit(" (x 3 mg) 40 mg and "), "p_type", F.lit(" 5,5 ml"))).otherwise(
        F.concat(F.lit("| "), name, F.lit(" | 40 mg | b |\nFiller 3 mg"))
    )
    docs = spread(read_table(spark, sf_dir, "part")).select("p_partkey", F.concat(F.lit("Other 9 mg\n## Composition:\n"), listed, F.lit("\n\nUses\nzzz 3 mg\nComposition\nyyy 4 mg")).alias("text"))
    names = lambda line: labels.dosed_names(line, _DOSE, r";|\. ", r"(?i)^\s*contains:", ("and", "with"), ("filler",))
    out = corpus.compositions(docs, "p_partkey", {"made_of": ["composition"], "use": ["uses"]}, "made_of", names)
    return out.select("p_partkey", F.when(F.col("names").isNotNull(), F.array_join("names", "/")).alias("names"))


@query(
    """select page_id, len(regexp_extract_all(html, '<h1[ >]')) as titles, len(regexp_extract_all(html, '<li[ >]')) as items, len(regexp_extract_all(html, '<h2[ >]')) as headings,
       false as scripts from pages"""
)
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, headings and list items of pages as their markdown has them; scripts are gone."""
    md = spread(read_table(spark, sf_dir, "pages")).select("page_id", corpus.html_markdown(F.col("html")).alias("md"))
    count = lambda pattern: F.regexp_count("md", F.lit(pattern)).cast("long")
    return md.select(
        "page_id", count(r"(?m)^# \S").alias("titles"), count(r"(?m)^- ?").alias("items"), count(r"(?m)^## \S").alias("headings"), F.contains("md", F.lit("track(")).alias("scripts")
    )


@query(
    """select 'label ' || (label % 3) as model, sha256(vec_id::varchar) as digest, len(embedding)::int as dims, round(embedding[1]::double, 5) as first,
    round(list_sum(embedding::double[]), 4) as total from embeddings where label is not null"""
)
def vector_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as a bundle with block digests and read by ranges through a data source."""
    path = new_path(spark, "vectors")
    vectors = read_table(spark, sf_dir, "embeddings").filter("label is not null").select(
        F.concat(F.lit("label "), F.col("label") % 3).alias("model"), F.sha2(F.col("vec_id").cast("string"), 256).alias("embedding_text_sha256"), F.col("embedding").alias("vector")
    )
    versions.write_vectors(vectors, path)
    ranges.register(spark)
    ranges.write_digests(spark, path)
    found = spark.read.format("vectors").load(path)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return found.select(
        "model", F.col("embedding_text_sha256").alias("digest"), "dims", F.round(F.col("vector")[0].cast("double"), 5).alias("first"), F.round(total, 4).alias("total")
    )
