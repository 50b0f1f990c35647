"""Typed readers of JSON lines, JSON lists, HTML folders and whole bundles.  Nothing is inferred."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.arrays import all_finite, from_base64, sealed
from vellum.operators.relations import all_findings, breaks, breaks_any, finding, latest, not_found, not_unique
from vellum.storage import text_in_folder

BLOCK = "struct<kind:string,markdown:string,start_page:int,end_page:int,table_key:string>"
SCHEMAS = {
    "documents": "key string, kind string, title string, source struct<title:string,url:string>, attributes map<string,string>",
    "sections": "key string, document_key string, heading string, context_path array<string>, ordinal int, "
    f"start_page int, end_page int, retrieval string, blocks array<{BLOCK}>",
    "glossary": "term string, case_sensitive boolean, expansions array<string>, aliases array<string>, category string",
    "mappings": "key string, aliases array<string>, visual_sign string, product_names array<string>, section_keys array<string>",
}
CANDIDATES = (
    "query_id string, query string, query_hash string, candidates array<struct<chunk_id:string,"
    "retrieval_score:double,retrieval_rank:int,document_text:string,document_hash:string,section_id:string,chunk_index:int>>"
)
#: In a folder of candidates: how many lines and candidates were written.  Spark's readers leave such names out.
MANIFEST = "_manifest.json"


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of JSON lines, blank lines left out.

    Without ``strict`` a line that isn't such an object comes with null columns and its text in
    ``_corrupt``; with it the read fails.
    """
    mode = "FAILFAST" if strict else "PERMISSIVE"
    full = schema if strict else f"{schema}, _corrupt string"
    return spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").json(path, mode=mode)


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a file that is one JSON array."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line_no``, ``value``: lines with their number in their file.

    Files are read whole so that numbers are certain: for record files of bounded size.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("_t"))
    each = files.select("file", F.posexplode(F.split("_t", "\r?\n")).alias("_n", "value"))
    return each.select("file", (F.col("_n") + 1).alias("line_no"), "value").filter(F.trim("value") != "")


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Findings for lines that aren't objects of the schema, by file and line number."""
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    lines = numbered_lines(spark, path).withColumn("r", parsed)
    bad = lines.filter(F.col("r").isNull() | F.col("r._corrupt").isNotNull())
    return finding(bad.withColumn("at", F.concat_ws(":", "file", "line_no")), "json", "at", F.lit("not such an object"))


def read_sealed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records whose stored ``sha256`` is that of their content; torn and altered lines are left out."""
    rows = read_json_lines(spark, path, f"{schema}, sha256 string").filter("_corrupt is null")
    names = [c for c in rows.columns if c not in ("sha256", "_corrupt")]
    return rows.filter(sealed(F.struct(*names)) == F.col("sha256")).select(*names)


def read_latest(spark: SparkSession, path: str, schema: str, key: list[str], order: str) -> DataFrame:
    """An append log's last record of each key."""
    return latest(read_json_lines(spark, path, schema, strict=True), key, order)


def read_vectors(spark: SparkSession, path: str, model: str, dims: int) -> DataFrame:
    """``embedding_text_sha256``, ``vector`` of one model: only its partition is read.

    Vectors of another width, or with parts that aren't finite, are left out.
    """
    schema = "embedding_text_sha256 string, dims int, vector string, model string"
    rows = spark.read.schema(schema).json(path).filter((F.col("model") == model) & (F.col("dims") == dims))
    out = rows.select("embedding_text_sha256", from_base64(F.col("vector")).alias("vector"))
    return out.filter((F.size("vector") == dims) & all_finite(F.col("vector")))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``bytes``, ``sha256`` of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``html`` of an HTML tree."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def _candidate_rows(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "query", "query_hash", F.explode("candidates").alias("c")).select("query_id", "query", "query_hash", "c.*")


def _count_findings(rows: DataFrame, manifest: str | None) -> DataFrame:
    """Findings for chunks and queries that come again, and for lines and candidates that the manifest counts otherwise.

    Every line and every candidate is counted, in one scan: a line counts at its first candidate, or as one without any.
    The manifest's own numbers come as one more row, so that there is a sum even where all lines are lost.
    """
    want = json.loads(manifest) if manifest else {}
    each = rows.select("query_id", F.posexplode_outer("candidates.chunk_id").alias("_at", "chunk_id"))
    none = F.lit(None).cast("string")
    counted = each.select("query_id", "chunk_id", F.when(F.coalesce("_at", F.lit(0)) == 0, 1).alias("lines"), F.when(F.col("_at").isNotNull(), 1).alias("pairs"))
    listed = rows.sparkSession.range(1).select(none.alias("query_id"), none.alias("chunk_id"), *[F.lit(want.get(k)).cast("long").alias(k) for k in ("record_count", "pair_count")])
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("lines", "pairs")] + [F.sum(c).alias(c) for c in ("record_count", "pair_count")]
    both = counted.unionByName(listed, allowMissingColumns=True)
    n = both.groupingSets([["query_id", "chunk_id"], ["query_id"], []], "query_id", "chunk_id").agg(F.grouping_id().alias("_set"), *sums)
    of_pair, of_query, of_all = (F.col("_set") == k for k in (0, 1, 3))
    pair, other = F.concat_ws("/", "query_id", "chunk_id"), "%d, not %d as in the manifest"
    rules = [
        ("chunk", of_pair & (F.col("pairs") > 1) & (pair != ""), pair, F.format_string("%d rows", "pairs")),
        ("query", of_query & (F.col("lines") > 1) & (F.trim("query_id") != ""), F.col("query_id"), F.format_string("%d rows", "lines")),
        ("record_count", of_all & (F.col("lines") != F.col("record_count")), none, F.format_string(other, "lines", "record_count")),
        ("pair_count", of_all & (F.col("pairs") != F.col("pair_count")), none, F.format_string(other, "pairs", "pair_count")),
    ]
    if manifest == "":
        rules.append(("manifest", of_all, none, F.lit("none in the folder")))
    return breaks_any(n, rules)


def read_candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(candidates one per row, findings): every line and every candidate is checked.

    A line has a query id of its own, a query that isn't blank, its hash and a list of candidates.  A candidate has a chunk id
    that comes once for its query, a text and its hash, a finite score and a rank from 1.  A folder has a manifest, which tells
    how many lines and candidates there are; a file that is read by itself needs none.
    """
    rows = read_json_lines(spark, path, CANDIDATES, strict=True)
    none = rows.withColumn("_none", F.col("candidates").isNull())
    lines = none.select("query_id", "query", "query_hash", "_none", F.posexplode_outer("candidates").alias("_at", "c")).select("*", "c.*")
    pair, first, there = F.concat_ws("/", "query_id", "chunk_id"), F.coalesce("_at", F.lit(0)) == 0, F.col("_at").isNotNull()

    def empty(c: str) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    def forged(text: Column, digest: str) -> Column:
        return ~F.sha2(text, 256).eqNullSafe(F.col(digest))

    finite = ~F.isnan("retrieval_score") & (F.abs("retrieval_score") < float("inf"))
    of_line = [  # looked at beside the line's first candidate
        ("query_id", empty("query_id"), "no id"),
        ("query_text", ~F.coalesce(F.col("query").rlike(r"\S"), F.lit(False)), "no query"),
        ("query_hash", forged(F.trim("query"), "query_hash"), "hash differs from the query"),
        ("candidates", F.col("_none"), "no list of candidates"),
    ]
    of_candidate = [
        ("chunk_id", empty("chunk_id"), "no id"),
        ("document_text", empty("document_text"), "no text"),
        ("document_hash", forged(F.col("document_text"), "document_hash"), "hash differs from the text"),
        ("score", ~F.coalesce(finite, F.lit(False)), "score isn't finite"),
        ("rank", F.coalesce("retrieval_rank", F.lit(0)) < 1, "rank isn't from 1"),
    ]
    rules = [(check, first & bad, F.col("query_id"), F.lit(message)) for check, bad, message in of_line]
    rules += [(check, there & bad, pair, F.lit(message)) for check, bad, message in of_candidate]
    ids = read_json_lines(spark, path, "query_id string, candidates array<struct<chunk_id:string>>", strict=True)
    counts = _count_findings(ids, text_in_folder(spark, path, MANIFEST))
    return _candidate_rows(rows), all_findings([breaks_any(lines, rules), counts])


def read_queries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Gold queries with an id and a text, the first ``limit`` by id."""
    rows = read_json_lines(spark, path, "query_id string, query string, eval_group string, difficulty string", strict=True)
    good = rows.filter("query_id is not null and trim(query) <> ''")
    return good if limit is None else good.orderBy("query_id").limit(limit)


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """``query_id``, ``section_id``, ``intent``, ``chunk_id``: one row per accepted chunk."""
    schema = "query_id string, intents array<struct<section_id:string,intent:string,accepted_chunk_ids:array<string>>>"
    rows = read_json_lines(spark, path, schema, strict=True)
    each = rows.select("query_id", F.explode("intents").alias("i"))
    return each.select("query_id", "i.section_id", "i.intent", F.explode("i.accepted_chunk_ids").alias("chunk_id"))


# -- bundles --------------------------------------------------------------------------------------
def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle folder by name; lines that can't be read keep ``_corrupt``."""
    return {
        "documents": read_json_lines(spark, f"{path}/documents.jsonl", SCHEMAS["documents"]),
        "sections": read_json_lines(spark, f"{path}/sections.jsonl", SCHEMAS["sections"]),
        "glossary": read_json_list(spark, f"{path}/glossary.json", SCHEMAS["glossary"]),
        "mappings": read_json_list(spark, f"{path}/mappings.json", SCHEMAS["mappings"]),
    }


def bundle_findings(bundle: dict[str, DataFrame]) -> DataFrame:
    """All problems of a bundle in one table: unreadable lines, keys, references, pages, blanks."""
    docs, sections = bundle["documents"], bundle["sections"]
    good = sections.filter("_corrupt is null")
    documents = docs.filter("_corrupt is null")
    blocks = good.select("key", F.explode_outer("blocks").alias("b")).select("key", "b.*")
    claims = bundle["mappings"].select(F.explode("section_keys").alias("section_key"), "key")
    ordinals = good.withColumn("at", F.concat_ws("/", "document_key", "ordinal"))
    return all_findings(
        [
            breaks(docs, "document_json", "key", F.col("_corrupt").isNotNull(), "line can't be read"),
            breaks(sections, "section_json", "key", F.col("_corrupt").isNotNull(), "line can't be read"),
            not_unique(documents, "document_key", "key"),
            not_unique(good, "section_key", "key"),
            not_unique(ordinals, "section_ordinal", "at"),
            not_unique(bundle["glossary"].withColumn("folded", F.lower(F.trim("term"))), "term", "folded"),
            not_unique(claims, "one_mapping", "section_key"),
            not_found(good, documents.select(F.col("key").alias("document_key")), "document", "document_key", "key"),
            not_found(claims, good.select(F.col("key").alias("section_key")), "section", "section_key", "key"),
            breaks(good, "section_pages", "key", F.col("start_page") > F.col("end_page"), "first page after the last"),
            breaks(blocks, "block_pages", "key", F.col("start_page") > F.col("end_page"), "first page after the last"),
            breaks(good, "section_text", "key", ~F.exists("blocks", lambda b: F.trim(b["markdown"]) != ""), "no text in any block"),
            breaks(documents, "document_title", "key", F.trim("title") == "", "no title"),
        ]
    )


def manifest_findings(spark: SparkSession, path: str) -> DataFrame:
    """Files that are missing, unexpected or changed against ``manifest.json`` ({file: sha256}).

    The manifest is a bounded file that the driver reads.
    """
    text = spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0]
    listed = spark.createDataFrame(list(json.loads(text).items()), "file string, sha256 string")
    name = F.element_at(F.split("path", "/"), -1)
    there = file_digests(spark, path).select(name.alias("file"), F.col("sha256").alias("found"))
    there = there.filter("file not in ('manifest.json', '_SUCCESS')")
    both = listed.join(there, "file", "full_outer")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("sha256") != F.col("found"), "changed")
    return finding(both.filter(state.isNotNull()), "file", "file", state)


def first_of_each(df: DataFrame, key: str, place: str) -> DataFrame:
    """Rows without later repeats of their key."""
    n = F.row_number().over(W.partitionBy(key).orderBy(place))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")
