"""A bundle as the rows of one release, the evaluation view of its chunks, and export to a bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.arrays import SEPARATOR, name_uuid
from vellum.operators import chunking, relations
from vellum.operators.search import strategy_of

#: Blocks beyond this size that are tables stay apart from the prose around them.
LONG_TABLE = chunking.MAX_CHARS


def section_chars(blocks: Column) -> Column:
    """Characters of the blocks' texts joined by blank lines."""
    return F.length(F.array_join(F.transform(blocks, lambda b: b["markdown"]), "\n\n"))


def scoped_id(kind: str, *parts: Column) -> Column:
    """The id of a named thing within its parent."""
    return name_uuid(F.concat_ws(SEPARATOR, F.lit(kind), *parts))


def snapshot(bundle: dict[str, DataFrame], collection: str, most: int = chunking.MAX_CHARS) -> dict[str, DataFrame]:
    """``documents``, ``sections``, ``revisions``, ``chunks`` and ``bridge`` of a bundle.

    Ids follow from keys (documents, sections) or content (revisions, chunks), so that equal parts
    of two releases are the same rows.  Of chunks with one id the first in section order stays.
    Sections without a known document are a finding of ``records.bundle_findings``, not rows here.
    The glossary goes to the tasks in counted blocks (``chunking.with_terms``).
    """
    docs = bundle["documents"].select(
        scoped_id("document", F.lit(collection), F.col("key")).alias("document_id"),
        F.col("key").alias("document_key"), "kind", "title", F.col("source.title").alias("source_title"),
        F.col("source.url").alias("source_url"), "attributes",
    )
    joined = bundle["sections"].join(docs.select("document_id", "document_key", "title"), "document_key")
    sections = joined.select(
        scoped_id("section", F.col("document_id"), F.col("key")).alias("section_id"), "document_id",
        F.col("key").alias("section_key"), "title", "heading", "context_path", "ordinal", "retrieval",
        "blocks", "start_page", "end_page",
        chunking.section_revision_id(F.col("key"), F.col("blocks")).alias("revision_id"),
    )
    revisions = sections.select(
        "revision_id", "section_id", "blocks", "start_page", "end_page", section_chars(F.col("blocks")).alias("chars")
    ).dropDuplicates(["revision_id"])
    aliases = bundle["mappings"].select(
        F.col("section_keys").alias("keys"), F.col("aliases").alias("names"), F.col("key").alias("place")
    )
    named = relations.first_match(sections.withColumnRenamed("section_key", "k"), aliases, "k", "keys", "place")
    ready = named.withColumnsRenamed({"k": "section_key"}).withColumn("aliases", F.col("rule.names"))
    drafts = chunking.chunk_sections(ready, bundle["glossary"], most)
    placed = drafts.join(sections.select("section_key", "section_id", "revision_id", "retrieval", "blocks"), "section_key")
    placed = placed.withColumn("strategy", strategy_of(F.col("retrieval"), section_chars(F.col("blocks"))))
    first = relations.earliest(
        placed.select("chunk_id", "section_id", "revision_id", "ordinal", "strategy", "section_key"), ["chunk_id"], "section_key", "ordinal"
    )
    chunks = relations.earliest(drafts, ["chunk_id"], "section_key", "ordinal")
    return {
        "documents": docs, "sections": sections.drop("blocks", "title"), "revisions": revisions,
        "chunks": chunks, "bridge": first.drop("section_key"),
    }


def chunk_label(section: Column, ordinal: Column) -> Column:
    """``section:chunk-007``."""
    return F.concat(section, F.format_string(":chunk-%03d", ordinal))


def evaluation_view(snap: dict[str, DataFrame], roles: dict[str, str], kinds: dict[str, str]) -> DataFrame:
    """Chunks with what evaluation asks of them: label, section, role and content type.

    ``roles`` maps block kinds, ``kinds`` document kinds; both are small and become literal maps.
    """
    role = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    docs = snap["documents"].select("document_id", "title", F.col("kind").alias("document_kind"), "source_title")
    sections = snap["sections"].select("section_id", "document_id", "heading", "context_path")
    bridge = snap["bridge"].select("chunk_id", "section_id", "strategy")
    rows = snap["chunks"].join(bridge, "chunk_id").join(sections, "section_id").join(docs, "document_id")
    return rows.select(
        chunk_label(F.col("section_key"), F.col("ordinal")).alias("chunk_label"), "section_key", "ordinal", "title", "heading",
        "source_title", kind[F.col("document_kind")].alias("content_type"), "context_header", "context_path", "chunk_text",
        "embedding_text", "strategy", role[F.col("kind")].alias("role"),
        F.when(F.col("kind") == "table", "table").otherwise("paragraph").alias("chunk_type"),
        F.coalesce("table_key", F.lit("")).alias("table_key"), "start_page", "end_page",
    )


def text_blocks(text: Column) -> Column:
    """Blocks of a text: paragraphs joined to prose, long pipe tables kept apart.

    An ordered fold over the paragraphs: a paragraph joins the last block if both are prose.
    """
    kind = "array<struct<kind:string,markdown:string>>"
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")

    def step(blocks: Column, p: Column) -> Column:
        table = p.startswith("|") & (F.length(p) > LONG_TABLE)
        last = F.try_element_at(blocks, F.lit(-1))
        grown = F.struct(last["kind"].alias("kind"), F.concat_ws("\n\n", last["markdown"], p).alias("markdown"))
        new = F.struct(F.when(table, "table").otherwise("prose").alias("kind"), p.alias("markdown"))
        joins = ~table & F.coalesce(last["kind"] == "prose", F.lit(False))
        kept = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))
        return F.when(joins, F.concat(kept, F.array(grown))).otherwise(F.concat(blocks, F.array(new)))

    return F.aggregate(paragraphs, F.array().cast(kind), step)


def exported(sections: DataFrame, place: str) -> tuple[DataFrame, DataFrame]:
    """(documents, sections) of a bundle from built sections.

    ``sections``: ``id``, ``document_key``, ``title``, ``heading``, ``context_path``, ``blocks`` and
    ``place``, the order of the build.  Sections without blocks are left out; the others are
    numbered within their document.  ``n_titles`` over 1 tells of a key that two titles share.
    """
    kept = sections.filter(F.size("blocks") > 0)
    order = W.partitionBy("document_key").orderBy(place, "id")
    numbered = kept.withColumn("ordinal", F.row_number().over(order))
    path = F.when(F.size("context_path") > 0, F.col("context_path")).otherwise(F.array("heading"))
    docs = kept.groupBy("document_key").agg(
        F.min_by("title", place).alias("title"), F.count_distinct("title").alias("n_titles"), F.count("*").alias("n_sections")
    )
    return docs, numbered.withColumn("context_path", path)


def citations(numbered: DataFrame, used: DataFrame) -> DataFrame:
    """The evidence behind the numbers that an answer uses, in the answer's order.

    ``numbered (request, index, …)``, ``used (request, place, index)``; unknown numbers are left out.
    """
    return used.join(numbered, ["request", "index"])


def usable(gold: DataFrame, sections: DataFrame) -> DataFrame:
    """Gold rows all of whose expected sections exist: an anti-join on those that lack one."""
    each = gold.select("query_id", F.explode("gold_sections").alias("section_id"))
    lacking = each.join(sections.select("section_id").distinct(), "section_id", "left_anti")
    return gold.join(lacking.select("query_id").distinct(), "query_id", "left_anti")


def has_body(markdown: Column) -> Column:
    """Whether anything but headings holds a letter or digit."""
    return F.regexp_replace(markdown, r"(?m)^#{1,6}[^\n]*$", "").rlike(r"[\p{L}\p{N}]")


def mentions(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms (``term``) with whether any text holds all their words next to each other.

    Word runs of up to three words meet the terms by an equi-join on their folded form.
    """
    key = F.array_join(F.regexp_extract_all(F.lower("term"), F.lit(r"([\p{L}\p{N}]+)"), 1), " ")
    folded = terms.select("term", key.alias("name"))
    found = chunking.glossary_matches(texts, "id", folded).select("term").distinct()
    return terms.join(found.withColumn("found", F.lit(True)), "term", "left").withColumn("found", F.coalesce("found", F.lit(False)))

