"""Sections to chunks: splitters per kind of block, glossary terms, text for embedding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.arrays import distinct_folded, version_id
from vellum.functions.terms import Automaton, Name
from vellum.functions.text import clean_lines
from vellum.storage import saved

MAX_CHARS = 3000
#: Terms that one chunk is annotated with at most.
MAX_TERMS = 8
VERSION = "chunks-1"

_BLANK_LINE = re.compile(r"\n\s*\n")
_STOP = re.compile(r"[.!?;:…]\s+")
_LAST_GAP = re.compile(r"\s+\S*$")


def _cuts(text: str, most: int) -> list[int]:
    """Where a text may be cut within ``most`` characters, the best place first.

    After a sentence end, after a line end, before a gap, or just there; 0 where there is no such place.
    """
    reach = text[: most + 1]
    gap = _LAST_GAP.search(reach)
    return [max((m.end() for m in _STOP.finditer(reach)), default=0), max(0, reach.rfind("\n")) and reach.rfind("\n") + 1, gap.start() if gap else 0, most]


def _pieces(paragraph: str, most: int) -> Iterator[str]:
    at, text = 0, paragraph.strip()
    while at < len(text):
        rest = text[at:]
        step = len(rest) if len(rest) <= most else next(filter(None, _cuts(rest, most)))
        yield from filter(None, [rest[:step].strip()])
        at += step + len(rest[step:]) - len(rest[step:].lstrip())


def _packed(units: list[str], glue: str, most: int) -> list[str]:
    """Units in order joined by ``glue``, as many as stay within ``most``; a longer one stays alone."""
    parts: list[str] = []
    for unit in units:
        if parts and len(parts[-1]) + len(glue) + len(unit) <= most:
            parts[-1] += glue + unit
        else:
            parts.append(unit)
    return parts


def split_prose(text: str, most: int = MAX_CHARS) -> list[str]:
    """Paragraphs packed together up to ``most`` characters; longer ones are cut."""
    if len(text) <= most:
        return [text]
    out: list[str] = []
    open_part = False
    for paragraph in filter(None, map(str.strip, _BLANK_LINE.split(text))):
        if open_part and len(out[-1]) + 2 + len(paragraph) <= most:
            out[-1] += "\n\n" + paragraph
        else:
            out += _pieces(paragraph, most)
            open_part = len(paragraph) <= most
    return out


def split_rows(text: str, most: int = MAX_CHARS) -> list[str]:
    """Parts of a pipe table that stay below ``most``, each under the table's first two rows.

    A row longer than that is a part of its own; text that doesn't start with two rows is prose.
    """
    text = text.strip()
    rows = [r.strip() for r in text.splitlines() if r.strip()]
    if len(text) <= most:
        return [text]
    if len(rows) < 3 or not (rows[0].startswith("|") and rows[1].startswith("|")):
        return split_prose(text, most)
    head = "\n".join(rows[:2])
    parts: list[str] = []
    for row in rows[2:]:
        if parts and len(parts[-1]) + 1 + len(row) < most:
            parts[-1] += "\n" + row
        else:
            parts.append(f"{head}\n{row}")
    return parts


def split_entries(text: str, most: int = MAX_CHARS) -> list[str]:
    """Entries packed together up to ``most``; a line that starts in lower case is of the entry above it."""
    lines = [r.rstrip() for r in text.strip().splitlines() if r.strip()]
    numbers = accumulate(int(not line[:1].islower()) for line in lines)
    entries = groupby(zip(numbers, lines, strict=True), key=lambda x: x[0])
    return _packed(["\n".join(line for _, line in own) for _, own in entries], "\n", most)


SPLITTERS = {"table": split_rows, "list": split_entries, "index_entries": split_entries}


@F.udtf(returnType="ordinal int, block int, chunk_text string", useArrow=False)
class BlockParts:
    """Table function (kinds, texts of a section's blocks, most characters) -> numbered parts; blank blocks have none.

    Rows go to Python and back by the hundred; with Arrow each section would be a table of its own.
    """

    def eval(self, kinds: list, texts: list, most: int) -> Iterator[tuple[int, int, str]]:
        ordinal = 0
        for block, (kind, text) in enumerate(zip(kinds if kinds is not None else [], texts if texts is not None else [], strict=True)):
            text = (text or "").strip()
            for part in SPLITTERS.get(kind, split_prose)(text, most) if text else []:
                ordinal += 1
                yield ordinal, block, part.strip()


def context_header(title: Column, path: Column, heading: Column, hidden: list[str]) -> Column:
    """The title and the path below it line by line, or ``title > heading`` without either line.

    Lines that start with a label of ``hidden`` are left out.
    """
    lines = F.filter(F.concat(F.array(F.coalesce(title, F.lit(""))), F.coalesce(path, F.array().cast("array<string>"))), lambda s: s != "")
    lines = F.transform(lines, lambda s, i: F.when(i > 0, F.concat(F.lit("> "), s)).otherwise(s))
    lines = F.transform(F.flatten(F.transform(lines, lambda s: F.split(s, r"\r\n|\r|\n"))), lambda s: F.trim(s))
    labels = F.array(*[F.lit(x.lower() + ":") for x in hidden]).cast("array<string>")
    shown = F.filter(
        lines, lambda s: (s != "") & ~F.exists(labels, lambda x: F.startswith(F.lower(s), x))
    )
    header = F.array_join(shown, "\n")
    short = F.array_join(F.filter(F.array(F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(heading, F.lit("")))), lambda s: s != ""), " > ")
    return F.when(header != "", header).otherwise(short)


# -- glossary -------------------------------------------------------------------------------------
#: Names of terms that one automaton holds (some 500 bytes each in a task); a larger glossary goes in blocks.
NAMES_A_BLOCK = 200_000
_FOUND = "array<struct<place:int,term:string,meaning:string>>"


def glossary_rows(glossary: DataFrame) -> DataFrame:
    """``term``, ``name``, ``exact``, ``meaning``: a row per name of a term, the term itself included.

    ``glossary``: ``term``, ``aliases``, ``case_sensitive``, ``expansions`` (null counts as none).  ``meaning`` is
    ``term = expansion; …``, null without expansions.  Of several rows of a term the names count together,
    and the least meaning.
    """
    none = F.array().cast("array<string>")
    term = F.trim(F.col("term"))
    meant = F.array_join(F.coalesce("expansions", none), "; ")
    rows = glossary.filter(term != "").select(
        term.alias("term"),
        F.explode(F.array_distinct(F.array_prepend(F.coalesce("aliases", none), term))).alias("name"),
        F.coalesce("case_sensitive", F.lit(False)).alias("exact"),
        F.when(meant != "", F.concat(term, F.lit(" = "), meant)).alias("meaning"),
    )
    meanings = rows.groupBy("term").agg(F.min("meaning").alias("meaning"))
    return rows.filter(F.trim("name") != "").select("term", "name", "exact").distinct().join(meanings, "term")


def _finder(names: list[Row], most: int) -> Callable[[Column], Column]:
    """Arrow UDF text -> array of (place, term, meaning): the first ``most`` terms of a list of names."""
    held = [tuple(n) for n in names]

    @F.pandas_udf(_FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(Name(term, name, exact) for term, name, exact, _ in held)
        meaning = {term: m for term, _, _, m in held}
        for texts in batches:
            yield texts.map(
                lambda t: [{"place": p, "term": n, "meaning": meaning[n]} for p, n in automaton.leading(t, most)] if t else []
            )

    return find


def with_terms(texts: DataFrame, glossary: DataFrame, text: Column, most: int = MAX_TERMS, block: int = NAMES_A_BLOCK) -> DataFrame:
    """``texts`` with ``terms``: the first ``most`` glossary terms of ``text`` by first place, then by name.

    A name counts where no letter or digit touches it, case aside unless the term is case-sensitive;
    every term is found by itself, whatever other names begin or end there.  ``glossary`` is as in
    ``glossary_rows``.  Its names are counted: up to ``block`` of them go to the tasks as one automaton and
    the texts are read once; of more, each block reads the texts once and the first of all stay.  A null or
    empty text has no terms.
    """
    names = saved(glossary_rows(glossary), "names")
    blocks = max(1, -(-names.count() // block))
    out = texts.withColumn("terms", F.array().cast(_FOUND))
    for b in range(blocks):
        own = names.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).select("term", "name", "exact", "meaning")
        both = F.array_sort(F.concat("terms", _finder(own.collect(), most)(text)))
        out = out.withColumn("terms", F.slice(both, 1, most))
        if b + 1 < blocks:  # one automaton at a time in a task
            out = saved(out, "terms")
    return out


def detected_terms(texts: DataFrame, row_id: str, glossary: DataFrame, most: int = MAX_TERMS, block: int = NAMES_A_BLOCK) -> DataFrame:
    """``row_id``, ``term``, ``place``, ``meaning``: a row for each of ``with_terms`` of the column ``text``."""
    found = with_terms(texts.select(row_id, "text"), glossary, F.col("text"), most, block)
    return found.select(row_id, F.explode("terms").alias("t")).select(row_id, "t.term", "t.place", "t.meaning")


def embedding_text(header: Column, aliases: Column, chunk: Column, expansions: Column, labels: tuple[str, str]) -> Column:
    """Header, aliases that the text doesn't show, the chunk and its terms' expansions.

    ``expansions`` are strings ``term = meaning``; ``labels`` stand before aliases and expansions.
    """
    shown = F.lower(F.concat_ws("\n\n", header, chunk))
    unseen = F.filter(distinct_folded(F.coalesce(aliases, F.array().cast("array<string>"))), lambda a: ~F.contains(shown, F.lower(a)))
    alias_line = F.when(F.size(unseen) > 0, F.concat(F.lit(labels[0] + ": "), F.array_join(unseen, ", ")))
    terms = F.when(F.size(expansions) > 0, F.concat(F.lit(labels[1] + ": "), F.array_join(expansions, " | ")))
    before = F.concat_ws("\n\n", F.when(header != "", header), alias_line, chunk)
    told = F.contains(F.lower(before), F.lit(labels[1].lower() + ":"))
    return F.trim(F.concat_ws("\n\n", before, F.when(~told, terms)))


def chunk_sections(
    sections: DataFrame,
    glossary: DataFrame | None,
    most: int | Column = MAX_CHARS,
    labels: tuple[str, str] = ("Also known as", "Terms"),
) -> DataFrame:
    """Chunks of sections, with content-addressed ids.

    ``sections``, a row per key: ``section_key``, ``title``, ``heading``, ``context_path``, ``aliases``,
    ``start_page``, ``end_page`` and ``blocks`` (structs kind, markdown, start_page, end_page,
    table_key).  The splitter follows from the block's kind alone; ``ordinal`` runs over the
    section's blocks.  ``most`` is a number or a column of ``sections``.  ``glossary``: ``term``, ``aliases``, ``case_sensitive``, ``expansions``; of any size, or None.
    """
    # the table function numbers the parts while it cuts a section, so that no chunk is shuffled for its number
    needed = sections.select(
        "section_key", "title", "heading", "context_path", "aliases", "start_page", "end_page", "blocks", (most if isinstance(most, Column) else F.lit(most)).alias("most")
    )
    parts = BlockParts(F.col("blocks.kind").outer(), F.col("blocks.markdown").outer(), F.col("most").outer())
    blocks = needed.lateralJoin(parts).withColumn("block", F.element_at("blocks", F.col("block") + 1))
    header = context_header(F.col("title"), F.col("context_path"), F.col("heading"), [labels[0]])
    blocks = blocks.withColumn("context_header", header)
    searched = F.concat_ws("\n\n", F.when(F.col("context_header") != "", F.col("context_header")), F.col("chunk_text"))
    blocks = blocks.withColumn("terms", F.array().cast(_FOUND)) if glossary is None else with_terms(blocks, glossary, searched)
    expansions = F.filter(F.transform("terms", lambda t: t["meaning"]), lambda e: e.isNotNull())
    text = embedding_text(F.col("context_header"), F.col("aliases"), F.col("chunk_text"), expansions, labels)
    blocks = blocks.withColumn("embedding_text", text)
    ids = version_id("chunk", F.col("section_key"), clean_lines("chunk_text"), clean_lines("embedding_text"), F.lit(VERSION))
    return blocks.select(
        ids.alias("chunk_id"), "section_key", "ordinal", F.col("block.kind").alias("kind"), "chunk_text", "context_header",
        "embedding_text", F.sha2("embedding_text", 256).alias("embedding_sha256"), "terms",
        F.coalesce("block.start_page", "start_page").alias("start_page"), F.coalesce("block.end_page", "end_page").alias("end_page"),
        F.when(F.col("block.kind") == "table", F.col("block.table_key")).alias("table_key"),
    )


def section_revision_id(section_key: Column, blocks: Column) -> Column:
    """An id that follows from the section's key and blocks."""
    body = F.to_json(F.struct(blocks.alias("blocks")), {"ignoreNullFields": "false"})
    return version_id("section-revision", section_key, body)


def glossary_matches(texts: DataFrame, row_id: str, glossary: DataFrame) -> DataFrame:
    """``row_id``, ``term``, ``place``: the first MAX_TERMS terms of each text, without Python.

    Terms of up to three words meet the texts' word runs by an equi-join, so that a large glossary
    isn't tried term by term.  ``glossary (term, name)``: names as lower-case words with single spaces.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    listed = texts.select(row_id, words.alias("w"))
    at = F.explode(F.sequence(F.lit(1), F.size("w")))
    starts = listed.filter(F.size("w") > 0).select(row_id, "w", at.alias("at"))
    heads = F.array(*[F.array_join(F.slice("w", F.col("at"), n), " ") for n in (1, 2, 3)])
    grams = starts.select(row_id, "at", F.explode(F.array_distinct(heads)).alias("name"))
    names = saved(glossary.select("term", "name").distinct(), "names")
    # word runs are shuffled only for a glossary that tasks can't hold
    found = grams.join(F.broadcast(names) if names.count() <= NAMES_A_BLOCK else names, "name")
    first = found.groupBy(row_id, "term").agg(F.min("at").alias("place"))
    order = W.partitionBy(row_id).orderBy("place", "term")
    return first.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= MAX_TERMS).drop("_n")
