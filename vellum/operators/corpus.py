"""Raw text, HTML and table fragments to sections, blocks and audited corpora."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.labels import canonical_label
from vellum.functions.text import any_of, is_data_row, row_cells, squeeze, table_rows
from vellum.operators.relations import carried


# -- HTML -----------------------------------------------------------------------------------------
class _Markdown(HTMLParser):
    """Collects markdown of headings, paragraphs, lists, emphasis, breaks and tables."""

    _SKIPPED = {"script", "style", "head", "template", "noscript"}
    _BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "blockquote", "body"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None
        self.skipped = 0

    def _put(self, text: str) -> None:
        (self.cell if self.cell is not None else self.out).append(text)

    def handle_starttag(self, tag, attrs):
        if tag in self._SKIPPED:
            self.skipped += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in self._BLOCKS:
            self._put("\n\n")
        elif tag in ("strong", "b"):
            self._put("**")
        elif tag in ("em", "i"):
            self._put("*")
        elif tag == "br":
            self._put("\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self._put("\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self._put("\n" + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in self._SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6") or tag in self._BLOCKS:
            self._put("\n\n")
        elif tag in ("strong", "b"):
            self._put("**")
        elif tag in ("em", "i"):
            self._put("*")
        elif tag in ("ul", "ol"):
            self.lists = self.lists[:-1]
            self._put("\n")
        elif tag in ("td", "th") and self.cell is not None:
            text = " ".join("".join(self.cell).split()).replace("|", "/")
            self.cell = None
            if self.rows:
                self.rows[-1].append(text)
        elif tag == "table" and self.rows is not None:
            rows = [r for r in self.rows if r]
            self.rows = None
            if rows:
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                lines.insert(1, "| " + " | ".join(["---"] * len(rows[0])) + " |")
                self._put("\n\n" + "\n".join(lines) + "\n\n")

    def handle_data(self, data):
        if not self.skipped and (self.rows is None or self.cell is not None):
            self._put(" ".join(data.split()).join((" " * data[:1].isspace(), " " * data[-1:].isspace())) if data.strip() else " ")


def _to_markdown(html: str) -> str:
    reader = _Markdown()
    reader.feed(html)
    reader.close()
    lines = [" ".join(x.split()) for x in "".join(reader.out).split("\n")]
    out: list[str] = []
    for line in lines:
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip()


#: Pages that a task has as Python strings at once.
PAGES = 32


def _markdown_slices(pages: pa.Array) -> pa.Array:
    parts = (pages.slice(at, PAGES).to_pylist() for at in range(0, len(pages), PAGES))
    done = [pa.array([None if t is None else _to_markdown(t) for t in part], pa.string()) for part in parts]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def html_markdown(pages: Column) -> Column:
    """Markdown of whole pages; null stays null."""

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        return _markdown_slices(batch)

    return run(pages)


def page_title(html: Column) -> Column:
    """The first h1's text, else the title's part before a bar."""
    h1 = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    title = F.split_part(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("|"), F.lit(1))
    plain = squeeze(F.regexp_replace(F.when(h1 != "", h1).otherwise(title), r"<[^>]*>", ""))
    return F.when(plain != "", plain)


def markdown_section(markdown: Column, heading: str) -> Column:
    """What stands under the first second-level heading that contains ``heading``; null without it."""
    body = F.regexp_extract(markdown, rf"(?ms)^## [^\n]*{heading}[^\n]*\n(.*?)(?=^## |\z)", 1)
    plain = F.regexp_replace(body, r"^\s+|\s+$", "")
    return F.when(plain != "", plain)


def locations(xml: Column) -> Column:
    """The distinct ``<loc>`` addresses of a site map, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)))


def page_kind(url: Column, categories: list[str]) -> Column:
    """The first part of a two-part path if it is a listed category; else null."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+/([^/?#]+)/[^/?#]+/?$", 1)
    return F.when(path.isin(categories), path)


# -- lines, pages, sections -----------------------------------------------------------------------
def lines_of(docs: DataFrame, row_id: str, text: str = "text") -> DataFrame:
    """One row per line: ``row_id``, ``line_no`` from 1, ``line``."""
    lines = F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line")
    return docs.select(row_id, lines).withColumn("line_no", F.col("line_no") + 1)


def page_lines(docs: DataFrame, row_id: str) -> DataFrame:
    """Lines with the page of the last marker ``<!-- page N -->`` before them; markers left out."""
    marked = lines_of(docs, row_id).withColumn(
        "mark", F.try_to_number(F.nullif(F.regexp_extract("line", r"<!--\s*page\s+([0-9]+)\s*-->", 1), F.lit("")), F.lit("999999999")).cast("int")
    )
    page = carried(marked, [row_id], F.col("mark"), "line_no")
    return marked.withColumn("page", page).filter("mark is null").drop("mark")


def reading_order(lines: DataFrame, page: str, width: str) -> DataFrame:
    """Lines of a two-column page in reading order: left column first, then down, then across.

    ``lines`` has ``x0``, ``x1``, ``y0``; adds ``place`` within the page.
    """
    column = F.when((F.col("x0") + F.col("x1")) / 2 < F.col(width) / 2, 0).otherwise(1)
    order = W.partitionBy(page).orderBy(column, F.round("y0", 1), F.round("x0", 1), "line_id")
    return lines.withColumn("place", F.row_number().over(order).cast("long"))


def markdown_sections(docs: DataFrame, row_id: str, extra: Column | None = None) -> DataFrame:
    """Sections of markdown: a heading opens one, text before the first is section 0.

    Columns: ``row_id``, ``section_no``, ``heading``, ``depth``, ``body``, ``n_lines``.  ``extra``
    marks further lines (on column ``line``) as headings.  A document's sections are summed by
    number, its lines are never gathered beyond their section.
    """
    is_heading = F.col("line").rlike(r"^#{1,6}\s+\S")
    if extra is not None:
        is_heading = is_heading | extra
    order = W.partitionBy(row_id).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    lines = lines_of(docs, row_id).withColumn("opens", is_heading)
    lines = lines.withColumn("section_no", F.sum(F.col("opens").cast("int")).over(order))
    body = F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct("line_no", "line"))))
    return (
        lines.groupBy(row_id, "section_no")
        .agg(
            F.max(F.when(F.col("opens"), F.col("line"))).alias("_heading"),
            F.array_join(body["line"], "\n").alias("body"),
            F.count_if(~F.col("opens")).alias("n_lines"),
        )
        .select(
            row_id,
            F.col("section_no").cast("long"),
            F.trim(F.regexp_replace(F.coalesce("_heading", F.lit("")), r"^#+\s*", "")).alias("heading"),
            F.length(F.regexp_extract(F.coalesce("_heading", F.lit("")), r"^(#*)", 1)).alias("depth"),
            F.regexp_replace("body", r"^\s+|\s+$", "").alias("body"),
            "n_lines",
        )
    )


def compositions(docs: DataFrame, row_id: str, headings: dict[str, list[str]], block: str, names: Callable[[Column], Column], skipped: str = "(?!)") -> DataFrame:
    """``row_id``, ``names``: what the documents' composition blocks list, each once, in order.

    A block are the lines after a heading whose label is ``block``, up to the next heading of
    ``headings`` (see ``labels.canonical_label``); blank lines and those that match ``skipped`` don't
    count.  ``names`` gives a line's names.  ``names`` of a document is null without a name, or if one
    can't be read.  The window goes over a document's lines.
    """
    order = W.partitionBy(row_id).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    lines = lines_of(docs, row_id).filter("trim(line) <> ''").withColumn("label", canonical_label(F.col("line"), headings))
    lines = lines.withColumn("under", F.last("label", ignorenulls=True).over(order))
    # the first block counts: it ends where another heading follows
    other = F.col("label").isNotNull() & (F.col("label") != block)
    started = F.max((F.col("label") == block).cast("int")).over(order)
    lines = lines.withColumn("ended", F.max(F.when(other & (started == 1), 1).otherwise(0)).over(order))
    inside = lines.filter((F.col("under") == block) & F.col("label").isNull() & (F.col("ended") == 0) & ~F.col("line").rlike(skipped))
    each = inside.select(row_id, "line_no", F.posexplode(names(F.col("line"))).alias("at", "name"))
    found = each.groupBy(row_id).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "at", "name")))["name"].alias("listed"), F.count_if(F.col("name").isNull()).alias("unread")
    )
    readable = F.when(F.col("unread") == 0, F.array_distinct("listed"))
    return docs.select(row_id).join(found.select(row_id, readable.alias("names")), row_id, "left")


def without_line_ranges(lines: DataFrame, ranges: DataFrame, row_id: str) -> DataFrame:
    """Lines outside the listed ranges (``first`` to ``last``) of their document."""
    hit = (F.col("line_no") >= F.col("first")) & (F.col("line_no") <= F.col("last"))
    gone = lines.join(ranges, row_id).filter(hit).select(row_id, "line_no")
    return lines.join(gone, [row_id, "line_no"], "left_anti")


def rejoined(blocks: DataFrame, by: str, order: str) -> DataFrame:
    """Sections again from their blocks: text, block ids in order, sorted distinct flags."""
    listed = F.array_sort(F.collect_list(F.struct(order, "block_id", "text")))
    flags = F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags"))))
    out = blocks.groupBy(by).agg(listed.alias("b"), flags.alias("flags"), F.count("*").alias("n_blocks"))
    return out.select(by, F.array_join("b.text", "\n\n").alias("text"), F.col("b.block_id").alias("block_ids"), "flags", "n_blocks")


def with_overrides(df: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns replaced where the override table has a value."""
    new = overrides.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = df.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def merged_pairs(sections: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sections in which the listed ``part`` sections are appended to their ``whole``."""
    parts = pairs.join(sections.select(F.col("section").alias("part"), F.col("text").alias("_more")), "part")
    more = parts.groupBy("whole").agg(F.array_sort(F.collect_list(F.struct("part", "_more"))).alias("m"))
    kept = sections.join(pairs.select(F.col("part").alias("section")), "section", "left_anti")
    out = kept.join(more.withColumnRenamed("whole", "section"), "section", "left")
    tail = F.coalesce(F.col("m._more"), F.array().cast("array<string>"))
    return out.withColumn("text", F.array_join(F.concat(F.array("text"), tail), "\n\n")).drop("m")


# -- tables ---------------------------------------------------------------------------------------
def pipe_tables(docs: DataFrame, row_id: str) -> DataFrame:
    """Runs of lines that start with a pipe, two or more, with a rule line among the first three.

    Columns: ``row_id``, ``first_line``, ``n_lines``, ``markdown``, ``caption`` (the nearest line
    before that isn't blank).  Gaps and islands over line numbers; no window holds more than a document.
    """
    lines = lines_of(docs, row_id).withColumn("line", F.trim("line"))
    order = W.partitionBy(row_id).orderBy("line_no")
    piped = F.col("line").startswith("|")
    text_line = F.when(~piped & (F.col("line") != ""), F.col("line"))
    back = order.rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("caption", F.last(text_line, ignorenulls=True).over(back)).filter(piped)
    lines = lines.withColumn("_island", F.col("line_no") - F.row_number().over(order))
    listed = F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"]
    blocks = lines.groupBy(row_id, "_island").agg(
        F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), listed.alias("rows"), F.max("caption").alias("caption")
    )
    ruled = F.exists(F.slice("rows", 1, 3), lambda r: r.rlike(r"^\|[-:|\s]*-[-:|\s]*$"))
    return blocks.filter((F.col("n_lines") >= 2) & ruled).select(
        row_id, "first_line", "n_lines", F.array_join("rows", "\n").alias("markdown"), "caption"
    )


def captions(lines: DataFrame, row_id: str) -> DataFrame:
    """Lines that caption a table (``Table 3: …``): ``row_id``, ``line_no``, ``page``, ``number``, ``caption``."""
    number = F.regexp_extract("line", r"(?i)^\s*\**\s*table\s+([0-9]+(?:\.[0-9]+)*)", 1)
    return lines.withColumn("number", number).filter("number <> ''").select(
        row_id, "line_no", "page", "number", squeeze(F.regexp_replace("line", r"\*", "")).alias("caption")
    )


#: Classes of tables: fixed values.
TABLE_CLASSES = ("front_matter_table", "index_table", "clinical_table", "review_table")


def table_kind(page: Column, context: Column, caption: Column, markdown: Column, words: dict[str, list[str]], front_pages: int) -> Column:
    """A table's class by its place and what is said around it.

    ``words`` has lists for ``front``, ``index``, ``appendix`` and ``clinical``, all in folded form.  Tables
    before page ``front_pages`` or under a front heading are front matter; those under an index
    heading are indexes; those without a caption under an appendix heading are to be reviewed; those
    whose heading, caption or first row has a clinical word are clinical; the others are reviewed.
    """
    front, index, clinical, review = map(F.lit, TABLE_CLASSES)
    heading, named = (F.lower(squeeze(F.coalesce(c, F.lit("")))) for c in (context, caption))
    header = F.lower(F.coalesce(F.try_element_at(F.split(markdown, "\n"), F.lit(1)), F.lit("")))
    shown = F.concat_ws("\n", heading, named, header)
    return (
        F.when((page < front_pages) | any_of(heading, words["front"]), front)
        .when(any_of(heading, words["index"]), index)
        .when(any_of(heading, words["appendix"]) & (named == ""), review)
        .when(any_of(shown, words["clinical"]), clinical)
        .otherwise(review)
    )


def opens_with_names(rows: Column, headers: tuple[str, ...] = (), longest: int = 180) -> Column:
    """Whether a table's first row is a header of its own.

    It is no row of values and starts with one of ``headers``, or has two cells with letters or more, none
    with more digits than letters, and is at most ``longest`` characters.
    """
    first = F.try_element_at(rows, F.lit(1))
    cells = F.filter(row_cells(first), lambda c: c != "")
    letters, digits = (lambda c, p=p: F.regexp_count(c, F.lit(p)) for p in (r"\p{L}", r"\p{Nd}"))
    named = F.filter(cells, lambda c: letters(c) > 0)
    numeric = F.exists(cells, lambda c: digits(c) > letters(c))
    listed = F.lower(F.try_element_at(cells, F.lit(1))).isin(*headers) if headers else F.lit(False)
    header = listed | ((F.size(named) >= 2) & ~numeric & (F.length(F.array_join(cells, " ")) <= longest))
    return F.coalesce(~is_data_row(first) & (F.size(cells) >= 2) & header, F.lit(False))


def continues(left: Column, right: Column, openings: tuple[str, ...] = (), headers: tuple[str, ...] = ()) -> Column:
    """``decision (decision, reason)``: whether a table goes on with the one before it.

    Both are structs (page, caption, context, flags, forced, rows).  ``forced`` of the table before
    (merge or separate) comes first; then the pages, the numbers of columns, equal captions, and
    what the headings and the first row say, each with its reason.
    """

    def said(decision: str, reason: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))

    near = right["page"].isin(left["page"], left["page"] + 1)
    first = F.try_element_at(right["rows"], F.lit(1))
    width = lambda t: F.size(row_cells(F.try_element_at(t["rows"], F.lit(1))))
    fold = lambda c: F.lower(squeeze(F.coalesce(c, F.lit(""))))
    same_context = fold(left["context"]) == fold(right["context"])
    going_on = F.array_contains(right["flags"], "continued_context")
    opened = F.lower(F.coalesce(F.try_element_at(row_cells(first), F.lit(1)), F.lit("")))
    marked = F.exists(F.array(*map(F.lit, openings)), lambda o: opened.startswith(o)) if openings else F.lit(False)
    return (
        F.when((left["forced"] == "separate"), said("separate", "override_forced_separate"))
        .when((left["forced"] == "merge") & near, said("merge", "override_forced_merge"))
        .when(~near, said("separate", "non_adjacent_page"))
        .when(F.coalesce(width(left) != width(right), F.lit(True)), said("separate", "column_mismatch"))
        .when((fold(left["caption"]) != "") & (fold(left["caption"]) == fold(right["caption"])), said("merge", "same_caption"))
        .when(F.array_contains(right["flags"], "duplicate_caption"), said("merge", "duplicate_caption"))
        .when(same_context & (fold(right["caption"]) == "") & ~going_on, said("review", "same_context_missing_caption"))
        .when(opens_with_names(right["rows"], headers), said("separate", "new_header_detected"))
        .when(going_on & same_context & is_data_row(first), said("merge", "numeric_data_continuation"))
        .when(going_on & same_context, said("merge", "continued_context_same_heading"))
        .when(marked, said("merge", "leading_continuation_marker"))
        .otherwise(said("separate", "no_continuation_signal"))
    )


def _appended(left: Column, right: Column, most_new: float = 0.7) -> Column:
    """The rows of both, without the right one's first row if it repeats the left one's header."""
    tokens = lambda row: F.array_distinct(F.regexp_extract_all(F.lower(row), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    header, first = (tokens(F.coalesce(F.try_element_at(r, F.lit(1)), F.lit(""))) for r in (left, right))
    again = (F.size(header) > 0) & (F.size(F.array_intersect(header, first)) > most_new * F.size(header))
    return F.concat(left, F.when(again, F.slice(right, 2, 1_000_000)).otherwise(right))


_GROUP = (
    "struct<page:int,caption:string,context:string,flags:array<string>,forced:string,rows:array<string>,"
    "ids:array<string>,first_page:int,last_page:int,reasons:array<string>,reason:string>"
)


def merged_tables(tables: DataFrame, doc: str, openings: tuple[str, ...] = (), headers: tuple[str, ...] = (), unchained: tuple[str, ...] = ()) -> DataFrame:
    """Fragments of tables put together over page breaks.

    ``tables``: ``doc``, ``page``, ``place``, ``table_id``, ``markdown``, ``caption``, ``context``, ``flags``,
    ``forced``.  Each fragment is compared with the table as merged so far, which keeps the caption,
    heading and header of its first fragment and moves to the page of its last one (but under the
    headings of ``unchained``); so a document's fragments, which are few, are folded in order.
    Columns: ``doc``, ``group``, ``markdown``, ``table_ids``, ``n_parts``, ``first_page``, ``last_page``,
    ``reasons`` (of the merges), ``opened`` (why the group was opened; null for the first).
    """
    rows = tables.select(
        doc, "page", "place",
        F.struct(
            F.col("page").cast("int").alias("page"), "caption", "context", F.coalesce("flags", F.array().cast("array<string>")).alias("flags"),
            "forced", table_rows(F.col("markdown")).alias("rows"), F.array(F.col("table_id").cast("string")).alias("ids"),
            F.col("page").cast("int").alias("first_page"), F.col("page").cast("int").alias("last_page"),
            F.array().cast("array<string>").alias("reasons"), F.lit(None).cast("string").alias("reason"),
        ).alias("t"),
    )
    listed = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page", "place", "t")))["t"].alias("t"))

    def fold(groups: Column, t: Column) -> Column:
        now = F.try_element_at(groups, F.lit(-1))
        said = continues(now, t, openings, headers)
        stays = any_of(F.lower(squeeze(F.coalesce(now["context"], F.lit("")))), unchained)
        grown = F.struct(
            F.when(stays, now["page"]).otherwise(t["page"]).alias("page"), now["caption"].alias("caption"), now["context"].alias("context"),
            F.array_sort(F.array_union(F.array_union(now["flags"], t["flags"]), F.array(F.lit("merged_fragment")))).alias("flags"),
            F.when(said["reason"] != "override_forced_merge", now["forced"]).alias("forced"),
            _appended(now["rows"], t["rows"]).alias("rows"), F.concat(now["ids"], t["ids"]).alias("ids"),
            F.least(now["first_page"], t["page"]).alias("first_page"), F.greatest(now["last_page"], t["page"]).alias("last_page"),
            F.concat(now["reasons"], F.array(said["reason"])).alias("reasons"), now["reason"].alias("reason"),
        )
        opened = F.concat(groups, F.array(t.withField("reason", said["reason"]).cast(_GROUP)))
        merged = F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(grown.cast(_GROUP)))
        return F.when(F.size(groups) == 0, F.array(t.cast(_GROUP))).when(said["decision"] == "merge", merged).otherwise(opened)

    groups = listed.select(doc, F.posexplode(F.aggregate("t", F.array().cast(f"array<{_GROUP}>"), fold)).alias("group", "g"))
    return groups.select(
        doc, (F.col("group") + 1).alias("group"), F.array_join("g.rows", "\n").alias("markdown"), F.col("g.ids").alias("table_ids"),
        F.size("g.ids").cast("long").alias("n_parts"), "g.first_page", "g.last_page", "g.reasons", F.col("g.reason").alias("opened"),
    )


def without_repeated_lines(sections: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """Section texts without the lines that a table of theirs repeats: of a line that has words, all
    are in one row of the table.  Adds ``n_removed``."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\p{N}+)"), 1)
    rows = tables.select(key, F.explode(table_rows(F.col("markdown"))).alias("r")).groupBy(key).agg(F.collect_set(words("r")).alias("_rows"))
    joined = sections.join(rows, key, "left")
    repeated = lambda line: F.coalesce(
        (F.size(words(line)) > 1) & F.exists("_rows", lambda r: F.size(F.array_except(words(line), r)) == 0), F.lit(False)
    )
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda s: ~repeated(s))
    return joined.withColumn("n_removed", F.size(lines) - F.size(kept)).withColumn("text", F.array_join(kept, "\n")).drop("_rows")


# -- audits ---------------------------------------------------------------------------------------
def corpus_audit(docs: DataFrame, row_id: str, group: str) -> DataFrame:
    """Per group: documents, distinct texts, characters, shortest, longest, empty ones."""
    size = F.length(F.coalesce("text", F.lit("")))
    return docs.groupBy(group).agg(
        F.count("*").alias("n"),
        F.count_distinct(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("n_texts"),
        F.sum(size).alias("chars"), F.min(size).alias("shortest"), F.max(size).alias("longest"),
        F.count_if(size == 0).alias("empty"),
    )


def same_texts(docs: DataFrame, row_id: str, by: str) -> DataFrame:
    """Groups of rows of one ``by`` whose lower-case, squeezed texts are equal: least id and number.

    Only the digest goes through the shuffle, and sums instead of the ids: a group may be large.
    """
    key = F.sha2(F.lower(squeeze(F.coalesce("text", F.lit("")))), 256)
    out = docs.select(by, row_id, key.alias("digest")).groupBy(by, "digest")
    return out.agg(F.min(row_id).alias("first_id"), F.count("*").alias("n")).filter("n > 1")


def split_words(chunks: DataFrame, by: str, order: str) -> DataFrame:
    """Chunks that start inside a word which the chunk before has begun."""
    before = F.lag("text").over(W.partitionBy(by).orderBy(order))
    cut = F.col("_before").rlike(r"\p{L}-?$") & F.col("text").rlike(r"^\p{Ll}")
    return chunks.withColumn("_before", before).filter(cut).drop("_before")

