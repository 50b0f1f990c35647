"""Gold questions from sections: categories, templates in turn, unique questions, judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.operators.relations import earliest
from vellum.operators.sampling import in_turns
from vellum.storage import with_positions


def category_of(text: Column, rules: dict[str, list[str]], other: str) -> Column:
    """The first category one of whose keywords the lower-case text contains."""
    folded = F.lower(text)
    hits = [
        F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(folded, w)), F.lit(name))
        for name, words in rules.items()
    ]
    return F.coalesce(*hits, F.lit(other))


def templated(label: Column, variant: Column, templates: list[str]) -> Column:
    """The template of the variant's turn with ``{}`` replaced by the label."""
    listed = F.array(*map(F.lit, templates))
    chosen = F.element_at(listed, F.pmod(variant, F.lit(len(templates))).cast("int") + 1)
    return F.replace(chosen, F.lit("{}"), label)


def questions(sections: DataFrame, templates: dict[str, list[str]], variants: int) -> DataFrame:
    """Questions of each section: one per variant, from the templates of its category.

    ``sections (section_id, label, category)``; columns ``section_id``, ``category``, ``variant``,
    ``query``.
    """
    each = sections.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    by_category = [
        F.when(F.col("category") == c, templated(F.col("label"), F.col("variant"), t)) for c, t in templates.items()
    ]
    out = each.withColumn("query", F.coalesce(*by_category)).filter("query is not null")
    return out.select("section_id", "category", "variant", "query")


#: Kinds of chunks and sections that questions are asked of: fixed values.
RISKY_STRATEGIES = ("chunk_window", "search_only")
RISKY_ROLES = ("table", "index_entry", "appendix_list")
LEAFLET_TYPE, LEAFLET_PREFIX = "brand_page", "leaflet:"


def is_leaflet_section(content_type: Column, section_id: Column) -> Column:
    """A leaflet's section: a page of a brand whose id says so."""
    return F.coalesce((content_type == LEAFLET_TYPE) & section_id.startswith(LEAFLET_PREFIX), F.lit(False))


def is_chunk_risk(strategy: Column, content_type: Column, role: Column) -> Column:
    """A chunk that retrieval may miss or cut: read by a window or only searched, a table, a list."""
    risky = (strategy.isin(*RISKY_STRATEGIES), content_type == "table", role.isin(*RISKY_ROLES))
    return F.coalesce(risky[0], F.lit(False)) | F.coalesce(risky[1], F.lit(False)) | F.coalesce(risky[2], F.lit(False))


def chunk_risk_candidates(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Risky chunks with their section, numbered in the order of ``chunk_key`` (null as 0) and ``chunk_id``.

    ``chunks (chunk_id, chunk_key, section_id, hydrate_strategy, chunk_content_type, chunk_role, …)``;
    chunks without a section of ``sections (section_id, …)`` are no candidates.
    """
    risky = chunks.filter(is_chunk_risk(F.col("hydrate_strategy"), F.col("chunk_content_type"), F.col("chunk_role")))
    both = risky.withColumn("chunk_key", F.coalesce("chunk_key", F.lit(0))).join(sections, "section_id")
    return with_positions(both, [F.col("chunk_key"), F.col("chunk_id")]).drop("group_rows")


def unique_questions(candidates: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Each query text once: that of the first candidate in order."""
    return earliest(candidates, ["query"], *order)


def suffixed_questions(candidates: DataFrame, label: str, row_id: str) -> DataFrame:
    """Query texts made unique: a repeat gets its label, a repeat of that its id, then a number."""
    out = candidates
    for step, extra in enumerate((F.col(label), F.col(row_id).cast("string"), None)):
        n = F.row_number().over(W.partitionBy("query").orderBy(row_id))
        end = F.concat(F.lit("#"), n) if extra is None else F.concat(F.lit("("), extra, F.lit(")"))
        out = out.withColumn(f"_n{step}", n).withColumn(
            "query", F.when(F.col(f"_n{step}") > 1, F.concat_ws(" ", "query", end)).otherwise(F.col("query"))
        )
    return out.drop("_n0", "_n1", "_n2")


def gold_rows(candidates: DataFrame, targets: dict[str, int]) -> DataFrame:
    """The first questions of each category up to its target, categories in turn, numbered.

    ``row_number() <= target`` bounds what a category sends to its window.
    """
    most = max(targets.values())
    each = in_turns(candidates, "category", [F.col("section_id"), F.col("variant")], k=most)
    quota = F.coalesce(*[F.when(F.col("category") == c, F.lit(n)) for c, n in targets.items()])
    kept = each.filter(F.col("turn") <= quota)
    number = F.row_number().over(W.orderBy("turn", "category"))  # as many rows as targets ask for
    return kept.withColumn("query_id", F.format_string("q-%05d", number))


def eval_tags(row: dict[str, Column]) -> Column:
    """Sorted distinct tags of those conditions that hold."""
    tags = F.array(*[F.when(c, F.lit(t)) for t, c in row.items()])
    return F.array_sort(F.array_distinct(F.array_compact(tags)))


def term_sections(sections: DataFrame, terms: str) -> DataFrame:
    """Inverted index: ``term``, its sorted sections and their number."""
    each = sections.select("section_id", F.explode(F.array_distinct(terms)).alias("term")).filter("term <> ''")
    found = F.array_sort(F.collect_set("section_id"))
    return each.groupBy("term").agg(found.alias("section_ids")).withColumn("n", F.size("section_ids"))


def shared_terms(sections: DataFrame, terms: str) -> DataFrame:
    """Terms of several sections."""
    return term_sections(sections, terms).filter("n > 1")


def judgments(gold: DataFrame, accepted: DataFrame) -> DataFrame:
    """Per query and gold section the chunks that count besides its own.

    ``gold (query_id, section_id, slug, intent)``, ``accepted (slug, intent, chunk_id)``.
    """
    pairs = gold.join(accepted, ["slug", "intent"])
    return pairs.groupBy("query_id", "section_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def blocked_matches(left: DataFrame, right: DataFrame, words: str = "words") -> DataFrame:
    """Pairs whose sets of words are equal, met by their least word: ``left_id``, ``right_id``.

    The blocking key is the smallest word, so that equal sets share it and most others don't.
    """
    a = left.withColumn("w", F.array_sort(F.array_distinct(words))).withColumn("block", F.try_element_at("w", F.lit(1)))
    b = right.withColumn("v", F.array_sort(F.array_distinct(words))).withColumn("block", F.try_element_at("v", F.lit(1)))
    pairs = a.select("left_id", "w", "block").join(b.select("right_id", "v", "block"), "block")
    return pairs.filter(F.col("w") == F.col("v")).select("left_id", "right_id")


def carried_intents(lines: DataFrame, intents: dict[str, str]) -> DataFrame:
    """Per chunk the intents in force: a heading's intent holds over lines and chunks until the next.

    ``lines (section_id, chunk_no, line_no, line)``; ``intents`` maps lower-case headings.
    """
    heading = F.lower(F.trim(F.regexp_replace("line", r"^#+\s*|[:\s]+$", "")))
    named = F.coalesce(*[F.when(heading == h, F.lit(i)) for h, i in intents.items()])
    upto = W.partitionBy("section_id").orderBy("chunk_no", "line_no").rowsBetween(W.unboundedPreceding, 0)
    held = lines.withColumn("intent", F.last(named, ignorenulls=True).over(upto))
    return held.groupBy("section_id", "chunk_no").agg(F.array_sort(F.collect_set("intent")).alias("intents"))


def changed_items(old: DataFrame, new: DataFrame, key: str, asked: list[str], judged: list[str]) -> DataFrame:
    """What two versions of a gold set ask to redo: ``answer``, ``judge``, ``drop`` or ``keep``."""
    def prints(df: DataFrame, tag: str) -> DataFrame:
        a = F.sha2(F.to_json(F.struct(*asked)), 256).alias(f"{tag}_asked")
        j = F.sha2(F.to_json(F.struct(*judged)), 256).alias(f"{tag}_judged")
        return df.select(key, a, j)

    both = prints(old, "old").join(prints(new, "new"), key, "full_outer")
    action = (
        F.when(F.col("new_asked").isNull(), "drop")
        .when(F.col("old_asked").isNull() | (F.col("old_asked") != F.col("new_asked")), "answer")
        .when(F.col("old_judged") != F.col("new_judged"), "judge")
        .otherwise("keep")
    )
    return both.select(key, action.alias("action"))
