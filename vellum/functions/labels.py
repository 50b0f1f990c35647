"""Names, labels and rule tables: what a corpus of one field needs comes in as parameters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import bound, fold_accents, match_key, slug, squeeze


def replaced_all(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered pattern replacements: the form that any list of text repairs takes."""
    for pattern, put in rules:
        text = F.regexp_replace(text, pattern, put)
    return text


def canonical_label(line: Column, labels: dict[str, list[str]]) -> Column:
    """The label one of whose spellings is the line's folded text, or its start before a colon."""

    def key(folded: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " "))

    def hit(k: Column) -> Column:
        return F.coalesce(*[F.when(k["plain"].isin(names) | k["head"].isin(names), F.lit(name)) for name, names in labels.items()])

    # folding moves no colon, so the line is folded once
    folded = fold_accents(F.regexp_replace(line, r"[*#_]+", " "))
    return bound(F.struct(key(folded).alias("plain"), key(F.split_part(folded, F.lit(":"), F.lit(1))).alias("head")), hit)


def is_title(line: Column, stop: list[str], longest: int = 90, share: float = 0.75, fields: tuple[str, ...] = ()) -> Column:
    """A line that looks like a document's title: short, mostly upper case, no digits or sentence end.

    What stands in brackets counts for nothing, and lines that start with one of ``fields`` (in
    folded form) are no titles.
    """
    bare = F.regexp_replace(line, r"\([^)]*\)", "")
    letters = F.regexp_count(bare, F.lit(r"\p{L}"))
    upper = F.regexp_count(bare, F.lit(r"\p{Lu}"))
    folded = match_key(line)
    field = F.exists(F.array(*map(F.lit, fields)), lambda f: folded.startswith(f)) if fields else F.lit(False)
    return (
        F.length(line).between(3, longest)
        & (letters >= 3)
        & (upper >= share * letters)
        & ~field
        & ~line.rlike(r"[.;:]\s*$|^\s*[0-9|]")
        & ~match_key(line).isin(stop)
    )


def section_id(kind: Column, title: Column, heading: Column, path: Column) -> Column:
    """A readable id of a section: its folded names with dots between."""
    parts = F.concat(F.array(kind, title, heading), F.coalesce(path, F.array().cast("array<string>")))
    return F.array_join(F.filter(F.transform(F.array_distinct(parts), lambda p: F.lower(squeeze(p))), lambda p: p != ""), ".")


def slugs(parts: list[Column]) -> Column:
    """Slugs of several columns joined by dots: with accents folded."""
    return F.concat_ws(".", *[slug(p) for p in parts])


def inline_headings(line: Column, labels: list[str]) -> Column:
    """The line cut before each bold label inside it; parts trimmed, none empty."""
    names = "|".join(re.escape(x) for x in sorted(labels, key=len, reverse=True))
    parts = F.split(line, rf"(?i)(?=\*\*(?:{names})\*\*)")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def names_in_title(title: Column, stop: list[str]) -> Column:
    """A title's names: without brackets, and also cut before the first stop word."""
    plain = squeeze(F.regexp_replace(title, r"\([^)]*\)", " "))
    words = "|".join(map(re.escape, stop))
    short = squeeze(F.regexp_replace(plain, rf"(?i)\b(?:{words})\b.*$", ""))
    return F.array_distinct(F.filter(F.array(plain, short), lambda n: n != ""))


def dosed_names(line: Column, dose: str, split: str, prefix: str, connectors: tuple[str, ...], fillers: tuple[str, ...] = ()) -> Column:
    """The folded names before the doses of a composition line, in order; a name that can't be read is null.

    Brackets count for nothing.  In a table row the first cell with a dose is named by what stands
    before the dose or else by the cell before; other lines are cut by ``split``, and each dose is
    named by what stands between it and the one before.  ``prefix`` (a pattern) and leading
    ``connectors`` are no part of a name; names that start with one of ``fillers`` name nothing.
    """
    dosed = rf"(?i)^(.*?)(?:{dose})"
    none = F.array().cast("array<string>")

    def cell(cells: Column, at: Column) -> Column:
        before = F.when(at > 1, F.try_element_at(cells, F.greatest(at - 1, F.lit(1)))).otherwise("")
        own = F.trim(F.regexp_extract(F.try_element_at(cells, at), dosed, 1))
        return F.when(at > 0, bound(own, lambda o: F.array(F.when(o != "", o).otherwise(before)))).otherwise(none)

    def row(cells: Column) -> Column:
        at = F.array_position(F.transform(cells, lambda c: c.rlike(dosed)), True).cast("int")
        return bound(at, lambda a: cell(cells, a))

    def names(plain: Column) -> Column:
        cells = F.filter(F.transform(F.split(F.regexp_replace(F.trim(plain), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)), lambda c: c != "")
        parts = F.transform(F.split(plain, split), lambda s: F.regexp_extract_all(s, F.lit(rf"(?i)(.*?)(?:{dose})"), 1))
        return F.when(F.contains(plain, F.lit("|")), bound(cells, row)).otherwise(F.flatten(parts))

    lead = "|".join(map(re.escape, connectors)) or "(?!)"

    def key(name: Column) -> Column:
        folded = F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, prefix, "")), "[^a-z0-9]+", " "))
        return bound(F.regexp_replace(folded, rf"^(?:(?:{lead})\s+)+|^(?:{lead})$", ""), known)

    def known(words: Column) -> Column:
        filler = F.exists(F.array(*map(F.lit, fillers)), lambda f: words.startswith(f)) if fillers else F.lit(False)
        return F.when(~words.rlike("[a-z]"), F.lit(None)).when(filler, "").otherwise(words)

    plain = F.regexp_replace(fold_accents(line), r"\([^)]*\)", " ")
    return F.filter(F.transform(bound(plain, names), key), lambda k: k.isNull() | (k != ""))


def respelled(words: Column, rules: list[tuple[str, str]], ending: str = "e") -> Column:
    """Words in one spelling: ordered replacements, and a final letter of long words dropped."""

    def one(w: Column) -> Column:
        for old, new in rules:
            w = F.replace(w, F.lit(old), F.lit(new))
        return F.when((F.length(w) > 4) & w.endswith(ending), F.left(w, F.length(w) - 1)).otherwise(w)

    return F.transform(words, one)


def same_parts(listed: Column, parts: Column, extra: list[str]) -> Column:
    """Whether two lists of word arrays name the same things, words of ``extra`` at the end apart."""
    ends = F.array(*map(F.lit, extra))
    bare = F.transform(listed, lambda ws: F.array_join(F.filter(ws, lambda w: ~F.array_contains(ends, w)), " "))
    wanted = F.transform(parts, lambda ws: F.array_join(ws, " "))
    return (F.size(bare) > 0) & (F.array_sort(F.array_distinct(bare)) == F.array_sort(F.array_distinct(wanted)))


def flattened_layout(markdown: Column) -> Column:
    """One-column tables, which only lay out text, as plain paragraphs."""
    rule = r"(?m)^\|\s*:?-+:?\s*\|[ \t]*$\n?"
    return F.regexp_replace(F.regexp_replace(markdown, rule, ""), r"(?m)^\|([^|\n]*)\|[ \t]*$", "$1")


def page_label(first: Column, last: Column, word: str = "page") -> Column:
    """``page 3-5``; empty without pages."""
    low, high = F.coalesce(first, last), F.coalesce(last, first)
    number = F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low, high))
    return F.coalesce(F.concat(F.lit(f"{word} "), number), F.lit(""))
