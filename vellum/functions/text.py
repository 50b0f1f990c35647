"""Text functions: native columns where the JVM's rules are the wanted ones, small Arrow UDFs else."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"
#: Letters that Unicode decomposition leaves alone but readers take for a plain letter.
UNDECOMPOSED = str.maketrans({"đ": "d", "Đ": "D", "Ð": "D"})
_SPACES = r"(?U)\s+"


def arrow_udf(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """A function of series as a function of columns; the UDF is made where it is used, since
    workers import this module without a session."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def use(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return use

    return wrap


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; a lambda that names a column's expression computes it at each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


# -- Unicode: needs Python's tables ---------------------------------------------------------------
@arrow_udf("string")
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _clean_lines(text: str) -> str:
    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")
    rows = [r.rstrip() for r in text.split("\n")]
    held = [k for k, r in enumerate(rows) if r]
    return "\n".join(rows[held[0] : held[-1] + 1]) if held else ""


@arrow_udf("string")
def clean_lines(texts: pd.Series) -> pd.Series:
    """NFC, ``\\n`` as the only line end, no space at line ends, no blank lines around the text."""
    return texts.map(_clean_lines, na_action="ignore")


def _fold_accents(text: str) -> str:
    apart = unicodedata.normalize("NFD", text)
    return "".join(c for c in apart if unicodedata.category(c) != "Mn").translate(UNDECOMPOSED)


@arrow_udf("string")
def fold_accents(texts: pd.Series) -> pd.Series:
    """The text without combining marks."""
    return texts.map(_fold_accents, na_action="ignore")


@arrow_udf("string")
def casefold(texts: pd.Series) -> pd.Series:
    """Full case folding, which ``lower`` isn't (ß)."""
    return texts.str.casefold()


# -- spaces, slugs, keys --------------------------------------------------------------------------
def squeeze(text: Column) -> Column:
    """Runs of any Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def slug(text: Column, mark: str = "-") -> Column:
    """Accents folded, lower case, other runs than a-z and 0-9 become ``mark``."""
    plain = F.regexp_replace(F.lower(fold_accents(text)), "[^a-z0-9]+", mark)
    return F.regexp_replace(plain, f"^{mark}+|{mark}+$", "")


def ascii_slug(text: Column, mark: str = "-") -> Column:
    """``slug`` of text that has no accents worth keeping: no Python."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", mark)
    return F.regexp_replace(plain, f"^{mark}+|{mark}+$", "")


def match_key(text: Column) -> Column:
    """Folded words with single spaces: for comparing what people typed."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(text)), "[^a-z0-9]+", " "))


def query_key(text: Column) -> Column:
    """Lower case, single spaces: two spellings of a query with the same key are one query."""
    return F.lower(squeeze(text))


def query_hash(text: Column) -> Column:
    """SHA-256 of the text without outer white space."""
    return F.sha2(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), 256)


def typed_carelessly(text: Column, short: dict[str, str]) -> Column:
    """No accents, and words written as the abbreviations of ``short`` (word to short form)."""
    out = fold_accents(text)
    for word, brief in short.items():
        out = F.regexp_replace(out, rf"(?i)\b{re.escape(word)}\b", brief)
    return out


# -- labels and previews --------------------------------------------------------------------------
def without_marks(text: Column) -> Column:
    """Markdown's emphasis, heading and code marks removed, spaces squeezed."""
    plain = F.regexp_replace(text, r"(?m)^\s{0,3}(#{1,6}|>|[-*+]|[0-9]+\.)\s+", "")
    return squeeze(F.regexp_replace(plain, r"[*_`|]+", " "))


def cut_at_word(text: Column, most: int, least: int = 24) -> Column:
    """At most ``most`` characters, ended at a space if one stands beyond ``least`` characters."""
    head = F.substring(text, 1, most)
    at_word = F.regexp_replace(head, r"\s+\S*\z", "")
    cut = F.when(F.length(at_word) >= least, at_word).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.rtrim(cut))


def snippet(text: Column, most: int) -> Column:
    """One line without table rules and pipes, cut at a word with an ellipsis."""
    if most < 1:
        raise ValueError("a snippet has at least one character")
    no_rules = F.regexp_replace(text, r"(?m)^[\s&&[^\n]]*\|[|:\s&&[^\n]]*-[-|: ]*$", " ")
    flat = squeeze(F.regexp_replace(no_rules, r"\|", " "))
    head = F.substring(flat, 1, most - 1)
    whole = F.substring(flat, most, 1) == " "
    at_word = F.regexp_replace(head, r" [^ ]*$", "")
    ended = F.when(whole | (F.instr(head, " ") == 0) | (at_word == ""), head).otherwise(at_word)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(ended), F.lit(ELLIPSIS)))


def upper_share(text: Column) -> Column:
    """Share of upper-case letters among the letters; 0 without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    upper = F.regexp_count(text, F.lit(r"\p{Lu}"))
    return F.when(letters > 0, upper / letters).otherwise(F.lit(0.0))


def headings(text: Column) -> Column:
    """The titles of all markdown headings, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}[ \t]+(\S[^\n]*?)[ \t]*$"), 1)


def numbered_depth(label: Column) -> Column:
    """Depth of a heading by its numbering (``2.1.3`` has 3, ``A.`` 1); 0 without one."""
    dotted = F.regexp_extract(label, r"^\s*([0-9]+(?:\.[0-9]+)*)[.)]?\s", 1)
    lettered = F.when(label.rlike(r"^\s*(?:[A-Z]|[IVX]+)[.)]\s"), 1).otherwise(0)
    return F.when(dotted == "", lettered).otherwise(F.size(F.split(dotted, r"\.")))


def spaced_numbers(text: Column) -> Column:
    """A space between a number and a word of two or more letters that sticks to it."""
    return F.regexp_replace(text, r"(?<=\p{N})(?=\p{Ll}{2,})", " ")


# -- pipe tables ----------------------------------------------------------------------------------
def table_rows(markdown: Column) -> Column:
    """The lines of a pipe table, trimmed, its rule line left out."""
    lines = F.transform(F.split(markdown, "\n"), lambda s: F.trim(s))
    return F.filter(lines, lambda s: s.startswith("|") & ~s.rlike(r"^\|[-:|\s]*$"))


def row_cells(row: Column) -> Column:
    """The trimmed cells of a table row."""
    inner = F.regexp_replace(row, r"^\s*\||\|\s*$", "")
    return F.transform(F.split(inner, r"\|"), lambda s: F.trim(s))


def table_cells(markdown: Column) -> Column:
    """All cells of a table that aren't empty, row by row."""
    return F.filter(F.flatten(F.transform(table_rows(markdown), row_cells)), lambda c: c != "")


def padded_rows(rows: Column) -> Column:
    """Rows (arrays of cells) filled up with empty cells to the widest."""

    def filled(own: Column, widest: Column) -> Column:
        return F.transform(own, lambda r: F.concat(r, F.array_repeat(F.lit(""), widest - F.size(r))))

    return bound(rows, lambda own: bound(F.array_max(F.transform(own, F.size)), lambda widest: filled(own, widest)))


def is_data_row(row: Column, units: tuple[str, ...] = (), openings: tuple[str, ...] = ()) -> Column:
    """A row of values rather than names: no rule line, two cells at least that aren't empty, and
    two digits, or a digit and one of ``units``, or a first cell that starts with one of ``openings``."""

    def valued(cells: Column) -> Column:
        joined = F.lower(F.array_join(cells, " "))
        digits = F.regexp_count(joined, F.lit(r"\p{Nd}"))
        with_unit = any_of(joined, units) & (digits >= 1) if units else F.lit(False)
        opened = F.lower(F.try_element_at(cells, F.lit(1)))
        opens = F.exists(F.array(*map(F.lit, openings)), lambda o: opened.startswith(o)) if openings else F.lit(False)
        return (F.size(cells) >= 2) & ((digits >= 2) | with_unit | opens)

    rule = row.rlike(r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$")
    return ~rule & bound(F.filter(row_cells(row), lambda c: c != ""), valued)


def any_of(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether the text contains one of the words."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if words else F.lit(False)


# -- tokens ---------------------------------------------------------------------------------------
def tokens(text: Column) -> Column:
    """Lower-case runs of letters or of numbers, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\p{N}+)"), 1)


def content_tokens(text: Column, stop: list[str], least: int = 3) -> Column:
    """Distinct tokens of ``least`` characters or more that aren't stop words, sorted."""
    long = F.filter(tokens(text), lambda t: F.length(t) >= least)
    return F.array_sort(F.array_except(F.array_distinct(long), F.array(*map(F.lit, stop))))


def word_grams(text: Column, longest: int = 3) -> Column:
    """Distinct runs of 1 to ``longest`` tokens joined by spaces, sorted."""

    def grams(words: Column, n: int) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - n))
        each = F.transform(places, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))
        return F.when(F.size(words) >= n, each).otherwise(F.array().cast("array<string>"))

    def all_sizes(words: Column) -> Column:
        return F.flatten(F.array(words, *[grams(words, n) for n in range(2, longest + 1)]))

    return F.array_sort(F.array_distinct(bound(tokens(text), all_sizes)))


def tokens_inside(text: Column, wanted: Column) -> Column:
    """How many of the array ``wanted`` the text contains."""
    return F.size(F.filter(wanted, lambda t: F.contains(text, t)))


# -- citations in answers -------------------------------------------------------------------------
_SENTENCE_END = r"(?U)(?<=[.!?])\s+|\n+"
#: What counts as white space around a sentence: that of Unicode and the four separators of ASCII.
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: Stands for a number that is too large for any block.
_BEYOND = 2**63 - 1


def stripped(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, _EDGES, "")


def sentences(text: Column) -> Column:
    """Stripped sentences and lines that aren't empty."""
    found = F.transform(F.split(text, _SENTENCE_END), stripped)
    return F.filter(found, lambda s: s != "")


def _number(digits: Column) -> Column:
    return F.coalesce(digits.try_cast("bigint"), F.when(digits.rlike("^[0-9]+$"), F.lit(_BEYOND)))


def cited_numbers(text: Column) -> Column:
    """The numbers in ``[n]`` marks, distinct, in order of their first use."""
    found = F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), 1)
    return F.array_distinct(F.transform(found, _number))


def marked_sentences(text: Column) -> Column:
    """Each sentence with a ``[n]`` mark beside the numbers of its marks."""
    each = F.transform(
        sentences(text), lambda s: F.struct(s.alias("sentence"), cited_numbers(s).alias("numbers"))
    )
    return F.filter(each, lambda s: F.size(s["numbers"]) > 0)


def stated_sentences(text: Column, least: int = 4) -> Column:
    """What a text states: sentences of at least ``least`` words, marks not counted, outside headings, rules and tables."""

    def counts(s: Column) -> Column:
        words = F.split(stripped(F.regexp_replace(s, r"\[[0-9]+\]", "")), r"(?U)\s+")
        return ~s.rlike(r"^(#|---|\|)") & (F.size(words) >= least)

    return F.filter(sentences(text), counts)


def context_blocks(text: Column) -> Column:
    """A map from number to text of blocks that start with ``[n] `` at a line's start.

    Of blocks with the same number the last counts.
    """
    blocks = F.filter(F.split(text, r"(?m)^(?=\[[0-9]+\] )"), lambda p: p.rlike(r"^\[[0-9]+\] "))
    pairs = F.transform(
        blocks,
        lambda p: F.struct(
            _number(F.regexp_extract(p, r"^\[([0-9]+)\] ", 1)).alias("key"),
            stripped(F.regexp_replace(p, r"^\[[0-9]+\] ", "")).alias("value"),
        ),
    )
    later = lambda p, k: F.exists(F.slice(pairs, k + 2, F.size(pairs)), lambda q: q["key"] == p["key"])
    return F.map_from_entries(F.filter(pairs, lambda p, k: ~later(p, k)))


def only_known_citations(text: Column, known: Column) -> Column:
    """The text without those ``[n]`` marks whose number isn't one of 1 to ``known``."""
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\[[0-9]+\])"), 1))
    bad = F.filter(marks, lambda m: ~_number(F.regexp_extract(m, "([0-9]+)", 1)).between(1, known))
    return F.aggregate(bad, text, lambda out, m: F.replace(out, m, F.lit("")))


def first_group(text: Column, groups: dict[str, str]) -> Column:
    """The name of the first pattern of ``groups`` that the squeezed, lower-case text meets."""
    folded = query_key(text)
    return F.coalesce(*[F.when(folded.rlike(p), F.lit(name)) for name, p in groups.items()])
