"""Joins, constraint checks, set algebra and ordered folds that recur over all tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.storage import saved, with_positions

#: Rows of a table that each task may hold.
SMALL_ROWS = 1_000_000


# -- lookups --------------------------------------------------------------------------------------
def pick_rows(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in the table of keys, once each."""
    return df.join(keys.select(*on), on, "left_semi")


def with_counts(parents: DataFrame, children: DataFrame, on: str, name: str) -> DataFrame:
    """Parents with their number of children, 0 where there is none; children are counted first."""
    counts = children.groupBy(on).agg(F.count("*").alias(name))
    return parents.join(counts, on, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def members(links: DataFrame, by: str, item: str, name: str) -> DataFrame:
    """The sorted distinct items of each ``by``."""
    return links.groupBy(by).agg(F.array_sort(F.collect_set(item)).alias(name))


def first_match(df: DataFrame, rules: DataFrame, key: str, keys: str, place: str) -> DataFrame:
    """For each row the first rule, by ``place``, whose array ``keys`` holds the row's ``key``.

    The rules are a small table next to the rows; they are reduced to one per key before the join.
    """
    others = [c for c in rules.columns if c not in (keys, place)]
    each = rules.select(F.explode(keys).alias(key), place, *others)
    best = each.groupBy(key).agg(F.min_by(F.struct(*others), place).alias("rule"))
    return df.join(best, key, "left")


def only_match(df: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """The name equal to the row's key, else the only one of which one is a prefix of the other.

    Prefix pairs meet by an equi-join: of the key's prefixes with the names, and of the names'
    prefixes with the keys.  ``matched`` is null where none or several match.
    """
    def heads(c: str) -> Column:
        n = F.length(c)
        return F.transform(
            F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>")),
            lambda i: F.substring(F.col(c), F.lit(1), i),
        )

    keys = df.select(key).distinct()
    known = names.select(F.col(name).alias("matched")).distinct()
    under = keys.select(key, F.explode(heads(key)).alias("head")).join(
        known, F.col("head") == F.col("matched")
    )
    over = known.select("matched", F.explode(heads("matched")).alias("head")).join(
        keys, F.col("head") == F.col(key)
    )
    found = under.select(key, "matched").unionByName(over.select(key, "matched")).distinct()
    best = found.groupBy(key).agg(
        F.max(F.when(F.col(key) == F.col("matched"), F.col("matched"))).alias("exact"),
        F.count("*").alias("n"),
        F.min("matched").alias("one"),
    )
    chosen = F.coalesce("exact", F.when(F.col("n") == 1, F.col("one"))).alias("matched")
    return df.join(best.select(key, chosen), key, "left")


def overlapping(a: DataFrame, b: DataFrame, on: str, span: int = 64) -> DataFrame:
    """Pairs of rows with equal ``on`` whose closed intervals [start, end] meet.

    An interval goes to each cell of ``span`` numbers that it touches; a pair counts in the cell
    where the later of the two starts, so it comes once and no group is joined as a whole.
    Columns of ``b`` get the prefix ``b_``; nulls count as 0.
    """
    def cells(df: DataFrame) -> DataFrame:
        df = df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("start", "end")}).filter("start <= end")
        low, high = F.floor(F.col("start") / span), F.floor(F.col("end") / span)
        return df.withColumn("_cell", F.explode(F.sequence(low, high)))

    right = cells(b).select(on, "_cell", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != on])
    both = cells(a).join(right, [on, "_cell"])
    later = F.floor(F.greatest("start", "b_start") / span)
    meets = (F.col("start") <= F.col("b_end")) & (F.col("b_start") <= F.col("end"))
    return both.filter(meets & (F.col("_cell") == later)).drop("_cell")


def overlapping_rows(a: DataFrame, b: DataFrame, on: str, small: int = SMALL_ROWS) -> DataFrame:
    """The rows of ``overlapping``, for tables in which many rows have one span.

    Distinct spans are paired; then each row takes the partners of its span, so that no two rows are
    compared that don't meet.  Where the pairs of spans and ``b`` have up to ``small`` rows each, ``a`` is not shuffled.
    Rows of ``a`` that meet something are sorted by span within their task: rows of one span, which have one list of
    partners, follow each other, so that the result, which grows with the square, takes little space in column files.
    """
    a, b = (df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("start", "end")}) for df in (a, b))
    span, other = [on, "start", "end"], [on, "b_start", "b_end"]
    pairs = saved(overlapping(a.select(*span).distinct(), b.select(*span).distinct(), on), "spans")
    right = b.select(on, *[F.col(c).alias(f"b_{c}") for c in b.columns if c != on])
    if max(pairs.count(), right.count()) <= small:
        met = pairs.groupBy(*span).agg(F.collect_list(F.struct("b_start", "b_end")).alias("_met"))
        near = a.join(F.broadcast(met), span).sortWithinPartitions(*span)  # a sort right below a join would be left out
        each = near.select(*a.columns, F.explode("_met").alias("_met")).select(*a.columns, "_met.*")
        out = each.join(F.broadcast(right), other)
    else:  # spans of ``a`` are the finer key, rows of ``b`` go to these
        out = a.join(pairs.join(right, other), span)
    return out.select(*a.columns, *[c for c in right.columns if c != on])


def nearest_overlap(a: DataFrame, b: DataFrame, on: str, id_: str) -> DataFrame:
    """Rows of ``a`` with ``b_<id_>``: of the rows of ``b`` that ``overlapping`` pairs with it the one with the
    nearest start, then the least id.  Rows that meet nothing go.

    The answer follows from the span alone, and of several rows of ``b`` with one span only the least id can
    be it.  So distinct spans are paired, and each row of ``a`` is joined once with its span's answer.
    """
    span = [on, "start", "end"]
    a = a.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("start", "end")})
    few = b.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("start", "end")}).groupBy(*span).agg(F.min(id_).alias(id_))
    pairs = overlapping(a.select(*span).distinct(), few, on)
    gap = F.abs(F.col("start") - F.col("b_start"))
    best = pairs.groupBy(*span).agg(F.min(F.struct(gap.alias("gap"), F.col(f"b_{id_}").alias("id"))).alias("best"))
    return a.join(best.select(*span, F.col("best.id").alias(f"b_{id_}")), span)


def best_candidate(candidates: DataFrame, by: str, *order: Column) -> DataFrame:
    """The best candidate of each row by the given order."""
    place = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return candidates.withColumn("_place", place).filter("_place = 1").drop("_place")


def same_title_pairs(rows: DataFrame, pairs: DataFrame, row_id: str) -> DataFrame:
    """Pairs of rows of one title whose categories are a listed pair.

    The pair table turns the self-join into an equi-join on title and category.
    """
    left = rows.select("title", F.col("category").alias("first_category"), F.col(row_id).alias("first"))
    right = rows.select("title", F.col("category").alias("second_category"), F.col(row_id).alias("second"))
    return (
        left.join(pairs.select("first_category", "second_category"), "first_category")
        .join(right, ["title", "second_category"])
        .filter("first <> second")
    )


def listing_changes(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys with their ``status``: missing, unexpected, changed or same."""
    both = expected.select(key, F.col(digest).alias("_want")).join(
        actual.select(key, F.col(digest).alias("_have")), key, "full_outer"
    )
    status = (
        F.when(F.col("_have").isNull(), "missing")
        .when(F.col("_want").isNull(), "unexpected")
        .when(F.col("_want") != F.col("_have"), "changed")
        .otherwise("same")
    )
    return both.select(key, status.alias("status"))


# -- set algebra over keys ------------------------------------------------------------------------
def three_way(wanted: DataFrame, cached: DataFrame, bundled: DataFrame, key: str) -> DataFrame:
    """Each wanted key once, with its ``origin``: cached, bundled or to compute."""
    keys = wanted.select(key).distinct()
    out = keys.join(cached.select(key).distinct().withColumn("_c", F.lit(True)), key, "left")
    out = out.join(bundled.select(key).distinct().withColumn("_b", F.lit(True)), key, "left")
    origin = F.when(F.col("_c"), "cached").when(F.col("_b"), "bundled").otherwise("compute")
    return out.select(key, origin.alias("origin"))


def replaced(df: DataFrame, is_old: Column, new: DataFrame) -> DataFrame:
    """The rows that aren't old, and the new ones."""
    return df.filter(~F.coalesce(is_old, F.lit(False))).unionByName(new)


def merged(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Old and new records by key; the old one stays and ``conflict`` tells that they differ."""
    both = old.select(*key, F.struct(*columns).alias("_old")).join(
        new.select(*key, F.struct(*columns).alias("_new")), key, "full_outer"
    )
    differ = F.col("_old").isNotNull() & F.col("_new").isNotNull() & (F.col("_old") != F.col("_new"))
    kept = both.withColumn("_kept", F.coalesce("_old", "_new"))
    return kept.select(*key, *[F.col(f"_kept.{c}").alias(c) for c in columns], differ.alias("conflict"))


# -- keys and order -------------------------------------------------------------------------------
def latest(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last row of each key; a maximum, so that a hot key is reduced before the shuffle."""
    others = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return last.select(*key, *[F.col(f"_row.{c}").alias(c) for c in others])


def earliest(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    others = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return first.select(*key, *[F.col(f"_row.{c}").alias(c) for c in others])


def upserted(old: DataFrame, new: DataFrame, key: list[str], replace: bool = True) -> DataFrame:
    """Rows by key: new ones replace old ones, or (``replace`` false) only fill gaps."""
    if replace:
        return old.join(new, key, "left_anti").unionByName(new)
    return old.unionByName(new.join(old, key, "left_anti"))


def orphans(children: DataFrame, parents: DataFrame, on: str) -> DataFrame:
    """Children without a parent."""
    return children.join(parents.select(on), on, "left_anti")


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that several rows have, blank ones left out, with their number."""
    out = df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    return out.filter(reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) != "" for k in key]))


def numbered_repeats(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Names made unique: the n-th repeat (from the second) gets ``:part-NNN``.

    ``order`` ends with a unique column.  A name may have most of the rows: they are numbered by
    ranges.
    """
    n = F.col("position")
    unique = F.when(n == 1, F.col(name)).otherwise(F.concat(name, F.format_string(":part-%03d", n)))
    placed = with_positions(df, [F.col(c) for c in order], (name,))
    return placed.withColumn("unique_name", unique).drop("position", "group_rows")


def runs(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Runs of consecutive whole numbers per group: ``first``, ``last``, ``n`` (gaps and islands).

    A group may have most of the numbers: they are numbered by ranges.
    """
    distinct = df.select(*by, F.col(number).cast("long").alias("x")).distinct().filter("x is not null")
    placed = with_positions(distinct, [F.col("x")], tuple(by))
    return (
        placed.withColumn("_island", F.col("x") - F.col("position"))
        .groupBy(*by, "_island")
        .agg(F.min("x").alias("first"), F.max("x").alias("last"), F.count("*").alias("n"))
        .drop("_island")
    )


def run_label(first: Column, last: Column) -> Column:
    """``7`` or ``3-5``; empty without either end."""
    low, high = F.coalesce(first, last), F.coalesce(last, first)
    one = F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low, high))
    return F.coalesce(one, F.lit(""))


def lacking_numbers(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Numbers between a group's least and largest that no row has, as runs ``first``, ``last``."""
    own = runs(df, by, number)
    after = F.lead("first").over(W.partitionBy(*by).orderBy("first"))
    return own.withColumn("_next", after).filter("_next is not null").select(
        *by, (F.col("last") + 1).alias("first"), (F.col("_next") - 1).alias("last")
    )


def carried(df: DataFrame, by: list[str], value: Column, *order: str) -> Column:
    """The last value that isn't null up to each row."""
    back = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(back)


# -- constraints ----------------------------------------------------------------------------------
def finding(df: DataFrame, check: str, row_id: str, message: Column, severity: str = "blocking") -> DataFrame:
    """Rows as findings: ``severity``, ``check``, ``id``, ``message``."""
    return df.select(
        F.lit(severity).alias("severity"),
        F.lit(check).alias("check"),
        F.col(row_id).cast("string").alias("id"),
        message.cast("string").alias("message"),
    )


def not_unique(df: DataFrame, check: str, key: str) -> DataFrame:
    return finding(repeated_keys(df, [key]), check, key, F.format_string("%d rows", "n"))


def not_found(df: DataFrame, parents: DataFrame, check: str, key: str, row_id: str) -> DataFrame:
    known = parents.select(key).distinct()
    lost = df.filter(F.col(key).isNotNull()).join(known, key, "left_anti")
    return finding(lost, check, row_id, F.concat(F.lit("unknown "), F.col(key).cast("string")))


def breaks(df: DataFrame, check: str, row_id: str, bad: Column, message: str) -> DataFrame:
    return finding(df.filter(F.coalesce(bad, F.lit(False))), check, row_id, F.lit(message))


def breaks_any(df: DataFrame, rules: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """Findings of several checks ``(check, bad, id, message)``, in one pass over the rows."""
    def each(check: str, bad: Column, row_id: Column, message: Column) -> Column:
        out = F.struct(F.lit("blocking").alias("severity"), F.lit(check).alias("check"), row_id.cast("string").alias("id"), message.alias("message"))
        return F.when(bad, out)

    some = reduce(lambda a, b: a | b, [F.coalesce(bad, F.lit(False)) for _, bad, _, _ in rules])  # lists are made for faulty rows only
    return df.filter(some).select(F.explode(F.array_compact(F.array(*[each(*r) for r in rules]))).alias("_f")).select("_f.*")


def not_contiguous(df: DataFrame, check: str, by: str, number: str) -> DataFrame:
    """Groups whose numbers aren't 1, 2, …, n without gap or repeat."""
    g = df.groupBy(by).agg(
        F.min(number).alias("low"), F.max(number).alias("high"),
        F.count("*").alias("n"), F.count_distinct(number).alias("d"),
    )
    good = (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("d") == F.col("n"))
    return finding(g.filter(~F.coalesce(good, F.lit(False))), check, by, F.format_string("%d rows from %d to %d", "n", "low", "high"))


def all_findings(parts: list[DataFrame]) -> DataFrame:
    """All findings in one table."""
    return reduce(DataFrame.unionByName, parts)


def quota_gaps(df: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose number of rows isn't the wanted one: ``wanted``, ``found``."""
    found = df.groupBy(*by).agg(F.count("*").alias("found"))
    both = wanted.join(found, by, "full_outer").fillna(0, ["wanted", "found"])
    return both.filter("wanted <> found")
