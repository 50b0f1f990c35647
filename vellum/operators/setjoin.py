"""Set-overlap joins by prefix filter: rows meet through their rare tokens, pairs are counted exactly.

Tokens have one order, from rare to frequent.  Two sets that share at least ``need`` tokens share one of the
first ``len - need + 1`` of either set, and at least EXTRA of the first ``len - need + EXTRA``.  So only those
prefixes are joined, token by token; pairs with too few of them in common, or whose remaining tokens are too
few, are dropped before any whole set is read, and the others are counted on their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.storage import discard, saved

#: Tokens whose frequency every task knows; rarer ones come before them in the order of their bytes.
FREQUENT = 50_000
#: Tokens that a pair shares within the prefixes, if it needs as many at all.
EXTRA = 3
#: Sets that a task has as Python strings at once.
SLICE = 128
#: Rows of one token in one task on the side that is split; the other side meets each part.
PART_ROWS = 20_000
#: Rows of sets that go to every task.
SMALL_ROWS = 50_000


def by_rarity(table: DataFrame, counts: DataFrame) -> DataFrame:
    """``id``, ``tokens``: distinct tokens from rare to frequent; ``counts (token, n)``.

    Of the counts the FREQUENT greatest go to the tasks.
    """
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    held = table.sparkSession.sparkContext.broadcast({r["token"]: r["n"] for r in top})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = held.value
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            sets = [sorted(set(t or ()), key=lambda x: (n.get(x, 0), x)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.string()))], ["id", "tokens"])

    rows = table.filter("id is not null").select(F.col("id").cast("long").alias("id"), F.filter("tokens", lambda t: t.isNotNull()).alias("tokens"))
    return rows.mapInArrow(run, "id long, tokens array<string>")


def token_counts(table: DataFrame) -> DataFrame:
    """``token``, ``n``: rows of ``table`` that hold each token."""
    return table.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def _prefix(sets: DataFrame, length: Column) -> DataFrame:
    """A row for each of the first ``length`` tokens: ``id``, ``size``, ``need``, ``at``, ``token``."""
    first = F.slice("tokens", 1, F.greatest(F.lit(0), F.least(F.size("tokens"), length)))
    return sets.select("id", F.size("tokens").alias("size"), "need", F.posexplode(first).alias("at", "token"))


def overlaps(left: DataFrame, right: DataFrame, counts: DataFrame) -> DataFrame:
    """``left_id``, ``right_id``, ``shared``: pairs that share at least the left row's ``need`` tokens.

    ``left (id, tokens, need)`` and ``right (id, tokens)`` as ``by_rarity`` orders them; ``counts (token, n)``
    are the right side's, by which frequent tokens are split over tasks.  ``need`` is 1 or more.
    """
    least = left.agg(F.min("need")).first()[0]
    if least is None:
        return left.sparkSession.createDataFrame([], "left_id long, right_id long, shared int")
    extra = F.least(F.col("need"), F.lit(EXTRA))
    mine = _prefix(left, F.size("tokens") - F.col("need") + extra).withColumn("extra", F.least("need", F.lit(EXTRA)))
    # the right side doesn't know the need of whom it meets: the least of all
    theirs = _prefix(right.withColumn("need", F.lit(least)), F.size("tokens") - F.lit(least) + F.lit(min(least, EXTRA)))
    asked = mine.select("token").distinct()
    parts = counts.join(F.broadcast(asked) if left.count() <= SMALL_ROWS else asked, "token", "left_semi")
    parts = parts.select("token", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"))
    mine = mine.join(parts, "token").select(
        F.col("id").alias("left_id"), "size", "need", "extra", "at", "token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    theirs = theirs.join(parts, "token").select(
        F.col("id").alias("right_id"), F.col("size").alias("right_size"), F.col("at").alias("right_at"), "token",
        F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"),
    )
    met = mine.join(theirs, ["token", "part"]).filter(F.col("right_size") >= F.col("need"))
    # what can be shared from a meeting on, that before it being counted by the others
    ahead = F.least(F.col("size") - F.col("at"), F.col("right_size") - F.col("right_at"))
    pairs = met.groupBy("left_id", "right_id").agg(
        F.count("*").alias("n"), F.max("extra").alias("extra"), F.max("need").alias("need"),
        F.max_by(ahead, F.col("at")).alias("ahead"),
    )
    # the last meeting is the n-th: no more than n - 1 before it, and what is ahead
    able = pairs.filter((F.col("n") >= F.col("extra")) & (F.col("n") - 1 + F.col("ahead") >= F.col("need"))).select("left_id", "right_id", "need")
    able = saved(able, "pairs")
    few = F.broadcast if able.count() <= SMALL_ROWS else (lambda df: df)
    whole = right.select(F.col("id").alias("right_id"), F.col("tokens").alias("right_tokens")).join(few(able), "right_id")
    whole = whole.join(left.select(F.col("id").alias("left_id"), "tokens"), "left_id")
    shared = F.size(F.array_intersect("tokens", "right_tokens"))
    return whole.select("left_id", "right_id", "need", shared.alias("shared")).filter("shared >= need").drop("need")


def best_overlaps(
    df: DataFrame,
    others: DataFrame,
    row_id: str,
    other_id: str,
    common: int = 8,
    share: float = 0.35,
    sure: float = 0.55,
    margin: int = 4,
    every: bool = True,
) -> DataFrame:
    """For each row the other with the most tokens in common, if it is a match.

    Both have a long id and the array ``tokens`` (distinct ones count, nulls don't).  A match has at least
    ``common`` tokens in common, ``share`` of the row's, and either ``sure`` of them or ``margin`` more than the
    second best.  Columns: the id, ``matched`` (null without a match), ``shared``, ``confidence``: those of the
    best other, ties going to the smaller id; null for a row that shares nothing.

    A row first meets what could match or stand within ``margin`` of a match.  With ``every`` the rows that
    meet nothing there are asked again with half the need, down to one token, for the numbers of their best
    other; without it they have nulls.  Rows that share an id count as one, with the tokens of the first.
    """
    base = others.select(F.col(other_id).alias("id"), "tokens")
    counts = saved(token_counts(base), "tokens")
    rows = df.select(F.col(row_id).alias("id"), "tokens")
    right = saved(by_rarity(base, counts), "sets")
    left = saved(by_rarity(rows, counts).filter(F.size("tokens") > 0).dropDuplicates(["id"]), "asked")
    least = F.greatest(F.lit(common), F.ceil(F.lit(share) * F.size("tokens"))) - (margin - 1)
    waiting = left.withColumn("need", F.greatest(F.lit(1), least).cast("int"))
    found, rounds = None, 0
    while True:
        pairs = saved(overlaps(waiting, right, counts), "overlaps")
        found = pairs if found is None else found.unionByName(pairs)
        if not every:
            break
        met = pairs.select(F.col("left_id").alias("id")).distinct()
        rest = waiting.filter("need > 1").join(met, "id", "left_anti")
        rest = saved(rest.withColumn("need", F.floor(F.col("need") / 2).cast("int")), "waiting")
        rounds += 1
        if rest.isEmpty():
            break
        waiting = rest
    sized = left.select(F.col("id").alias("left_id"), F.size("tokens").alias("n"))
    order = W.partitionBy("left_id").orderBy(F.desc("shared"), "right_id")
    two = found.withColumn("place", F.row_number().over(order)).filter("place <= 2")
    best = two.groupBy("left_id").agg(
        F.min_by(F.struct("right_id", "shared"), "place").alias("best"),
        F.coalesce(F.max(F.when(F.col("place") == 2, F.col("shared"))), F.lit(0)).alias("second"),
    )
    best = best.join(sized, "left_id")
    confidence = F.col("best.shared") / F.col("n")
    good = (
        (F.col("best.shared") >= common)
        & (confidence >= share)
        & ((confidence >= sure) | (F.col("best.shared") - F.col("second") >= margin))
    )
    kinds = dict(df.dtypes)[row_id], dict(others.dtypes)[other_id]
    out = best.select(
        F.col("left_id").cast(kinds[0]).alias(row_id),
        F.when(good, F.col("best.right_id")).cast(kinds[1]).alias("matched"),
        F.col("best.shared").cast("long").alias("shared"),
        confidence.alias("confidence"),
    )
    return df.select(row_id).join(out, row_id, "left")
