"""Mixing sources to target weights, with DataFrame operations only.

The words of each source are one stream, packed into blocks of ``block_words``.  The mix is a list
of slots, a block each, in output shards; each shard draws its counts of the sources from a
multinomial with the target shares.  The n-th slot that a source gets over all shards takes the
block that a pseudorandom permutation of the source's block indexes maps n to.  The slots join the
packed blocks by index: a row of the mix is a run of a document's words with its shard, its slot in
the shard and its place in the block.  What the mix takes of a document is the sum of its rows.
The remainder block of a stream has the last slot of each pass, so that the slots of a pass hold
exactly the words of the source; the last slot is cut to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import saved

#: Words of a block, and blocks of an output shard.
BLOCK_WORDS, SHARD_BLOCKS = 1024, 256
#: Pieces of a source's stream that are summed apart, so that no task has a whole source; shards whose
#: draws are summed as one piece; slots of a task, about.
PIECES, PIECE_SHARDS, TASK_SLOTS = 512, 1024, 50_000
#: Rounds of the swap-or-not permutation.
ROUNDS = 16


def word_count(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: null sources are a source of their own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...], share: float, most: float
) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target`` from ``sizes (source, size)``.

    Sources in code-point order, null last, have the ``weights`` in turn and share ``share`` times
    all words by weight; none gets over ``most`` times its words, and what is over goes to the
    others by weight.  In the order of cap by weight the capped sources come first, so that one
    running sum finds them.  One row per source: only this small table is sorted as a whole.
    """
    rank = W.orderBy(F.col("source").asc_nulls_last())
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, W.unboundedFollowing)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    total = F.sum("source_size").over(W.partitionBy())
    left = F.lit(float(share)) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("turn", (F.row_number().over(rank) - 1) % len(weights))
        .withColumn("weight", F.element_at(turn, F.col("turn") + 1))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
        # beyond the first source that isn't capped the levels only fall: its level is the largest
        .withColumn("level", F.max("level").over(W.partitionBy()))
        .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")))
        .select("source", "source_size", "weight", "target")
    )


def permuted(index: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 at ``index``: swap-or-not (Hoang et al. 2012)."""

    def step(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), n) + n - x, n)
        swap = F.pmod(F.xxhash64(key, r, F.greatest(x, mirror), F.lit("swap")), F.lit(2)) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, step)


def streams(sized: DataFrame) -> DataFrame:
    """``sized`` with ``start``: the place of each document's first word in its source's stream.

    A stream is a number of pieces by document hash.  Running sums go within a piece and over the
    sums of the pieces, so no task orders a whole source.  ``piece`` and ``nth`` tell rows apart.
    """
    split = sized.withColumn("piece", F.pmod(F.xxhash64("doc_id", "size"), F.lit(PIECES)))
    within = W.partitionBy("key", "piece").orderBy("doc_id", "size")
    ahead = W.partitionBy("key").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        split.groupBy("key", "piece")
        .agg(F.sum("size").alias("piece_size"))
        .withColumn("base", F.coalesce(F.sum("piece_size").over(ahead), F.lit(0)))
        .select("key", "piece", "base")
    )
    return (
        split.withColumn("nth", F.row_number().over(within))
        .withColumn(
            "start",
            F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"),
        )
        .join(bases, ["key", "piece"])
        .withColumn("start", F.col("start") + F.col("base"))
        .drop("base")
    )


def slots(sources: DataFrame, seed: int) -> DataFrame:
    """The slots of the mix: ``shard``, ``place``, ``key``, ``block``, ``words``.

    ``sources (key, source_size, target)``.  The slots of a shard draw their sources
    independently, which makes its counts multinomial; what a source would get beyond its target
    is left out, and what it lacks in the end goes to more shards.  ``place`` is the slot within the
    shard, from 0 without gaps, in a pseudorandom order; ``words`` is the number of the block's
    first words that are taken.
    """
    words, full = F.round("target").cast("long"), F.floor(F.col("source_size") / BLOCK_WORDS)
    counted = (
        sources.filter("source_size > 0")
        .withColumn("words", words)
        .withColumn("full", full.cast("long"))
        .withColumn("pass_slots", F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long"))
        .withColumn("passes", F.floor(F.col("words") / F.col("source_size")).cast("long"))
        .withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
        .withColumn(
            "need",
            F.col("passes") * F.col("pass_slots") + F.ceil(F.col("rest") / BLOCK_WORDS),
        )
        .filter("need > 0")
    )
    ranges = counted.select(
        "key",
        "need",
        F.sum("need").over(W.orderBy("key")).alias("high"),
    ).withColumn("low", F.col("high") - F.col("need"))
    total = ranges.agg(F.max("high")).first()[0] or 0
    shards = -(-total // SHARD_BLOCKS)
    # sources and draws meet by cells of the number line
    cell = max(1, total // 4096)
    cells = F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))
    drawn = (
        sources.sparkSession.range(shards * SHARD_BLOCKS)
        .select(
            F.floor(F.col("id") / SHARD_BLOCKS).alias("shard"),
            F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, total))).alias("draw"),
        )
        .withColumn("cell", F.floor(F.col("draw") / cell))
        .join(ranges.withColumn("cell", F.explode(cells)), "cell")
        .filter("draw >= low and draw < high")
        .groupBy("shard", "key")
        .agg(F.count("*").alias("n"))
    )
    # running sums over the shards of a source go within pieces and over the sums of the pieces
    piece = F.floor(F.col("shard") / PIECE_SHARDS)
    drawn = saved(drawn.withColumn("piece", piece), "drawn")
    within = W.partitionBy("key", "piece").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    run = W.partitionBy("key").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        drawn.groupBy("key", "piece")
        .agg(F.sum("n").alias("piece_n"))
        .withColumn("base", F.coalesce(F.sum("piece_n").over(run), F.lit(0)))
        .select("key", "piece", "base")
    )
    ahead = W.partitionBy("shard").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        drawn.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(bases, ["key", "piece"])
        .withColumn("first", F.col("first") + F.col("base"))
        .join(counted.select("key", "need"), "key")
        .withColumn("n", F.least("n", F.col("need") - F.col("first")))
        .filter("n > 0")
        .withColumn("offset", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .withColumn("held", F.sum("n").over(W.partitionBy("shard")))
        .select("shard", "key", "n", "first", "offset", "held")
    )
    got = drawn.groupBy("key").agg(F.sum("n").alias("first"))
    # one row per source
    lacking = (
        counted.select("key", "need")
        .join(got, "key", "left")
        .select(
            F.lit(shards).cast("long").alias("shard"),
            "key",
            (F.col("need") - F.coalesce("first", F.lit(0))).alias("n"),
            F.coalesce("first", F.lit(0)).alias("first"),
        )
        .filter("n > 0")
        .withColumn("offset", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .withColumn("held", F.sum("n").over(W.partitionBy("shard")))
    )
    at = F.col("slot") % F.col("pass_slots")
    turn = F.floor(F.col("slot") / F.col("pass_slots")).cast("long")
    seeded = F.xxhash64(F.lit(seed), "key", turn)
    size = F.when(at < F.col("full"), BLOCK_WORDS).otherwise(
        F.col("source_size") - F.col("full") * BLOCK_WORDS
    )
    cut = F.when(turn < F.col("passes"), size).otherwise(
        F.least(size, F.col("rest") - at * BLOCK_WORDS)
    )
    # the slots of a shard change places; those that were lacking are dealt to shards after that
    mixed = permuted(
        F.col("offset") + F.col("slot") - F.col("first"),
        F.col("held"),
        F.xxhash64(F.lit(seed), "shard", F.lit("place")),
    )
    return (
        _spread(placed.unionByName(lacking), total)
        .withColumn("slot", F.explode(F.expr("sequence(first, first + n - 1)")))
        .join(counted.drop("target", "words"), "key")
        .withColumn("mixed", mixed)
        .select(
            (F.col("shard") + F.floor(F.col("mixed") / SHARD_BLOCKS)).cast("long").alias("shard"),
            (F.col("mixed") % SHARD_BLOCKS).cast("long").alias("place"),
            "key",
            F.when(at < F.col("full"), permuted(at, F.greatest("full", F.lit(1)), seeded))
            .otherwise(at)
            .alias("block"),
            cut.cast("long").alias("words"),
        )
    )


def _spread(ranges: DataFrame, slots: int) -> DataFrame:
    """``ranges (first, n, …)`` cut to pieces of a shard's slots, over as many tasks as the slots need."""
    tasks = max(ranges.sparkSession.sparkContext.defaultParallelism, -(-slots // TASK_SLOTS))
    last = F.expr("first + n")
    cut = ranges.withColumn("from", F.explode(F.expr(f"sequence(first, first + n - 1, {SHARD_BLOCKS})")))
    return (
        cut.withColumn("offset", F.col("offset") + F.col("from") - F.col("first"))
        .withColumn("n", F.least(last - F.col("from"), F.lit(SHARD_BLOCKS)))
        .withColumn("first", F.col("from"))
        .drop("from")
        .repartition(tasks, "key", "first")
    )


def packed(own: DataFrame) -> DataFrame:
    """The blocks of the streams: a row for each run of a document's words in a block.

    Adds to ``own`` ``block``, ``at`` (the run's place in the block), ``begin`` and ``end`` (of the
    document's words, end exclusive).  A block has at most BLOCK_WORDS runs.
    """
    last = F.col("start") + F.col("size") - 1
    blocks = F.sequence(F.floor(F.col("start") / BLOCK_WORDS), F.floor(last / BLOCK_WORDS))
    first = F.col("block") * BLOCK_WORDS
    return (
        own.filter("size > 0")
        .withColumn("block", F.explode(blocks))
        .withColumn("begin", F.greatest(F.lit(0), first - F.col("start")))
        .withColumn("end", F.least("size", first + BLOCK_WORDS - F.col("start")))
        .withColumn("at", F.col("start") + F.col("begin") - first)
    )


def _mixed(
    docs: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with their places in the streams, the sources, and the rows of the mix."""
    sized = saved(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
        ),
        "sizes",
    )
    sources = saved(
        source_targets(sized, weights, share, most).withColumn("key", source_key(F.col("source"))),
        "sources",
    )
    own = saved(streams(sized.withColumn("key", source_key(F.col("source")))), "streams")
    rows = (
        slots(sources, seed)
        .join(packed(own), ["key", "block"])
        .filter("at < words")
        .withColumn("end", F.least("end", F.col("begin") + F.col("words") - F.col("at")))
        .select(
            "shard", "place", "key", "source", "block", "at", "doc_id", "piece", "nth", "begin", "end"
        )
    )
    return own, sources, saved(rows, "mix")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """The mix: runs of words of documents in the blocks of output shards.

    Columns: ``shard``, ``place`` (slot in the shard), ``source``, ``block`` (its index in the
    source's stream), ``at`` (the run's first place in the block), ``doc_id``, ``begin``, ``end``
    (of the document's words, from 0, end exclusive).  Ordered by shard, place and at, the runs are
    the text of the mix.

    Shards draw their sources' slots by the target shares; what a source then lacks of its target goes into
    trailing shards, which are therefore no draws of those shares.  A null or empty text has no words and isn't
    in the mix; a text of any length is cut into blocks; rows that share a doc_id or have none, and a null source,
    count like any other; an empty table gives an empty mix.  Other columns are ignored.
    """
    *_, rows = _mixed(docs, weights, share, most, seed)
    return rows.drop("key", "piece", "nth")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """How much of each document the mix takes, summed over the rows of the mix (see ``mix``).

    Columns: ``doc_id``, ``size`` (words of the text), ``source_size``, ``target`` (of its
    source), ``taken`` (words that the mix takes, repeats counted).  A source's taken words are its
    target, rounded; no document is taken more than ``ceil(most)`` times.  A null text has no words
    and a null source is a source of its own, the last in order.  Repeated rows each have their own
    place in the stream.  The seed fixes the mix: reruns agree whatever the partitions.  An empty
    table gives an empty table.  Other columns are ignored.
    """
    own, sources, rows = _mixed(docs, weights, share, most, seed)
    row = ["key", "piece", "nth"]
    taken = rows.groupBy(*row).agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    return (
        own.join(taken, row, "left")
        .join(sources.select("key", "source_size", "target"), "key")
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )
