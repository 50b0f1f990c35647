"""Importance resampling towards a target distribution over hashed n-grams.

Two scans of the texts: the first counts the buckets of all n-grams of the corpus (and of the target's
texts), the second sums the gains of each document's n-grams.  In both, a task keeps one number per
bucket.  Scores perturbed by Gumbel noise from a hash of the id turn the draw without replacement
into the highest scores; their ranks come from sorted ranges, not from one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import BATCH_ROWS, documents, saved
from vellum.llm.crcgrams import Grams
from vellum.storage import spread, with_positions

#: Buckets of the hashed n-grams, words of the longest one, least words of a document that may be drawn.
BUCKETS, WORDS, LEAST_WORDS = 10_000, 3, 20
#: Documents drawn of 100 that may be, and the seed of the noise.
PERCENT, SEED = 5, 42
#: Rows of a batch's slice.
SLICE = BATCH_ROWS


def _texts(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all texts and where each begins."""
    flat = pc.cast(column, pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = flat.buffers()[2]
    data = raw.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if raw is not None and len(flat) else b""
    return data, ends[:-1] - ends[0]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, words: int = WORDS) -> np.ndarray:
    """How many n-grams of one to ``words`` words of the column ``text`` fall into each bucket.

    A task sends its counts once, at most one row per bucket; ``buckets`` bounds what is collected.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held = Grams(words), np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for _, crcs, whole in grams(*_texts(batch.slice(at, SLICE).column(0))):
                    for crc, real in zip(crcs, whole, strict=True):
                        held += np.bincount(crc[real] % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], ["bucket", "n"])

    text = texts.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = text.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in found:
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket floor(1000 ln of its share in the target over its share in the source), each
    count raised by one."""
    buckets, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (all_source + buckets) / ((s + 1) * (all_target + buckets))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def weigh(docs: DataFrame, gains: np.ndarray, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``n_features``, ``n_words``, ``weight`` (long): the gains of each row's n-grams summed."""
    buckets = np.uint32(len(gains))

    def weigh_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(words)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                features, weight, single = (np.zeros(part.num_rows, np.int64) for _ in range(3))
                for text, crcs, whole in grams(*_texts(part.column(1))):
                    # a block holds few texts, which are sorted: sums of runs, exact in long
                    starts = np.flatnonzero(np.diff(text, prepend=-1))
                    rows = text[starts]
                    single[rows] += np.diff(starts, append=len(text))
                    for crc, real in zip(crcs, whole, strict=True):
                        weight[rows] += np.add.reduceat(np.where(real, gains[crc % buckets], 0), starts)
                        features[rows] += np.add.reduceat(real.astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x) for x in (features, single, weight))],
                    ["doc_id", "n_features", "n_words", "weight"],
                )

    return documents(docs).mapInArrow(weigh_batches, "doc_id long, n_features long, n_words long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u in (0, 1) from the first 32 bits of the SHA-256 of ``seed:doc_id``."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    words: int = WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score``, ``rank`` (long) and ``n_words`` of every row.

    A to z and digits and all characters beyond ASCII make words, A-Z being lower-cased; features are
    the runs of one to ``words`` words, repeats counted.  ``floor(percent * N / 100)`` of the N rows with
    at least ``least_words`` words are drawn: those of the highest score, ties going to the smaller
    doc_id (then the fewer features, the smaller weight; of rows alike in all, any).  ``rank`` counts them
    from 1 and is null for the others.

    A null or empty text has no features and weighs 0; very long texts are taken in blocks of
    ``crcgrams.BLOCK`` bytes.  Rows that share a doc_id are rows of their own.  A row without a doc_id
    is drawn like any other, its noise being that of the empty id, and comes after all ids in ties.
    An empty table gives an empty table; without target texts every target count is 0.  Other columns are
    ignored, whatever their names.
    """
    docs = spread(docs)
    gains = bucket_gains(bucket_counts(docs, buckets, words), bucket_counts(target, buckets, words))
    scored = saved(
        weigh(docs, gains, words).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored"
    )
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    # scores down to the one of the last that can be drawn, by counts of scores: most rows aren't ranked
    least = _score_of_rank(able, drawn)
    ranked = with_positions(able.filter(F.col("score") >= least), order) if least is not None else able.limit(0).withColumn("position", F.lit(0))
    rank = F.when(F.col("position") <= drawn, F.col("position")).cast("long")
    rest = ~F.coalesce((F.col("n_words") >= least_words) & (F.col("score") >= F.lit(least)), F.lit(False))
    names = ("doc_id", "n_features", "weight", "score")
    return ranked.select(*names, rank.alias("rank"), "n_words").unionByName(
        scored.filter(rest).select(*names, F.lit(None).cast("long").alias("rank"), "n_words")
    )


def _score_of_rank(rows: DataFrame, rank: int) -> int | None:
    """The score of the row at ``rank`` from the top; None for rank 0.

    Found by counts in 4,096 classes of scores and then within the class, so that a bounded
    number of rows comes to the driver in each round.
    """
    if rank == 0:
        return None
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    while low < high:
        width = max(1, -(-(high - low + 1) // 4096))
        place = F.floor((F.col("score") - low) / width).cast("long")
        counts = (
            rows.filter(F.col("score").between(low, high)).groupBy(place.alias("k")).count().orderBy(F.desc("k")).collect()
        )
        for k, n in counts:
            if rank <= n:
                low, high = low + k * width, min(high, low + (k + 1) * width - 1)
                break
            rank -= n
    return low
