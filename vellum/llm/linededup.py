"""Line deduplication: two Bloom filters find suspects, an exact join on those decides.

The first scan of the texts fills, in each task, a filter of hashes seen once and one of hashes seen
twice, and merges the pairs of filters piece by piece; the second sends only the hashes that the
twice-seen filter has on to a shuffle, where a repeat is confirmed and its first document chosen; the
third rewrites the texts.  The filters' bits follow from the bytes of text, up to ``MOST_BITS``: where a
corpus overfills them, more lines are suspected and shuffled (24 bytes each), and the result stays
exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import BATCH_ROWS, documents, free_name, map_columns, saved, small_batches

SPACE = b" \t\n\r\x0b\x0c"
#: Bytes of text for each bit of a filter, the bits' least and greatest number, and those that one hash sets.
BYTES_A_BIT, LEAST_BITS, MOST_BITS, PROBES = 16, 1 << 20, 1 << 28, 3
#: Bytes of a filter that are merged in one group, and partitions that fill one pair of filters at most.
PIECE, PARTITIONS = 1 << 16, 16
#: Pairs of pieces that one group merges: more are merged in rounds, so that no group grows with the tasks.
MERGED = 64
#: Digests of dropped lines (of some 40 bytes) that go to every task; beyond it the texts are shuffled.
SMALL_DIGESTS = 1_000_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line; None if it has under ``min_chars`` code points."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and len(key.decode("utf-8")) < min_chars:
        return None
    return key


def _digests(text: str, min_chars: int) -> set[bytes]:
    keys = (line_key(x, min_chars) for x in text.encode("utf-8").split(b"\n"))
    return {xxhash.xxh3_128_digest(k) for k in keys if k is not None}


def _probes(digests: np.ndarray, bits: int) -> np.ndarray:
    """The filter's bits of each 16-byte digest, one row per digest."""
    a, b = digests[:, 0], digests[:, 1] | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)
    return ((a[:, None] + b[:, None] * steps) & np.uint64(bits - 1)).astype(np.int64)


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _set(filter_: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filter_, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _all_set(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row of ``at``, whether the filter has all of its bits."""
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def filter_bits(docs: DataFrame) -> int:
    """The bits of a filter for the lines of ``docs``: a power of two that follows from their bytes."""
    size = documents(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << (size // BYTES_A_BIT).bit_length()))


_PAIRS = "piece int, task int, once binary, twice binary"


def twice_filter(docs: DataFrame, min_chars: int, bits: int) -> bytes:
    """The packed filter of hashes that at least two documents may hold (``bits / 8`` bytes)."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        some = False
        for batch in (b.slice(k, BATCH_ROWS) for b in batches for k in range(0, b.num_rows, BATCH_ROWS)):
            found = [d for t in batch["text"].to_pylist() for d in _digests(t, min_chars)]
            if not found:
                continue
            some = True
            found, times = np.unique(np.array(found, "V16"), return_counts=True)
            at = _probes(found.view(np.uint64).reshape(-1, 2), bits)
            _set(twice, at[(times > 1) | _all_set(once, at)].ravel())
            _set(once, at.ravel())
        task = TaskContext.get().partitionId()
        for k in range(0, bits // 8 if some else 0, PIECE):
            pieces = [pa.array([x[k : k + PIECE].tobytes()], pa.binary()) for x in (once, twice)]
            places = [pa.array([x], pa.int32()) for x in (k // PIECE, task)]
            yield pa.RecordBatch.from_arrays([*places, *pieces], names=["piece", "task", "once", "twice"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        once, twice = np.zeros(PIECE, np.uint8), np.zeros(PIECE, np.uint8)
        for a, b in zip(table["once"], table["twice"], strict=True):
            a, b = (np.frombuffer(x.as_buffer(), np.uint8) for x in (a, b))
            twice |= b | (once & a)
            once |= a
        places = [pa.array([k.as_py()], pa.int32()) for k in key]
        return pa.table([*places, pa.array([once.tobytes()]), pa.array([twice.tobytes()])], names=["piece", "task", "once", "twice"])

    # fewer tasks send fewer filters, but a task that is lost must not be a large share of the texts
    texts = small_batches(documents(docs)).select("text")
    cores, parts = docs.sparkSession.sparkContext.defaultParallelism, texts.rdd.getNumPartitions()
    tasks = max(1, cores, -(-parts // PARTITIONS))
    pairs = texts.coalesce(tasks).mapInArrow(fill, _PAIRS)
    while tasks > 1:
        tasks = -(-tasks // MERGED)
        group = F.floor(F.col("task") / MERGED).cast("int").alias("task")
        pairs = pairs.select("piece", group, "once", "twice").groupBy("piece", "task").applyInArrow(merge, _PAIRS)
    rows = pairs.select("piece", "twice").collect()
    merged = {r["piece"]: bytes(r["twice"]) for r in rows}
    return b"".join(merged.get(k, bytes(PIECE)) for k in range(bits // 8 // PIECE))


def _repeats(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id``, ``drops`` (digests of the keys whose lines the document loses)."""
    spark, bits = docs.sparkSession, filter_bits(docs)
    packed = spark.sparkContext.broadcast(twice_filter(docs, min_chars, bits))

    def make():
        held = np.frombuffer(packed.value, np.uint8)

        def run(ids, texts):
            kept_ids, digests = [], []
            for i, text in zip(ids, texts, strict=True):
                for d in _digests(text, min_chars):
                    kept_ids.append(i)
                    digests.append(d)
            if not digests:
                return [], []
            where = np.flatnonzero(_all_set(held, _probes(_words(digests), bits))).tolist()
            return [kept_ids[k] for k in where], [digests[k] for k in where]

        return run

    with_id = documents(docs).filter("doc_id is not null")
    suspects = saved(map_columns(with_id, make, "doc_id long, digest binary"), "suspects")
    # written, so that the join has exchanges of its own, which Spark splits at a frequent line
    repeated = saved(
        suspects.groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last")
        .select("digest", "first"),
        "repeated",
    )
    found = suspects.join(repeated, "digest").filter("doc_id > first").groupBy("doc_id")
    return saved(found.agg(F.collect_set("digest").alias("drops")), "drops")


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with the kept lines as ``text``, and ``n_lines``, ``n_dropped`` (long).

    A line's key is the line stripped of ASCII white space, A-Z in lower case; keys of at least
    ``min_chars`` code points that two documents or more hold stay only in the smallest doc_id
    among them, where all their lines stay.  A null or empty text is one empty line; texts and
    lines may be of any length; a text whose
    lines all go is empty.  Rows that share a doc_id count as one document.  Rows without a
    doc_id keep all lines and count for nothing.  Other columns pass through, whatever their names, but
    for columns named n_lines, n_dropped, which are replaced.  An empty table gives an empty table.
    """

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def rewrite(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for text, gone in zip(texts, drops, strict=True):
            lines = text.encode("utf-8").split(b"\n")
            if gone is None or not len(gone):
                out.append((text, len(lines), 0))
                continue
            gone = {bytes(d) for d in gone}
            keys = [line_key(x, min_chars) for x in lines]
            kept = [
                x
                for x, k in zip(lines, keys, strict=True)
                if k is None or xxhash.xxh3_128_digest(k) not in gone
            ]
            out.append((b"\n".join(kept).decode("utf-8"), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    drops = _repeats(docs, min_chars)
    digests = drops.agg(F.sum(F.size("drops"))).first()[0] or 0
    key, gone, new = (free_name(docs, c) for c in ("key", "drops", "new"))
    drops = drops.select(F.col("doc_id").alias(key), F.col("drops").alias(gone))
    drops = F.broadcast(drops) if digests <= SMALL_DIGESTS else drops
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return (
        small_batches(docs).withColumn("text", F.coalesce("text", F.lit("")))
        .join(drops, F.col("doc_id").cast("long") == F.col(key), "left")
        .withColumn(new, rewrite("text", gone))
        .select(*others, *[F.col(new)[c].alias(c) for c in ("text", "n_lines", "n_dropped")])
    )
