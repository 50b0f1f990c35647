"""SimHash near-duplicates: fingerprints, and a Gray-order hierarchical index over them.

Fingerprints are 64-bit.  Two link when at most ``radius`` bits differ.  One half of the bits then
differs in at most ``radius // 2`` places, so the index is built twice, once with each half leading
(*orders*).  In an order the fingerprints are grouped by their first ``p`` bits, and a group meets
just the groups whose leading bits are near enough (*cells*); a cell is joined in one task by
descending two trees over the Gray-sorted fingerprints.  A node holds the masked bits that all its
members share; node pairs whose shared bits already differ too often go as a whole, as do those
whose members are all in one class, and pairs that cannot exceed the radius link as a whole.  A cell
returns a spanning forest, never all its pairs; one of many rows is cut into parts.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import documents, in_parts, map_columns, saved
from vellum.llm.components import connected_components, merge_labels

#: Fingerprints of a group by leading bits, about, and of one part of a cell.
GROUP_ROWS, PART_ROWS = 16_384, 65_536
#: Node pairs that are expanded at once.
FRONTIER = 50_000
#: Leading bits of a tree's next level, beyond those of the level above.
LEVEL_BITS = 3

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str, shingle: int = 4) -> int:
    """The unsigned fingerprint of a whole text; 0 if it has no words.

    Words are runs without ASCII white space, A-Z in lower case; each shingle, repeats included,
    votes with its XXH64 (seed 42).  A bit is set if it is set in over half of the hashes.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    data, n, digest = b" ".join(words), max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    if n == 1:
        return digest(data, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    hashes = np.array(
        [digest(data[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)],
        np.uint64,
    )
    octets = hashes.view(np.uint8).reshape(n, 8) + _PLACES
    counts = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(2 * counts.ravel() > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed long) of every document."""

    def make():
        def run(ids, texts):
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            return ids, fps.view(np.int64)

        return run

    return map_columns(documents(docs), make, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class _Tree:
    """Levels of nodes over sorted codes; of a node: first and end row, shared bits, their mask."""

    def __init__(self, codes: np.ndarray, first_bits: int):
        n = len(codes)
        self.levels = []
        bits = max(1, first_bits)
        while True:
            head = codes >> np.uint64(64 - bits)
            start = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
            every = np.bitwise_and.reduceat(codes, start)
            some = np.bitwise_or.reduceat(codes, start)
            self.levels.append((start, np.r_[start[1:], n], every, ~(every ^ some)))
            if len(start) == n or bits == 64:
                break
            bits = min(64, bits + LEVEL_BITS)

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each node of a level: its first child and the end of its children below."""
        start, end, *_ = self.levels[level]
        below = self.levels[level + 1][0]
        return np.searchsorted(below, start), np.searchsorted(below, end)


def _pairs(a0, a1, b0, b1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (i, j, which) with i in a0..a1 and j in b0..b1, for each entry ``which``."""
    wide = b1 - b0
    each = (a1 - a0) * wide
    which = np.repeat(np.arange(len(a0)), each)
    at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    return a0[which] + at // wide[which], b0[which] + at % wide[which], which


def link_codes(codes: np.ndarray, radius: int, budget: int, bits: int, apart: bool = False) -> np.ndarray:
    """Labels of the classes that links within ``radius`` make among distinct codes.

    Only pairs that differ in at most ``budget`` bits of the upper half are looked at, and with
    ``apart`` only those that differ in the first ``bits`` bits.  Rows with the same label, a row
    number, are linked directly or through others.
    """
    n = len(codes)
    order = np.argsort(gray_rank(codes), kind="stable")
    tree = _Tree(codes[order], bits)
    labels = np.arange(n)
    half = np.uint64(0xFFFFFFFF00000000)
    deepest = len(tree.levels) - 1
    top = np.arange(len(tree.levels[0][0]))
    stack = [(0, *np.triu_indices(len(top), int(apart)))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > FRONTIER:
            stack.append((level, i[FRONTIER:], j[FRONTIER:]))
            i, j = i[:FRONTIER], j[:FRONTIER]
        start, end, pattern, mask = tree.levels[level]
        common = mask[i] & mask[j]
        differ = (pattern[i] ^ pattern[j]) & common
        total = np.bitwise_count(differ)
        keep = (total <= radius) & (np.bitwise_count(differ & half) <= budget)
        i, j, common, total = i[keep], j[keep], common[keep], total[keep]
        if not len(i):
            continue
        low, high = np.minimum.reduceat(labels, start), np.maximum.reduceat(labels, start)
        several = (low[i] != high[j]) | (low[j] != high[i])
        i, j, common, total = i[several], j[several], common[several], total[several]
        sure = total + np.bitwise_count(~common) <= radius
        if sure.any():
            a, b = i[sure], j[sure]
            zero = np.zeros(len(a), np.int64)
            u, v, _ = _pairs(start[a], end[a], start[b], start[b] + 1 + zero)
            labels = merge_labels(labels, u, v)
            u, v, _ = _pairs(start[a], start[a] + 1 + zero, start[b], end[b])
            labels = merge_labels(labels, u, v)
        i, j = i[~sure], j[~sure]
        if level == deepest or not len(i):
            continue
        first, last = tree.children(level)
        x, y, which = _pairs(first[i], last[i], first[j], last[j])
        ordered = (i[which] != j[which]) | (x <= y)
        stack.append((level + 1, x[ordered], y[ordered]))
    out = np.empty(n, np.int64)
    least = np.full(n, n, np.int64)
    np.minimum.at(least, labels, order)
    out[order] = least[labels]
    return out


def _masks(bits: int, most: int) -> list[int]:
    """All ``bits``-wide masks with at most ``most`` bits set."""
    return [sum(1 << b for b in at) for k in range(most + 1) for at in combinations(range(bits), k)]


def _cells(fps: DataFrame, bits: int, radius: int) -> DataFrame:
    """A row for each fingerprint and cell: order, the two leading patterns, fp."""

    def order(number: int, lead: Column, budget: int) -> DataFrame:
        head = F.shiftrightunsigned(lead, 64 - bits)
        near = F.array(*[F.lit(m).cast("long") for m in _masks(bits, min(bits, budget))])
        return (
            fps.withColumn("head", head)
            .withColumn("mask", F.explode(near))
            .withColumn("other", F.col("head").bitwiseXOR(F.col("mask")))
            .select(
                F.lit(number).alias("order"),
                F.least("head", "other").alias("head"),
                F.greatest("head", "other").alias("other"),
                "fp",
            )
        )

    swapped = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    first = radius // 2
    return order(0, F.col("fp"), first).unionByName(order(1, swapped, radius - first - 1))


def fingerprint_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges ``a, b`` (fingerprints) that connect exactly what links within ``radius`` connect.

    ``fps (fp)`` holds distinct fingerprints.  The leading bits of a group follow from the
    row count, so that a cell stays near ``2 * GROUP_ROWS`` rows of 16 bytes at every size; a cell of
    more than PART_ROWS, where many fingerprints begin alike, is cut into pairs of parts.  A group is
    joined with itself in a cell of its own only.
    """
    rows = fps.count()
    bits = min(24, max(4, math.ceil(math.log2(max(1, rows) / GROUP_ROWS))))

    def join(key: tuple, table: pa.Table) -> pa.Table:
        own = table["fp"].to_numpy()
        codes = own.view(np.uint64)
        lead, budget = codes, radius // 2
        if key[0].as_py():
            lead = (codes << np.uint64(32)) | (codes >> np.uint64(32))
            budget = radius - radius // 2 - 1
        labels = link_codes(lead, radius, budget, bits, key[1].as_py() != key[2].as_py())
        moved = labels != np.arange(len(labels))
        return pa.table({"a": own[moved], "b": own[labels[moved]]})

    names = ["order", "head", "other"]
    tasks = in_parts(_cells(fps, bits, radius), names, PART_ROWS, "fp").drop("part")
    return tasks.groupBy(*names, "low", "high").applyInArrow(join, "a long, b long")


def simhash_components(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` of every document.

    ``component_id`` is the smallest doc_id reachable through links of at most ``radius`` differing
    bits, the document itself included.  Null and empty texts have fingerprint zero and link like
    any other; texts of any length are read whole; exact copies meet by equal fingerprints and are never paired.  Rows without a
    doc_id get a fingerprint and the component of that fingerprint, but make no links of their
    own (null if no document with an id has it).  Repeated rows come out as often as they come
    in; an empty table gives an empty table.  Columns other than doc_id and text are ignored.
    """
    marked = saved(fingerprints(docs, shingle), "fingerprints")
    first = saved(
        marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id")),
        "first",
    )
    found = connected_components(fingerprint_links(first.select("fp"), radius))
    classes = saved(
        first.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")),
        "classes",
    )
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return marked.join(classes.join(least, "component").select("fp", "component_id"), "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
