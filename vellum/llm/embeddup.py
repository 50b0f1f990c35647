"""Embedding near-duplicates: a subspace pigeonhole join.

Unit vectors with a cosine of at least c are at most 2 - 2c apart in squared distance.  After a
rotation the vectors are cut into blocks of ``BLOCK_WIDTH`` coordinates; such a pair is within its share
of that budget in one block at least.  Vectors of a label meet in parts of a counted size, each pair
of parts in one task, which has each vector once for all blocks.  There each block is range-joined on a
grid: the first coordinates name a cell, the last one is sorted within, so that a vector is compared
with runs of near cells only.  What a block's distance admits is tested exactly, and a pair counts in
the first block that admits it; a task returns numbers of links and a spanning forest, not the
pairs.  Equal vectors are joined once with their count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import in_parts, saved
from vellum.llm.components import connected_components, merge_labels

#: Coordinates of a block; vectors of one part of a label, about.
BLOCK_WIDTH, PART_ROWS = 4, 16_384
#: Cells within a block's reach, by coordinate; the last coordinate has none, it is sorted.
STEPS = (2, 2, 1)
#: Pairs that are tested at once.
PAIRS = 200_000
#: Added to the squared distance against rounding; the exact test follows.
SLACK = 1e-9


def rotation(width: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of equal width as float64, and their norms."""
    x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(len(column), -1)
    return x, np.sqrt(np.einsum("ij,ij->i", x, x))


def _bounds(width: int) -> list[tuple[int, int]]:
    """The coordinates of each block."""
    return [(a, min(width, a + BLOCK_WIDTH)) for a in range(0, width, BLOCK_WIDTH)]


def _share(cosine: float, width: int) -> float:
    return (2 - 2 * cosine + SLACK) / len(_bounds(width))


def block_pairs(y: np.ndarray, reach: float, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs ``u, v`` of the block ``y``, each once: all within ``reach`` are among them.

    They are in cells within reach and differ in the last coordinate by at most ``reach``.  With
    ``side`` (0 or 1) a pair has a row of each, ``u`` being of side 0.
    """
    n, width = y.shape
    steps = STEPS[: width - 1]
    cell = np.floor(y[:, :-1] / (reach / np.array(steps)[None, :])).astype(np.int64) if steps else np.zeros((n, 0), np.int64)
    cell -= cell.min(axis=0, initial=0) - max(steps, default=0)
    reaches = cell.max(axis=0, initial=0) + 1 + max(steps, default=0)
    code = np.zeros(n, np.int64)
    for k in range(len(steps)):
        code = code * reaches[k] + cell[:, k]
    # a cell's rows are one run of this key, sorted by the last coordinate; runs are a gap apart
    last = y[:, -1] - y[:, -1].min(initial=0)
    gap = last.max(initial=0) + 3 * reach
    order = np.lexsort((last, code))
    place = code.astype(np.float64) * gap + last
    asked = order if side is None else order[side[order] == 0]
    held = order if side is None else order[side[order] == 1]
    keys = place[held]
    slack = reach + np.abs(place).max(initial=0) * 1e-15
    for move in product(*[range(-s, s + 1) for s in steps]):
        if side is None and move < (0,) * len(steps):
            continue
        shift = 0
        for k, m in enumerate(move):
            shift = shift * int(reaches[k]) + m
        at = place[asked] + shift * gap
        low, high = np.searchsorted(keys, at - slack), np.searchsorted(keys, at + slack, side="right")
        if side is None and not any(move):
            low = np.arange(1, n + 1)  # within a cell: with the rows after it
        count = np.maximum(high - low, 0)
        some = np.flatnonzero(count)
        for rows in np.split(some, np.flatnonzero(np.diff(np.cumsum(count[some]) // PAIRS)) + 1):
            if len(rows):
                each = count[rows]
                inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
                yield np.repeat(asked[rows], each), held[np.repeat(low[rows], each) + inside]


def _apart(columns: np.ndarray, u: np.ndarray, v: np.ndarray, a: int, b: int) -> np.ndarray:
    """Squared distances in the coordinates a..b, added one by one, so that each block says the same."""
    total = np.zeros(len(u))
    for k in range(a, b):
        total += (columns[k, u] - columns[k, v]) ** 2
    return total


def link_part(x: np.ndarray, norm: np.ndarray, times: np.ndarray, cosine: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: links (weighted by ``times``) and the least row that links reach; pairs as in ``block_pairs``."""
    n, width = x.shape
    turned = np.ascontiguousarray(((x / norm[:, None]) @ rotation(width)).T)
    bounds, share = _bounds(width), _share(cosine, width)
    reach = np.sqrt(share + SLACK)
    links, labels = np.zeros(n, np.int64), np.arange(n)
    for block, (a, b) in enumerate(bounds):
        for u, v in block_pairs(turned[a:b].T, reach, side):
            near = _apart(turned, u, v, a, b) <= share + SLACK
            u, v = u[near], v[near]
            near = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v]) >= cosine
            u, v = u[near], v[near]
            before = [_apart(turned, u, v, c, d) <= share + SLACK for c, d in bounds[:block]]
            here = ~np.any([np.zeros(len(u), bool), *before], axis=0)
            u, v = u[here], v[here]
            links += np.bincount(u, times[v], n).astype(np.int64)
            links += np.bincount(v, times[u], n).astype(np.int64)
            labels = merge_labels(labels, u, v)
    return links, labels


def _join_parts(cosine: float) -> Callable[[tuple, pa.Table], pa.Table]:
    def join(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[2].as_py(), key[3].as_py()
        x, norm = _vectors(table["embedding"])
        row, times, part = (table[c].to_numpy() for c in ("row", "times", "part"))
        links, labels = link_part(x, norm, times, cosine, None if low == high else (part != low).astype(np.int8))
        said = links > 0
        return pa.table({"row": row[said], "links": links[said], "root": row[labels[said]]})

    return join


def near_embeddings(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of each row of ``vectors``.

    ``vectors`` has ``vec_id``, ``embedding`` (array of float or double, kept as it is) and ``label`` (of any
    type); other columns are ignored, whatever their names.  Rows of equal label and width link if their cosine in double precision is at least
    ``cosine``.  ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest
    vec_id reachable, the row's own included, and ``kept`` tells that it is the row's own.  Rows
    with a null label, and vectors that are null, empty, zero or hold null or non-finite parts link
    with nothing and keep their own id.  Rows without a vec_id link with nothing and have a null
    component and kept false.  Rows that share a vec_id are rows of their own: repeated ones are links
    of each other, different vectors aren't mixed up.  An empty table gives an empty table.
    """
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), "label"
    )
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & ~bad
        & F.exists("embedding", lambda v: v != 0),
        F.lit(False),
    )
    # 128 bits stand for label and vector, so that vectors needn't move to find their class again
    keys = [F.xxhash64(F.lit(k), "label", "embedding").alias(f"k{k}") for k in (0, 1)]
    good = rows.filter(usable).select("*", *keys)
    reps = (
        good.groupBy("label", "k0", "k1")
        .agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times"), F.first("embedding").alias("embedding"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    reps = saved(reps, "vectors")
    parts = in_parts(
        reps.select("label", F.size("embedding").alias("width"), "row", "times", "embedding"), ["label", "width"], PART_ROWS, "row"
    )
    found = saved(
        parts.groupBy("label", "width", "low", "high").applyInArrow(_join_parts(cosine), "row long, links long, root long"),
        "links",
    )
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    classes = saved(
        reps.drop("embedding", "label")
        .join(links, "row", "left")
        .join(connected_components(found.selectExpr("row as a", "root as b")).withColumnRenamed("node", "row"), "row", "left")
        .withColumn("component", F.coalesce("component", "row")),
        "classes",
    )
    least = classes.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    own = classes.join(least, "component").select("k0", "k1", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (
        good.select("vec_id", "k0", "k1")
        .join(own, ["k0", "k1"])
        .select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
