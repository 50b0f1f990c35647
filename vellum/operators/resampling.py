"""Bootstrap resamples of exactly n draws, without a group in one task.

The n draws of a resample are split over a tree of rows: a node's rows are halved by the next bit of a hash of
their id, and a binomial number of the node's draws goes to the left half, by its share of the rows.  A leaf has
LEAF rows or so and spreads its draws over them one by one.  That is a multinomial draw of n rows.  The random
numbers of a node follow from the seed, the group and the node, so every task that needs a node's split makes the
same one, and reruns agree however the rows are partitioned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.storage import saved

#: Rows of a leaf at most on average, and weights that a task has at once.
LEAF, AT_ONCE = 65_536, 4_000_000
RESAMPLES = 10_000


def _numbers(seed: int, group: str, level: int, node: int) -> np.random.Generator:
    """The random numbers of a node."""
    told = hashlib.sha256(f"{seed}\x1f{group}\x1f{level}\x1f{node}".encode()).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(told[:16], "little")))


def leaf_draws(seed: int, group: str, n: int, path: list[tuple[int, int]], leaf: int, resamples: int) -> np.ndarray:
    """Draws of each resample that reach a leaf; ``path`` has for each level the rows of the left half and of both."""
    draws, depth = np.full(resamples, n, np.int64), len(path)
    for level, (left, both) in enumerate(path):
        to_left = _numbers(seed, group, level, leaf >> (depth - level)).binomial(draws, left / both)
        draws = draws - to_left if leaf >> (depth - level - 1) & 1 else to_left
    return draws


def _paths(leaves: DataFrame) -> DataFrame:
    """``group``, ``leaf``, ``path``: left and both rows at each level above a leaf; small tables."""
    levels = leaves.select("group", "leaf", "depth", "rows", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("level"))
    placed = levels.withColumn("node", F.expr("shiftrightunsigned(leaf, depth - level)"))
    nodes = saved(placed.groupBy("group", "level", "node").agg(F.sum("rows").alias("rows")), "nodes")
    below = placed.filter("level > 0").select("group", "leaf", "level", (F.col("node") - F.col("node") % 2).alias("left_node"))
    left = nodes.select("group", "level", F.col("node").alias("left_node"), F.col("rows").alias("left"))
    right = nodes.select("group", "level", (F.col("node") - 1).alias("left_node"), F.col("rows").alias("right"))
    sides = below.join(left, ["group", "level", "left_node"], "left").join(right, ["group", "level", "left_node"], "left")
    sides = sides.na.fill(0, ["left", "right"]).withColumn("both", F.col("left") + F.col("right"))
    found = sides.groupBy("group", "leaf").agg(F.array_sort(F.collect_list(F.struct("level", "left", "both"))).alias("path"))
    return leaves.select("group", "leaf", "n").join(found, ["group", "leaf"], "left")


def resampled_sums(
    df: DataFrame, by: list[str], row_id: str, values: list[str], resamples: int = RESAMPLES, seed: int = 0
) -> DataFrame:
    """``by``, ``resample``, ``draws`` and for each of ``values`` the sum over the rows drawn, as often as they are.

    ``draws`` is the group's number of rows in every resample.  Rows with a null or NaN in any of ``values``
    don't count.  ``row_id`` tells rows apart: rows of one id stay in one leaf.  The shuffle has the rows once and
    a row per leaf and resample.
    """
    names = [f"v{k}" for k in range(len(values))]
    kept = df.select(
        *by, F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("group") if by else F.lit("").alias("group"),
        F.xxhash64(F.col(row_id)).alias("hash"), *[F.col(v).cast("double").alias(n) for v, n in zip(values, names, strict=True)],
    )
    for n in names:
        kept = kept.filter(F.col(n).isNotNull() & ~F.isnan(n))
    sizes = kept.groupBy("group").agg(F.count("*").alias("n"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF))).cast("int")
    sizes = saved(sizes.select("group", "n", depth.alias("depth")), "sizes")
    leaf = F.when(F.col("depth") > 0, F.expr("shiftrightunsigned(hash, 64 - depth)")).otherwise(F.lit(0)).cast("long")
    # sizes has a row per group, and joins by group would gather one: small ones go to every task
    held = F.broadcast(sizes) if sizes.count() <= 100_000 else sizes
    placed = kept.join(held, "group").withColumn("leaf", leaf)
    leaves = saved(placed.groupBy("group", "leaf", "n", "depth").agg(F.count("*").alias("rows")), "leaves")
    ddl = "group string, resample int, draws long, " + ", ".join(f"{n} double" for n in names)
    drawn = (
        placed.select("group", "leaf", "hash", *names)
        .join(_paths(leaves), ["group", "leaf"])
        .groupBy("group", "leaf")
        .applyInArrow(_leaf_sums(names, resamples, seed), ddl)
    )
    sums = drawn.groupBy("group", "resample").agg(F.sum("draws").alias("draws"), *[F.sum(n).alias(n) for n in names])
    keys = kept.select("group", *by).groupBy("group").agg(*[F.first(c).alias(c) for c in by]) if by else None
    out = sums.join(keys, "group") if by else sums
    return out.select(*by, "resample", "draws", *[F.col(n).alias(v) for n, v in zip(names, values, strict=True)])


def _leaf_sums(names: list[str], resamples: int, seed: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def sums(key: tuple, table: pa.Table) -> pa.Table:
        group, leaf = key[0].as_py(), key[1].as_py()
        path = [(p["left"], p["both"]) for p in table["path"][0].as_py() or ()]
        draws = leaf_draws(seed, group, table["n"][0].as_py(), path, leaf, resamples)
        rows = np.stack([table[n].to_numpy() for n in names], axis=1)
        rows = rows[np.lexsort([*rows.T, table["hash"].to_numpy()])]  # whatever order they came in
        numbers, m, out = _numbers(seed, group, -1, leaf), len(rows), np.empty((resamples, len(names)))
        step = max(1, AT_ONCE // m)
        for at in range(0, resamples, step):
            own = draws[at : at + step]
            which = numbers.integers(0, m, int(own.sum())) + np.repeat(np.arange(len(own)) * m, own)
            out[at : at + step] = np.bincount(which, minlength=m * len(own)).reshape(len(own), m) @ rows
        columns = {"group": [group] * resamples, "resample": np.arange(resamples, dtype=np.int32), "draws": draws}
        return pa.table(columns | {n: out[:, k] for k, n in enumerate(names)})

    return sums


def interval(draws: DataFrame, by: list[str], statistic: Column, floor: bool = False) -> DataFrame:
    """``low``, ``high`` of the 95 % percentile interval of a statistic of each resample's sums.

    By linear interpolation between the ordered values, or (``floor``) the values at the places rounded down.
    Resamples where the statistic is null or NaN are left out; without any, both are null.
    """
    values = draws.select(*by, statistic.cast("double").alias("value")).filter("value is not null and not isnan(value)")
    if not floor:
        cut = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
        return values.groupBy(*by).agg(cut.alias("cut")).select(*by, F.col("cut")[0].alias("low"), F.col("cut")[1].alias("high"))
    listed = values.groupBy(*by).agg(F.array_sort(F.collect_list("value")).alias("v"))  # one value per resample

    def at(share: float) -> Column:
        return F.try_element_at("v", F.floor(F.lit(share) * (F.size("v") - 1)).cast("int") + 1)

    return listed.select(*by, at(0.025).alias("low"), at(0.975).alias("high"))
