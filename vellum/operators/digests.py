"""Digest trees of tables: kept per version, compared from the root, read only where they differ.

A row's digest is the SHA-256 of its JSON.  Rows lie in the order of their digests; the first hexadecimal digits
name a node, and the number of digits of a leaf follows from the number of rows, so that a leaf has LEAF rows on
average however large the table is.  A node's digest is that of its children, or of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.segments import lay_out
from vellum.storage import saved

#: Rows of a leaf on average, and prefixes that a filter lists.
LEAF, LISTED = 1024, 4096


def row_digest(columns: list[str]) -> Column:
    """The SHA-256 of the row's JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def tree_depth(rows: int, leaf: int = LEAF) -> int:
    """Digits of a leaf's prefix: the least with at most ``leaf`` rows each on average."""
    depth = 0
    while rows > leaf * 16**depth:
        depth += 1
    return depth


def _joined(column: str) -> Column:
    """The SHA-256 of the sorted strings of a group."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(column)), ","), 256)


def tree_nodes(digests: DataFrame, depth: int) -> DataFrame:
    """``level``, ``prefix``, ``digest``, ``n_rows`` of every node, from ``digests (digest, n)``.

    Leaves are hashed from their rows, each level above from the (at most 16) children of a node.
    """
    rows = digests.select(F.substring("digest", 1, depth).alias("prefix"), F.concat_ws("x", "digest", "n").alias("one"), "n")
    level = rows.groupBy("prefix").agg(_joined("one").alias("digest"), F.sum("n").alias("n_rows"))
    if depth == 0 and level.isEmpty():
        level = digests.sparkSession.sql("select '' as prefix, sha2('', 256) as digest, 0L as n_rows")
    level = saved(level, "leaves")
    out = level.withColumn("level", F.lit(depth))
    for d in range(depth - 1, -1, -1):
        named = level.select(F.substring("prefix", 1, d).alias("prefix"), F.concat_ws(":", "prefix", "digest").alias("one"), "n_rows")
        level = named.groupBy("prefix").agg(_joined("one").alias("digest"), F.sum("n_rows").alias("n_rows"))
        out = out.unionByName(level.withColumn("level", F.lit(d)))
    return out.select("level", "prefix", "digest", F.col("n_rows").cast("long").alias("n_rows"))


def table_digest(df: DataFrame, columns: list[str], leaf: int = LEAF) -> DataFrame:
    """``digest``, ``n_rows``: one digest of the rows of a table (with repeats), whatever their order."""
    digests = saved(df.select(row_digest(columns).alias("digest")).groupBy("digest").agg(F.count("*").alias("n")), "digests")
    rows = digests.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return tree_nodes(digests, tree_depth(rows, leaf)).filter("level = 0").select("digest", "n_rows")


def write_tree(df: DataFrame, key: list[str], columns: list[str], path: str, leaf: int = LEAF) -> None:
    """Keeps the tree of a version: ``rows`` (digest, n, the key) in the order of digests, and ``nodes``.

    ``key`` names the row; ``columns`` are what is compared, the key included.
    """
    rows = df.select(row_digest(columns).alias("digest"), *key).groupBy("digest", *key).agg(F.count("*").alias("n"))
    lay_out(rows, ["digest"], f"{path}/rows")
    kept = df.sparkSession.read.parquet(f"{path}/rows")
    total = kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    nodes = tree_nodes(kept.select("digest", "n"), tree_depth(total, leaf))
    lay_out(nodes, ["level", "prefix"], f"{path}/nodes")


def _under(table: DataFrame, column: str, prefixes: DataFrame, digits: int) -> DataFrame:
    """Rows whose ``column`` begins with one of ``prefixes (prefix)`` of so many digits.

    A few prefixes become ranges that reach the scan, many are joined.
    """
    if digits == 0:
        return table if not prefixes.isEmpty() else table.limit(0)
    few = prefixes.limit(LISTED + 1).collect()
    if len(few) > LISTED:
        return table.join(prefixes.withColumnRenamed("prefix", "_p"), F.substring(column, 1, digits) == F.col("_p"), "left_semi")
    if not few:
        return table.limit(0)
    names = sorted(r["prefix"] for r in few)
    # neighbouring prefixes are one range: "g" comes after every digit
    runs: list[list[str]] = []
    for name in names:
        if runs and int(name, 16) == int(runs[-1][1], 16) + 1:
            runs[-1][1] = name
        else:
            runs.append([name, name])
    inside = F.lit(False)
    for low, high in runs if len(runs) <= 64 else []:
        inside = inside | ((F.col(column) >= low) & (F.col(column) < high + "g"))
    if len(runs) > 64:
        bounds = (F.col(column) >= names[0]) & (F.col(column) < names[-1] + "g")
        inside = bounds & F.substring(column, 1, digits).isin(names)
    return table.filter(inside)


def differing_leaves(spark: SparkSession, old: str, new: str) -> tuple[DataFrame, int, int]:
    """``prefix`` of the nodes that differ at the deepest level that both trees have, how many digits those have,
    and how many nodes were read.

    Level by level from the root: only children of nodes that differ are read.
    """
    nodes = [spark.read.parquet(f"{p}/nodes") for p in (old, new)]
    depth = min(n.agg(F.max("level")).first()[0] for n in nodes)
    wrong, read = spark.createDataFrame([("",)], "prefix string"), 0
    for level in range(depth + 1):
        a, b = (_under(n.filter(F.col("level") == level), "prefix", wrong, max(0, level - 1)) for n in nodes)
        both = a.select("prefix", F.col("digest").alias("a")).join(b.select("prefix", F.col("digest").alias("b")), "prefix", "full_outer")
        both = saved(both, "level")
        read += both.count()
        wrong = both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("prefix")
    return wrong, depth, read


def tree_differences(spark: SparkSession, old: str, new: str, key: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """``key``, ``status`` (added, removed or changed) of two kept trees, and what was read of them.

    Equal to a full outer join of the tables by key; only rows of leaves that differ are read.  A key that
    several rows have is changed if its rows differ in any way and neither side lacks them all.
    """
    wrong, depth, nodes = differing_leaves(spark, old, new)
    wrong = saved(wrong, "wrong")
    parts = [_under(spark.read.parquet(f"{p}/rows"), "digest", wrong, depth) for p in (old, new)]
    a, b = (saved(p, "leaf-rows") for p in parts)
    read = {"nodes": nodes, "leaves": wrong.count(), "old_rows": a.count(), "new_rows": b.count()}
    same = ["digest", "n", *key]
    only_old, only_new = a.select(*same).exceptAll(b.select(*same)), b.select(*same).exceptAll(a.select(*same))
    sides = only_old.select(*key, F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(only_new.select(*key, F.lit(0).alias("old"), F.lit(1).alias("new")))
    status = F.when(F.sum("old") == 0, "added").when(F.sum("new") == 0, "removed").otherwise("changed")
    return sides.groupBy(*key).agg(status.alias("status")), read
