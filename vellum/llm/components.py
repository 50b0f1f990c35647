"""Connected components of an edge table, and the spanning forest of a batch of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import discard, saved


def merge_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Joins the classes of ``u[i]`` and ``v[i]``; a class is labelled by its smallest index."""
    while len(u):
        a, b = labels[u], labels[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        if not len(u):
            break
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def _shape(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))
        ).first()
    )


def _star(links: DataFrame) -> DataFrame:
    """``links`` with the smallest ``other`` of each ``node``; a hub's rows can be split by AQE."""
    least = links.groupBy("node").agg(F.min("other").alias("least"))
    return links.join(least, "node")


def connected_components(edges: DataFrame) -> DataFrame:
    """Every node of ``edges (a long, b long)`` with the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al. 2014), which turn each component
    into a star about its smallest node in a logarithmic number of rounds.  Each round is written
    to the shared folder, the one before goes; the driver only sees a row count and a checksum.  Loops and repeated
    edges are harmless, edges with a null end are dropped.  An empty table gives an empty table.
    Columns: ``node``, ``component`` (a component's smallest node is its own component).
    """
    now = saved(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        .distinct(),
        "edges",
    )
    shape = _shape(now)
    while shape[0]:
        both = now.select("node", F.col("root").alias("other")).unionByName(
            now.select(F.col("root").alias("node"), F.col("node").alias("other"))
        )
        large = (
            _star(both)
            .filter("other > node")
            .select(F.col("other").alias("node"), F.least("node", "least").alias("root"))
            .distinct()
        )
        down = large.select("node", F.col("root").alias("other"))
        small = (
            _star(down)
            .select(
                F.explode(
                    F.array(
                        F.struct("node", F.col("least").alias("root")),
                        F.struct(F.col("other").alias("node"), F.col("least").alias("root")),
                    )
                ).alias("e")
            )
            .select("e.node", "e.root")
            .filter("node <> root")
            .distinct()
        )
        last, now = now, saved(small, "edges")
        discard(last)
        before, shape = shape, _shape(now)
        if before == shape:
            break
    return now.select("node", F.col("root").alias("component")).unionByName(
        now.select(F.col("root").alias("node"), F.col("root").alias("component")).distinct()
    )
