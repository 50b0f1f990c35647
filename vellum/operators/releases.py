"""Versioned releases of a corpus as tables: staging, publishing, rollback, retirement, purging.

Tables: ``releases (release_id, collection_id, number, status, digest, chunker, model,
published_at)``, ``current (collection_id, release_id)``, ``bridge (release_id, chunk_id, section,
ordinal)``, ``chunks (chunk_id, …)`` and ``points (id, release_ids, …)``.  Nothing is changed in
place: each function returns the next version of a table, which ``sinks.versions`` publishes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.operators.relations import upserted

READY, STAGED, RETIRED = "ready", "staged", "retired"


def _many(ids: DataFrame) -> DataFrame:
    """The right side of a join whose rows grow with the input: both sides are shuffled.

    Files of ids are far smaller than what a task would hold of them, so by their size Spark would send
    millions of ids to the driver and to every executor.
    """
    return ids.hint("merge")


def same_release(releases: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (collection_id, digest, chunker, model) the newest release that isn't retired."""
    key = ["collection_id", "digest", "chunker", "model"]
    alive = releases.filter(F.col("status") != RETIRED)
    newest = alive.groupBy(*key).agg(F.max_by("release_id", "number").alias("release_id"))
    return wanted.select(*key).join(_many(newest), key, "left")


def import_decision(wanted: DataFrame, releases: DataFrame, current: DataFrame) -> DataFrame:
    """``no_change``, ``reused`` or ``imported`` for each bundle to import."""
    found = same_release(releases, wanted)
    now = current.select("collection_id", F.col("release_id").alias("current_id"))
    decision = (
        F.when(F.col("release_id").isNull(), "imported")
        .when(F.col("release_id") == F.col("current_id"), "no_change")
        .otherwise("reused")
    )
    return found.join(_many(now), "collection_id", "left").withColumn("decision", decision)


def staged(releases: DataFrame, bundle: DataFrame) -> DataFrame:
    """Releases with one more for each row of ``bundle``: the next number of its collection."""
    last = releases.groupBy("collection_id").agg(F.max("number").alias("_last"))
    turn = F.row_number().over(W.partitionBy("collection_id").orderBy("release_id"))
    new = bundle.join(_many(last), "collection_id", "left").withColumns(
        {
            "number": (F.coalesce("_last", F.lit(0)) + turn).cast("long"),
            "status": F.lit(STAGED),
            "published_at": F.lit(None).cast("timestamp"),
        }
    )
    return releases.unionByName(new.select(*releases.columns))


def marked_ready(releases: DataFrame, counts: DataFrame) -> DataFrame:
    """Staged releases become ready where as many points are indexed as chunks are expected.

    ``counts (release_id, expected, indexed)``.
    """
    full = counts.filter("expected = indexed").select("release_id").withColumn("_full", F.lit(True))
    now = F.when(F.col("_full") & (F.col("status") == STAGED), READY).otherwise(F.col("status"))
    return releases.join(_many(full), "release_id", "left").withColumn("status", now).drop("_full").select(*releases.columns)


def published(releases: DataFrame, current: DataFrame, chosen: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(releases, current) after the ready releases of ``chosen (release_id)`` become current."""
    ids = chosen.select("release_id").distinct().withColumn("_chosen", F.lit(True))
    ready = F.col("_chosen") & (F.col("status") == READY)
    marked = releases.join(_many(ids), "release_id", "left")
    moment = F.when(ready, F.coalesce("published_at", at)).otherwise(F.col("published_at"))
    new = marked.filter(ready).groupBy("collection_id").agg(F.max_by("release_id", "number").alias("release_id"))
    return (
        marked.withColumn("published_at", moment).select(*releases.columns),
        upserted(current.select("collection_id", "release_id"), new, ["collection_id"]),
    )


def rollback_targets(releases: DataFrame, current: DataFrame) -> DataFrame:
    """Per collection the ready release that was published last before the current one."""
    at = releases.select(F.col("release_id").alias("_now"), F.col("published_at").alias("_since"))
    pairs = releases.filter(F.col("status") == READY).join(
        _many(current.select("collection_id", F.col("release_id").alias("_now"))), "collection_id"
    ).join(_many(at), "_now")
    before = pairs.filter(F.col("published_at") < F.col("_since"))
    return before.groupBy("collection_id").agg(
        F.max_by("release_id", F.struct("published_at", "number")).alias("release_id")
    )


def to_retire(releases: DataFrame, current: DataFrame, keep: int) -> DataFrame:
    """Live releases beyond the current one and the newest ``keep`` others of each collection."""
    others = releases.filter(F.col("status") != RETIRED).join(_many(current.select("release_id")), "release_id", "left_anti")
    age = F.row_number().over(W.partitionBy("collection_id").orderBy(F.desc("number")))
    return others.withColumn("age", age).filter(F.col("age") > keep).select("collection_id", "release_id", "number")


def retired(releases: DataFrame, gone: DataFrame) -> DataFrame:
    """Releases with those of ``gone`` marked as retired."""
    ids = gone.select("release_id").distinct().withColumn("_gone", F.lit(True))
    now = F.when(F.col("_gone"), RETIRED).otherwise(F.col("status"))
    return releases.join(_many(ids), "release_id", "left").withColumn("status", now).select(*releases.columns)


def memberships(bridge: DataFrame, releases: DataFrame) -> DataFrame:
    """For each chunk of a live release the sorted ids of the live releases that have it."""
    alive = releases.filter(F.col("status") != RETIRED).select("release_id")
    live = bridge.join(_many(alive), "release_id", "left_semi")
    return live.groupBy("chunk_id").agg(F.array_sort(F.collect_set("release_id")).alias("release_ids"))


def with_memberships(points: DataFrame, members: DataFrame) -> DataFrame:
    """Points with new release lists; points of no live release are gone."""
    return points.drop("release_ids").join(_many(members.withColumnRenamed("chunk_id", "id")), "id")


def release_counts(points: DataFrame) -> DataFrame:
    """Points per release."""
    each = points.select(F.explode("release_ids").alias("release_id"))
    return each.groupBy("release_id").agg(F.count("*").alias("n"))


def unreferenced(rows: DataFrame, references: list[tuple[DataFrame, str]], key: str) -> DataFrame:
    """Rows that none of the tables refers to: a chain of anti-joins."""
    for table, column in references:
        used = table.select(F.col(column).alias(key)).filter(F.col(key).isNotNull())
        rows = rows.join(_many(used), key, "left_anti")
    return rows


def purge_report(chunks: DataFrame, bridge: DataFrame, releases: DataFrame, citations: DataFrame) -> DataFrame:
    """One row: chunks without a live release that go (``deleted``), or stay as they are cited (``kept``)."""
    live = memberships(bridge, releases).select("chunk_id")
    dead = chunks.select("chunk_id").join(_many(live), "chunk_id", "left_anti")
    cited = citations.select("chunk_id").distinct().withColumn("_cited", F.lit(True))
    return dead.join(_many(cited), "chunk_id", "left").agg(
        F.count_if(F.col("_cited").isNull()).alias("deleted"), F.count_if(F.col("_cited").isNotNull()).alias("kept")
    )


def expired(df: DataFrame, moment: str, now: Column, seconds: int) -> DataFrame:
    """Rows older than their lifetime."""
    return df.filter(F.col(moment) < now - F.make_dt_interval(secs=F.lit(seconds)))


def reindexed(points: DataFrame, releases: DataFrame, model: str) -> DataFrame:
    """Points of live releases that the model made: what a rebuild of the index takes."""
    own = releases.filter((F.col("status") != RETIRED) & (F.col("model") == model)).select("release_id")
    hit = points.select("id", F.explode("release_ids").alias("release_id")).join(_many(own), "release_id", "left_semi")
    return points.join(_many(hit.select("id").distinct()), "id", "left_semi")


def snapshot_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name``, ``n_rows`` of each table of a snapshot."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
