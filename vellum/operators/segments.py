"""Kept indexes as folders of segments, one per release: what is common to postings and vectors.

A segment's table ``totals`` is written last: a segment without it isn't there.  ``gone`` lists the documents
of earlier segments that a release replaces or deletes, so a search as of any release sees what held then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.storage import saved


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def segments(spark: SparkSession, path: str, upto: int | None = None) -> list[int]:
    """The releases whose segments are complete, in order, up to one."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(where)]
    numbers = sorted(int(n.removeprefix("segment=")) for n in found if n.startswith("segment="))
    done = [n for n in numbers if fs.exists(_fs(spark, f"{path}/segment={n}/totals/_SUCCESS")[1])]
    return [n for n in done if upto is None or n <= upto]


def earlier(spark: SparkSession, path: str, release: int) -> list[int]:
    """The segments before a new ``release``, which has to come after all of them."""
    numbers = segments(spark, path)
    if numbers and numbers[-1] >= release:
        raise ValueError(f"release {release} is not after {numbers[-1]}, the last of {path}")
    return numbers


def read_part(spark: SparkSession, path: str, part: str, numbers: list[int]) -> DataFrame:
    """A table of several segments, with ``segment``."""
    out = None
    for n in numbers:
        one = spark.read.parquet(f"{path}/segment={n}/{part}").withColumn("segment", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def lay_out(table: DataFrame, order: list[str], path: str, folder: str | None = None) -> None:
    """Writes a table in ranges of ``order``, in folders where one is named."""
    keys = [folder, *order] if folder else order
    out = table.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite")
    (out.partitionBy(folder) if folder else out).parquet(path)


def live(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Rows of ``id``, ``segment`` that no later segment takes back."""
    if gone is None:
        return rows
    taken = gone.select(F.col("id").alias("gone_id"), F.col("segment").alias("gone_in"))
    return rows.join(taken, (F.col("id") == F.col("gone_id")) & (F.col("segment") < F.col("gone_in")), "left_anti")


def gone_rows(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame | None:
    """``id``, ``segment`` of all that later segments take back; None where there is one segment only."""
    return read_part(spark, path, "gone", numbers).select("id", "segment") if len(numbers) > 1 else None


def unique_rows(rows: DataFrame, value: str) -> DataFrame:
    """``rows (id, …)`` with one row per id: of several the one with the greatest ``value``.

    Only rows of repeated ids are shuffled with their values.
    """
    kept = rows.filter("id is not null").withColumn("id", F.col("id").cast("long"))
    twice = saved(kept.groupBy("id").count().filter("count > 1").select("id"), "repeated")
    if twice.isEmpty():
        return kept
    names = [c for c in kept.columns if c != "id"]
    most = kept.join(twice, "id", "left_semi").groupBy("id").agg(F.max(F.struct(value, *[c for c in names if c != value])).alias("v"))
    return kept.join(twice, "id", "left_anti").unionByName(most.select("id", *[F.col(f"v.{c}").alias(c) for c in names]))
