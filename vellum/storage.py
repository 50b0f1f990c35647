"""Tables of the input folder, intermediate tables in the shared folder, and global positions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(table: DataFrame) -> DataFrame:
    """A scan's rows over all cores where it has fewer splits than the cluster has cores.

    For work on texts, which costs far more than moving them; a table of many files stays as it is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) a temporary folder of this machine is
    taken and set; on a cluster its executors couldn't see it, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table read from there.

    It cuts the lineage and fixes what isn't deterministic; lost executors lose none of it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.saved_path = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table that ``saved`` returned and that nothing will read again."""
    spark = table.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(table.saved_path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_in_folder(spark: SparkSession, path: str, name: str) -> str | None:
    """The text of a small file in a folder, empty where it lacks; None where the path is no folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder, where = hadoop.Path(path), hadoop.Path(f"{path}/{name}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not (fs.exists(folder) and fs.getFileStatus(folder).isDirectory()):
        return None
    if not fs.exists(where):
        return ""
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def with_positions(df: DataFrame, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``position``: 1, 2, … within each group ``by``, in ``order``, and ``group_rows``.

    A window over a group would put a group that holds a third of the rows into one task.  Here
    the rows are range-partitioned by group and order, written once, numbered within partitions
    and shifted by the counts of the partitions before: no task has more than its range.  ``order``
    has to be total (end with a unique id); columns named like the results are replaced.
    """
    df = df.drop("position", "group_rows")
    keys = [F.col(c) for c in by]
    cut = saved(
        df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), "ranges"
    )
    counts = cut.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    ahead = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_slice").alias("_slice_of"),
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(*by)).alias("group_rows"),
    )
    same = F.col("_slice") == F.col("_slice_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = W.partitionBy(*by, "_slice").orderBy(*order)
    return (
        cut.withColumn("_inside", F.row_number().over(inside))
        .join(shifts, same)
        .withColumn("position", (F.col("_inside") + F.col("_before")).cast("long"))
        .drop("_slice", "_slice_of", "_inside", "_before", *[f"_by_{c}" for c in by])
    )
