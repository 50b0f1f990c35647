"""A journal that a streaming query appends to exactly once.

A batch is a folder of sealed rows, and counts from when its commit file is there.  The commit is put in
place by one rename and names the journal's identity, the batch, its rows and the digest of its seals.  A
batch that comes again after a restart is skipped if its commit is there; rows without a commit, which a lost
driver left, are written anew.  So each batch is in the journal once, however often the query is killed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.arrays import sealed
from vellum.operators.digests import table_digest
from vellum.sinks.versions import file_exists, list_names, read_text_file, write_text_file


class JournalError(ValueError):
    """The folder is another query's journal, or what a commit promises isn't there."""


def _commit(path: str, number: int) -> str:
    return f"{path}/commits/{number:020d}.json"


def _claim(spark: SparkSession, path: str, identity: str) -> None:
    """Binds the journal to ``identity``, or checks that it is."""
    where = f"{path}/IDENTITY"
    if not file_exists(spark, where):
        write_text_file(spark, where, identity)
    found = read_text_file(spark, where)
    if found != identity:
        raise JournalError(f"{path} belongs to {found!r}, not to {identity!r}")


def append_batch(batch: DataFrame, number: int, path: str, identity: str) -> bool:
    """Appends one batch; False if the journal has it already."""
    spark = batch.sparkSession
    _claim(spark, path, identity)
    if file_exists(spark, _commit(path, number)):
        return False
    here = f"{path}/batches/{number:020d}"
    batch.withColumn("seal", sealed(F.struct(*batch.columns))).write.mode("overwrite").parquet(here)
    kept = table_digest(spark.read.parquet(here), ["seal"]).first()
    row = {"identity": identity, "batch": number, "rows": kept["n_rows"], "digest": kept["digest"]}
    write_text_file(spark, _commit(path, number), json.dumps(row, sort_keys=True))
    return True


def journal_sink(path: str, identity: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``; ``identity`` names the query, across its restarts."""

    def put(batch: DataFrame, number: int) -> None:
        append_batch(batch, number, path, identity)

    return put


def commits(spark: SparkSession, path: str) -> list[dict]:
    """What the commits say, by batch."""
    names = sorted(n for n in list_names(spark, f"{path}/commits") if n.endswith(".json"))
    return [json.loads(read_text_file(spark, f"{path}/commits/{n}")) for n in names]


def read_journal(spark: SparkSession, path: str, schema: str, check: bool = True) -> DataFrame:
    """The rows of all committed batches, with ``batch`` and ``seal``; what isn't committed is left out.

    With ``check`` a batch whose rows aren't those of its commit, or a row that isn't that of its seal, is a
    JournalError.
    """
    out = None
    for c in commits(spark, path):
        rows = spark.read.schema(f"{schema}, seal string").parquet(f"{path}/batches/{c['batch']:020d}")
        if check:
            kept = table_digest(rows, ["seal"]).first()
            names = [n for n in rows.columns if n != "seal"]
            broken = rows.filter(~F.col("seal").eqNullSafe(sealed(F.struct(*names))))
            if (kept["n_rows"], kept["digest"]) != (c["rows"], c["digest"]) or not broken.isEmpty():
                raise JournalError(f"batch {c['batch']} of {path} isn't what was committed")
        rows = rows.withColumn("batch", F.lit(c["batch"]).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], f"{schema}, seal string, batch long")
