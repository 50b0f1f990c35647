"""What the operators share: Arrow mapping, broadcasts of counted tables, cutting of hot groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.storage import discard, read_table, saved

__all__ = ["arrow_schema", "discard", "documents", "free_name", "in_parts", "map_columns", "read_table", "saved", "small", "small_batches"]

#: Rows of a batch that goes to Python; texts may be long.
BATCH_ROWS = 512
_BATCHES, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
#: Rows of ids, of some 16 bytes, that go to every task; more are joined by a shuffle.
SMALL_ROWS = 1_000_000

_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
    "array<float>": pa.list_(pa.float32()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string made of the types in ``_ARROW``."""
    return pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in ddl.split(", "))])


def small_batches(table: DataFrame) -> DataFrame:
    """``table``, whose session sends batches of BATCH_ROWS rows to Python from now on.

    All operators here ask for the same, and only where the session has Spark's default: a value
    that the caller has set stays.
    """
    conf = table.sparkSession.conf
    if conf.get(_BATCHES) == _DEFAULT:
        conf.set(_BATCHES, BATCH_ROWS)
    return table


def map_columns(df: DataFrame, make: Callable[[], Callable], ddl: str) -> DataFrame:
    """Maps Arrow batches of ``df`` through a function of Python lists, one list per column.

    ``make`` runs once per task and returns the function, so that indexes and caches are built
    once; the function returns one list (or array) per column of ``ddl``.
    """
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                out = fn(*[c.to_pylist() for c in batch.slice(at, BATCH_ROWS).columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=f.type) for v, f in zip(out, schema, strict=True)],
                    schema=schema,
                )

    return small_batches(df).mapInArrow(run, ddl)


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of the table, a null text being empty; other columns go."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A written table, for broadcasting if it has at most ``rows`` rows (they are counted)."""
    return F.broadcast(table) if table.count() <= rows else table


def free_name(table: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of the table."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_parts(rows: DataFrame, names: list[str], most: int, by: str, size: Column | None = None, most_size: int = 1) -> DataFrame:
    """``rows`` with ``low``, ``high``, ``part``: a row for each task that it takes part in.

    Groups by ``names`` of over ``most`` rows, or over ``most_size`` in sum of ``size``, are cut into
    parts by the hash of the column ``by``; a task has a pair of parts (or one part with itself), so
    that each two rows of a group meet and no task has a whole hot group.
    """
    parts = F.ceil(F.count("*") / most)
    if size is not None:
        parts = F.greatest(parts, F.ceil(F.sum(size) / most_size))
    large = rows.groupBy(*names).agg(parts.cast("int").alias("parts")).filter("parts > 1")
    salted = rows.join(large, names, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    salted = salted.withColumn("part", F.pmod(F.xxhash64(by), F.col("parts")).cast("int"))
    return (
        salted.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("low", F.least("part", "_other"))
        .withColumn("high", F.greatest("part", "_other"))
        .drop("parts", "_other")
    )
