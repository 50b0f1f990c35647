"""Event-time and stateful operators.  They work on streams; ``run_to_end`` drains a bounded one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from vellum.storage import new_path
from vellum.streaming.marks import held_back, without_unknown


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The table as a stream.  The schema is that of the files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # the pattern makes a table that is one file a folder with one match
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def with_event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Event times without a zone become UTC timestamps, as watermarks need."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the query over all data now there and returns its output table.

    Output and state are in the shared folder.  ``update`` output is written batch by batch with
    its number in ``batch``, for the reader to take the last row of each key.
    """
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).outputMode("append").start()
    else:
        def put(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

        query = writer.foreachBatch(put).outputMode(mode).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else StructType([*stream.schema, StructField("batch", IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)


# -- windows --------------------------------------------------------------------------------------
def tumbling(events: DataFrame, size: str, late: str, by: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregates per window and key; events later than ``late`` are dropped."""
    out = with_event_time(events).withWatermark("ts", late).groupBy(F.window("ts", size), *by).agg(*aggs)
    return out.select(F.col("window.start").alias("window_start"), *[c for c in out.columns if c != "window"])


def sliding(events: DataFrame, size: str, step: str, late: str, by: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregates per overlapping window and key."""
    out = with_event_time(events).withWatermark("ts", late).groupBy(F.window("ts", size, step), *by).agg(*aggs)
    return out.select(F.col("window.start").alias("window_start"), *[c for c in out.columns if c != "window"])


def sessions(events: DataFrame, gap: str, late: str, key: str) -> DataFrame:
    """Runs of a key's events with less than ``gap`` between neighbours: start, end of the gap, count."""
    out = with_event_time(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), key)
    return out.agg(F.count("*").alias("n")).select(
        key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n"
    )


def deduplicated(events: DataFrame, key: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return with_event_time(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def latest_by_key(events: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The last event of each key so far (update mode): one struct of state per key."""
    last = F.max_by(F.struct(*columns), F.struct("ts", "event_id")).alias("r")
    return with_event_time(events).groupBy(key).agg(last).select(key, "r.*")


def joined_within(left: DataFrame, right: DataFrame, key: str, within: str, late: str) -> DataFrame:
    """Pairs of a left event and a right one of the same key that follows within an interval."""
    a = with_event_time(left).withWatermark("ts", late).select(F.col(key), F.col("event_id").alias("left_id"), F.col("ts").alias("left_ts"))
    b = with_event_time(right).withWatermark("ts", late).select(F.col(key).alias("_key"), F.col("event_id").alias("right_id"), F.col("ts").alias("right_ts"))
    near = (F.col("right_ts") >= F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"interval {within}"))
    return a.join(b, (F.col(key) == F.col("_key")) & near).drop("_key")


# -- state per key --------------------------------------------------------------------------------
def due_every(events: DataFrame, key: str, every: int) -> DataFrame:
    """A row each time a key has had ``every`` more events: ``key``, ``reached``.

    State per key is one number, so a hot key costs no memory.
    """
    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        now = before + sum(len(b) for b in batches)
        state.update((now,))
        reached = range((before // every + 1) * every, now + 1, every)
        yield pd.DataFrame({key: [k[0]] * len(reached), "reached": list(reached)}, columns=[key, "reached"])

    kind = dict(events.dtypes)[key]
    return events.select(key).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, reached long", "seen long", "append", GroupStateTimeout.NoTimeout
    )


def with_deadline(events: DataFrame, key: str, ends: str, seconds: int, late: str, keep: int = 86_400) -> DataFrame:
    """How each key's run ended: by an event of type ``ends``, or ``timeout`` in event time.

    ``events`` has ``ts``, ``event_type``; a run starts with its first event.  A key has one outcome:
    ended and timed-out keys are remembered until ``keep`` seconds of event time have passed since
    their last event, and forgotten then.  Columns: key, ``outcome``.
    """
    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, done = state.get if state.exists else (None, 0, False)
        if state.hasTimedOut:
            if done:
                state.remove()
            else:
                state.update((start, last, True))
                state.setTimeoutTimestamp(max(last + 1000 * keep, state.getCurrentWatermarkMs() + 1))
                yield pd.DataFrame({key: [k[0]], "outcome": ["timeout"]})
            return
        over = False
        for b in batches:
            first, last = int(b["ts"].min().timestamp() * 1000), max(last, int(b["ts"].max().timestamp() * 1000))
            start = first if start is None else min(start, first)
            over |= bool((b["event_type"] == ends).any())
        if over and not done:
            yield pd.DataFrame({key: [k[0]], "outcome": ["ended"]})
        done = done or over
        state.update((start, last, done))
        wake = last + 1000 * keep if done else start + 1000 * seconds
        state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))

    kind = dict(events.dtypes)[key]
    timed = with_event_time(events).withWatermark("ts", late).select(key, "ts", "event_type")
    return timed.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, outcome string", "start long, last long, done boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_parts(deltas: DataFrame) -> DataFrame:
    """Text deltas of answers as message parts: a part opens before its first delta and closes at
    its ``end``; ``[n]`` marks over ``known`` go, also where a mark is split between two deltas.

    ``deltas (run, seq, kind, text, known)`` with ``kind`` text or end; columns ``run``, ``seq``,
    ``part``, ``text``.  Rows of a run come in order of ``seq`` within a batch; the state is whether
    a part is open and the unfinished mark.
    """
    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        is_open, held = state.get if state.exists else (False, "")
        rows = pd.concat(list(batches)).sort_values("seq")
        out: list[tuple] = []
        for seq, kind, text, known in zip(rows["seq"], rows["kind"], rows["text"], rows["known"], strict=True):
            if kind == "text":
                if not is_open:
                    out.append((k[0], seq, "open", ""))
                    is_open = True
                whole = held + (text or "")
                held = held_back(whole)
                shown = without_unknown(whole[: len(whole) - len(held)], int(known))
                if shown:
                    out.append((k[0], seq, "delta", shown))
            elif is_open:
                if held:
                    out.append((k[0], seq, "delta", held))
                out.append((k[0], seq, "close", ""))
                is_open, held = False, ""
        state.update((is_open, held))
        yield pd.DataFrame(out, columns=["run", "seq", "part", "text"])

    return deltas.groupBy("run").applyInPandasWithState(
        step, "run long, seq long, part string, text string", "is_open boolean, held string", "append", GroupStateTimeout.NoTimeout
    )
