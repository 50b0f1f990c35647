"""Conversations: turns, pages, context, running budgets, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.text import query_key


def pair_turns(messages: DataFrame) -> DataFrame:
    """Each assistant message that follows a user message, with that message.

    ``messages (conv_id, turn, role, text)``; other roles are left out first, a user message that
    another one follows is overwritten, and an assistant message after another is dropped.  The
    window goes over a conversation, whose messages are ordered by ``turn``.
    """
    order = W.partitionBy("conv_id").orderBy("turn")
    spoken = messages.filter(F.col("role").isin("user", "assistant"))
    back = spoken.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.lag("role").over(order).alias("role_before"),
        F.lag("text").over(order).alias("question"),
        F.lag("turn").over(order).alias("question_turn"),
    )
    return back.filter("role = 'assistant' and role_before = 'user'").select(
        "conv_id", "question_turn", F.col("turn").alias("answer_turn"), "question", F.col("text").alias("answer")
    )


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last ``n`` turns of each conversation, ``age`` 1 being the latest."""
    age = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("answer_turn")))
    return turns.withColumn("age", age.cast("long")).filter(F.col("age") <= n)


def turns_since(turns: DataFrame, skip: int) -> DataFrame:
    """Turns after the first ``skip`` of each conversation."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("answer_turn"))
    return turns.withColumn("place", place.cast("long")).filter(F.col("place") > skip)


def recent_context(turns: DataFrame, most_turns: int, most_chars: int, usable: Column | None = None) -> DataFrame:
    """The latest usable turns whose characters together stay within the budget, oldest dropped."""
    kept = turns if usable is None else turns.filter(usable)
    late = last_turns(kept, most_turns).withColumn("size", F.length("question") + F.length("answer"))
    newest = W.partitionBy("conv_id").orderBy("age").rowsBetween(W.unboundedPreceding, 0)
    return late.withColumn("so_far", F.sum("size").over(newest)).filter(F.col("so_far") <= most_chars)


def page_after(df: DataFrame, moment: str, row_id: str, n: int, after: tuple | None = None) -> DataFrame:
    """One page in descending (moment, id) order, and one row more that tells of a next page.

    The condition is written out, not on a struct, so that it reaches the Parquet scan.
    """
    out = df
    if after is not None:
        t, i = F.lit(after[0]), F.lit(after[1])
        out = out.filter((F.col(moment) <= t) & ((F.col(moment) < t) | (F.col(row_id) < i)))
    return out.orderBy(F.desc(moment), F.desc(row_id)).limit(n + 1)


def page_of_each(df: DataFrame, by: str, moment: str, row_id: str, n: int) -> DataFrame:
    """The newest ``n`` rows of every group, oldest first by ``place``; ``more`` tells of others."""
    newest = W.partitionBy(by).orderBy(F.desc(moment), F.desc(row_id))
    top = df.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= n + 1)
    more = F.max("_age").over(W.partitionBy(by)) > n
    shown = top.withColumn("more", more).filter(F.col("_age") <= n)
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc("_age")))
    return shown.withColumn("place", place.cast("long")).drop("_age")


def summary_due(turns: DataFrame, done: DataFrame, every: int) -> DataFrame:
    """Conversations with at least ``every`` turns that no summary covers: ``waiting``."""
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    open_turns = F.col("n") - F.coalesce("summarized", F.lit(0))
    return n.join(done, "conv_id", "left").withColumn("waiting", open_turns).filter(F.col("waiting") >= every)


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The last vote per user and message."""
    others = [c for c in feedback.columns if c not in ("user_id", "message_id")]
    last = feedback.groupBy("user_id", "message_id").agg(F.max_by(F.struct(*others), "at").alias("r"))
    return last.select("user_id", "message_id", "r.*")


def citation_lists(citations: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Per message the citations in order, with their document's title."""
    full = citations.join(chunks, "chunk_id").join(documents, "document_id")
    item = F.struct("place", "chunk_id", "title")
    return full.groupBy("message_id").agg(F.array_sort(F.collect_list(item)).alias("citations"))


def block_texts(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """The texts of each citation's chunks, joined in the order of its array ``chunk_ids``."""
    each = citations.select("citation_id", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    texts = each.join(chunks.select("chunk_id", "text"), "chunk_id")
    listed = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return texts.groupBy("citation_id").agg(listed.alias("x")).select(
        "citation_id", F.array_join("x.text", "\n\n").alias("block")
    )


def audit_hits(hits: DataFrame, cited: DataFrame) -> DataFrame:
    """Hits of each request and query ranked by score, with ``cited``: whether the answer cites them."""
    place = F.row_number().over(W.partitionBy("request", "query").orderBy(F.desc("score"), "id"))
    marks = cited.select("request", "id").distinct().withColumn("_cited", F.lit(True))
    out = hits.withColumn("rank", place.cast("long")).join(marks, ["request", "id"], "left")
    return out.withColumn("cited", F.coalesce("_cited", F.lit(False))).drop("_cited")


# -- turns as state -------------------------------------------------------------------------------
def next_steps(last: Column, has_evidence: Column, searches: Column, most: int) -> Column:
    """The steps that may follow the last one."""
    more = searches < most
    return (
        F.when(last.isNull(), F.array(F.lit("guard")))
        .when(last == "guard", F.array(F.lit("rephrase"), F.lit("search"), F.lit("answer")))
        .when(last == "rephrase", F.array(F.lit("search"), F.lit("answer")))
        .when(last == "search", F.when(has_evidence, F.array(F.lit("judge"), F.lit("answer"))).otherwise(F.array(F.lit("refine"), F.lit("answer"))))
        .when((last == "judge") & more, F.array(F.lit("refine"), F.lit("answer")))
        .when((last == "refine") & more, F.array(F.lit("search")))
        .otherwise(F.array(F.lit("answer")))
    )


def answer_plan(verdict: Column, needs_search: Column, has_evidence: Column, sufficient: Column) -> Column:
    """What kind of answer a run gives."""
    return (
        F.when(verdict == "block", "blocked")
        .when(verdict == "redirect", "redirect")
        .when(~needs_search, "no_retrieval")
        .when(~has_evidence, "abstain")
        .when(sufficient, "grounded")
        .otherwise("grounded_partial")
    )


def new_queries(proposed: DataFrame, used: DataFrame) -> DataFrame:
    """Proposed queries (request, place, text) that the run hasn't used, each spelling once."""
    keyed = proposed.withColumn("_key", query_key(F.col("text")))
    first = keyed.groupBy("request", "_key").agg(F.min_by(F.struct("place", "text"), "place").alias("q"))
    old = used.select("request", query_key(F.col("text")).alias("_key")).distinct()
    return first.filter("_key <> ''").join(old, ["request", "_key"], "left_anti").select("request", "q.place", "q.text")


def within_budget(calls: DataFrame, by: str, order: str, cost: str, most: int) -> DataFrame:
    """Calls with the running cost ``spent`` and whether it is ``allowed``."""
    upto = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return calls.withColumn("spent", F.sum(cost).over(upto)).withColumn("allowed", F.col("spent") <= most)
