"""Conversations and events: turns, context, screens, citations; and the same events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text
from vellum.operators import history
from vellum.plans.registry import query
from vellum.storage import new_path, read_table
from vellum.streaming import events as streams
from vellum.streaming import journal, runs

_TURNS = """
with s as (select * from conversations where role in ('user', 'assistant')),
w as (select *, lag(role) over p as rb, lag(text) over p as q, lag(turn) over p as qt from s window p as (partition by conv_id order by turn)),
turns as (select conv_id, qt as question_turn, turn as answer_turn, q as question, text as answer from w where role = 'assistant' and rb = 'user')
"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.pair_turns(read_table(spark, sf_dir, "conversations"))


@query(_TURNS + "select conv_id, question_turn, answer_turn, md5(question) as question, md5(answer) as answer from turns")
def paired_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer with the user message right before it."""
    return _turns(spark, sf_dir).withColumns({"question": F.md5("question"), "answer": F.md5("answer")})


@query(_TURNS + "select conv_id, answer_turn, row_number() over (partition by conv_id order by answer_turn desc) as age from turns qualify age <= 2")
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two turns of each conversation."""
    return history.last_turns(_turns(spark, sf_dir), 2).select("conv_id", "answer_turn", "age")


@query(_TURNS + "select conv_id, answer_turn, row_number() over (partition by conv_id order by answer_turn) as place from turns qualify place > 2")
def turns_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns after the first two."""
    return history.turns_since(_turns(spark, sf_dir), 2).select("conv_id", "answer_turn", "place")


@query(
    _TURNS
    + """, l as (select conv_id, answer_turn, length(question) + length(answer) as size, row_number() over (partition by conv_id order by answer_turn desc) as age from turns),
    c as (select *, sum(size) over (partition by conv_id order by age) as so_far from l where age <= 4)
    select conv_id, answer_turn, so_far::bigint as so_far from c where so_far <= 600"""
)
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest turns, at most four, within 600 characters."""
    return history.recent_context(_turns(spark, sf_dir), 4, 600).select("conv_id", "answer_turn", "so_far")


@query(
    _TURNS
    + """, n as (select conv_id, count(*) as n from turns group by 1)
    select conv_id, (n - case when conv_id % 2 = 0 then 1 else 0 end)::bigint as waiting from n where n - case when conv_id % 2 = 0 then 1 else 0 end >= 2"""
)
def summaries_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with two turns or more that no summary covers."""
    turns = _turns(spark, sf_dir)
    done = turns.filter("conv_id % 2 = 0").select("conv_id", F.lit(1).alias("summarized")).distinct()
    return history.summary_due(turns, done, 2).select("conv_id", F.col("waiting").cast("long").alias("waiting"))


@query(
    """with f as (select conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as t from conversations where role = 'user')
    select conv_id, turn, case when regexp_matches(t, 'the (\\w+) the') then 'loop' when regexp_matches(t, '(^| )(and|with) ') then 'join' else 'allowed' end as verdict from f"""
)
def guard_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first group of patterns that a message meets."""
    groups = {"loop": r"the (\w+) the", "join": "(^| )(and|with) "}
    rows = read_table(spark, sf_dir, "conversations").filter("role = 'user'")
    return rows.select("conv_id", "turn", F.coalesce(text.first_group(F.col("text"), groups), F.lit("allowed")).alias("verdict"))


@query(
    """with m as (select conv_id, turn, regexp_replace(text, '\\. ', '. [' || turn % 4 || '] ', 'g') as t from conversations where role = 'assistant'),
    s as (select conv_id, turn, t, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)),
      lambda x: trim(x, ' \t\n\r')), lambda x: x <> '') as ss from m)
    select conv_id, turn, len(ss) as sentences,
      len(list_filter(ss, lambda x: not regexp_matches(x, '^(#|---|\\|)') and len(regexp_split_to_array(trim(regexp_replace(x, '\\[[0-9]+\\]', '', 'g'), ' \t\n\r'), '\\s+')) >= 4)) as content,
      len(list_filter(ss, lambda x: regexp_matches(x, '\\[[0-9]+\\]'))) as cited, md5(regexp_replace(t, '\\[0*(0|[3-9]|[1-9][0-9]+)\\]', '', 'g')) as sanitized from s"""
)
def answer_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, content sentences and citations of answers."""
    rows = read_table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    marked = F.regexp_replace("text", r"\. ", F.concat(F.lit(". ["), F.col("turn") % 4, F.lit("] ")))
    return rows.select(
        "conv_id", "turn", F.size(text.sentences(marked)).alias("sentences"), F.size(text.stated_sentences(marked)).alias("content"),
        F.size(text.marked_sentences(marked)).alias("cited"), F.md5(text.only_known_citations(marked, F.lit(2))).alias("sanitized"),
    )


@query(
    """with v as (select user_id, event_id % 50 as message_id, event_type as vote, ts as at_, event_id from events)
    select user_id, message_id, vote from v qualify row_number() over (partition by user_id, message_id order by at_ desc, event_id desc) = 1"""
)
def latest_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last vote per user and message."""
    rows = read_table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50).alias("message_id"), F.col("event_type").alias("vote"), F.struct("ts", "event_id").alias("at"))
    return history.latest_feedback(rows).select("user_id", "message_id", "vote")


@query(
    """with h as (select conv_id as request, turn % 2 as query, turn as id, length(text) % 10 as score, turn % 3 = 0 as cited from conversations)
    select request, query, id, cited, row_number() over (partition by request, query order by score desc, id) as rank from h"""
)
def audited_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits per request and query ranked by score, with a mark on the cited ones."""
    rows = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("request"), (F.col("turn") % 2).alias("query"), F.col("turn").alias("id"), (F.length("text") % 10).alias("score")
    )
    out = history.audit_hits(rows, rows.filter("id % 3 = 0").select("request", "id"))
    return out.select("request", "query", "id", "cited", "rank")


@query(
    """with u as (select distinct conv_id as request, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as k from conversations where turn <= 1),
    p as (select conv_id as request, turn as place, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as k from conversations where turn >= 1),
    f as (select request, k, min(place) as place from p where k <> '' group by all)
    select request, place from f where (request, k) not in (select request, k from u)"""
)
def new_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed queries that a run hasn't used yet in any spelling."""
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("place"), "text")
    return history.new_queries(rows.filter("place >= 1"), rows.filter("place <= 1")).select("request", "place")


@query(
    """select conv_id, turn, case when role = 'system' then 'blocked' when turn % 2 = 0 then 'no_retrieval' when turn % 3 = 0 then 'abstain'
         when length(text) > 100 then 'grounded' else 'grounded_partial' end as plan,
       case when turn = 0 then 'guard' when turn = 1 then 'rephrase,search,answer' when turn = 2 then 'search,answer'
            when turn = 3 then case when length(text) > 100 then 'judge,answer' else 'refine,answer' end else 'answer' end as steps from conversations"""
)
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of answer a run gives, and the steps that may come next."""
    turn = F.col("turn")
    long = F.length("text") > 100
    plan = history.answer_plan(F.when(F.col("role") == "system", "block").otherwise("pass"), turn % 2 != 0, turn % 3 != 0, long)
    last = F.when(turn == 1, "guard").when(turn == 2, "rephrase").when(turn == 3, "search").when(turn > 3, "judge")
    steps = history.next_steps(last, long, turn, 4)
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", plan.alias("plan"), F.array_join(steps, ",").alias("steps"))


# -- streams --------------------------------------------------------------------------------------
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.read_stream(spark, sf_dir, "events")


_END = "(select max(ts) - interval 10 minute from events)"


@query(
    f"""with w as (select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all)
    select * from w where window_start + interval 1 hour <= {_END}"""
)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and sums by event type, as the watermark closes the hours."""
    aggs = [F.count("*").alias("n"), F.sum("value").alias("total")]
    out = streams.run_to_end(streams.tumbling(_events(spark, sf_dir), "1 hour", "10 minutes", ["event_type"], aggs), "tumbling")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    f"""with e as (select ts, event_type from events), s as (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as window_start, event_type from e)
    select window_start, event_type, count(*) as n from s where window_start + interval 2 hour <= {_END} group by all"""
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over two hours, every hour."""
    out = streams.run_to_end(streams.sliding(_events(spark, sf_dir), "2 hours", "1 hour", "10 minutes", ["event_type"], [F.count("*").alias("n")]), "sliding")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(
    f"""with e as (select user_id, ts, coalesce(ts >= lag(ts) over p + interval 30 minute, true) as opens from events window p as (partition by user_id order by ts)),
    g as (select *, sum(opens::int) over (partition by user_id order by ts) as s from e),
    r as (select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from g group by user_id, s)
    select * from r where session_end <= {_END}"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with gaps under thirty minutes."""
    out = streams.run_to_end(streams.sessions(_events(spark, sf_dir), "30 minutes", "10 minutes", "user_id"), "sessions")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("select user_id, count(distinct event_type) as n from events group by 1")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types per user from a deduplicated stream."""
    out = streams.run_to_end(streams.deduplicated(_events(spark, sf_dir), ["user_id", "event_type"], "3650 days").select("user_id", "event_type"), "distinct")
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


@query("select user_id, event_id, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, in update mode."""
    out = streams.run_to_end(streams.latest_by_key(_events(spark, sf_dir), "user_id", ["event_id", "value"]), "latest", "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), "batch").alias("r"))
    return last.select("user_id", "r.event_id", "r.value")


@query("select user_id, unnest(range(5, count(*) + 1, 5)) as reached from events group by user_id having count(*) >= 5")
def stream_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each fifth event of a user: keyed state."""
    return streams.run_to_end(streams.due_every(_events(spark, sf_dir), "user_id", 5), "due")


@query(
    """select a.user_id, a.event_id as left_id, b.event_id as right_id from events a join events b on a.user_id = b.user_id
       where a.event_type = 'view' and b.event_type = 'purchase' and b.ts >= a.ts and b.ts <= a.ts + interval 2 hour"""
)
def stream_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and the purchases that follow within two hours: a join of two streams."""
    views = _events(spark, sf_dir).filter("event_type = 'view'")
    buys = _events(spark, sf_dir).filter("event_type = 'purchase'")
    out = streams.run_to_end(streams.joined_within(views, buys, "user_id", "2 hours", "10 minutes"), "joined")
    return out.select("user_id", "left_id", "right_id")


@query(
    """with w as (select max(ts) - interval 10 minute as mark from events),
    g as (select user_id, min(ts) as start, bool_or(event_type = 'purchase') as ended from events group by 1)
    select user_id, case when ended then 'ended' else 'timeout' end as outcome from g, w where ended or start + interval 1 hour < mark"""
)
def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user's run of events ends with a purchase or times out.  Keyed state with a timer."""
    return streams.run_to_end(streams.with_deadline(_events(spark, sf_dir), "user_id", "purchase", 3600, "10 minutes"), "outcomes")


@query(
    """with d as (select conv_id as run, turn as seq, role = 'user' as ends, coalesce(lag(role <> 'user') over (partition by conv_id order by turn), false) as is_open,
         regexp_replace(text, '\\[0*(0|[4-9]|[1-9][0-9]+)\\]', '', 'g') as shown from conversations)
    select run, seq, 'open' as part, '' as text from d where not ends and not is_open
    union all select run, seq, 'delta', shown from d where not ends and shown <> ''
    union all select run, seq, 'close', '' from d where ends and is_open"""
)
def stream_message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text deltas as message parts with citation marks cleaned.  Keyed state; tested on deltas."""
    deltas = streams.read_stream(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "end").otherwise("text").alias("kind"),
        F.col("text"), F.lit(3).alias("known"),
    )
    return streams.run_to_end(streams.stream_parts(deltas), "parts")


@query("select event_id, user_id, event_type, 1::bigint as times from events")
def stream_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a stream appended to a journal: each once, though every batch comes a second time."""
    path, state = new_path(spark, "journal"), new_path(spark, "journal-state")
    put = journal.journal_sink(path, "events")

    def twice(batch: DataFrame, number: int) -> None:
        put(batch, number)
        put(batch, number)

    rows = streams.read_stream(spark, sf_dir, "events", 1).select("event_id", "user_id", "event_type")
    rows.writeStream.foreachBatch(twice).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    kept = journal.read_journal(spark, path, "event_id long, user_id long, event_type string")
    return kept.groupBy("event_id", "user_id", "event_type").agg(F.count("*").alias("times"))


@query("select user_id, 'ended' as outcome, 1 as run, count(*) as events from events group by user_id having count(*) filter (where event_type = 'purchase') > 0")
def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of users that a purchase ended, by state variables and a timer per user."""
    tracked = runs.tracked_runs(streams.read_stream(spark, sf_dir, "events"), "user_id", "purchase", seconds=86_400)
    out, state = new_path(spark, "runs"), new_path(spark, "runs-state")
    with runs.column_state(spark):
        # one batch of all that is there: with timers in processing time a query never runs out of batches
        writer = tracked.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        writer.trigger(once=True).start().awaitTermination()
    return spark.read.schema(tracked.schema).parquet(out)
