"""Repair of conversation structure by weighted finite-state composition.

Three machines: the input acceptor reads a conversation's rows in order, the edit transducer keeps, deletes,
re-labels or inserts turns at a cost, and the grammar acceptor takes role initials ``(s?(ua)+)?``.  Their
composition is expanded state by state, from the end, and never built: a state is a place in
the input, how many turns the gap there has got, and a state of the grammar.  It has no cycle, since two turns
inserted in one gap lead to where no turn does, so a third is never of use.  The weights are pairs of a
cost and the string of the edits' initials, of which the less in lexicographic order counts; strings are not
compared, but their ranks among the states of one level.

Of two paths over the same rows between the same states, with equal cost, neither's string starts the
other (what it went on with would be insertions, which cost), so the least of a part stays the least
whatever follows.  Thus a conversation of any length can be cut into segments, whose weights between each two
grammar states are found by tasks of their own and multiplied afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import saved, small
from vellum.storage import with_positions

#: Edits' initials in ASCII order and what they cost; a truncated row that isn't deleted costs as much more.
DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
TRUNCATED_COST = 3
#: Roles by initial that edits can give.
GIVEN = {"u": "user", "a": "assistant"}
#: The grammar's states: nothing read, a system turn, a user turn, an assistant turn; its moves and ends.
STATES = range(4)
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ENDS = {0, 3}
LEGAL = {"su", "ua", "au"}
#: Insertions in one gap at most, by the argument above.
IN_GAP = 2
#: Faults of a row.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: White space, ends of sentences.
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: Rows of a conversation that are repaired in one piece; of longer ones, rows of a segment.
MOST_ROWS, SEGMENT = 4096, 1024
RESULT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class Row(NamedTuple):
    """What the machines read of a row."""

    initial: str
    fault: int


class Edit(NamedTuple):
    """One edit of a path: its initial, and the initial of the role it gives ('' where it gives none)."""

    label: str
    given: str


def row_edits(row: Row) -> list[tuple[str, str, int]]:
    """The transducer's arcs that read a row: label, initial of the role that comes out, cost."""
    arcs = [(DELETE, "", COST[DELETE])]
    if row.fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_COST if row.fault == TRUNCATED else 0
        arcs.append((KEEP, row.initial, COST[KEEP] + more))
        arcs += [(REROLE, g, COST[REROLE] + more) for g in GIVEN]
    return arcs


def grammar_move(state: int, label: str, initial: str) -> int | None:
    """Where the grammar is after a role's initial; deleted rows and empty roles say nothing."""
    return state if label == DELETE or not initial else MOVES.get((state, initial))


def best_paths(rows: list[Row], ends: set[int], closing: bool) -> dict[int, tuple[int, list[Edit]]]:
    """Of each grammar state that can start before ``rows`` and reach one of ``ends``: cost and edits.

    ``closing`` tells that the conversation ends here, so that turns may be inserted after the last row.
    States are met in reverse topological order; one that reaches no end is never expanded further.
    """
    # of a level's states: cost, rank of the string, label, given initial, the state after
    after: dict[int, tuple] = {}
    levels: list[list[dict[int, tuple]]] = []
    for i in range(len(rows), -1, -1):
        arcs = row_edits(rows[i]) if i < len(rows) else None
        gap: list[dict[int, tuple]] = [{} for _ in range(IN_GAP + 1)]
        for k in range(IN_GAP, -1, -1):
            level = {}
            for g in STATES:
                found = []
                if arcs is None:
                    if g in ends:
                        found.append((0, "", -1, "", g))
                else:
                    for label, given, cost in arcs:
                        to = grammar_move(g, label, given)
                        if to in after:
                            found.append((cost + after[to][0], label, after[to][1], given, to))
                if k < IN_GAP and (arcs is not None or closing):
                    for given in GIVEN:
                        to = MOVES.get((g, given))
                        if to in gap[k + 1]:
                            found.append((COST[INSERT] + gap[k + 1][to][0], INSERT, gap[k + 1][to][1], given, to))
                if found:
                    level[g] = min(found)
            ranks = {s: r for r, s in enumerate(sorted({v[1:3] for v in level.values()}))}
            gap[k] = {g: (v[0], ranks[v[1:3]], v[1], v[3], v[4]) for g, v in level.items()}
        levels.append(gap)
        after = gap[0]
    levels.reverse()
    out = {}
    for start, top in after.items():
        edits, i, k, g = [], 0, 0, start
        while True:
            _, _, label, given, to = levels[i][k][g]
            if not label:
                break
            edits.append(Edit(label, given))
            i, k, g = (i, k + 1, to) if label == INSERT else (i + 1, 0, to)
        out[start] = (top[0], edits)
    return out


def repaired_lines(rows: list[tuple[str, str]], edits: list[Edit]) -> Iterator[str]:
    """The lines ``role:text`` of rows of role and text after edits."""
    left = iter(rows)
    for label, given in edits:
        if label == INSERT:
            yield f"{GIVEN[given]}:"
            continue
        role, text = next(left)
        if label != DELETE:
            yield f"{GIVEN[given] if label == REROLE else role}:{text}"


def text_fault(text: str) -> int:
    """BLANK, TRUNCATED or FINE by the text alone."""
    end = text.rstrip(SPACE)[-1:]
    return BLANK if not end else FINE if end in STOPS else TRUNCATED


def repair(rows: list[tuple[int | None, str, str]]) -> tuple:
    """The columns of RESULT for a whole conversation: rows of turn, role and text in order."""
    seen, read, faults = set(), [], [0, 0, 0, 0]
    for _, role, text in rows:
        fault = text_fault(text)
        if fault != BLANK and (role, text) in seen:
            fault = DUPLICATE
        seen.add((role, text))
        faults[fault] += 1
        read.append(Row(role[:1], fault))
    illegal = sum(a.initial + b.initial not in LEGAL for a, b in zip(read, read[1:], strict=False))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, edits = best_paths(read, ENDS, closing=True)[0]
    text = "\n".join(repaired_lines([r[1:] for r in rows], edits))
    digest = hashlib.sha256(text.encode("utf-8")).hexdigest()
    return (gaps, *faults[1:], illegal, cost, "".join(e.label for e in edits), digest)


# -- Spark ----------------------------------------------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``copy`` (0, or 1 for a repetition; null: the row is dropped).

    Damage follows from the CRC-32 of ``conv_id:turn``; a null is one space, there and in role and text.
    """
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = (F.crc32(name.cast("binary")) % 20).alias("kind")
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        kind,
    )
    text = (
        F.when(F.col("kind") == 0, None)
        .when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.translate("text", STOPS, ""))
        .otherwise(F.col("text"))
    )
    copies = (
        F.when(F.col("kind") == 0, F.array(F.lit(None).cast("int")))
        .when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1)))
        .otherwise(F.array(F.lit(0)))
    )
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("copy"),
    )


def _order() -> list[Column]:
    """Rows of a conversation: by turn, role, start of the text, and its digest, so that keys stay short."""
    return [
        F.col("turn").asc_nulls_first(),
        F.col("role").asc(),
        F.substring("text", 1, 64).asc(),
        F.sha2("text", 256).asc(),
        F.col("copy").asc(),
    ]


def _stream(rows: DataFrame, conv_type: str) -> DataFrame:
    """Repairs conversations that come one after another, rows in order; one at a time is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *(c.split()[0] for c in RESULT.split(", "))]
        kinds = [*[pa.int64()] * 6, pa.string(), pa.string()]
        out: list[tuple] = []
        conv, conv_kind, held, any_ = None, None, [], False

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, [conv_kind, *kinds], strict=True)], names)

        for batch in batches:
            conv_kind = batch.schema.field("conv_id").type
            columns = [batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "copy")]
            for c, turn, role, text, copy in zip(*columns, strict=True):
                if any_ and c != conv:
                    out.append((conv, *repair(held)))
                    held = []
                conv, any_ = c, True
                if copy is not None:
                    held.append((turn, role, text))
            if out:
                yield flush()
        if any_:
            out.append((conv, *repair(held)))
            yield flush()

    return rows.mapInArrow(run, f"conv_id {conv_type}, {RESULT}")


def repair_conversations(conversations: DataFrame, most_rows: int = MOST_ROWS, segment: int = SEGMENT) -> DataFrame:
    """One row per conv_id of the damaged ``conversations``, with faults, cheapest repair and its digest.

    ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` (long), ``audit`` (initials of
    the edits: Delete, Insert, Keep, Rerole) and ``repaired_sha256``.  Rows come by turn, nulls first; rows of
    one turn by role and text (beyond 64 characters by its SHA-256).  Nulls in role and text are one space;
    the rows without a conv_id are one conversation.  Repeated rows are rows of their own, thus duplicates.
    An empty role says nothing to the grammar.  A conversation without rows left has zeros, an empty audit
    and the digest of the empty text.  An empty table gives an empty table; other columns are ignored.
    Texts may be of any length, but one conversation's texts, up to ``most_rows`` rows, are held at once.

    Conversations of over ``most_rows`` rows are cut into segments of ``segment`` rows for tasks of their own.
    Only their edits (some bytes a row) meet in one task, and their texts pass through one in order, row by
    row, since a SHA-256 has to read them so.
    """
    rows = damaged(conversations)
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    long = saved(rows.filter("copy is not null").groupBy("conv_id").count().filter(F.col("count") > most_rows), "long")
    if long.isEmpty():
        return _stream(rows.repartition("conv_id").sortWithinPartitions("conv_id", *_order()), conv_type)
    ids = small(long.select(F.col("conv_id").alias("long_id"), F.lit(True).alias("is_long")))
    marked = rows.join(ids, F.col("conv_id").eqNullSafe(F.col("long_id")), "left")
    short = marked.filter("is_long is null").select(*rows.columns)
    short = _stream(short.repartition("conv_id").sortWithinPartitions("conv_id", *_order()), conv_type)
    whole = marked.filter("is_long and copy is not null").select(*rows.columns)
    return short.unionByName(_repair_long(whole, segment, conv_type))


def _repair_long(rows: DataFrame, segment: int, conv_type: str) -> DataFrame:
    """``repair_conversations`` for conversations that no task can hold."""
    placed = saved(with_positions(rows, _order(), ("conv_id",)).drop("group_rows"), "placed")
    stripped = F.rtrim("text", F.lit(SPACE))
    own = F.when(stripped == "", BLANK).when(F.substring(stripped, -1, 1).isin(*STOPS), FINE).otherwise(TRUNCATED)
    light = placed.select(
        "conv_id",
        "position",
        F.substring("role", 1, 1).alias("initial"),
        own.alias("own"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
    )
    firsts = (
        light.filter(F.col("own") != BLANK)
        .groupBy("conv_id", "digest")
        .agg(F.min("position").alias("first"), F.count("*").alias("times"))
        .filter("times > 1")
        .select(F.col("conv_id").alias("first_conv"), F.col("digest").alias("first_digest"), "first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("first_conv")) & (F.col("digest") == F.col("first_digest"))
    repeated = (F.col("own") != BLANK) & (F.col("position") > F.col("first"))
    coded = (
        light.join(firsts, same, "left")
        .withColumn("fault", F.when(repeated, DUPLICATE).otherwise(F.col("own")))
        .withColumn("segment", F.floor((F.col("position") - 1) / segment).cast("long"))
    )
    last = placed.groupBy("conv_id").agg(F.max("position").alias("rows"))
    last = F.broadcast(last.select(F.col("conv_id").alias("last_conv"), "rows"))  # a row for each long conversation
    pieces = (
        coded.groupBy("conv_id", "segment")
        .agg(F.sort_array(F.collect_list(F.struct("position", "initial", "fault"))).alias("read"))
        .join(last, F.col("conv_id").eqNullSafe(F.col("last_conv")))
        .withColumn("closing", F.col("rows") <= (F.col("segment") + 1) * segment)
        .select("conv_id", "segment", "closing", F.col("read.initial").alias("initials"), F.col("read.fault").alias("faults"))
    )
    weighed = pieces.withColumn("paths", _segment_paths("initials", "faults", "closing")).select(
        "conv_id",
        "segment",
        "paths",
        *[_count_of("faults", k).alias(n) for k, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))],
        F.element_at("initials", 1).alias("head"),
        F.element_at("initials", -1).alias("tail"),
        F.size(
            F.filter(
                F.zip_with(F.slice("initials", 1, F.size("initials") - 1), F.slice("initials", 2, F.size("initials")), lambda a, b: F.concat(a, b)),
                lambda x: ~x.isin(*sorted(LEGAL)),
            )
        ).alias("inside"),
    )
    counts = ("blank", "duplicate", "truncated", "inside")
    joined = weighed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("segment", "paths", "head", "tail"))).alias("parts"),
        *[F.sum(c).cast("long").alias(c) for c in counts],
    )
    chosen = saved(joined.withColumn("best", _chosen("parts.paths", "parts.head", "parts.tail")).drop("parts"), "chosen")
    turns = placed.groupBy("conv_id").agg(
        F.max("turn").alias("most"), F.min("turn").alias("least"), F.countDistinct("turn").alias("turns")
    )
    turns = turns.select(
        F.col("conv_id").alias("turn_conv"),
        F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"),
    )
    digests = _digests(placed, chosen, conv_type)
    equal = lambda c: F.col("conv_id").eqNullSafe(F.col(c))
    return (
        chosen.join(turns, equal("turn_conv"))
        .join(digests, equal("digest_conv"))
        .select(
            "conv_id",
            "gaps",
            "blank",
            "duplicate",
            "truncated",
            (F.col("inside") + F.col("best.across")).alias("illegal"),
            F.col("best.cost").alias("cost"),
            F.col("best.audit").alias("audit"),
            "repaired_sha256",
        )
    )


def _count_of(column: str, value: int) -> Column:
    return F.size(F.filter(column, lambda x: x == value))


_PATHS = "array<struct<start: int, stop: int, cost: long, labels: string, given: string>>"


def _segment_paths(initials: str, faults: str, closing: str) -> Column:
    """The cheapest edits of a segment between each two grammar states; ``given`` has a dot for none."""

    @F.udf(_PATHS, useArrow=True)
    def paths(initials, faults, closing):
        rows, out = [Row(a, f) for a, f in zip(initials, faults, strict=True)], []
        for stop in STATES:
            # at the conversation's end the turns inserted there belong to this segment
            for start, (cost, edits) in best_paths(rows, {stop}, closing).items():
                out.append((start, stop, cost, "".join(e.label for e in edits), "".join(e.given or "." for e in edits)))
        return out

    return paths(initials, faults, closing)


def _chosen(paths: str, heads: str, tails: str) -> Column:
    """The cheapest way through the segments: cost, audit, what each edit gives, illegal neighbours across."""

    @F.udf("struct<cost: long, audit: string, given: string, across: long>", useArrow=True)
    def choose(paths, heads, tails):
        best = {g: (0, "", "") for g in ENDS}
        for part in reversed(paths):
            found = {}
            for p in part:
                if p["stop"] in best:
                    cost, audit, given = best[p["stop"]]
                    way = (p["cost"] + cost, p["labels"] + audit, p["given"] + given)
                    found[p["start"]] = min(found.get(p["start"], way), way)
            best = found
        across = sum(a + b not in LEGAL for a, b in zip(tails, heads[1:], strict=False))
        return (*best[0], across)

    return choose(paths, heads, tails)


def _digests(placed: DataFrame, chosen: DataFrame, conv_type: str) -> DataFrame:
    """``digest_conv``, ``repaired_sha256``: edits go to their rows, which then pass in order."""
    edits = (
        chosen.select("conv_id", F.posexplode(F.split("best.audit", "")).alias("at", "label"), F.col("best.given").alias("given"))
        .filter("label <> ''")
        .withColumn("gives", F.expr("substring(given, at + 1, 1)"))
        .drop("given")
    )
    # the row an edit stands at: rows read before it, and itself if it reads one
    reads = F.when(F.col("label") != INSERT, 1).otherwise(0)
    running = _running_reads(saved(edits.withColumn("reads", reads), "edits"))
    lines = (
        running.join(
            placed.select(F.col("conv_id").alias("row_conv"), F.col("position").alias("row"), "role", "text"),
            F.col("conv_id").eqNullSafe(F.col("row_conv")) & (F.col("row_at") == F.col("row")) & (F.col("reads") == 1),
            "left",
        )
        .filter(F.col("label") != DELETE)
        .select(
            "conv_id",
            "at",
            F.concat(
                F.when(F.col("label") == KEEP, F.col("role")).when(F.col("gives") == "u", GIVEN["u"]).otherwise(GIVEN["a"]),
                F.lit(":"),
                F.when(F.col("label") == INSERT, "").otherwise(F.col("text")),
            ).alias("line"),
        )
    )
    # each conversation has a row here, so that one whose rows all go has a digest too
    start = chosen.select("conv_id", F.lit(-1).alias("at"), F.lit(None).cast("string").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, first, kind = None, None, True, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], ["digest_conv", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for c, line in zip(batch["conv_id"].to_pylist(), batch["line"].to_pylist(), strict=True):
                if line is None:
                    if digest is not None:
                        yield row()
                    conv, digest, first = c, hashlib.sha256(), True
                    continue
                digest.update(line.encode("utf-8") if first else b"\n" + line.encode("utf-8"))
                first = False
        if digest is not None:
            yield row()

    ordered = lines.unionByName(start).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return ordered.mapInArrow(run, f"digest_conv {conv_type}, repaired_sha256 string")


def _running_reads(edits: DataFrame) -> DataFrame:
    """``edits`` with ``row_at``: how many rows were read up to and with each, without one window per conversation."""
    cut = edits.withColumn("block", F.floor(F.col("at") / SEGMENT))
    sums = cut.groupBy("conv_id", "block").agg(F.sum("reads").alias("n"))
    # a row for each SEGMENT edits
    ahead = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(
        F.col("conv_id").alias("sum_conv"), F.col("block").alias("sum_block"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")
    )
    inside = W.partitionBy("conv_id", "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    same = F.col("conv_id").eqNullSafe(F.col("sum_conv")) & (F.col("block") == F.col("sum_block"))
    return (
        cut.withColumn("within", F.sum("reads").over(inside))
        .join(before, same)
        .withColumn("row_at", F.col("within") + F.col("before"))
        .select("conv_id", "at", "label", "gives", "reads", "row_at")
    )
