"""Conversation repair against exhaustive search, plain code and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import oracle
import pytest
from pyspark.sql import functions as F

from vellum.llm import queries
from vellum.llm.dialogues import BLANK, DUPLICATE, ENDS, FINE, TRUNCATED, Row, best_paths, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
GRAMMAR = re.compile(r"(s?(ua)+)?")


def searched(rows):
    """Least (cost, audit, lines) over all edits with at most three turns inserted in a gap."""
    inserted = [[("I", r, 3, f"{r}:") for r in way] for n in range(4) for way in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    options = []
    for role, text, fault in rows:
        own = [("D", "", 4, None)]
        if fault not in (BLANK, DUPLICATE):
            more = 3 * (fault == TRUNCATED)
            own += [("K", role, more, f"{role}:{text}")] + [("R", r, 3 + more, f"{r}:{text}") for r in ("user", "assistant")]
        options += [inserted, [[x] for x in own]]
    options.append(inserted)
    for way in itertools.product(*options):
        edits = [e for part in way for e in part]
        if GRAMMAR.fullmatch("".join(r[:1] for _, r, _, _ in edits)):
            found = (sum(c for _, _, c, _ in edits), "".join(a for a, _, _, _ in edits), "\n".join(x for *_, x in edits if x is not None))
            best = found if best is None else min(best, found)
    return best


def plain_fault(rows, k):
    role, text = rows[k]
    bare = text.rstrip(" \t\n\r\x0b\x0c")
    if not bare:
        return BLANK
    return DUPLICATE if (role, text) in rows[:k] else FINE if bare[-1] in ".!?" else TRUNCATED


def forward(rows):
    """The same by plain dynamic programming over whole strings, for longer conversations."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    name = {"u": "user", "a": "assistant"}

    def inserts(states):
        out = dict(states)
        for _ in range(2):
            for g, (cost, audit, lines) in list(out.items()):
                for c in "ua":
                    to = moves.get((g, c))
                    if to is not None:
                        new = (cost + 3, audit + "I", [*lines, name[c] + ":"])
                        out[to] = min(out.get(to, new), new)
        return out

    states = inserts({"": (0, "", [])})
    for k, (role, text) in enumerate(rows):
        fault, new = plain_fault(rows, k), {}
        for g, (cost, audit, lines) in states.items():
            ways = [(g, 4, "D", [])]
            if fault in (FINE, TRUNCATED):
                more = 3 * (fault == TRUNCATED)
                ways.append((moves.get((g, role[:1])) if role else g, more, "K", [f"{role}:{text}"]))
                ways += [(moves.get((g, c)), 3 + more, "R", [f"{name[c]}:{text}"]) for c in "ua"]
            for to, more, label, line in ways:
                if to is not None:
                    found = (cost + more, audit + label, lines + line)
                    new[to] = min(new.get(to, found), found)
        states = inserts(new)
    return min(states[g] for g in ("", "a") if g in states)


def plain(rows):
    """All rows of ``repair_conversations`` for rows of conv_id, turn, role, text."""
    by = {}
    for c, t, role, text in rows:
        one = lambda v: " " if v is None else v
        kept = by.setdefault(c, [])
        role, text, kind = one(role), one(text), zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept += [(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [r[1:] for r in kept]
        faults = [plain_fault(pairs, k) for k in range(len(pairs))]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
        cost, audit, lines = forward(pairs)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((c, gaps, *[faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)], illegal, cost, audit, digest))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_exhaustive_search_of_short_conversations():
    r = random.Random(2)
    roles = ["user", "assistant", "system", "tool", "", "ua"]
    for _ in range(120):
        rows = [(r.choice(roles), f"t{k}", r.choice([FINE, FINE, BLANK, DUPLICATE, TRUNCATED])) for k in range(r.randrange(3))]
        cost, edits = best_paths([Row(a[:1], f) for a, _, f in rows], ENDS, closing=True)[0]
        assert (cost, "".join(e.label for e in edits)) == searched(rows)[:2]


def made_rows():
    r = random.Random(9)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, " "]
    texts = ["Yes.", "No", "What?", "", None, " \n", "Fine!  ", "Long text " * 30 + ".", "é…", "a. "]
    rows = [(c, r.choice([t, t, t, None, t + 3]), r.choice(roles), r.choice(texts)) for c in range(60) for t in range(r.randrange(1, 12))]
    rows += [(None, t, r.choice(roles), r.choice(texts)) for t in range(9)]
    rows += [(70, None, "user", "One."), (70, None, "user", "One."), (71, 0, "assistant", "x" * 100_000)]
    rows += [(c, 0, "user", "Only.") for c in range(100, 160)]  # some are dropped whole
    return rows


def test_rows_as_plain_code(spark):
    rows = made_rows()
    assert rows_of(repair_conversations(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


@pytest.mark.parametrize("most,segment", [(3, 2), (5, 4), (40, 16)])
def test_long_conversations_in_segments(spark, most, segment):
    """Segments and their product give the rows that one piece gives."""
    r = random.Random(4)
    rows = made_rows()
    roles, texts = ["user", "assistant", "system", "assistant", ""], ["Yes.", "No", "", "Why?", "So", "Done."]
    rows += [(500, t, r.choice(roles), r.choice(texts) + str(r.randrange(40)) + r.choice([".", ""])) for t in range(150)]
    rows += [(501, t, "tool", "") for t in range(60)]  # all rows go
    have = repair_conversations(spark.createDataFrame(rows, SCHEMA), most_rows=most, segment=segment)
    assert rows_of(have) == plain(rows)


def test_empty_table_clashing_columns_and_string_ids(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for c in range(5) for t in range(6)]
    table = spark.createDataFrame(rows, SCHEMA)
    for name in ("position", "audit", "kind", "copy", "segment", "count", "long_id"):
        table = table.withColumn(name, F.lit("x"))
    assert rows_of(repair_conversations(table)) == rows_of(repair_conversations(table, 3, 2)) == plain(rows)
    named = repair_conversations(table.withColumn("conv_id", F.col("conv_id").cast("string")))
    assert dict(named.dtypes)["conv_id"] == "string" and [tuple(r)[1:] for r in named.orderBy("conv_id").collect()] == [p[1:] for p in plain(rows)]


def test_same_rows_as_sql(spark, sf_dir):
    name = "op13_conversation_repair"
    assert oracle.differences(queries.queries()[name](spark, sf_dir), oracle.connect(sf_dir), queries.oracle_sql()[name]) == ""
