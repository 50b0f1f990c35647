"""Bundles as releases, exports, labels."""

import itertools
import random

from pyspark.sql import functions as F
from test_engine import bundle
from test_text import column

from vellum.functions import labels, lattice
from vellum.operators import snapshot


def test_snapshot(spark):
    b = bundle(spark)
    more = spark.createDataFrame([("s2", "d1", "h2", ["p2"], 2, None, None, "index_only", [("table", "| a |\n|---|\n| 1 |", 4, 5, "t")])], b["sections"].schema)
    b["sections"] = b["sections"].unionByName(more).unionByName(more.withColumns({"key": F.lit("s3"), "document_key": F.lit("gone")}))
    snap = snapshot.snapshot(b, "c")
    counts = {n: df.count() for n, df in snap.items()}
    assert counts == {"documents": 1, "sections": 2, "revisions": 2, "chunks": 2, "bridge": 2}
    again = snapshot.snapshot(b, "c")
    assert {r[0] for r in again["chunks"].select("chunk_id").collect()} == {r[0] for r in snap["chunks"].select("chunk_id").collect()}
    other = snapshot.snapshot(b, "another")
    assert other["documents"].first()["document_id"] != snap["documents"].first()["document_id"]
    view = {r["chunk_label"]: r for r in snapshot.evaluation_view(snap, {"prose": "body", "table": "data"}, {"k": "article"}).collect()}
    assert set(view) == {"s1:chunk-001", "s2:chunk-001"}
    assert (view["s1:chunk-001"]["strategy"], view["s1:chunk-001"]["role"], view["s1:chunk-001"]["content_type"]) == ("full_section", "body", "article")
    assert (view["s2:chunk-001"]["strategy"], view["s2:chunk-001"]["chunk_type"], view["s2:chunk-001"]["start_page"]) == ("search_only", "table", 4)
    assert "Also known as" not in view["s1:chunk-001"]["embedding_text"]  # the text shows the alias x


def test_blocks_and_export(spark, monkeypatch):
    monkeypatch.setattr(snapshot, "LONG_TABLE", 20)
    got = column(spark, ["one\n\ntwo\n\n| long table of more than twenty |\n\n| short |\n\nthree", "", None], snapshot.text_blocks)
    assert [(b["kind"], b["markdown"]) for b in got[0]] == [("prose", "one\n\ntwo"), ("table", "| long table of more than twenty |"), ("prose", "| short |\n\nthree")]
    assert got[1:] == [[], None]
    rows = [("a", "d", "T", "h", [], ["x"], 2), ("b", "d", "T", "h", ["p"], ["x"], 1), ("c", "d", "U", "h", [], [], 0)]
    docs, sections = snapshot.exported(spark.createDataFrame(rows, "id string, document_key string, title string, heading string, context_path array<string>, blocks array<string>, place int"), "place")
    assert {r["id"]: (r["ordinal"], r["context_path"]) for r in sections.collect()} == {"b": (1, ["p"]), "a": (2, ["h"])}
    assert tuple(docs.first()) == ("d", "T", 1, 2)


def test_citations_and_gold(spark):
    numbered = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "request int, index int, chunk string")
    used = spark.createDataFrame([(1, 1, 2), (1, 2, 9), (1, 3, 1)], "request int, place int, index int")
    assert [r["chunk"] for r in snapshot.citations(numbered, used).orderBy("place").collect()] == ["b", "a"]
    gold = spark.createDataFrame([(1, ["a"]), (2, ["a", "z"]), (3, [])], "query_id int, gold_sections array<string>")
    sections = spark.createDataFrame([("a",)], "section_id string")
    assert sorted(r["query_id"] for r in snapshot.usable(gold, sections).collect()) == [1, 3]
    texts = spark.createDataFrame([(1, "Some Big-Word here"), (2, None)], "id int, text string")
    terms = spark.createDataFrame([("big word",), ("word big",)], "term string")
    assert {r["term"]: r["found"] for r in snapshot.mentions(texts, terms).collect()} == {"big word": True, "word big": False}
    assert column(spark, ["# Only\n---", "# H\nbody"], snapshot.has_body) == [False, True]


def test_labels(spark):
    assert column(spark, ["a ph b y"], lambda c: labels.replaced_all(c, [("ph", "f"), ("y$", "i")])) == ["a f b i"]
    join = lattice.joined_syllables(["para", "paracetamol", "dose", "over", "overdose"])
    assert column(spark, ["over dose of parace tamol  x", None], lambda c: join(c)) == ["over dose of paracetamol  x", None]
    names = {"use": ["use", "how to use"], "dose": ["dose"]}
    assert column(spark, ["**How to use:**", "Dose: 5 mg", "Other"], lambda c: labels.canonical_label(c, names)) == ["use", "dose", None]
    assert column(spark, ["ASPIRIN PLUS", "Aspirin", "THE END.", "STOP"], lambda c: labels.is_title(c, ["stop"])) == [True, False, False, False]
    assert column(spark, ["x **Use** y **Dose** z"], lambda c: labels.inline_headings(c, ["use", "dose"])) == [["x", "**Use** y", "**Dose** z"]]
    assert column(spark, ["Brand (tablet) treats pain"], lambda c: labels.names_in_title(c, ["treats"])) == [["Brand treats pain", "Brand"]]
    assert column(spark, [["phenyle", "ace"]], lambda c: labels.respelled(c, [("ph", "f"), ("y", "i")]), "array<string>") == [["fenil", "ace"]]
    assert column(spark, ["| only |\n| --- |\n| text |\n| a | b |"], labels.flattened_layout) == [" only \n text \n| a | b |"]
    df = spark.createDataFrame([([["a", "salt"], ["b"]], [["b"], ["a"]], 3, None), ([["a"]], [["a"], ["b"]], 3, 5)], "l array<array<string>>, p array<array<string>>, f int, t int")
    got = df.select(labels.same_parts(F.col("l"), F.col("p"), ["salt"]), labels.page_label(F.col("f"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(True, "page 3"), (False, "page 3-5")]
    row = spark.sql("select 'Drug' as a, 'Aspirin  X' as b, 'Use' as c, array('Use', 'More') as p")
    assert row.select(labels.section_id(F.col("a"), F.col("b"), F.col("c"), F.col("p")), labels.slugs([F.col("a"), F.col("b")])).first() == ("drug.aspirin x.use.more", "drug.aspirin-x")


def cheapest(lattice, parts):
    """Every way to cut the parts into words."""
    best = None
    for cuts in itertools.product((False, True), repeat=len(parts) - 1):
        words = [[parts[0]]]
        for part, cut in zip(parts[1:], cuts, strict=True):
            words.append([part]) if cut else words[-1].append(part)
        cost = 0.0
        for w in words:
            whole = "".join(w).lower()
            pairs = {(a.lower(), b.lower()) for a, b in itertools.pairwise(w)}
            if len(w) == 1:
                cost += lattice.costs[whole] if whole in lattice.alone else 3.0
            elif whole in lattice.costs and not pairs & lattice.excluded and not (len(w[-1]) == 1 and w[-1].isupper()) and len(w) <= 8:
                cost += lattice.costs[whole] + 1.01 * (len(w) - 1)
            else:
                cost = float("inf")
        way = (round(cost, 9), len(parts) - len(words), tuple(map(len, words)), ["".join(w) for w in words])
        best = way if best is None or way < best else best
    return best[3]


def test_lattice_as_exhaustive_search():
    r = random.Random(4)
    syllables = ["pa", "ra", "ce", "ta", "mol", "A", "o", "ver"]
    for _ in range(60):
        words = {"".join(r.choice(syllables).lower() for _ in range(r.randrange(1, 5))): r.choice([1.0, 1.0, 0.5, 2.0]) for _ in range(25)}
        made = lattice.Lattice(words, r.sample(syllables, 2), [(r.choice(syllables), r.choice(syllables)) for _ in range(3)])
        parts = [r.choice(syllables) for _ in range(r.randrange(1, 11))]
        assert made.words(parts) == cheapest(made, parts), (words, parts)


def test_split_words_of_many_parts(spark):
    join = lattice.joined_syllables(["para", "paracetamol", "dose", "over", "overdose", "tab", "tablet", "c", "kit"], ("c",), (("over", "dose"),))
    given = ["pa ra ce ta mol 5 mg", "over dose OVER DO SE", "tab let-2 tab let", "c kit  c", "", None, "x\npara ceta\nmol"]
    want = ["paracetamol 5 mg", "over dose OVER DOSE", "tab let-2 tablet", "c kit  c", "", None, "x\npara ceta\nmol"]
    assert column(spark, given, lambda c: join(c)) == want
