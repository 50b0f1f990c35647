"""Kept indexes, set joins, digest trees and journals against plain code."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import digests, postings, search, setjoin, vectors
from vellum.sinks import versions
from vellum.storage import new_path
from vellum.streaming import journal

DOCS = "id long, text string"
QUERIES = "query_id long, text string"


# -- postings -------------------------------------------------------------------------------------
def plain_bm25(docs, queries, k):
    words = {i: re.findall(r"[^\W\d_]+|\d+", (t or "").lower()) for i, t in docs.items()}
    n, mean = len(words), sum(map(len, words.values())) / max(1, len(words)) or 1.0
    df = Counter(t for w in words.values() for t in set(w))
    out = {}
    for q, text in queries:
        scored = []
        for i, w in words.items():
            tf, s = Counter(w), 0.0
            for t in set(re.findall(r"[^\W\d_]+|\d+", (text or "").lower())):
                if tf[t]:
                    s += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if s > 0:
                scored.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


def same_ranks(have, want):
    for q, hits in want.items():
        assert [i for i, _ in have.get(q, [])] == [i for i, _ in hits], q
        assert np.allclose([s for _, s in have.get(q, [])], [s for _, s in hits], atol=2e-6)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_IDS", 16)
    monkeypatch.setattr(postings, "BUCKETS", 8)


def words(r, n):
    return " ".join(r.choice("the a of on in b1 c2 dd ee ff gg hh ii jj kk ll".split()[: 1 + int(16 * r.random() ** 2)]) for _ in range(n))


def test_postings_by_release(spark, small_blocks):
    """Additions, replacements and deletions, as of each release and after compaction."""
    r = random.Random(3)
    path = new_path(spark, "postings")
    live = {k * 3: words(r, r.randrange(1, 60)) for k in range(150)} | {1: None, 2: "", 4: "?!"}
    asked = [(1, "the kk jj"), (2, "ll"), (3, "of the a"), (4, "nothing here"), (5, None), (6, "ee EE dd-b1")]
    queries = spark.createDataFrame(asked, QUERIES)
    postings.add_release(spark, path, 1, spark.createDataFrame([*live.items(), (None, "the"), (0, "")], DOCS))
    states = [dict(live)]
    change = {k: words(r, 30) for k in (0, 3, 6, 500, 501)}
    postings.add_release(spark, path, 2, spark.createDataFrame(list(change.items()), DOCS), spark.createDataFrame([(9,), (12,), (9999,)], "id long"))
    live = {k: v for k, v in (live | change).items() if k not in (9, 12)}
    states.append(dict(live))
    postings.add_release(spark, path, 4, spark.createDataFrame([(9, "the kk kk"), (0, "jj")], DOCS), spark.createDataFrame([(3,)], "id long"))
    live = {k: v for k, v in (live | {9: "the kk kk", 0: "jj"}).items() if k != 3}
    states.append(dict(live))
    for n, state in zip((1, 2, 4), states, strict=True):
        same_ranks(found(postings.search_index(spark, path, queries, 5, upto=n)), plain_bm25(state, asked, 5))
        assert postings.totals(spark, path, n)[0] == len(state)
    target = new_path(spark, "postings")
    postings.compact(spark, path, target)
    same_ranks(found(postings.search_index(spark, target, queries, 5)), plain_bm25(live, asked, 5))
    with pytest.raises(ValueError, match="release 4"):
        postings.add_release(spark, path, 4, spark.createDataFrame([], DOCS))


def name(k):
    return chr(97 + k // 26) + "x" + chr(97 + k % 26)


def test_release_touches_its_own_terms_only(spark, small_blocks):
    path = new_path(spark, "postings")
    postings.add_release(spark, path, 1, spark.createDataFrame([(k, f"common {name(k)}") for k in range(100)], DOCS))
    postings.add_release(spark, path, 2, spark.createDataFrame([(7, "common new")], DOCS))
    written = {r["term"] for r in spark.read.parquet(f"{path}/segment=2/postings").collect()}
    changed = {r["term"]: r["df"] for r in spark.read.parquet(f"{path}/segment=2/terms").collect()}
    assert written == {"common", "new"} and changed == {"new": 1, name(7): -1}


def test_unfinished_release_is_not_seen(spark, small_blocks):
    path = new_path(spark, "postings")
    postings.add_release(spark, path, 1, spark.createDataFrame([(1, "aa bb")], DOCS))
    spark.createDataFrame([(2, "aa")], DOCS).write.parquet(f"{path}/segment=2/forward")  # what a lost driver left
    queries = spark.createDataFrame([(1, "aa")], QUERIES)
    assert [i for i, _ in found(postings.search_index(spark, path, queries, 5))[1]] == [1]
    postings.add_release(spark, path, 2, spark.createDataFrame([(2, "aa")], DOCS))
    assert sorted(i for i, _ in found(postings.search_index(spark, path, queries, 5))[1]) == [1, 2]


def test_plan_reads_the_folders_of_the_terms(spark, small_blocks):
    path = new_path(spark, "postings")
    postings.add_release(spark, path, 1, spark.createDataFrame([(k, f"common {name(k)}") for k in range(200)], DOCS))
    plan = postings.search_index(spark, path, spark.createDataFrame([(1, name(5))], QUERIES), 3)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan)
    assert postings.search_index(spark, new_path(spark, "none"), spark.createDataFrame([(1, "x")], QUERIES), 3).count() == 0


# -- vectors --------------------------------------------------------------------------------------
VECTORS = "id long, embedding array<double>"


def clustered(r, n, width=16, groups=12):
    centres = r.normal(size=(groups, width))
    return {k: (centres[k % groups] + 0.4 * r.normal(size=width)).tolist() for k in range(n)}


def plain_nearest(base, asked, k):
    out = {}
    for q, v in asked.items():
        v = np.array(v)
        scored = [(-round(float(v @ np.array(x) / math.sqrt((v @ v) * (np.array(x) @ np.array(x)))), 6), i) for i, x in base.items()]
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_vector_index_by_release(spark):
    r = np.random.default_rng(5)
    base = clustered(r, 900)
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 8), (None, [1.0] * 16), (7, base[7])]
    path = new_path(spark, "vectors")
    table = spark.createDataFrame([*base.items(), *odd], VECTORS)
    model = vectors.fit(table, sample=600)
    assert len(model.cells) <= 600 // vectors.A_CELL and model.books.shape == (4, 256, 4)
    vectors.create(spark, path, model)
    vectors.add_release(spark, path, 1, table)
    asked = {k: base[k] for k in range(0, 900, 45)}
    queries = spark.createDataFrame([*asked.items(), (-1, [0.0] * 16), (-2, [1.0] * 3)], "query_id long, embedding array<double>")
    every = {"probes": len(model.cells), "candidates": 900}
    same_ranks(found(vectors.search_vectors(spark, path, queries, 10, **every)), plain_nearest(base, asked, 10))
    moved = {3: [-x for x in base[3]], 2000: base[45], 46: [0.0] * 16}  # a vector that can't be compared goes
    vectors.add_release(spark, path, 2, spark.createDataFrame(list(moved.items()), VECTORS), spark.createDataFrame([(90,), (91,)], "id long"))
    now = {k: v for k, v in (base | {3: moved[3], 2000: moved[2000]}).items() if k not in (90, 91, 46)}
    same_ranks(found(vectors.search_vectors(spark, path, queries, 10, **every)), plain_nearest(now, asked, 10))
    same_ranks(found(vectors.search_vectors(spark, path, queries, 10, upto=1, **every)), plain_nearest(base, asked, 10))
    # the cells that the model asks for, and few candidates: nearly all of the nearest
    assert vectors.load(spark, path).probes == model.probes <= len(model.cells) // 2
    near = found(vectors.search_vectors(spark, path, queries, 10, candidates=100))
    want = plain_nearest(now, asked, 10)
    assert np.mean([len({i for i, _ in near[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.95


def test_vector_scan_leaves_out_cells_and_vectors(spark):
    r = np.random.default_rng(6)
    path, base = new_path(spark, "vectors"), spark.createDataFrame(list(clustered(r, 500).items()), VECTORS)
    vectors.create(spark, path, vectors.fit(base))
    vectors.add_release(spark, path, 1, base)
    queries = base.filter("id = 4").withColumnRenamed("id", "query_id")
    rows = vectors.read_part(spark, path, "rows", [1])
    scan = vectors._scan_codes(spark, queries.collect(), rows, None, vectors.load(spark, path), 2, 50)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*folder", scan) and re.search(r"PushedFilters: \[.*In\(cell", scan)
    assert "embedding" not in re.search(r"ReadSchema: (\S+)", scan)[1]
    assert vectors.search_vectors(spark, path, queries.limit(0), 5).count() == 0


def test_best_keeps_the_best_with_ties():
    r = np.random.default_rng(1)
    best, score = search.Best(7, 5), np.round(r.normal(size=(7, 4000)), 1)
    ids = r.permutation(4000)
    for at in range(0, 4000, 512):
        best.add(score[:, at : at + 512], ids[at : at + 512])
    asking, found_ids, values = best.rows()
    for q in range(7):
        want = sorted((-s, i) for s, i in zip(score[q], ids, strict=True))[:5]
        assert [(-s, i) for s, i in zip(values[asking == q], found_ids[asking == q], strict=True)] == want


# -- set joins ------------------------------------------------------------------------------------
@pytest.mark.parametrize("part_rows,every", [(20_000, True), (3, True), (20_000, False)])
def test_overlaps_as_all_pairs(spark, monkeypatch, part_rows, every):
    monkeypatch.setattr(setjoin, "PART_ROWS", part_rows)
    r = random.Random(8)
    tokens = [f"t{k}" for k in range(60)]
    draw = lambda n: [tokens[int(60 * r.random() ** 2)] for _ in range(n)]
    others = {k: draw(r.randrange(0, 40)) for k in range(120)} | {200: None, 201: [None, "t1"]}
    rows = {k: (others[r.randrange(120)] or [])[: r.randrange(1, 30)] + draw(r.randrange(8)) for k in range(60)}
    rows |= {100: None, 101: [], 102: ["only-here"], 103: ["t1", None, "t1"]}
    kind = "array<string>"
    have = setjoin.best_overlaps(
        spark.createDataFrame(list(rows.items()), f"r long, tokens {kind}"), spark.createDataFrame([*others.items(), (None, ["t1"])], f"o long, tokens {kind}"), "r", "o", every=every
    )
    have = {x["r"]: (x["matched"], x["shared"], x["confidence"]) for x in have.collect()}
    assert set(have) == set(rows)
    clean = lambda t: {x for x in t or () if x is not None}
    for k, own in rows.items():
        own, scored = clean(own), []
        for o, other in others.items():
            n = len(own & clean(other))
            if n:
                scored.append((-n, o))
        scored.sort()
        if not scored:
            assert have[k] == (None, None, None)
            continue
        n, second = -scored[0][0], -scored[1][0] if len(scored) > 1 else 0
        good = n >= 8 and n / len(own) >= 0.35 and (n / len(own) >= 0.55 or n - second >= 4)
        if every or n >= max(8, math.ceil(0.35 * len(own))):
            assert have[k] == (scored[0][1] if good else None, n, n / len(own)), k
        else:
            assert have[k][0] is None


# -- digest trees ---------------------------------------------------------------------------------
def test_digest_of_rows_in_any_order(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("b", None)], "k string, v int")
    one = digests.table_digest(df, ["k", "v"]).first()
    assert one == digests.table_digest(df.repartition(3), ["k", "v"]).first() and one["n_rows"] == 3
    assert digests.table_digest(df.distinct(), ["k", "v"]).first() != one
    assert digests.table_digest(df.limit(0), ["k"]).first()["n_rows"] == 0
    assert [digests.tree_depth(n) for n in (0, 1024, 1025, 16 * 1024, 10**11)] == [0, 0, 1, 1, 7]


@pytest.mark.parametrize("leaf", [2, 16, 4096])
def test_tree_differences_as_full_join(spark, monkeypatch, leaf):
    monkeypatch.setattr(digests, "LISTED", 20)
    rows = {k: ("v", k % 7) for k in range(1000)}
    new = {k: v for k, v in rows.items() if k not in (3, 4)} | {5: ("w", 0), 6: (None, 1), 5000: ("n", 2)}
    table = lambda x: spark.createDataFrame([(k, *v) for k, v in x.items()], "k long, a string, b long")
    paths = [new_path(spark, "tree") for _ in range(3)]
    for version, path in zip((rows, new, rows), paths, strict=True):
        digests.write_tree(table(version), ["k"], ["k", "a", "b"], path, leaf)
    diff, read = digests.tree_differences(spark, paths[0], paths[1], ["k"])
    want = {3: "removed", 4: "removed", 5: "changed", 6: "changed", 5000: "added"}
    assert {r["k"]: r["status"] for r in diff.collect()} == want
    if leaf < 100:
        assert read["old_rows"] < 100 and read["leaves"] <= 7
    same, read = digests.tree_differences(spark, paths[0], paths[2], ["k"])
    assert same.count() == 0 and read == {"nodes": 1, "leaves": 0, "old_rows": 0, "new_rows": 0}


def test_tree_differences_of_any_sizes(spark):
    """Trees of different depth, empty tables, repeated rows."""
    table = lambda n: spark.range(n).select(F.col("id").alias("k"))
    paths = [new_path(spark, "tree") for _ in range(4)]
    for version, path in zip((table(300), table(290), table(0), table(290).union(table(1))), paths, strict=True):
        digests.write_tree(version, ["k"], ["k"], path, 16)
    keys = lambda a, b: sorted((r["k"], r["status"]) for r in digests.tree_differences(spark, paths[a], paths[b], ["k"])[0].collect())
    assert keys(0, 1) == [(k, "removed") for k in range(290, 300)]
    assert keys(2, 1) == [(k, "added") for k in range(290)] and keys(1, 3) == [(0, "changed")]


# -- pointer and journal --------------------------------------------------------------------------
def test_pointer_is_replaced_at_once(spark, monkeypatch):
    path = f"{new_path(spark, 'pointer')}/CURRENT"
    versions.write_text_file(spark, path, "one")
    versions.write_text_file(spark, path, "two")
    assert versions.read_text_file(spark, path) == "two"
    real = versions._file_system

    def dies(session, where):
        hadoop, fs = real(session, where)

        class Hadoop:
            def __getattr__(self, name):
                if name == "FileContext":
                    raise RuntimeError("killed before the rename")
                return getattr(hadoop, name)

        return Hadoop(), fs

    monkeypatch.setattr(versions, "_file_system", dies)
    with pytest.raises(RuntimeError):
        versions.write_text_file(spark, path, "three")
    monkeypatch.undo()
    assert versions.read_text_file(spark, path) == "two"


def test_journal_after_a_kill_between_write_and_commit(spark, tmp_path, monkeypatch):
    source, path, state = tmp_path / "in", new_path(spark, "journal"), new_path(spark, "state")
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(source))
        query = stream.writeStream.foreachBatch(journal.journal_sink(path, "ids")).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()

    write, seen = journal.write_text_file, []

    def killed(session, where, text):
        seen.append(where)
        if "/commits/" in where and len([x for x in seen if "/commits/" in x]) == 3:
            raise RuntimeError("killed")
        write(session, where, text)

    monkeypatch.setattr(journal, "write_text_file", killed)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.undo()
    assert [c["batch"] for c in journal.commits(spark, path)] == [0, 1]
    assert journal.read_journal(spark, path, "id long").count() == 20  # the rows without a commit don't count
    run()
    rows = journal.read_journal(spark, path, "id long")
    assert sorted(r["id"] for r in rows.collect()) == list(range(40))
    assert not journal.append_batch(spark.range(5), 2, path, "ids")  # a replayed batch
    assert journal.read_journal(spark, path, "id long").count() == 40
    with pytest.raises(journal.JournalError, match="belongs to"):
        journal.append_batch(spark.range(5), 9, path, "others")


def test_journal_finds_torn_batches(spark):
    path = new_path(spark, "journal")
    assert journal.read_journal(spark, path, "id long").count() == 0
    journal.append_batch(spark.range(5), 0, path, "x")
    journal.append_batch(spark.range(0), 1, path, "x")
    assert journal.read_journal(spark, path, "id long").count() == 5
    spark.range(3).withColumn("seal", F.lit("no")).write.mode("overwrite").parquet(f"{path}/batches/{0:020d}")
    with pytest.raises(journal.JournalError, match="batch 0"):
        journal.read_journal(spark, path, "id long")


def test_a_release_leaves_nothing_beside_the_index(spark):
    from vellum.storage import shared_dir

    before, path = set(versions.list_names(spark, shared_dir(spark))), new_path(spark, "postings")
    docs = spark.createDataFrame([(k, f"a b{k % 7} a" if k % 5 else None) for k in range(3000)], DOCS)
    postings.add_release(spark, path, 1, docs)
    postings.add_release(spark, path, 2, docs.filter("id % 2 = 0"), spark.createDataFrame([(1,), (3,)], "id long"))
    left = set(versions.list_names(spark, shared_dir(spark))) - before
    assert {n.split("-")[0] for n in left} <= {"postings", "repeated"}
    # terms of a block stand together
    held = spark.read.parquet(f"{path}/segment=1/postings")
    assert held.groupBy("term", "block").count().count() == 9 * 3
    assert postings.totals(spark, path) == (2998, 2398 * 4)


def test_codes_hold_the_nearest_of_many_vectors():
    x = np.random.default_rng(3).normal(size=(20_000, 64)).astype(np.float32)
    x /= np.sqrt((x**2).sum(1))[:, None]
    blocks = x.reshape(len(x), -1, vectors.WIDTH)
    books = [vectors._k_means(blocks[:4000, b], vectors.CODES, 4, b) for b in range(blocks.shape[1])]
    coded = np.stack([book[vectors._nearest(blocks[:, b], book)] for b, book in enumerate(books)], axis=1).reshape(x.shape)
    exact, near = x[:100] @ x.T, x[:100] @ coded.T
    best, kept = np.argsort(-exact, axis=1)[:, :10], np.argsort(-near, axis=1)[:, :100]
    assert np.mean([np.isin(b, k).mean() for b, k in zip(best, kept, strict=True)]) >= 0.98
