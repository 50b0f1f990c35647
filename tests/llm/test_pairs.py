"""Embedding, SimHash and signature near-duplicates against all pairs compared one by one."""

import numpy as np
import pytest
import xxhash

from vellum.llm import embeddup, nearcopies
from vellum.llm.components import connected_components, merge_labels
from vellum.llm.embeddup import near_embeddings
from vellum.llm.nearcopies import drop_near_copies, link_signatures, near_copy_components, signature
from vellum.llm.simhash import fingerprint, link_codes, simhash_components


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# -- embeddings -----------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int, component_id string, n_links int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "other", 7) for r in rows], VECTORS)


def brute_links(rows, cosine=0.98):
    links = []
    for i, (_, a, la) in enumerate(rows):
        for j in range(i):
            _, b, lb = rows[j]
            if la is None or la != lb or a is None or b is None or len(a) != len(b):
                continue
            x, y = (np.array([np.nan if v is None else v for v in v_], np.float32).astype(float) for v_ in (a, b))
            if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
                continue
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links.append((j, i))
    return links


def check_vectors(out, rows):
    links = brute_links(rows)
    roots = components(len(rows), links)
    for k, (vec_id, _, _) in enumerate(rows):
        got = out[vec_id]
        assert got["n_links"] == sum(k in p for p in links), vec_id
        want = min(rows[x][0] for x in range(len(rows)) if roots[x] == roots[k])
        assert got["component_id"] == want, vec_id
        assert got["kept"] == (vec_id == want)


def some_vectors(seed, n, width, labels):
    rng = np.random.default_rng(seed)
    rows, made = [], []
    for k in range(n):
        if made and rng.random() < 0.6:
            v = made[rng.integers(len(made))] + rng.normal(0, rng.choice([0, 0.02, 0.1]), width) / np.sqrt(width)
        else:
            v = rng.normal(0, 1, width)
            v /= np.sqrt(v @ v)
        made.append(v)
        rows.append((k * 3, [float(x) for x in v.astype(np.float32)], int(rng.integers(labels))))
    return rows


@pytest.mark.parametrize("task_rows", [20_000, 25])
def test_embeddings_match_all_pairs(spark, monkeypatch, task_rows):
    monkeypatch.setattr(embeddup, "PART_ROWS", task_rows)
    rows = some_vectors(1, 150, 16, 2)
    nan = float("nan")
    rows += [(1001, None, 0), (1002, [0.0] * 16, 0), (1003, [nan] * 16, 0), (1004, [float("inf")] * 16, 0),
             (1005, [None] + [1.0] * 15, 0), (1006, rows[0][1], None), (1007, [1.0, 0.0], 0), (1008, [2.0, 0.0], 0), (1009, [], 1)]
    out = {r["vec_id"]: r for r in near_embeddings(vectors(spark, rows)).collect()}
    assert len(out) == len(rows)
    check_vectors(out, rows)


def test_embeddings_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    check_vectors({r["vec_id"]: r for r in near_embeddings(table).collect()}, rows)


def test_labels_of_any_type_and_doubles(spark):
    """Doubles stay doubles: the pair is just below and just above the bound, which floats can't tell."""
    angle = np.arccos(0.98)
    at = lambda a: [float(np.cos(a)), float(np.sin(a))]
    rows = [(1, at(0.0), "x"), (2, at(angle - 1e-10), "x"), (3, at(0.0), "y"), (4, at(angle + 1e-10), "y"), (5, at(0.0), None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_embeddings(table).collect()}
    assert out == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5)}


def test_embeddings_empty_repeated_and_without_id(spark):
    assert near_embeddings(vectors(spark, [])).count() == 0
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    out = near_embeddings(vectors(spark, rows)).collect()
    assert sorted((r["vec_id"] is None, r["n_links"], r["component_id"], r["kept"]) for r in out) == [
        (False, 1, 5, True), (False, 1, 5, True), (True, 0, None, False)]


# -- components -----------------------------------------------------------------------------------
def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(3)
    pairs = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (3, 2), (200, 201), (201, 202)]
    pairs += [(int(a) + 300, int(b) + 300) for a, b in rng.integers(0, 60, (40, 2))]
    out = {r[0]: r[1] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    roots = components(400, pairs)
    linked = {x for p in pairs for x in p if p[0] != p[1]}
    assert out == {x: roots[x] for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- fingerprints ---------------------------------------------------------------------------------
def plain_fingerprint(text, k=4):
    white = " \t\n\r\x0b\x0c"
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = "".join(" " if c in white else c for c in folded).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n\t", "one", "One two", "a b c d", "a b c d e f g a b c d e", "Ä É x y B", "x" * 9000 + " y z " * 400])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def brute_classes(codes, radius):
    n = len(codes)
    return components(n, [(j, i) for i in range(n) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= radius])


@pytest.mark.parametrize("seed", range(4))
def test_gray_index_finds_all_links(seed):
    rng = np.random.default_rng(seed)
    codes = set()
    for base in rng.integers(0, 1 << 63, 12, dtype=np.uint64).tolist():
        for _ in range(25):
            code = base
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                code ^= 1 << int(bit)
            codes.add(code)
    codes = sorted(codes)
    arr = np.array(codes, np.uint64)
    swapped = (arr << np.uint64(32)) | (arr >> np.uint64(32))
    labels = np.arange(len(arr))
    for lead, budget in ((arr, 2), (swapped, 1)):
        own = link_codes(lead, 4, budget, 4)
        labels = merge_labels(labels, np.arange(len(arr)), own)
    want = brute_classes(codes, 4)
    assert labels.tolist() == want


DOCS = "doc_id long, text string, source string, fingerprint string, component_id long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "s", "f", -1) for i, t in rows], DOCS)


def test_simhash_query_matches_all_pairs(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in table.orderBy("doc_id").collect()]
    long = " ".join(f"w{k % 997}" for k in range(3000))
    rows += [(9000, None), (9001, ""), (9002, " \n "), (9003, long), (9004, long + " end"), (9005, long), (9006, "tie tie tie tie tie")]
    out = {r["doc_id"]: r for r in simhash_components(documents(spark, rows)).collect()}
    codes = [plain_fingerprint(t or "") for _, t in rows]
    roots = brute_classes(codes, 4)
    assert len(out) == len(rows)
    for k, (i, _) in enumerate(rows):
        assert out[i]["fingerprint"] == f"{codes[k]:016x}"
        assert out[i]["component_id"] == rows[roots[k]][0]


def test_simhash_edge_rows(spark):
    out = simhash_components(documents(spark, [(None, "a b"), (4, "a b"), (4, "a b"), (None, "zz yy")])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in out if r["component_id"] is not None) == [(False, 4), (False, 4), (True, 4)]
    assert len(out) == 4
    assert simhash_components(documents(spark, [])).count() == 0


# -- wide signatures ------------------------------------------------------------------------------
def edited(rng, words, share):
    return [f"n{rng.integers(1 << 40)}" if rng.random() < share else w for w in words]


def jaccard(a, b, k=5):
    x, y = ({" ".join(t[i : i + k]) for i in range(max(1, len(t) - k + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_signature_index_finds_what_pairs_show():
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows += [base] + [edited(rng, base, s) for s in (0.002, 0.01, 0.02, 0.05)]
    words = np.array([signature(" ".join(r)) for r in rows])
    for word in range(nearcopies.WORDS):
        pairs = [
            (j, i) for i in range(len(rows)) for j in range(i)
            if (int(words[i, word]) ^ int(words[j, word])).bit_count() <= nearcopies.RADIUS
            and sum((int(a) ^ int(b)).bit_count() for a, b in zip(words[i], words[j], strict=True)) <= nearcopies.LIMIT
        ]
        assert link_signatures(words, word).tolist() == components(len(rows), pairs)


@pytest.mark.parametrize("cell_rows", [8192, 16])
def test_near_copies_go_and_others_stay(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(nearcopies, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(6)
    families = []
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 4000, 250)]
        families.append([edited(rng, base, s) for s in (0, 0, 0.002, 0.004)])
        half = base[:125] + [f"v{x}" for x in rng.integers(0, 4000, 125)]
        families.append([half])  # shares half its text: no copy
    rows = [words for members in families for words in members]
    kept = {r["doc_id"] for r in drop_near_copies(documents(spark, [(k, " ".join(w)) for k, w in enumerate(rows)])).collect()}
    at = missed = 0
    for members in families:
        assert at in kept
        for k, words in enumerate(members[1:], at + 1):
            if jaccard(words, members[0]) >= 0.9:
                assert k not in kept
            missed += k in kept
        at += len(members)
    assert missed <= 3  # of 120 copies, some are near 0.8


def test_signature_cells_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "TASK_ROWS", 10)
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 4000, 400)]
    rows = [(k, " ".join(edited(rng, base, 0.005))) for k in range(45)] + [(99, "something else entirely in here")]
    out = {r["doc_id"]: r["component_id"] for r in near_copy_components(documents(spark, rows)).collect()}
    assert out == {k: 0 for k in range(45)} | {99: 99}


def test_near_copies_of_edge_rows(spark):
    rows = [(3, None), (1, ""), (2, " "), (7, "same words here"), (8, "same words here"), (None, "same words here"), (7, "x y z")]
    kept = [r["doc_id"] for r in drop_near_copies(documents(spark, rows)).collect()]
    assert sorted(kept, key=lambda x: (x is None, x)) == [1, 7, 7, None]
    assert drop_near_copies(documents(spark, [])).count() == 0


def at_similarity(rng, n, same, tag):
    """Two texts of n shingles each that share ``same`` of them; the words of others are their own."""
    base = [f"{tag}x{k}" for k in range(n + 4)]
    return base, base[: same + 4] + [f"{tag}y{k}" for k in range(n - same)]


@pytest.mark.parametrize("key_rows", [2048, 4])
def test_isolated_pairs_link_from_the_similarity_on(spark, monkeypatch, key_rows):
    monkeypatch.setattr(nearcopies, "KEY_ROWS", key_rows)
    rng = np.random.default_rng(8)
    rows = []
    for k in range(400):  # 0.8, 0.81, 0.85 and 0.79, 0.75, 0.7
        same = (160, 162, 166, 159, 155, 149)[k % 6]
        rows += at_similarity(rng, 180, same, f"p{k}")
    out = {r["doc_id"]: r["component_id"] for r in near_copy_components(documents(spark, [(k, " ".join(w)) for k, w in enumerate(rows)])).collect()}
    for k in range(0, len(rows), 2):
        assert out[k] == k
        assert (out[k + 1] == k) == (jaccard(rows[k], rows[k + 1]) >= 0.8), jaccard(rows[k], rows[k + 1])


@pytest.mark.parametrize("key_rows", [2048, 6])
def test_near_copies_match_all_pairs(spark, monkeypatch, key_rows):
    monkeypatch.setattr(nearcopies, "KEY_ROWS", key_rows)
    monkeypatch.setattr(nearcopies, "PAIR_ROWS", 5)
    rng = np.random.default_rng(9)
    rows = []
    for n in (6, 12, 40, 200):
        for _ in range(6):
            base = [f"w{x}" for x in rng.integers(0, 4000, n)]
            rows += [base, base + base[:7]] + [edited(rng, base, s) for s in (0.005, 0.01, 0.015, 0.02, 0.03, 0.05)]
    links = [(j, i) for i in range(len(rows)) for j in range(i) if jaccard(rows[i], rows[j]) >= 0.8]
    out = {r["doc_id"]: r["component_id"] for r in near_copy_components(documents(spark, [(k, " ".join(w)) for k, w in enumerate(rows)])).collect()}
    assert [out[k] for k in range(len(rows))] == components(len(rows), links)


def test_vectors_that_share_an_id_are_not_mixed_up(spark):
    rows = [(7, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (8, [1.0, 0.01], 1), (9, [0.01, 1.0], 1)]
    out = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_embeddings(vectors(spark, rows)).collect())
    assert out == [(7, 1, 7), (7, 1, 7), (8, 1, 7), (9, 1, 7)]
    rows = [(7, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (3, [1.0, 0.01], 1)]
    out = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_embeddings(vectors(spark, rows)).collect())
    assert out == [(3, 1, 3), (7, 0, 7), (7, 1, 3)]


def test_block_pairs_prune_and_lose_none():
    rng = np.random.default_rng(2)
    y = rng.normal(0, 0.125, (1500, 4))
    y[700:] = y[:800] + rng.normal(0, 0.02, (800, 4))
    near = {(i, j) for i, j in zip(*np.nonzero(((y[:, None] - y[None]) ** 2).sum(axis=2) <= 0.05**2), strict=True) if i < j}
    found = [(min(a, b), max(a, b)) for u, v in embeddup.block_pairs(y, 0.05) for a, b in zip(u.tolist(), v.tolist(), strict=True)]
    assert len(found) == len(set(found)) and near <= set(found)
    assert len(found) < 0.03 * len(y) * (len(y) - 1) / 2
    side = rng.integers(0, 2, len(y)).astype(np.int8)
    across = [(a, b) for u, v in embeddup.block_pairs(y, 0.05, side) for a, b in zip(u.tolist(), v.tolist(), strict=True)]
    assert all(side[a] == 0 and side[b] == 1 for a, b in across)
    assert {p for p in near if side[p[0]] != side[p[1]]} <= {(min(p), max(p)) for p in across}


def test_fingerprints_that_share_an_id_are_not_mixed_up(spark):
    rows = [(5, "a b c d e"), (5, "other words stand in here now"), (3, "a b c d e"), (9, "other words stand in here now")]
    out = sorted((r["doc_id"], r["component_id"]) for r in simhash_components(documents(spark, rows)).collect())
    assert out == [(3, 3), (5, 3), (5, 5), (9, 5)]
