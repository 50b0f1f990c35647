"""Near copies: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two indexes and every one is verified on the exact shingle sets, in a join.
The first index is the Gray-order index on SimHash signatures.  A signature has ``WORDS``
fingerprints of 64 bits; a pair is found where one word differs in at most ``RADIUS`` bits and all
of them in at most ``LIMIT``.  Of ``RADIUS + c`` blocks of a word, ``c`` are equal in such a pair,
which makes the cells of an equi-join; ``c`` follows from the row count so that cells stay small.  A
cell is joined by descending two trees over its Gray-sorted codes (see ``simhash``), whose node
pairs are pruned by the bits that already differ, or because all their members are in one class.
Cells return spanning forests.

At a similarity of 0.8 that index alone misses pairs.  So the sets also have ``BANDS`` keys of
``BAND_ROWS`` minima each: two sets of similarity s agree in one with probability 1 - (1 - s^5)^24, all
but 1 of 13,000 pairs at 0.8.  Of the rows with a key, each is first verified against the one of the
smallest doc_id.  Where that leaves several classes, the key's rows meet in a task with their sets,
which verifies pairs across classes, each in the first key that both share, until what they connect is
known: no pair that shares a key is left out but those of one class, which need no link, and only
a forest leaves the task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import documents, free_name, in_parts, map_columns, saved, small
from vellum.llm.components import connected_components, merge_labels
from vellum.llm.simhash import _BITS, _PLACES, FRONTIER, _pairs, _Tree, gray_rank

#: Near copies have this Jaccard similarity of their shingle sets.
SIMILARITY = 0.8
#: Words of a shingle, fingerprints of a signature, differing bits of one fingerprint that the index
#: finds, and of the whole signature up to which it proposes documents: at a similarity of 0.8
#: about 38 of the 256 bits differ, with a deviation of 6; at 0.5 it is 68.
SHINGLE, WORDS, RADIUS, LIMIT = 5, 4, 5, 46
#: Keys of a set, and minima of a key.
BANDS, BAND_ROWS = 24, 5
#: Pairs across classes that differ in more bits of the signature can't be near copies (for sets of
#: four and five shingles 48 differ at 0.8, with a deviation of 6).
FAR = 84
#: Rows of a key, hashes of their sets, and verified pairs of a document, that one task gets about.
KEY_ROWS, KEY_HASHES, PAIR_ROWS = 2048, 1_000_000, 1024
#: Rows of a cell, about, and rows of one side of a task at most.
CELL_ROWS, TASK_ROWS = 8192, 50_000
#: Cells of up to so many rows are compared row by row.
SMALL = 128

_NAMES = [f"s{k}" for k in range(WORDS)]
_MIX = np.array(
    [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64
)
#: Odd factors of the minima's permutations, and shingles that are permuted at once.
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_AT_ONCE = 4096


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles (one of all words, if they are fewer).

    Words are split and folded as in ``simhash.fingerprint``; no words, no shingles.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    data, n = b" ".join(words), max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(data[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64))


def signature(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The signature's words; all 0 if the text has no words."""
    return set_signature(shingle_set(text, shingle))


def set_signature(h: np.ndarray) -> np.ndarray:
    """A bit is set where over half of the set's hashes, mixed anew for each word, have it set."""
    out, n = np.zeros(WORDS, np.uint64), len(h)
    for k in range(WORDS if n else 0):
        mixed = (h ^ (h >> np.uint64(32))) * _MIX[k]
        mixed ^= mixed >> np.uint64(29)
        octets = mixed.view(np.uint8).reshape(n, 8) + _PLACES
        counts = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
        out[k] = np.packbits(2 * counts.ravel() > n, bitorder="little").view(np.uint64)[0]
    return out


def band_keys(h: np.ndarray) -> list[int]:
    """The set's keys (signed), each of ``BAND_ROWS`` minima under permutations; none if it is empty."""
    if not len(h):
        return []
    mixed = h ^ (h >> np.uint64(32))
    parts = [mixed[k : k + _AT_ONCE] for k in range(0, len(h), _AT_ONCE)]
    least = np.min([(p[None, :] * _FACTORS[:, None]).min(axis=1) for p in parts], axis=0)
    rows = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(rows)]


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Of every document: ``doc_id``, ``code`` (digest of its set), ``size``, ``keys``, ``s0`` …"""

    def make():
        def run(ids, texts):
            sets = [shingle_set(t, shingle) for t in texts]
            found = np.array([set_signature(h) for h in sets], np.uint64).view(np.int64)
            codes = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
            return [ids, codes, list(map(len, sets)), [band_keys(h) for h in sets], *found.T]

        return run

    ddl = "doc_id long, code binary, size long, keys array<long>, " + ", ".join(f"{c} long" for c in _NAMES)
    return map_columns(documents(docs), make, ddl)


def _near(words: np.ndarray, word: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs are found by the word and are near copies."""
    one = np.bitwise_count(words[a, word] ^ words[b, word]) <= RADIUS
    a, b = a[one], b[one]
    total = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
    one[np.flatnonzero(one)] = total <= LIMIT
    return one


def link_signatures(words: np.ndarray, word: int, side: np.ndarray | None = None) -> np.ndarray:
    """Class labels (row numbers) that the near copies found by one word make among the rows.

    With ``side`` only pairs across the two sides are looked at.
    """
    n = len(words)
    order = np.lexsort((gray_rank(words[:, (word + 1) % WORDS]), gray_rank(words[:, word])))
    w = words[order]
    apart = None if side is None else side[order]
    labels = np.arange(n)

    def link(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal labels
        open_pairs = labels[a] != labels[b]
        if apart is not None:
            open_pairs &= apart[a] != apart[b]
        a, b = a[open_pairs], b[open_pairs]
        good = _near(w, word, a, b)
        labels = merge_labels(labels, a[good], b[good])

    if n <= SMALL:
        link(*np.triu_indices(n, 1))
    else:
        for step in (1, 2, 4, 8):  # neighbours first: what they join needs no comparing later
            link(np.arange(n - step), np.arange(step, n))
        _descend(w[:, word], lambda: labels, link)
    out = np.empty(n, np.int64)
    least = np.full(n, n, np.int64)
    np.minimum.at(least, labels, order)
    out[order] = least[labels]
    return out


def _descend(codes: np.ndarray, labels_now, link) -> None:
    """Offers to ``link`` all row pairs within the radius that aren't in one class yet."""
    tree = _Tree(codes, 4)
    deepest = len(tree.levels) - 1
    top = np.arange(len(tree.levels[0][0]))
    stack = [(0, *np.triu_indices(len(top)))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > FRONTIER:
            stack.append((level, i[FRONTIER:], j[FRONTIER:]))
            i, j = i[:FRONTIER], j[:FRONTIER]
        start, end, pattern, mask = tree.levels[level]
        labels = labels_now()
        low, high = np.minimum.reduceat(labels, start), np.maximum.reduceat(labels, start)
        one_class = (low[i] == high[j]) & (low[j] == high[i])
        differ = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j])
        keep = (differ <= RADIUS) & ~one_class
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level < deepest:
            first, last = tree.children(level)
            x, y, which = _pairs(first[i], last[i], first[j], last[j])
            ordered = (i[which] != j[which]) | (x <= y)
            stack.append((level + 1, x[ordered], y[ordered]))
            continue
        # the rows of the deepest nodes; many rows may share a code
        size = (end[i] - start[i]) * (end[j] - start[j])
        for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(size) // FRONTIER)) + 1):
            a, b = i[part], j[part]
            for x in range(0, int((end[a] - start[a]).max()), 256):
                low_a = start[a] + x
                some = low_a < end[a]
                rows = np.minimum(end[a], low_a + 256)
                u, v, _ = _pairs(low_a[some], rows[some], start[b][some], end[b][some])
                link(u, v)


def _blocks(rows: int) -> list[list[tuple[int, int]]]:
    """The block choices of a word's index: of each the (first bit, bits) that are equal."""
    for c in range(9):
        m = RADIUS + c
        width = 64 // m
        if rows <= CELL_ROWS << (c * width):
            break
    places = [(k * width, width) for k in range(m - 1)] + [((m - 1) * width, 64 - (m - 1) * width)]
    return [list(x) for x in combinations(places, c)] if c else [[]]


def _value(word: Column, blocks: list[tuple[int, int]]) -> Column:
    """The bits of the blocks as one number."""
    out = F.lit(0).cast("long")
    for first, bits in blocks:
        part = F.shiftrightunsigned(word, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        out = F.shiftleft(out, bits).bitwiseOR(part)
    return out


def _values(codes: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """As ``_value``, of an array of codes."""
    out = np.zeros(len(codes), np.uint64)
    for first, bits in blocks:
        out = (out << np.uint64(bits)) | ((codes >> np.uint64(first)) & np.uint64((1 << bits) - 1))
    return out


def link_cells(words: np.ndarray, word: int, values: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """As ``link_signatures``, but only rows of equal ``values`` (a cell) are compared."""
    order = np.argsort(values, kind="stable")
    w, labels = words[order], np.arange(len(words))
    start = np.flatnonzero(np.r_[True, np.diff(values[order]) != 0])
    end = np.r_[start[1:], len(words)]
    rows = end - start
    few = np.flatnonzero((rows > 1) & (rows <= SMALL))
    for cells in np.split(few, np.flatnonzero(np.diff(np.cumsum(rows[few] ** 2) // FRONTIER)) + 1):
        u, v, _ = _pairs(start[cells], end[cells], start[cells], end[cells])
        some = u < v if side is None else (u < v) & (side[order[u]] != side[order[v]])
        u, v = u[some], v[some]
        good = _near(w, word, u, v)
        labels = merge_labels(labels, u[good], v[good])
    for a, b in zip(start[rows > SMALL].tolist(), end[rows > SMALL].tolist(), strict=True):
        labels[a:b] = a + link_signatures(w[a:b], word, None if side is None else side[order[a:b]])
    out = np.empty(len(words), np.int64)
    out[order] = order[labels]
    return out


def signature_links(first: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect what pairs within RADIUS and LIMIT among signatures connect.

    ``first (node, s0 …)``.  A group of cells has CELL_ROWS rows about; one of more than TASK_ROWS is
    cut into parts by hash, each pair of parts being a task, so that no task has a whole group of
    copies.
    """
    rows = first.count()
    choices, buckets = _blocks(rows), -(-rows // CELL_ROWS) or 1
    keys = F.array(
        *[
            F.struct(
                F.lit(word).alias("word"),
                F.lit(k).alias("choice"),
                F.pmod(F.xxhash64(_value(F.col(f"s{word}"), blocks)), F.lit(buckets)).alias("bucket"),
            )
            for word in range(WORDS)
            for k, blocks in enumerate(choices)
        ]
    )
    cells = first.select("node", *_NAMES, F.explode(keys).alias("cell")).select("node", *_NAMES, "cell.*")
    names = ["word", "choice", "bucket"]
    tasks = in_parts(cells, names, TASK_ROWS, "node").select(*names, "low", "high", "part", "node", *_NAMES)

    def join(key: tuple, table: pa.Table) -> pa.Table:
        nodes, word = table["node"].to_numpy(), key[0].as_py()
        words = np.stack([table[c].to_numpy().view(np.uint64) for c in _NAMES], axis=1)
        side = table["part"].to_numpy() if key[3].as_py() != key[4].as_py() else None
        labels = link_cells(words, word, _values(words[:, word], choices[key[1].as_py()]), side)
        moved = labels != np.arange(len(labels))
        return pa.table({"a": nodes[moved], "b": nodes[labels[moved]]})

    return tasks.groupBy(*names, "low", "high").applyInArrow(join, "a long, b long")


def _with_set(pairs: DataFrame, sets: DataFrame, end: str) -> DataFrame:
    """``pairs`` with the set of one end; the pairs of a frequent document are spread over tasks."""
    hot = pairs.groupBy(end).agg(F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("parts")).filter("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    salted = pairs.join(F.broadcast(hot), end, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), parts).cast("int"))
    copies = (
        sets.select(F.col("node").alias(end), F.col("shingles").alias(f"{end}_set"))
        .join(F.broadcast(hot), end, "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    )
    return salted.drop("parts").join(copies.drop("parts"), [end, "part"]).drop("part")


def shingle_sets(nodes: DataFrame, held: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """``node``, ``shingles`` of the written table ``nodes (node)``."""

    def make():
        def run(ids, texts):
            sets = [shingle_set(t, shingle) for t in texts]
            return [[xxhash.xxh3_128_digest(h.tobytes()) for h in sets], [h.view(np.int64) for h in sets]]

        return run

    wanted = saved(held.select("node", "doc_id", "code").join(nodes, "node"), "wanted")
    texts = documents(docs).join(small(wanted.select("doc_id")), "doc_id", "left_semi")
    sets = map_columns(texts, make, "code binary, shingles array<long>").groupBy("code").agg(F.first("shingles").alias("shingles"))
    return saved(sets.join(wanted.select("node", "code"), "code").drop("code"), "sets")


def verified(pairs: DataFrame, held: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The distinct ``pairs (a, b)`` of nodes whose sets have a Jaccard similarity of SIMILARITY."""
    ends = saved(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ends")
    sets = shingle_sets(ends, held, docs, shingle)
    both = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - both
    found = _with_set(_with_set(pairs, sets, "a"), sets, "b").filter(both / union >= SIMILARITY)
    return saved(found.select("a", "b").distinct(), "near")


def may_be_near(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The ``pairs (a, b)`` whose sizes and signatures allow a similarity of SIMILARITY."""
    for end in ("a", "b"):
        own = held.select(F.col("node").alias(end), F.col("size").alias(f"{end}_size"), *[F.col(c).alias(f"{end}_{c}") for c in _NAMES])
        pairs = pairs.join(own, end)
    apart = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _NAMES), F.lit(0))
    less, more = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    return pairs.filter((apart <= FAR) & (less >= SIMILARITY * more)).select("a", "b")


def link_sets(table: pa.Table, band: int, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that connect what near copies of different classes connect among a key's rows.

    ``table`` has ``size``, ``class``, ``part``, ``keys``, ``shingles``, ``s0`` …  Pairs that share the key of
    an earlier band aren't looked at; with ``across`` only pairs of different parts are.
    """
    n = table.num_rows
    size, part = table["size"].to_numpy(), table["part"].to_numpy()
    _, group = np.unique(table["class"].to_numpy(), return_inverse=True)
    words = np.stack([table[c].to_numpy().view(np.uint64) for c in _NAMES], axis=1)
    keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(n, BANDS)[:, :band]
    _, hashes = np.unique(table["shingles"].combine_chunks().flatten().to_numpy(), return_inverse=True)
    end = np.cumsum(table["shingles"].combine_chunks().value_lengths().to_numpy())
    start = np.r_[0, end[:-1]]
    mine = np.zeros(int(hashes.max(initial=0)) + 1, bool)
    labels, out = np.arange(int(group.max(initial=0)) + 1), []
    for k in range(n - 1):
        some = (labels[group[k + 1 :]] != labels[group[k]]) & (np.minimum(size[k + 1 :], size[k]) >= SIMILARITY * np.maximum(size[k + 1 :], size[k]))
        if across:
            some &= part[k + 1 :] != part[k]
        at = np.flatnonzero(some) + k + 1
        at = at[np.bitwise_count(words[at] ^ words[k]).sum(axis=1, dtype=np.int64) <= FAR]
        at = at[~(keys[at] == keys[k]).any(axis=1)]
        mine[hashes[start[k] : end[k]]] = True
        for rows in np.split(at, np.flatnonzero(np.diff(np.cumsum(size[at]) // KEY_HASHES)) + 1):
            rows = rows[labels[group[rows]] != labels[group[k]]]
            if not len(rows):
                continue
            first = np.cumsum(size[rows]) - size[rows]
            places = np.arange(int(size[rows].sum())) + np.repeat(start[rows] - first, size[rows])
            both = np.add.reduceat(mine[hashes[places]], first, dtype=np.int64)
            good = rows[both / (size[k] + size[rows] - both) >= SIMILARITY]
            if len(good):
                _, one = np.unique(labels[group[good]], return_index=True)
                out += [(k, x) for x in good[one].tolist()]
                labels = merge_labels(labels, np.full(len(good), group[k]), group[good])
        mine[hashes[start[k] : end[k]]] = False
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def across_classes(rows: DataFrame) -> DataFrame:
    """Edges ``a, b`` between near copies of other classes that have an equal key.

    ``rows (band, key, node, size, class, keys, shingles, s0 …)``.
    """

    def join(key: tuple, table: pa.Table) -> pa.Table:
        ids = table["node"].to_numpy()
        u, v = link_sets(table, key[0].as_py(), key[2].as_py() != key[3].as_py())
        return pa.table({"a": ids[u], "b": ids[v]})

    tasks = in_parts(rows, ["band", "key"], KEY_ROWS, "node", F.col("size"), KEY_HASHES)
    return tasks.groupBy("band", "key", "low", "high").applyInArrow(join, "a long, b long")


def near_copy_links(first: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Edges ``a, b`` of near copies, as many as connect them.

    ``first (node, doc_id, code, size, keys, s0 …)`` has a row per distinct set, ``node`` being unique.
    """
    held = first.filter("size > 0")
    keyed = saved(held.select("node", F.posexplode("keys").alias("band", "key")), "keyed")
    shared = saved(keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1"), "shared")
    stars = keyed.join(shared, ["band", "key"]).select(F.col("node").alias("a"), F.col("least").alias("b"))
    forest = signature_links(held).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tried = may_be_near(stars.unionByName(forest).filter("a <> b").distinct(), held)
    near = verified(saved(tried, "tried"), held, docs, shingle)
    classes = connected_components(near)
    # keys of two rows are settled; the others may hold rows of several classes
    rows = saved(
        keyed.join(shared.filter("n > 2").select("band", "key"), ["band", "key"])
        .join(classes, "node", "left")
        .withColumn("class", F.coalesce("component", "node"))
        .drop("component"),
        "classed",
    )
    # of keys with the same rows the first is enough
    members = [F.count("*").alias("_n"), *[F.sum(F.xxhash64(F.lit(k), "node").cast("decimal(38,0)")).alias(f"_m{k}") for k in (0, 1)]]
    several = (
        rows.groupBy("band", "key")
        .agg(F.min("class").alias("_l"), F.max("class").alias("_h"), *members)
        .filter("_l < _h")
        .groupBy("_n", "_m0", "_m1")
        .agg(F.min(F.struct("band", "key")).alias("_k"))
        .select("_k.band", "_k.key")
    )
    rows = saved(rows.join(several, ["band", "key"]), "several")
    sets = shingle_sets(saved(rows.select("node").distinct(), "ends"), held, docs, shingle)
    full = held.select("node", "size", "keys", *_NAMES).join(sets, "node")
    return near.unionByName(saved(across_classes(rows.join(full, "node")), "across"))


def near_copy_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``component_id`` of every row: the smallest doc_id that links of near copies reach.

    Texts without words are copies of each other.  Rows without a doc_id make no links and have the
    component of their shingle set, null where no row with an id has it.  Repeated rows come out as
    often as they come in; other columns are ignored; an empty table gives an empty table.
    """
    marked = saved(signatures(docs, shingle), "signatures")
    rest = ["size", "keys", *_NAMES]
    known = marked.filter("doc_id is not null")
    sets = known.groupBy("code").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in rest])
    first = saved(sets.withColumn("node", F.monotonically_increasing_id()), "first")
    found = connected_components(near_copy_links(first, docs, shingle))
    classes = saved(
        first.join(found, "node", "left").select("code", "doc_id", F.coalesce("component", "node").alias("component")),
        "classes",
    )
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return marked.select("doc_id", "code").join(classes.select("code", "component").join(least, "component"), "code", "left").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row for each group of near copies: that of the smallest doc_id.

    Rows without a doc_id stay.  Where rows share a doc_id all of them stay if one does, so that no
    group loses all its rows.  Other columns pass through; an empty table gives an empty table.
    """
    found = near_copy_components(docs, shingle)
    gone = free_name(docs, "gone")
    ids = found.groupBy(F.col("doc_id").alias(gone)).agg(F.min(F.col("doc_id") != F.col("component_id")).alias("all")).filter("all").select(gone)
    return docs.join(small(saved(ids, "gone")), F.col("doc_id").cast("long") == F.col(gone), "left_anti")
