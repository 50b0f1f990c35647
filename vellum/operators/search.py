"""Ranked search for a table of queries: dense, BM25, fused, pooled, reranked, hydrated, packed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.text import tokens
from vellum.storage import saved

#: Query vectors of one scan of the base; what a task holds of the queries is bounded by it.
QUERY_BLOCK = 4096
#: Rows of the base whose scores a task has at once: QUERY_BLOCK x SLICE doubles are 17 MB.
SLICE = 512
K1, B = 1.2, 0.75


def ranked(df: DataFrame, by: str, *order: Column, k: int | None = None) -> DataFrame:
    """``rank`` (long) from 1 within ``by``; only the first ``k``.

    With ``k`` Spark keeps ``k`` rows per group and task before the shuffle, so large groups cost
    nothing there.
    """
    out = df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long"))
    return out if k is None else out.filter(F.col("rank") <= k)


# -- dense ----------------------------------------------------------------------------------------
def unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and which rows can be compared: full width, all finite, not zero."""
    lengths = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), float))
    good = lengths == width
    flat = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False)
    x = flat.astype(np.float64).reshape(-1, width)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        usable = np.isfinite(norm) & (norm > 0)
        x = x[usable] / norm[usable, None]
    good[good] = usable
    return x, good


def dense_search(queries: DataFrame, base: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """``query_id``, ``id``, ``score``, ``rank``: the ``k`` nearest rows of ``base`` by cosine.

    ``queries (query_id, embedding)``, ``base (id, embedding)``.  Queries go to the tasks in blocks
    of QUERY_BLOCK; per block one scan of the base, in which each task keeps its best ``k`` per
    query, so that the shuffle has ``k`` rows per query and task.  Scores are rounded to ``digits``
    and ties go to the smaller id.  Vectors that are null, zero, not finite or of another width
    than the query's match nothing.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
    asked = asked.filter(F.exists("embedding", lambda v: v != 0))
    blocks = -(-asked.count() // QUERY_BLOCK)
    found = None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = [r for r in own.collect() if all(v is not None and np.isfinite(v) for v in r["embedding"])]
        part = _scan(spark, rows, base, k, digits)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, id long, score double, rank long")
    return ranked(found, "query_id", F.desc("score"), F.col("id"), k=k)


def _scan(spark, rows: list, base: DataFrame, k: int, digits: int) -> DataFrame:
    widths = sorted({len(r["embedding"]) for r in rows})
    groups = spark.sparkContext.broadcast(
        [
            (
                w,
                np.array([r["query_id"] for r in rows if len(r["embedding"]) == w]),
                np.array([r["embedding"] for r in rows if len(r["embedding"]) == w], np.float64),
            )
            for w in widths
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = [(w, q / np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]) for w, _, q in groups.value]
        best = {w: Best(len(q), k) for w, q in units}
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for width, unit in units:
                x, good = unit_rows(batch.column(1), width)
                if len(x):
                    best[width].add(np.round(unit @ x.T, digits), ids[good])
        for width, names, _ in groups.value:
            asking, ids, score = best[width].rows()
            yield pa.RecordBatch.from_pydict({"query_id": names[asking], "id": ids, "score": score})

    rows_in = base.select(F.col("id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows_in.filter("id is not null").mapInArrow(run, "query_id long, id long, score double")


# -- BM25 -----------------------------------------------------------------------------------------
def bm25_search(queries: DataFrame, base: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """``query_id``, ``id``, ``score``, ``rank``: the ``k`` best rows of ``base`` by BM25.

    ``queries (query_id, text)``, ``base (id, text)``.  Document frequencies of the queries' terms
    are counted first; then queries go to the tasks in blocks of QUERY_BLOCK, and one scan per block
    scores each document where it is read and keeps the best ``k`` per query and task.  No pair of a
    document and a query goes through a shuffle unless it is among those.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col("query_id").cast("long"), F.array_distinct(tokens(F.col("text"))).alias("terms"))
    asked = asked.filter(F.size("terms") > 0)
    rows_in = base.select(F.col("id").cast("long"), tokens(F.col("text")).alias("words")).filter("id is not null")
    # the empty term, which no text has, counts all documents and words in the same pass
    every = F.array_append(F.array_distinct("words"), F.lit(""))
    wanted = asked.select(F.explode(F.array_append("terms", F.lit(""))).alias("term")).distinct()
    holders = saved(
        rows_in.select(F.size("words").alias("length"), F.explode(every).alias("term"))
        .join(wanted, "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("length").alias("words")),
        "terms",
    )
    total = holders.filter("term = ''").first()
    n, mean = (total["df"], total["words"] / total["df"] or 1.0) if total else (0, 1.0)
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = holders.filter("term <> ''").select("term", idf.alias("idf"))
    blocks = -(-asked.count() // QUERY_BLOCK)
    found = None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        terms = own.select("query_id", F.explode("terms").alias("term"))
        listed = terms.join(weights, "term").groupBy("term", "idf").agg(F.collect_list("query_id").alias("ids"))
        part = _bm25_scan(spark, listed.collect(), rows_in, mean, k, digits)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, id long, score double, rank long")
    return ranked(found, "query_id", F.desc("score"), F.col("id"), k=k)


def bm25_scores(texts: pa.Array, terms: pa.Array, postings: list[tuple], queries: int, mean: float) -> np.ndarray:
    """A row per query and a column per text (a list of words); ``postings`` has term, weight and queries of each of ``terms``.

    Words are looked up as a column, and a term's texts and queries get its scores at once.
    """
    lengths = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    longness = K1 * (1 - B + B * lengths / mean)
    found = pc.index_in(texts.flatten(), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.repeat(np.arange(len(texts)), lengths)[found >= 0]
    pairs, counts = np.unique(found[found >= 0] * len(texts) + at, return_counts=True)
    at, found = pairs % max(1, len(texts)), pairs // max(1, len(texts))
    share = counts * (K1 + 1) / (counts + longness[at])
    bounds = np.flatnonzero(np.diff(found, prepend=-1, append=-1))
    score = np.zeros((queries, len(texts)))
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        _, weight, asking = postings[found[begin]]
        score[np.ix_(asking, at[begin:end])] += weight * share[begin:end]
    return score


def _bm25_scan(spark, listed: list, rows_in: DataFrame, mean: float, k: int, digits: int) -> DataFrame:
    names = np.array(sorted({q for r in listed for q in r["ids"]}), np.int64)
    postings = [(r["term"], r["idf"], np.searchsorted(names, r["ids"])) for r in listed]
    held = spark.sparkContext.broadcast((names, postings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, postings = held.value
        best = Best(len(queries), k)
        terms = pa.array([term for term, _, _ in postings], pa.string())
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            score = bm25_scores(batch.column(1), terms, postings, len(queries), mean)
            best.add(np.round(score, digits), ids, least=10.0**-digits / 2)
        asking, ids, score = best.rows()
        yield pa.RecordBatch.from_pydict({"query_id": queries[asking], "id": ids, "score": score})

    return rows_in.mapInArrow(run, "query_id long, id long, score double")


class Best:
    """The ``k`` best ids of each query so far, ties by id; flat, so that it grows by what it keeps only."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.bar = np.full(queries, -np.inf)
        self.asking, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)
        self.score = np.empty(0)

    def add(self, score: np.ndarray, ids: np.ndarray, least: float = -np.inf) -> None:
        """``score`` has a row per query and a column per id; those under ``least`` don't count."""
        bar = np.maximum(self.bar, least)
        if score.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(score, -self.k, axis=1)[:, -self.k])
        asking, at = np.nonzero(score >= bar[:, None])
        if not len(asking):
            return
        self.merge(asking, ids[at].astype(np.int64), score[asking, at])

    def merge(self, asking: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Adds single scores; ``asking`` is the number of the query of each."""
        asking = np.concatenate([self.asking, asking])
        ids, score = np.concatenate([self.ids, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, asking))
        asking = asking[order]
        begins = np.flatnonzero(np.diff(asking, prepend=-1))
        place = np.arange(len(asking)) - np.repeat(begins, np.diff(begins, append=len(asking)))
        last = place == self.k - 1
        self.bar[asking[last]] = score[order][last]
        kept = place < self.k
        self.asking, self.ids, self.score = asking[kept], ids[order][kept], score[order][kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query, id and score, a row for each kept."""
        return self.asking, self.ids, self.score


# -- fusion, pool, rerank -------------------------------------------------------------------------
def fuse_ranks(branches: list[DataFrame], k: int, constant: int = 2, digits: int = 6) -> DataFrame:
    """Reciprocal rank fusion: each branch gives 1 / (constant + rank), a missing one nothing."""
    each = branches[0].select("query_id", "id", "rank")
    for b in branches[1:]:
        each = each.unionByName(b.select("query_id", "id", "rank"))
    fused = each.groupBy("query_id", "id").agg(
        F.round(F.sum(1 / (F.lit(constant) + F.col("rank"))), digits).alias("score")
    )
    return ranked(fused, "query_id", F.desc("score"), F.col("id"), k=k)


def merge_hits(hits: DataFrame) -> DataFrame:
    """One row per request and chunk: best score, queries in order, place of the first find.

    ``hits (request, query_pos, rank, id, score)``.
    """
    seen = F.array_sort(F.collect_set(F.struct("query_pos", "rank")))
    return (
        hits.groupBy("request", "id")
        .agg(
            F.max("score").alias("score"),
            seen.alias("seen"),
            F.min(F.struct("rank", "query_pos")).alias("first"),
        )
        .withColumn("queries", F.array_distinct(F.col("seen.query_pos")))
        .select("request", "id", "score", "queries", "first")
    )


def candidate_pool(hits: DataFrame, most: int) -> DataFrame:
    """``merge_hits`` in rounds over the queries: all first hits, then all second ones, …"""
    pool = merge_hits(hits)
    return ranked(pool, "request", F.col("first.rank"), F.col("first.query_pos"), k=most)


def rerank(
    candidates: DataFrame, scores: DataFrame, known: DataFrame | None = None, k: int = 8
) -> DataFrame:
    """The best ``k`` candidates by given scores.

    ``candidates (request, id, score, rank)``; ``scores`` and ``known`` are ``(request, id,
    rerank_score)``.  A known score is used before a fresh one; a candidate without either keeps
    its own score.  Ties go to known scores, then to the earlier rank and the smaller id.
    """
    out = candidates.join(scores.withColumnRenamed("rerank_score", "_fresh"), ["request", "id"], "left")
    if known is not None:
        out = out.join(known.withColumnRenamed("rerank_score", "_known"), ["request", "id"], "left")
    else:
        out = out.withColumn("_known", F.lit(None).cast("double"))
    final = out.select(
        "request",
        "id",
        F.col("rank").alias("fused_rank"),
        F.coalesce("_known", "_fresh").alias("rerank_score"),
        F.coalesce("_known", "_fresh", "score").alias("final_score"),
        F.col("_known").isNotNull().alias("reused"),
    )
    order = (F.desc("final_score"), F.desc("reused"), F.col("fused_rank"), F.col("id"))
    return ranked(final, "request", *order, k=k)


# -- around hits ----------------------------------------------------------------------------------
def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that belong to each hit, by its ``strategy`` and ``radius``.

    ``hits (hit, section, ordinal, strategy, radius)``, ``chunks (section, ordinal, …)``:
    ``search_only`` has none, ``chunk_window`` those within the radius, ``full_section`` all of the
    section.  One join for all hits.
    """
    around = chunks.withColumnRenamed("ordinal", "chunk_ordinal")
    near = F.abs(F.col("chunk_ordinal") - F.col("ordinal")) <= F.col("radius")
    wanted = (F.col("strategy") == "full_section") | ((F.col("strategy") == "chunk_window") & near)
    return hits.filter("strategy <> 'search_only'").join(around, "section").filter(wanted)


def strategy_of(mode: Column, characters: Column, most: int = 16_000) -> Column:
    """How much of its section a hit brings."""
    return (
        F.when(mode == "index_only", "search_only")
        .when(characters > most, "chunk_window")
        .otherwise("full_section")
    )


def pack_evidence(evidence: DataFrame, most: int) -> DataFrame:
    """What fits ``most`` characters per request, in score order; each item has smaller forms.

    ``evidence (request, id, score, sizes)``: ``sizes`` are the characters of the item's forms from
    the fullest to the barest.  Going down the scores, an item takes the first form that fits what
    is left; one that doesn't fit is skipped and never cut.  The running remainder depends on all
    choices before, so a request's items (a few reranked hits) are folded within one row.
    Columns: ``request``, ``id``, ``form`` (from 1), ``size``, ``place``.
    """
    items = F.array_sort(
        F.collect_list(F.struct((-F.col("score")).alias("least"), "id", "sizes"))
    )
    state = F.struct(
        F.lit(most).cast("long").alias("left"),
        F.array().cast("array<struct<id:bigint,form:int,size:bigint>>").alias("taken"),
    )

    def step(acc: Column, item: Column) -> Column:
        sizes = item["sizes"].cast("array<bigint>")
        fits = F.filter(sizes, lambda s: s <= acc["left"])
        # the sizes fall, so the first that fits is the largest that does
        size = F.try_element_at(fits, F.lit(1))
        form = F.array_position(sizes, size).cast("int")
        row = F.struct(item["id"].alias("id"), form.alias("form"), size.alias("size"))
        return F.when(size.isNull(), acc).otherwise(
            F.struct(
                (acc["left"] - size).alias("left"),
                F.concat(acc["taken"], F.array(row)).alias("taken"),
            )
        )

    folded = evidence.groupBy("request").agg(items.alias("items"))
    taken = folded.select("request", F.aggregate("items", state, step)["taken"].alias("taken"))
    return taken.select("request", F.posexplode("taken").alias("place", "item")).select(
        "request", "item.id", "item.form", "item.size", (F.col("place") + 1).cast("long").alias("place")
    )


def merge_rounds(found: DataFrame) -> DataFrame:
    """Evidence over the rounds of a run: ``found (request, round, id, fusion, rerank, query)``.

    Per chunk the best of both scores, its queries in order of first use, and a running number
    ``ref`` by first find.
    """
    uses = found.groupBy("request", "id", "query").agg(F.min("round").alias("first_use"))
    queries = uses.groupBy("request", "id").agg(
        F.array_sort(F.collect_list(F.struct("first_use", "query"))).alias("q")
    )
    best = found.groupBy("request", "id").agg(
        F.max("fusion").alias("fusion"),
        F.max("rerank").alias("rerank"),
        F.min("round").alias("found_in"),
        F.max("round").alias("last_round"),
    )
    out = best.join(queries.select("request", "id", F.col("q.query").alias("queries")), ["request", "id"])
    number = F.row_number().over(W.partitionBy("request").orderBy("found_in", "id"))
    return out.withColumn("ref", F.concat(F.lit("E"), number))


def release_scope(points: DataFrame, current: DataFrame) -> DataFrame:
    """Points of the current release of their collection: ``points`` has ``collection_id`` and the
    array ``release_ids``, ``current`` one release per collection."""
    return points.join(current.select("collection_id", "release_id"), "collection_id").filter(
        F.array_contains("release_ids", F.col("release_id"))
    )
