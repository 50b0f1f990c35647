"""A kept approximate vector index: coarse cells, product-quantised residuals, exact scores at the end.

Cells are those of k-means on a bounded sample of unit vectors.  Of each vector the index has its cell, a code
of one byte for each few coordinates of what is left after the cell's centre, and the vector itself.  A search
reads the codes of the cells that are nearest to its queries, keeps candidates by the score of the codes, and
scores only those by their vectors.  Rows lie in folders by cell and in the order of cells within, so cells that
no query probes are not read; the vectors are a column that the code scan leaves alone.

An index is a folder of segments (``operators.segments``), one per release, beside the ``model``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.arrays import cosine
from vellum.operators.search import Best, ranked, unit_rows
from vellum.operators.segments import earlier, gone_rows, lay_out, live, read_part, segments, unique_rows
from vellum.storage import saved

#: Vectors that the model is fitted on at most, and rounds of k-means.
SAMPLE, ROUNDS = 50_000, 12
#: Coordinates of one code byte (with 4 of them the ten nearest of 50,000 vectors fell out of the hundred best by code), values of a code, folders of cells, vectors of a sample for each cell at least.
WIDTH, CODES, FOLDERS, A_CELL = 2, 256, 64, 24
#: The share of the nearest that probed cells have to hold, and vectors by whose nearest it is counted.
RECALL, NEAREST, TRIED = 0.98, 10, 256
#: Queries of one scan of the codes, rows that a task scores at once, ids that go to every task.
QUERY_BLOCK, SLICE, SMALL_IDS = 512, 1024, 1_000_000


class Model(NamedTuple):
    """Centres of the cells; of each block of coordinates the values of its codes; cells that a query needs."""

    cells: np.ndarray
    books: np.ndarray
    probes: int = 1

    @property
    def width(self) -> int:
        return self.cells.shape[1]

    def residual_blocks(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """What is left of vectors after their cells' centres, in blocks (padded with zeros)."""
        rest = np.zeros((len(x), self.books.shape[0] * WIDTH), np.float32)
        rest[:, : x.shape[1]] = x - self.cells[cell]
        return rest.reshape(len(x), -1, WIDTH)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * (x @ centres.T), axis=1)


def _k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of ``k`` groups; a group that runs empty gets the vector that is furthest from its centre."""
    draw = np.random.default_rng(seed)
    centres = x[draw.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([_nearest(x[at : at + 4096], centres) for at in range(0, len(x), 4096)])
        size = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
        empty = np.flatnonzero(size == 0)
        if len(empty):
            far = np.argsort(-((x - centres[own]) ** 2).sum(1), kind="stable")[: len(empty)]
            centres[empty[: len(far)]] = x[far]
    return centres


def usable(vectors: DataFrame) -> DataFrame:
    """``id``, ``embedding`` (doubles) of vectors that can be compared: all finite, not zero."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter("id is not null").select(F.col("id").cast("long").alias("id"), v.cast("array<double>").alias("embedding"))
    return rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))


def needed_probes(x: np.ndarray, own: np.ndarray, centres: np.ndarray, recall: float, k: int = NEAREST) -> int:
    """How many cells, the nearest first, have a share of ``recall`` of the ``k`` nearest of a vector.

    Counted for the first TRIED vectors among all of ``x``, each without itself.
    """
    asked = x[:TRIED]
    near = asked @ x.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort((centres**2).sum(1)[None, :] - 2 * (asked @ centres.T), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL, seed: int = 42) -> Model:
    """A model for ``vectors (id, embedding)`` of the most common width.

    Fitted on the driver from ``sample`` vectors at most, those of the least hashes of their ids.  ``cells`` is by
    default the root of the number of vectors, and never more than the sample has A_CELL vectors for.  How many
    cells a query probes follows from ``recall`` of the nearest vectors of the sample: few where vectors stand in
    groups, most of them where they are spread evenly in many dimensions.
    """
    rows = usable(vectors)
    widths = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        raise ValueError("no vectors to fit cells on")
    width, n = widths["w"], widths["count"]
    drawn = rows.filter(F.size("embedding") == width).orderBy(F.xxhash64("id"), "id").limit(sample)
    x = np.array([r["embedding"] for r in drawn.select("embedding").collect()], np.float64)
    x = (x / np.sqrt((x**2).sum(1))[:, None]).astype(np.float32)
    most = max(1, len(x) // A_CELL)
    centres = _k_means(x, min(cells or max(1, round(math.sqrt(n))), most), ROUNDS, seed)
    blocks = -(-width // WIDTH)
    empty = Model(centres, np.zeros((blocks, 1, WIDTH), np.float32))
    own = np.concatenate([_nearest(x[at : at + 4096], centres) for at in range(0, len(x), 4096)])
    rest = empty.residual_blocks(x, own)
    books = [_k_means(rest[:, b], min(CODES, len(x)), ROUNDS, seed + b + 1) for b in range(blocks)]
    return Model(centres, np.stack(books), needed_probes(x, own, centres, recall))


def create(spark: SparkSession, path: str, model: Model) -> None:
    """Starts an index: writes the model, a row per centre and code value."""
    rows = [("cell", 0, k, [float(v) for v in c]) for k, c in enumerate(model.cells)]
    rows += [("code", b, k, [float(v) for v in c]) for b, book in enumerate(model.books) for k, c in enumerate(book)]
    rows.append(("probes", 0, model.probes, []))
    table = spark.createDataFrame(rows, "kind string, block int, number int, value array<float>")
    table.coalesce(1).write.mode("errorifexists").parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "block", "number").collect()
    cells = np.array([r["value"] for r in rows if r["kind"] == "cell"], np.float32)
    codes = [r for r in rows if r["kind"] == "code"]
    blocks = 1 + max(r["block"] for r in codes)
    probes = next(r["number"] for r in rows if r["kind"] == "probes")
    return Model(cells, np.array([r["value"] for r in codes], np.float32).reshape(blocks, -1, WIDTH), probes)


def encoded(vectors: DataFrame, model: Model) -> DataFrame:
    """``id``, ``cell``, ``code``, ``embedding`` of usable vectors of the model's width."""
    held = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            x, good = unit_rows(batch.column(1), m.width)
            if not len(x):
                continue
            cell = _nearest(x.astype(np.float32), m.cells)
            rest = m.residual_blocks(x.astype(np.float32), cell)
            code = np.stack([_nearest(rest[:, b], book) for b, book in enumerate(m.books)], axis=1).astype(np.uint8)
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), kept.column(1)],
                ["id", "cell", "code", "embedding"],
            )

    return usable(vectors).mapInArrow(run, "id long, cell int, code binary, embedding array<double>")


def add_release(spark: SparkSession, path: str, release: int, vectors: DataFrame, deleted: DataFrame | None = None) -> None:
    """Writes the segment of ``release``: ``vectors (id, embedding)`` are new or replace earlier ones,
    ``deleted (id)`` go.  Releases come in growing order.

    Only ids of earlier segments are read.  Vectors that can't be compared, or of another width than the model's,
    are left out, and so are rows without an id; an earlier vector of theirs goes.  Of several rows with one id
    the greatest vector counts.
    """
    before, here = earlier(spark, path, release), f"{path}/segment={release}"
    given = unique_rows(vectors.select("id", "embedding"), "embedding")
    rows = encoded(given, load(spark, path)).withColumn("folder", F.pmod("cell", F.lit(FOLDERS)))
    lay_out(rows, ["cell"], f"{here}/rows", "folder")
    gone = spark.createDataFrame([], "id long")
    if before:
        changed = given.select("id")
        changed = changed if deleted is None else changed.union(deleted.select(F.col("id").cast("long"))).distinct()
        held = read_part(spark, path, "rows", before).select("id", "segment").join(changed, "id", "left_semi")
        gone = live(held, gone_rows(spark, path, before)).select("id")
    lay_out(gone, ["id"], f"{here}/gone")
    spark.read.parquet(f"{here}/rows").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{here}/totals")


def search_vectors(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int,
    probes: int | None = None,
    candidates: int | None = None,
    upto: int | None = None,
    digits: int = 6,
) -> DataFrame:
    """``query_id``, ``id``, ``score``, ``rank``: near to the ``k`` nearest vectors of the index by cosine.

    ``queries (query_id, embedding)``.  The ``probes`` nearest cells of each query are read (by default as many
    as the model found to need), as of release ``upto`` (the last by default); of their vectors the ``candidates`` best by code (ten for each of ``k`` by
    default) are scored exactly, in doubles, rounded to ``digits``; ties go to the smaller id.  With as many
    probes as cells and candidates as vectors this is the exact search.
    """
    numbers = segments(spark, path, upto)
    model, most = load(spark, path), candidates or 10 * k
    rows = read_part(spark, path, "rows", numbers) if numbers else None
    asked = usable(queries.withColumnRenamed("query_id", "id")).filter(F.size("embedding") == model.width)
    asked = saved(asked.withColumnsRenamed({"id": "query_id"}), "asked")
    blocks = -(-asked.count() // QUERY_BLOCK) if numbers else 0
    gone = gone_rows(spark, path, numbers)
    if gone is not None and gone.count() <= SMALL_IDS:
        gone = F.broadcast(gone)
    found = None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()  # about QUERY_BLOCK rows
        if own:
            part = _scan_codes(spark, own, rows, gone, model, probes or model.probes, most)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, id long, score double, rank long")
    best = ranked(found, "query_id", F.desc("near"), F.col("id"), k=most)
    best = saved(best.select("query_id", "id", "cell", "segment"), "candidates")
    cells = [r["cell"] for r in best.select("cell").distinct().collect()]
    small = F.broadcast(best) if best.count() <= SMALL_IDS else best
    whole = _in_cells(rows, cells).select("id", "cell", "segment", "embedding").join(small, ["id", "cell", "segment"])
    asking = asked.withColumnRenamed("embedding", "asked")
    scored = whole.join(asking, "query_id").select("query_id", "id", F.round(cosine(F.col("asked"), F.col("embedding")), digits).alias("score"))
    return ranked(scored, "query_id", F.desc("score"), F.col("id"), k=k)


def _in_cells(rows: DataFrame, cells: list[int]) -> DataFrame:
    """Rows of some cells: folders are left out at once, other cells by what the files say of theirs."""
    return rows.filter(F.col("folder").isin(sorted({c % FOLDERS for c in cells}))).filter(F.col("cell").isin(cells))


def _scan_codes(spark: SparkSession, asked: list, rows: DataFrame, gone: DataFrame | None, model: Model, probes: int, most: int) -> DataFrame:
    """The ``most`` best per query and task of the probed cells, by code."""
    names = np.array([r["query_id"] for r in asked], np.int64)
    q = np.array([r["embedding"] for r in asked], np.float64)
    q = (q / np.sqrt((q**2).sum(1))[:, None]).astype(np.float32)
    near = q @ model.cells.T
    distance = (model.cells**2).sum(1)[None, :] - 2 * near
    probed = np.argsort(distance, axis=1, kind="stable")[:, :probes]
    cells = np.unique(probed).tolist()
    padded = np.zeros((len(q), model.books.shape[0] * WIDTH), np.float32)
    padded[:, : q.shape[1]] = q
    # of each query, block and code value what it adds to the cosine
    table = np.einsum("qbw,bcw->bcq", padded.reshape(len(q), -1, WIDTH), model.books).astype(np.float32)
    asking = {c: np.flatnonzero((probed == c).any(axis=1)) for c in cells}
    held = spark.sparkContext.broadcast((names, near, table, asking))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, near, table, asking = held.value
        best, place = Best(len(names), most), []
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            cell = batch.column(1).to_numpy()
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(cell), -1)
            # the row's number stands for its id, so that cell and segment come along
            at = len(place) * SLICE + np.arange(len(cell))
            place.append((batch.column(0).to_numpy(), cell, batch.column(3).to_numpy()))
            for c in np.unique(cell):
                mine = np.flatnonzero(cell == c)
                who = asking[int(c)]
                score = np.repeat(near[who, c][:, None], len(mine), axis=1)
                for b in range(code.shape[1]):
                    score += table[b][code[mine, b]][:, who].T
                ask, row = np.nonzero(score >= best.bar[who][:, None])
                best.merge(who[ask], at[mine][row], score[ask, row].astype(np.float64))
        if place:
            ask, row, score = best.rows()
            ids = np.array([place[r // SLICE][0][r % SLICE] for r in row], np.int64)
            cells = np.array([place[r // SLICE][1][r % SLICE] for r in row], np.int32)
            segment = np.array([place[r // SLICE][2][r % SLICE] for r in row], np.int32)
            yield pa.RecordBatch.from_pydict({"query_id": names[ask], "id": ids, "cell": cells, "segment": segment, "near": score})

    codes = live(_in_cells(rows, cells).select("id", "cell", "code", "segment"), gone)
    return codes.mapInArrow(run, "query_id long, id long, cell int, segment int, near double")
