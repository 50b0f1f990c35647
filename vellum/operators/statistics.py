"""Intervals, tests and agreement, as aggregates; resampling without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.operators.resampling import RESAMPLES, interval, resampled_sums
from vellum.storage import saved, with_positions

#: The 0.975 quantile of the normal distribution.
Z95 = 1.959963984540054
#: Rows whose signs a task has at once.
SIGN_ROWS = 256


def wilson(share: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval of a share of ``n``; null for n = 0."""
    centre = share + Z95**2 / (2 * n)
    half = Z95 * F.sqrt(share * (1 - share) / n + Z95**2 / (4 * n * n))
    scale = 1 + Z95**2 / n
    low = F.greatest(F.lit(0.0), (centre - half) / scale)
    high = F.least(F.lit(1.0), (centre + half) / scale)
    return F.when(n > 0, low), F.when(n > 0, high)


def share_summary(df: DataFrame, by: list[str], flag: Column) -> DataFrame:
    """``n``, ``share`` and its Wilson interval per group; null flags don't count."""
    out = df.filter(flag.isNotNull()).groupBy(*by)
    out = out.agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("share"))
    low, high = wilson(F.col("share"), F.col("n"))
    return out.withColumns({"low": low, "high": high})


def ppi(df: DataFrame, judge: str, human: str) -> DataFrame:
    """Prediction-powered mean: the judge's mean over all rows, corrected on rows with a human grade.

    One row; all null with fewer than two rows of either kind.
    """
    gap = F.when(F.col(human).isNotNull(), F.col(judge) - F.col(human))
    s = df.filter(F.col(judge).isNotNull()).agg(
        F.count("*").alias("n_all"),
        F.count(gap).alias("n"),
        (F.avg(judge) - F.avg(gap)).alias("estimate"),
        (F.var_samp(judge) / F.count("*") + F.var_samp(gap) / F.count(gap)).alias("variance"),
    )
    half = Z95 * F.sqrt("variance")
    enough = (F.col("n") >= 2) & (F.col("n_all") >= 2)
    return s.select(
        "n",
        F.when(enough, F.col("estimate")).alias("estimate"),
        F.when(enough, F.col("estimate") - half).alias("low"),
        F.when(enough, F.col("estimate") + half).alias("high"),
    )


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """``n``, ``agreement``, ``kappa`` (Cohen), ``ac1`` (Gwet) of two raters' labels, one row.

    From the contingency table, which has a row per pair of labels.  Rows without either label
    don't count; with a single label in use all are 1.
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(
        F.col(a).alias("a"), F.col(b).alias("b")
    ).agg(F.count("*").alias("n"))
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).alias("nb")),
                F.struct(F.col("b").alias("label"), F.lit(0).alias("na"), F.col("n").alias("nb")),
            )
        ).alias("s"),
        F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("same"),
    )
    per = sides.groupBy("s.label").agg(
        F.sum("s.na").alias("na"), F.sum("s.nb").alias("nb"), (F.sum("same") / 2).alias("same")
    )
    both = (F.col("na") + F.col("nb")).cast("double")
    s = per.agg(
        F.sum("na").alias("n"),
        F.count("*").alias("labels"),
        F.sum("same").alias("same"),
        F.sum(F.col("na").cast("double") * F.col("nb")).alias("chance"),
        F.sum(both).alias("uses"),
        F.sum(both * both).alias("squares"),
    )
    n = F.col("n").cast("double")
    observed = F.col("same") / n
    kappa_chance = F.col("chance") / (n * n)
    # the mean of share * (1 - share), over labels less one, with shares of the two raters together
    ac1_chance = (F.col("uses") / (2 * n) - F.col("squares") / (4 * n * n)) / (F.col("labels") - 1)
    return s.select(
        "n",
        observed.alias("agreement"),
        F.when(kappa_chance == 1, 1.0).otherwise((observed - kappa_chance) / (1 - kappa_chance)).alias("kappa"),
        F.when(F.col("labels") < 2, 1.0).otherwise((observed - ac1_chance) / (1 - ac1_chance)).alias("ac1"),
    )


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the average rank of ``column`` over all rows; equal values share their mean rank.

    Only the counts of distinct values are ordered; they are range-partitioned first, so that the
    running sum goes within ranges and over the sums of the ranges.
    """
    counts = df.groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    cut = counts.repartitionByRange("_value").withColumn("_slice", F.spark_partition_id())
    cut = saved(cut, "values")
    ahead = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    bases = cut.groupBy("_slice").agg(F.sum("_n").alias("_sum"))
    bases = bases.select("_slice", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    inside = W.partitionBy("_slice").orderBy("_value").rowsBetween(W.unboundedPreceding, 0)
    ranks = (
        cut.withColumn("_upto", F.sum("_n").over(inside))
        .join(bases, "_slice")
        .select("_value", (F.col("_base") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    )
    return df.join(ranks, F.col(column) == F.col("_value")).drop("_value")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """``n``, ``rho`` of the rows that have both values; null if a side is constant."""
    rows = df.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_ranks(average_ranks(rows, a, "_ra"), b, "_rb")
    s = ranked.agg(
        F.count("*").alias("n"),
        F.covar_pop("_ra", "_rb").alias("both"),
        (F.stddev_pop("_ra") * F.stddev_pop("_rb")).alias("spread"),
        F.min("_ra").alias("la"), F.max("_ra").alias("ha"),
        F.min("_rb").alias("lb"), F.max("_rb").alias("hb"),
    )
    varied = (F.col("la") < F.col("ha")) & (F.col("lb") < F.col("hb"))
    return s.select("n", F.when(varied, F.try_divide("both", "spread")).alias("rho"))


def holm(tests: DataFrame, family: list[str], p: str = "p_value") -> DataFrame:
    """``tests`` with ``adjusted``: Holm's step-down p-values within each family of tests.

    A family is a table of tests, one row per configuration, not data; null and NaN stay null.
    """
    known = F.col(p).isNotNull() & ~F.isnan(p)
    order = W.partitionBy(*family, known).orderBy(F.col(p))
    left = F.count("*").over(W.partitionBy(*family, known)) - F.row_number().over(order) + 1
    step = F.least(F.lit(1.0), left * F.col(p))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    return tests.withColumn("_step", step).withColumn(
        "adjusted", F.when(known, F.max("_step").over(upto))
    ).drop("_step")


def interpolated(df: DataFrame, by: list[str], column: str, points: tuple[float, ...]) -> DataFrame:
    """Percentiles with linear interpolation, one column ``p<100 point>`` each, and ``n``.

    Values are numbered by ranges (see ``with_positions``), and only those beside each point are
    summed up, so that no task keeps the values of a group.  Groups without values are left out.
    """
    values = df.select(*by, F.col(column).cast("double").alias("_value")).filter("_value is not null")
    placed = with_positions(values, [F.col("_value")], tuple(by))
    at = F.col("position") - 1
    sides = []
    for k, q in enumerate(points):
        place = (F.col("group_rows") - 1) * F.lit(float(q))
        low = F.floor(place)
        sides += [
            F.max(F.when(at == low, F.col("_value"))).alias(f"_low{k}"),
            F.max(F.when(at == F.ceil(place), F.col("_value"))).alias(f"_high{k}"),
            F.max(place - low).alias(f"_part{k}"),
        ]
    out = placed.groupBy(*by).agg(F.count("*").alias("n"), *sides)
    names = {f"p{round(100 * q)}": (1 - F.col(f"_part{k}")) * F.col(f"_low{k}") + F.col(f"_part{k}") * F.col(f"_high{k}") for k, q in enumerate(points)}
    return out.select(*by, "n", *[c.alias(n) for n, c in names.items()])


# -- resampling -----------------------------------------------------------------------------------
def _signs(ids: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """A sign per row and resample that follows from the row's id and the seed alone."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        x = x + np.uint64(seed) + np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
    return 1.0 - 2.0 * (x & np.uint64(1))


def sign_flips(df: DataFrame, by: list[str], row_id: str, value: str, resamples: int, seed: int) -> DataFrame:
    """``by``, ``resample``, ``total``: sums of ``value`` with random signs.

    Each task sums its own rows, SIGN_ROWS at a time; the shuffle has a row per task, group and resample, however
    many rows a group has.
    """
    schema = ", ".join(f"{c} {t}" for c, t in df.select(*by).dtypes)
    ddl = (schema + ", " if schema else "") + "resample int, total double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in (b.slice(at, SIGN_ROWS) for b in batches for at in range(0, b.num_rows, SIGN_ROWS)):
            table = batch.to_pandas()
            groups = table.groupby(by, sort=False, dropna=False) if by else [((), table)]
            for key, rows in groups:
                part = rows["_value"].to_numpy(float) @ _signs(rows["_row"].to_numpy(), resamples, seed)
                key = tuple(None if x != x else x for x in (key if isinstance(key, tuple) else (key,)))
                sums[key] = sums[key] + part if key in sums else part
        for key, total in sums.items():
            columns = {c: [k] * resamples for c, k in zip(by, key, strict=True)}
            yield pa.RecordBatch.from_pydict(columns | {"resample": np.arange(resamples, dtype=np.int32), "total": total})

    slim = df.select(*by, F.xxhash64(row_id).alias("_row"), F.col(value).cast("double").alias("_value"))
    parts = slim.filter(F.col("_value").isNotNull() & ~F.isnan("_value")).mapInArrow(run, ddl)
    return parts.groupBy(*by, "resample").agg(F.sum("total").alias("total"))


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Rows of one group next to each other, null groups included."""
    if not by:
        return left.crossJoin(right)  # one row each, or one on the right
    renamed = right.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    return left.join(renamed, same).drop(*[f"_by_{c}" for c in by])


def bootstrap_mean(
    df: DataFrame, by: list[str], row_id: str, value: str, resamples: int = RESAMPLES, seed: int = 0
) -> DataFrame:
    """``n``, ``mean`` and its 95 % percentile bootstrap interval per group; nulls and NaN don't count."""
    draws = resampled_sums(df, by, row_id, [value], resamples, seed)
    cut = interval(draws, by, F.col(value) / F.col("draws"))
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    own = known.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return _beside(own, cut, by).select(*by, "n", "mean", "low", "high")


def paired_bootstrap(
    df: DataFrame, by: list[str], row_id: str, baseline: str, candidate: str, resamples: int = RESAMPLES, seed: int = 0
) -> DataFrame:
    """``n``, ``mean`` of candidate less baseline and its 95 % percentile interval over resampled rows."""
    return bootstrap_mean(df.withColumn("_difference", F.col(candidate) - F.col(baseline)), by, row_id, "_difference", resamples, seed)


def bootstrap_statistic(
    df: DataFrame, by: list[str], row_id: str, values: list[str], statistic: Column, resamples: int = RESAMPLES, seed: int = 0
) -> DataFrame:
    """``low``, ``high``: interval of any statistic of sums, at places rounded down.

    ``statistic`` is of the columns ``draws`` and ``values`` (sums over a resample); where it is null or NaN the
    resample is left out.
    """
    return interval(resampled_sums(df, by, row_id, values, resamples, seed), by, statistic, floor=True)


def paired_test(
    df: DataFrame, by: list[str], row_id: str, difference: str, resamples: int = RESAMPLES, seed: int = 0
) -> DataFrame:
    """Mean paired difference per group, its bootstrap interval and a two-sided sign-flip p-value."""
    summary = bootstrap_mean(df, by, row_id, difference, resamples, seed)
    flips = sign_flips(df, by, row_id, difference, resamples, seed + 1)
    joined = _beside(flips, summary, by)
    extreme = F.count_if(F.abs(F.col("total")) / F.col("n") >= F.abs("mean") - 1e-12)
    keys = [*by, "n", "mean", "low", "high"]
    return joined.groupBy(*keys).agg(((extreme + 1) / (F.count("*") + 1)).alias("p_value"))


def metric_summaries(
    wide: DataFrame, by: list[str], row_id: str, shares: list[str], means: list[str]
) -> DataFrame:
    """A row per group and metric: Wilson intervals for 0/1 metrics, bootstrap for the others."""
    parts = [
        share_summary(wide, by, F.col(m)).select(*by, F.lit(m).alias("metric"), "n", F.col("share").alias("mean"), "low", "high")
        for m in shares
    ]
    parts += [
        bootstrap_mean(wide, by, row_id, m).select(*by, F.lit(m).alias("metric"), "n", "mean", "low", "high")
        for m in means
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
