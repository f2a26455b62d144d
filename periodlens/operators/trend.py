"""Monotonic trend tests on many series at once. Input: the long table ``(series, t, x)``, t distinct per series.

One series has one row per period, so it is bounded by the calendar; the number of series is not bounded.
No pair of points is ever formed as a row:

* Mann-Kendall's S is the number of rising minus falling pairs. Two points with different ranks differ first
  at exactly one bit of the rank, and share all higher bits. So each point is looked at once per bit, among
  the points with the same higher bits, and a running count tells how many earlier points fell to the other
  side: n log n rows and one shuffle.
* Sen's slope needs order statistics of all pairwise slopes; an Arrow-batched helper selects them per series.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from periodlens.functions import stats
from periodlens.operators import series, skew

ALPHA = 0.05


def _clean(long: DataFrame) -> DataFrame:
    return series.finite(long).select("series", "t", F.col("x").cast("double").alias("x"))


def _ranked(long: DataFrame) -> DataFrame:
    """Size of the series, rank of the value and number of points with the same value."""
    all_points, by_value = W.partitionBy("series"), W.partitionBy("series").orderBy("x")
    return _clean(long).select(
        "series",
        "t",
        "x",
        F.count("*").over(all_points).alias("n"),
        F.rank().over(by_value).alias("rank"),
        F.count("*").over(W.partitionBy("series", "x")).alias("ties"),
    )


def _pair_signs(long: DataFrame) -> DataFrame:
    """Points repeated per bit of their rank, with rising minus falling pairs that end there."""
    points = _ranked(long)
    levels = F.sequence(F.lit(0), F.length(F.bin("n")) - 1)
    looked = points.select("*", F.explode(levels).alias("level"))
    looked = looked.withColumn("bit", F.expr("shiftright(rank, level) & 1")).withColumn(
        "prefix", F.expr("shiftright(rank, level + 1)")
    )
    before = W.partitionBy("series", "level", "prefix").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    ones = F.coalesce(F.sum("bit").over(before), F.lit(0))
    zeros = F.coalesce(F.sum(1 - F.col("bit")).over(before), F.lit(0))
    return looked.withColumn("signs", F.when(F.col("bit") == 1, zeros).otherwise(-ones))


def _tie_sums(counted=None) -> list:
    """Sums over groups of t equal values, taken point by point: t(t-1)(2t+5) and t(t-1)/2."""
    t, counted = F.col("ties"), F.lit(True) if counted is None else counted
    return [
        F.sum(F.when(counted, (t - 1) * (2 * t + 5)).otherwise(0)).alias("tie_var"),
        F.sum(F.when(counted, (t - 1) / 2.0).otherwise(0.0)).alias("tie_pairs"),
    ]


def _variance():
    n = F.col("n").cast("double")
    return (n * (n - 1) * (2 * n + 5) - F.col("tie_var")) / 18.0


def _statistics(sums: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")
    pairs = n * (n - 1) / 2
    return (
        sums.filter("n >= 3")
        .withColumn("var_s", _variance())
        .withColumn("z", F.coalesce(F.try_divide(F.col("s") - F.signum("s"), F.sqrt("var_s")), F.lit(0.0)))
        .withColumn("tau", F.try_divide(F.col("s").cast("double"), F.sqrt((pairs - F.col("tie_pairs")) * pairs)))
        .drop("tie_var", "tie_pairs")
    )


def mann_kendall(long: DataFrame) -> DataFrame:
    """``series, n, s, var_s, z, tau`` per series of at least three points; see :func:`with_p` for p.

    Variance with tie correction, Z with continuity correction, tau-b. A series whose values are all equal
    has no trend: S and Z are 0 and tau is NULL.
    """
    sums = _pair_signs(long).groupBy("series").agg(
        F.max("n").alias("n"), F.sum("signs").cast("bigint").alias("s"), *_tie_sums(F.col("level") == 0)
    )
    return _statistics(sums)


def with_p(tested: DataFrame, z: str = "z", out: str = "p_raw") -> DataFrame:
    """Two-sided normal p value of a Z column."""
    return tested.withColumn(out, stats.normal_two_sided(F.col(z)))


def _slope(points: str, variance, alpha: float):
    z = NormalDist().inv_cdf(1 - alpha / 2)
    return stats.sen_udf(z)(F.col(f"{points}.t").cast("array<double>"), F.col(f"{points}.x"), variance)


def sens_slope(long: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``series, n, slope, ci_lo, ci_hi``: median pairwise slope and its rank-based interval, in x per unit of t."""
    arrays = _ranked(long).groupBy("series").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("t", "x"))).alias("pts"), _tie_sums()[0]
    )
    sen = _slope("pts", _variance(), alpha)
    return arrays.filter("n >= 2").select("series", "n", sen.alias("sen")).select("series", "n", "sen.*")


def all_tests(long: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Both tests and the ends of every series in one pass: one shuffle, no join.

    ``series, n, s, var_s, z, tau, p_raw, slope, ci_lo, ci_hi, t_first, t_last, x_first, x_last``.
    """
    first = F.col("level") == 0
    sums = _pair_signs(long).groupBy("series").agg(
        F.max("n").alias("n"),
        F.sum("signs").cast("bigint").alias("s"),
        *_tie_sums(first),
        F.array_sort(F.collect_list(F.when(first, F.struct("t", "x")))).alias("pts"),
    )
    tested = with_p(_statistics(sums)).withColumn("sen", _slope("pts", F.col("var_s"), alpha))
    head, tail = F.get("pts", F.lit(0)), F.element_at("pts", -1)
    return tested.select(
        "series", "n", "s", "var_s", "z", "tau", "p_raw", "sen.*",
        head["t"].alias("t_first"), tail["t"].alias("t_last"), head["x"].alias("x_first"), tail["x"].alias("x_last"),
    )


# Distinct p values of a family that one task should rank at most.
VALUES_PER_RANGE = 50_000


def _bucket(p: str, fineness):
    """Value range of a p value: 256 equal ones, and below 1/256 eight per halving, as far down as doubles go.

    ``fineness`` cuts each of them into so many.
    """
    v = F.col(p)
    high = F.floor(v * 256 * fineness) + (1 << 40)
    low = F.floor(F.log2(v) * 8 * fineness) + (1 << 39)
    return F.when(v >= 1 / 256, high).when(v > 0, low).otherwise(0).cast("bigint")


def bh(df: DataFrame, p: str, family: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """Add ``p_bh`` and ``significant_fdr`` (Benjamini-Hochberg) within each family of tests.

    A family may hold most of the rows. Equal p values are counted first, the distinct ones are ranked inside
    their value range, and shifted by what lies in the ranges below; the running minimum from above is put
    together the same way. The more distinct values the largest family has, the more ranges there are, so no task
    sorts a whole family, and the result is exact. Rows with a NULL p stay, untested and beside the join.
    ``df`` is read more than once; settle it first if it is costly (see ``sources.tables.settle``).
    """
    fam = list(family)
    keyed = df.withColumn("_fam", F.struct(*fam) if fam else F.lit(0))
    tested, untested = keyed.filter(F.col(p).isNotNull()), keyed.filter(F.col(p).isNull())
    distinct = tested.groupBy("_fam", p).agg(F.count("*").alias("_c"))
    largest = distinct.groupBy("_fam").count().agg(F.max("count")).scalar()
    fineness = F.greatest(F.lit(1), F.ceil(largest / (128 * VALUES_PER_RANGE)))
    # The three windows below share one shuffle and one sort each way.
    part = W.partitionBy("_fam", "_b")
    local = distinct.withColumn("_b", _bucket(p, fineness)).select(
        "*", F.sum("_c").over(part.orderBy(p).rowsBetween(W.unboundedPreceding, 0)).alias("_up")
    )
    below = W.partitionBy("_fam").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = local.groupBy("_fam", "_b").agg(F.sum("_c").alias("_cb")).select(
        "_fam",
        "_b",
        F.coalesce(F.sum("_cb").over(below), F.lit(0)).alias("_off"),
        F.sum("_cb").over(W.partitionBy("_fam")).alias("_m"),
    )
    raw = local.join(offsets, ["_fam", "_b"]).withColumn(
        "_raw", F.col(p) * F.col("_m") / (F.col("_off") + F.col("_up"))
    )
    above = W.partitionBy("_fam").orderBy("_b").rowsBetween(1, W.unboundedFollowing)
    floors = raw.groupBy("_fam", "_b").agg(F.min("_raw").alias("_min")).select(
        "_fam", "_b", F.min("_min").over(above).alias("_floor")
    )
    low = F.min("_raw").over(part.orderBy(p).rowsBetween(0, W.unboundedFollowing))
    adjusted = raw.withColumn("_low", low).join(floors, ["_fam", "_b"]).select(
        "_fam", p, "_c", F.least("_low", "_floor", F.lit(1.0)).alias("p_bh")
    )
    hot = skew.hot_keys(distinct, ["_fam", p], "_c")
    spread = [c for c in df.columns if c not in (p, *fam)] or [p]
    joined = skew.join_unique(tested, adjusted, ["_fam", p], hot, spread, "_c", how="left")
    joined = joined.unionByName(untested.withColumn("p_bh", F.lit(None).cast("double")))
    return joined.select(*df.columns, "p_bh", (F.col("p_bh") <= alpha).alias("significant_fdr"))


def direction(tau: str = "tau"):
    tau = F.col(tau)
    return F.when(tau > 0, "increasing").when(tau < 0, "decreasing").otherwise("none")
