"""Change points in many series at once. Input: ``(series, t, x)``, or ``(series, dim, t, x)`` for several dimensions.

A series is held as one row of prefix-sum arrays, so the cost of any segment is a subtraction. The search over
segmentations is the exact dynamic programme, run by an Arrow-batched helper on that row: no pair of periods
becomes a row, nothing is shuffled between rounds, and no lineage builds up. Breaks that no later end can want are given
up on the way, so a series of one dimension takes little more than linear time (100,000 points and five breaks: 5 s), and
memory per series is linear in its periods. Several dimensions take up to the square of the periods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from periodlens.functions import stats
from periodlens.operators.series import finite

MAX_BREAKS = 5
REPORT_CAP = 8


def _with_dim(long: DataFrame) -> DataFrame:
    return long if "dim" in long.columns else long.withColumn("dim", F.lit(""))


def prefix_sums(long: DataFrame, centred: bool = False) -> DataFrame:
    """``(series, dim, t, x, pos, p1, p2)``: running sums of x and x² up to and including the 1-based position.

    ``centred`` takes the mean of the series from every value before summing. Squared errors stay the same, and a
    large common level does not eat up the digits.
    """
    w = W.partitionBy("series", "dim").orderBy("t")
    running = w.rowsBetween(W.unboundedPreceding, 0)
    level = F.avg("x").over(W.partitionBy("series", "dim")) if centred else F.lit(0.0)
    return finite(_with_dim(long)).withColumn("_v", F.col("x") - level).select(
        "series",
        "dim",
        "t",
        "x",
        F.row_number().over(w).alias("pos"),
        F.sum("_v").over(running).alias("p1"),
        F.sum(F.col("_v") * F.col("_v")).over(running).alias("p2"),
    )


def segment_cost(long: DataFrame, breaks: DataFrame) -> DataFrame:
    """Squared error about the mean of every segment that starts at the series' begin or at a break.

    ``breaks`` is ``(series, t)`` with t the first period of a new segment. Output: ``series, t_from, t_to,
    points, cost``, the cost summed over dimensions. A segment's sums are the difference of the prefix sums
    at its two ends, so the series is read once.
    """
    starts = breaks.select("series", "t", F.lit(True).alias("_start")).distinct()
    marked = finite(_with_dim(long)).join(starts, ["series", "t"], "left")
    w = W.partitionBy("series", "dim").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    numbered = marked.withColumn("segment", F.sum(F.coalesce(F.col("_start"), F.lit(False)).cast("int")).over(w))
    ends = numbered.join(prefix_sums(long, centred=True).select("series", "dim", "t", "pos", "p1", "p2"), ["series", "dim", "t"])
    last = F.max(F.struct("pos", "p1", "p2"))
    per_segment = ends.groupBy("series", "dim", "segment").agg(
        F.min("t").alias("t_from"), F.max("t").alias("t_to"), F.count("*").alias("points"), last.alias("e")
    )
    prev = F.lag("e").over(W.partitionBy("series", "dim").orderBy("t_from"))
    per_segment = per_segment.withColumn("b", prev)
    s1 = F.col("e.p1") - F.coalesce(F.col("b.p1"), F.lit(0.0))
    s2 = F.col("e.p2") - F.coalesce(F.col("b.p2"), F.lit(0.0))
    costs = per_segment.withColumn("c", F.greatest(s2 - s1 * s1 / F.col("points"), F.lit(0.0)))
    return costs.groupBy("series", "t_from", "t_to", "points").agg(F.sum("c").alias("cost"))


def _arrays(long: DataFrame) -> DataFrame:
    """One row per series: ``n``, ``d``, sorted ``ts`` and, per dimension, prefix sums with a leading zero."""
    per_dim = prefix_sums(long, centred=True).groupBy("series", "dim").agg(
        F.array_sort(F.collect_list(F.struct("pos", "t", "p1", "p2"))).alias("pts")
    )
    zero = F.array(F.lit(0.0))
    sums = F.struct("dim", F.concat(zero, "pts.p1").alias("p1"), F.concat(zero, "pts.p2").alias("p2"))
    return (
        per_dim.select("series", "dim", F.col("pts.t").alias("ts"), sums.alias("sums"))
        .groupBy("series")
        .agg(F.array_sort(F.collect_list("sums")).alias("dims"), F.first("ts").alias("ts"))
        .withColumn("n", F.size("ts"))
        .withColumn("d", F.size("dims"))
    )


def partition(long: DataFrame, max_breaks: int = MAX_BREAKS) -> DataFrame:
    """Best segmentation with exactly m breaks for m = 0..``max_breaks`` (at most n-1).

    Output: ``series, n, d, m, sse, breaks`` with the first period of every new segment. All dimensions of a
    series must cover the same periods (see ``series.combine``).
    """
    solve = stats.partition_udf(max_breaks)
    solved = _arrays(long).select("series", "n", "d", "ts", solve("dims.p1", "dims.p2").alias("best"))
    per_m = solved.select("series", "n", "d", "ts", F.posexplode(F.arrays_zip("best.sse", "best.breaks")).alias("m", "v"))
    return per_m.select(
        "series",
        "n",
        "d",
        "m",
        F.col("v.sse").alias("sse"),
        F.transform("v.breaks", lambda s: F.get("ts", s)).alias("breaks"),
    )


def select(partitions: DataFrame) -> DataFrame:
    """Pick m by the information criterion that also counts break positions; the smaller m on ties.

    Output: ``series, n, d, m, sse, bic, breaks``.
    """
    nd = F.col("n").cast("double") * F.col("d")
    k = (F.col("m") + 1) * F.col("d") + F.col("m") + 1
    bic = nd * F.log(F.greatest(F.col("sse"), F.lit(1e-12)) / nd) + k * F.log(nd)
    best = F.min(F.struct(bic.alias("bic"), "m", "n", "d", "sse", "breaks")).alias("r")
    return partitions.groupBy("series").agg(best).select("series", "r.n", "r.d", "r.m", "r.sse", "r.bic", "r.breaks")


def detect(long: DataFrame, max_breaks: int = MAX_BREAKS) -> DataFrame:
    """Number and periods of the breaks of every series."""
    return select(partition(long, max_breaks))


def pettitt(long: DataFrame) -> DataFrame:
    """``series, n, k, break_t, p``: the period before which the ranks shift most, the first on ties.

    The statistic is a running sum of mid-ranks, so it takes one sort per series instead of all pairs.
    """
    by_value, by_time = W.partitionBy("series").orderBy("x"), W.partitionBy("series").orderBy("t")
    points = finite(long).select(
        "series",
        "t",
        F.count("*").over(W.partitionBy("series")).alias("n"),
        # Twice the mid-rank, which is a whole number.
        (2 * F.rank().over(by_value) + F.count("*").over(W.partitionBy("series", "x")) - 1).alias("rank2"),
    )
    u = F.sum(F.col("rank2") - F.col("n") - 1).over(by_time.rowsBetween(W.unboundedPreceding, 0))
    walked = points.select("series", "n", u.alias("u"), F.row_number().over(by_time).alias("pos"),
                           F.lead("t").over(by_time).alias("next_t"))
    best = F.min(F.struct((-F.abs("u")).alias("u"), "pos", "next_t")).alias("b")
    top = walked.filter("pos < n").groupBy("series", "n").agg(best)
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    return top.select("series", "n", (-F.col("b.u")).cast("bigint").alias("k"), F.col("b.next_t").alias("break_t")).withColumn(
        "p", F.least(F.lit(1.0), 2.0 * F.exp(-6.0 * k * k / (n * n * n + n * n)))
    )


def agreement(a: DataFrame, b: DataFrame, tol: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct periods of ``a`` within ``tol`` of a period of ``b``: equality join on widened periods, no range join."""
    near = b.select(*keys, F.explode(F.sequence(F.col("t") - tol, F.col("t") + tol)).alias("t")).distinct()
    return a.select(*keys, "t").distinct().join(near, [*keys, "t"], "left_semi")
