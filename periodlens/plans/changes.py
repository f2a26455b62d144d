"""Change reports: several detectors side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.functions.lists import join_periods
from periodlens.operators import changepoint, series
from periodlens.sources.tables import settle


def report(long: DataFrame, cap: int = changepoint.REPORT_CAP, alpha: float = 0.05) -> DataFrame:
    """Per series: penalised breaks, whether the search stayed below its cap, and the single ranked break.

    A series of one point has no break of either kind; its ranked columns are NULL.
    """
    found = changepoint.detect(long, cap).select(
        "series", F.col("n").alias("n_periods"), F.col("m").alias("n_change_points"), "breaks",
        (F.col("m") < cap).alias("reliable"),
    )
    ranked = changepoint.pettitt(long).select(
        "series", F.col("break_t").alias("pettitt_t"), F.col("k").alias("pettitt_k"), F.col("p").alias("pettitt_p"),
        (F.col("p") < alpha).alias("pettitt_significant"),
    )
    return found.join(ranked, "series", "left")


def standardised(long: DataFrame, parts: tuple[str, ...], name: str) -> DataFrame:
    """Several series as one multivariate series of standard scores, each weighing the same."""
    joint = series.combine(long, parts, name)
    return series.zscore(joint, ("series", "dim")).select("series", "dim", "t", F.col("z").alias("x"))


def mood(long: DataFrame, parts: tuple[str, ...], clusters: DataFrame, period: str, max_breaks: int = changepoint.MAX_BREAKS) -> DataFrame:
    """Joint breaks of several features, each feature's ranked break, the boundaries of a clustering, and agreement.

    Rows: ``method, target, n_change_points, break_periods, p_value``. The last row lists the joint breaks within one
    period of a boundary. The series are settled first: one row per period, read by every method.
    """
    target = "+".join(parts)
    long = settle(long.filter(F.col("series").isin(list(parts))), "series")
    found = settle(changepoint.detect(standardised(long, parts, target), max_breaks), "breaks")
    joint = found.select(
        F.lit("optimal_partition_bic").alias("method"), F.col("series").alias("target"),
        F.col("m").alias("n_change_points"), join_periods("breaks").alias("break_periods"),
        F.lit(None).cast("double").alias("p_value"),
    )
    single = changepoint.pettitt(long).select(
        F.lit("pettitt").alias("method"), F.col("series").alias("target"), F.lit(1).alias("n_change_points"),
        F.col("break_t").cast("string").alias("break_periods"), F.col("p").alias("p_value"),
    )
    labelled = clusters.select(F.lit(target).alias("series"), F.col(period).alias("t"), F.col("cluster").alias("label"))
    edges = settle(series.boundaries(labelled).select("t"), "boundaries")
    near = changepoint.agreement(found.select(F.explode("breaks").alias("t")), edges)

    def listed(periods: DataFrame, method: str) -> DataFrame:
        return periods.agg(F.array_sort(F.collect_list("t")).alias("ts")).select(
            F.lit(method).alias("method"), F.lit(target).alias("target"), F.size("ts").alias("n_change_points"),
            join_periods("ts").alias("break_periods"), F.lit(None).cast("double").alias("p_value"),
        )

    both = joint.unionByName(single).unionByName(listed(edges, "kmeans_cluster_boundaries"))
    return both.unionByName(listed(near, "breaks_near_boundaries"))
