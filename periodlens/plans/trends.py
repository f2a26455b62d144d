"""Trend tables: test, slope, change over the window and false-discovery control per series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.operators import trend
from periodlens.sources.tables import settle


def table(long: DataFrame, alpha: float = trend.ALPHA, decade: float = 10.0, family: tuple[str, ...] = ()) -> DataFrame:
    """One row per series, sorted by adjusted p. Eager up to the tests, which are written out once.

    ``decade`` is the number of period units of the ``change_per_decade`` column. The percent change
    relates to the first value and is NULL where that is not positive.
    """
    total = F.col("slope") * (F.col("t_last") - F.col("t_first"))
    rows = trend.all_tests(long, alpha).select(
        "series",
        "n",
        "tau",
        "s",
        "z",
        "p_raw",
        F.col("slope").alias("sen_slope"),
        "ci_lo",
        "ci_hi",
        (F.col("slope") * decade).alias("change_per_decade"),
        total.alias("total_change"),
        F.when(F.col("x_first") > 0, F.try_divide(total, F.col("x_first")) * 100.0).alias("pct_change_vs_first"),
        trend.direction().alias("direction"),
    )
    return trend.bh(settle(rows, "tests"), "p_raw", family, alpha).orderBy("p_bh", "series")


def share_table(long: DataFrame, alpha: float = trend.ALPHA) -> DataFrame:
    """Trend of each label's share with its first and last value, sorted by tau. Eager up to the tests."""
    rows = trend.all_tests(long, alpha).select(
        F.col("series").alias("label"),
        "tau",
        "z",
        "p_raw",
        F.col("x_first").alias("share_first"),
        F.col("x_last").alias("share_last"),
        trend.direction().alias("direction"),
    )
    return trend.bh(settle(rows, "tests"), "p_raw", (), alpha).orderBy("tau", "label")
