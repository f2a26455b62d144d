"""Per-period averages and the long table ``(series, t, x)`` that all statistics read.

A period column may be any orderable int; :func:`month_index` and :func:`day_index` derive one from a
timestamp. After :func:`period_mean` a series has one row per period, so what later operators hold of one
series is bounded by the calendar and not by the number of input rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def month_index(ts: Column | str) -> Column:
    """Months since year 0 as int, so that neighbouring months differ by one."""
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def day_index(ts: Column | str) -> Column:
    """Days since 1970-01-01 as int."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_date(ts.cast("date"))


def finite(df: DataFrame, value: str = "x") -> DataFrame:
    """Rows whose value is a number: neither NULL nor NaN nor infinite."""
    return df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))


def period_mean(df: DataFrame, period: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Average and non-NULL count of every feature per period: one scan, one shuffle for all of them."""
    aggs = [e for f in features for e in (F.avg(f).alias(f"avg_{f}"), F.count(f).alias(f"num_{f}"))]
    return df.groupBy(*by, period).agg(*aggs, F.count("*").alias("num_rows"))


def feature_by_period(df: DataFrame, period: str, feature: str) -> DataFrame:
    """One feature: ``(period, avg_<feature>, num_songs)`` with the count of non-NULL values."""
    return df.groupBy(period).agg(F.avg(feature).alias(f"avg_{feature}"), F.count(feature).alias("num_songs"))


def to_long(wide: DataFrame, period: str, features: Sequence[str], prefix: str = "avg_", by: str | None = None) -> DataFrame:
    """``(series, t, x)`` from the columns ``<prefix><feature>``; ``by`` adds its value in front of the name."""
    values = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("series"), F.col(f"{prefix}{f}").cast("double").alias("x"))
                for f in features
            ]
        )
    )
    keys = [F.col(period).alias("t")] + ([F.col(by).cast("string").alias("_by")] if by else [])
    long = wide.select(*keys, values.alias("v"))
    name = F.concat_ws(":", "_by", "v.series") if by else F.col("v.series")
    return long.select(name.alias("series"), "t", F.col("v.x").alias("x"))


def category_stats(df: DataFrame, category: str, feature: str) -> DataFrame:
    """Mean and sample deviation of a feature per category."""
    return df.groupBy(category).agg(
        F.avg(feature).alias(f"avg_{feature}"), F.stddev_samp(feature).alias(f"{feature}_std")
    )


def min_max(long: DataFrame, value: str = "x", out: str = "x_norm") -> DataFrame:
    """``(x-min)/(max-min)`` within each series; NULL where the series is flat."""
    w = W.partitionBy("series")
    low, high = F.min(value).over(w), F.max(value).over(w)
    return long.withColumn(out, F.try_divide(F.col(value) - low, high - low))


def zscore(long: DataFrame, keys: Sequence[str] = ("series",), value: str = "x", out: str = "z") -> DataFrame:
    """Standard score with the population deviation; NULL where the series is flat."""
    w = W.partitionBy(*keys)
    return long.withColumn(
        out, F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w))
    )


def combine(long: DataFrame, parts: Sequence[str], name: str) -> DataFrame:
    """Several one-dimensional series → one multivariate ``(series, dim, t, x)``, on the periods all of them have."""
    picked = finite(long).filter(F.col("series").isin(list(parts)))
    counted = picked.withColumn("_n", F.count("*").over(W.partitionBy("t")))
    return counted.filter(F.col("_n") == len(set(parts))).select(
        F.lit(name).alias("series"), F.col("series").alias("dim"), "t", "x"
    )


def first_last(long: DataFrame) -> DataFrame:
    """First and last period of each series with their values."""
    return long.groupBy("series").agg(
        F.min("t").alias("t_first"),
        F.max("t").alias("t_last"),
        F.min_by("x", "t").alias("x_first"),
        F.max_by("x", "t").alias("x_last"),
    )


def boundaries(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Periods whose label differs from the previous period's: ``(series, t)``."""
    before = F.lag(label).over(W.partitionBy("series").orderBy("t"))
    marked = labelled.withColumn("_before", before)
    return marked.filter(F.col("_before").isNotNull() & (F.col("_before") != F.col(label))).select("series", "t")
