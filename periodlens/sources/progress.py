"""Which periods of a long job are finished."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_PENDING = 100_000


def finished(spark: SparkSession, manifest: str, period: str, type_: str = "int") -> DataFrame:
    """Periods recorded as finished; empty before the first run."""
    try:
        return spark.read.parquet(manifest).select(period).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"`{period}` {type_}")


def pending(df: DataFrame, manifest: str, period: str) -> list:
    """``(period, rows)`` of what is not recorded yet, in order: one pair per calendar period. NULL is a period too.

    More than ``MOST_PENDING`` are an error: they are planned on the driver and sent to all tasks.
    """
    counts = df.groupBy(period).agg(F.count("*").alias("_rows"))
    done = finished(df.sparkSession, manifest, period, df.schema[period].dataType.simpleString()).withColumnRenamed(period, "_done")
    left = counts.join(done, F.col(period).eqNullSafe(F.col("_done")), "left_anti")
    rows = left.orderBy(F.col(period).asc_nulls_first()).limit(MOST_PENDING + 1).collect()
    if len(rows) > MOST_PENDING:
        raise ValueError(f"more than {MOST_PENDING} values of {period} are pending; take a coarser period")
    return [(r[0], r[1]) for r in rows]


def record(spark: SparkSession, manifest: str, period: str, type_: str, values: Sequence) -> None:
    spark.createDataFrame([(v,) for v in values], f"`{period}` {type_}").coalesce(1).write.mode("append").parquet(manifest)
