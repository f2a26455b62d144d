"""How far two labellers agree on the same entities. Input: one row per entity with both labels.

A missing label is a label like any other: two missing ones agree, a missing and a given one do not. The counts of all
functions therefore add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame, a: str, b: str, tied: str | None = None) -> DataFrame:
    """One row: entities, agreements, disagreements, percent agreement and, if given, entities flagged as tied."""
    same = F.col(a).eqNullSafe(F.col(b))
    ties = [F.count_if(F.col(tied)).alias("ties")] if tied else []
    out = df.agg(
        F.count("*").alias("entities"),
        F.count_if(same).alias("agreements"),
        F.count_if(~same).alias("disagreements"),
        *ties,
    )
    return out.withColumn("agreement_pct", F.try_divide(F.col("agreements") * 100.0, F.col("entities").cast("double")))


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of differing labels with their count, most frequent first."""
    pairs = df.filter(~F.col(a).eqNullSafe(F.col(b))).groupBy(a, b).agg(F.count("*").alias("count"))
    return pairs.orderBy(F.desc("count"), a, b)


def involvement(df: DataFrame, a: str, b: str) -> DataFrame:
    """How often a label stands on either side of a disagreement."""
    either = df.filter(~F.col(a).eqNullSafe(F.col(b))).select(F.explode(F.array(a, b)).alias("label"))
    return either.groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label")


def histogram(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label")
