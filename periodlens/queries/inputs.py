"""The supplied tables in the roles of the analyses, on the Spark side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodlens.operators import series

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

# Word lists of the lexicon queries.
LEXICONS = {
    "common": ["the", "of", "and", "this"],
    "link": ["de", "la", "der", "und", "que", "et"],
}
# Word lists of the lexicon labeller; their order decides first-wins ties.
LABELS = {
    "article": ["the", "a", "an", "der", "die", "das", "el", "la", "le", "les", "los"],
    "place": ["of", "to", "in", "on", "at", "from", "von", "zu", "en", "dans", "sur"],
    "link": ["and", "or", "but", "und", "et", "que", "qui"],
    "being": ["is", "was", "be", "are", "ist", "est", "es"],
    "pointer": ["it", "this", "that", "sich", "se", "su", "as"],
}
NAMES = list(LABELS)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(col: Column | str, digits: int = 6) -> Column:
    """Rounded, so that the order of summation does not show; adding 0.0 turns -0.0 into 0.0."""
    return F.round(col, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded."""
    return df.select(*[r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").withColumn("m", series.month_index("l_shipdate"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").withColumn("day", series.day_index("ts"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the number in their source as period."""
    number = F.regexp_extract("source", r"(\d+)", 1).try_cast("int")
    return read(spark, sf, "documents").withColumn("period", number)


def month_series(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly means of the numeric columns as ``(series, t, x)``, rounded to make equal values equal."""
    return rounded(series.to_long(series.period_mean(lineitem(spark, sf), "m", FEATURES), "m", FEATURES))


def month_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Standard scores of the monthly means."""
    return series.zscore(month_series(spark, sf)).select("series", "t", F.col("z").alias("x"))


def supplier_series(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly mean quantity of every supplier, one series each."""
    means = series.period_mean(lineitem(spark, sf), "m", ["l_quantity"], by=["l_suppkey"])
    return rounded(series.to_long(means, "m", ["l_quantity"], by="l_suppkey"))


def day_series(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean event value, overall."""
    return rounded(series.to_long(series.period_mean(events(spark, sf), "day", ["value"]), "day", ["value"]))
