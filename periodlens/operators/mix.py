"""Category mix per period: counts, shares, the top category, stacked bands.

Everything starts from one aggregate over (period, category), so a period or category holding a large
part of the rows is already reduced to one row per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from periodlens.sources.tables import settle

MOST_COLUMNS = 2000


def category_counts(df: DataFrame, period: str, category: str) -> DataFrame:
    """Rows per (period, category); a NULL category is left out."""
    return df.filter(F.col(category).isNotNull()).groupBy(period, category).agg(F.count("*").alias("category_count"))


def category_mix(df: DataFrame, period: str, category: str) -> DataFrame:
    """Long mix: count, period total and share of each category seen in a period."""
    counts = category_counts(df, period, category)
    total = F.sum("category_count").over(W.partitionBy(period))
    return counts.withColumn("num_rows", total).withColumn(
        "share", F.try_divide(F.col("category_count").cast("double"), F.col("num_rows").cast("double"))
    )


def category_mix_wide(df: DataFrame, period: str, category: str, values: Sequence[str]) -> DataFrame:
    """One count column ``g0..gN`` and one share column ``share_g0..`` per given value; gaps are 0.

    The columns are numbered because values may hold dots or blanks. ``num_rows`` counts all rows of the
    period that have a category.
    """
    counts = [F.count_if(F.col(category) == v).alias(f"g{i}") for i, v in enumerate(values)]
    wide = df.filter(F.col(category).isNotNull()).groupBy(period).agg(*counts, F.count("*").alias("num_rows"))
    shares = {f"share_g{i}": F.try_divide(F.col(f"g{i}"), F.col("num_rows")) for i in range(len(values))}
    return wide.withColumns(shares)


def widen(counts: DataFrame, period: str, category: str, values: Sequence[str]) -> DataFrame:
    """As :func:`category_mix_wide`, from counts per period and category."""
    n = F.col("category_count")
    columns = [F.coalesce(F.sum(F.when(F.col(category) == v, n)), F.lit(0)).alias(f"g{i}") for i, v in enumerate(values)]
    wide = counts.groupBy(period).agg(*columns, F.sum(n).alias("num_rows"))
    return wide.withColumns({f"share_g{i}": F.try_divide(F.col(f"g{i}"), F.col("num_rows")) for i in range(len(values))})


def vectors(counts: DataFrame, period: str, category: str) -> tuple[DataFrame, int]:
    """Counts per period and category → one sparse vector of shares per period, and the number of categories. Eager.

    ``(period, num_rows, idx, val)``: positions in the order of all categories, ascending, and the shares there.
    """
    names = counts.select(category).distinct()
    # One row per category, numbered in one task: as many as a vector has dimensions.
    numbered = settle(names.withColumn("_at", (F.row_number().over(W.orderBy(category)) - 1).cast("int")), "categories")
    pair = F.struct(F.col("_at").alias("at"), F.col("category_count").alias("n"))
    rows = counts.join(numbered, category).groupBy(period).agg(
        F.sum("category_count").alias("num_rows"), F.array_sort(F.collect_list(pair)).alias("_all")
    )
    share = F.transform("_all", lambda x: F.try_divide(x["n"].cast("double"), F.col("num_rows").cast("double")))
    return rows.select(period, "num_rows", F.col("_all.at").alias("idx"), share.alias("val")), numbered.count()


def by_category(counts: DataFrame, period: str, category: str) -> tuple[DataFrame, DataFrame]:
    """Counts per period and category → numbered periods ``(period, num_rows, _at)`` and shares ``(dim, at, val)``. Eager.

    Periods are numbered in their order, nulls first. The shares have a row per category, ``dim``: the periods it was seen
    in, ascending, and its shares there. No task holds all categories.
    """
    totals = counts.select(F.col(period).alias("_p"), "category_count").groupBy("_p").agg(F.sum("category_count").alias("num_rows"))
    # One row per period, numbered in one task.
    order = W.orderBy(F.col("_p").asc_nulls_first())
    numbered = settle(totals.withColumn("_at", (F.row_number().over(order) - 1).cast("int")), "periods")
    long = counts.select(F.col(period).alias("_q"), F.col(category).alias("dim"), "category_count").join(numbered, F.expr("_p <=> _q"))
    share = F.try_divide(F.col("category_count").cast("double"), F.col("num_rows").cast("double"))
    rows = long.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), share.alias("val")))).alias("_all"))
    rows = settle(rows.select("dim", F.col("_all.at").alias("at"), F.col("_all.val").alias("val")), "shares")
    return numbered.withColumnRenamed("_p", period), rows


def category_values(df: DataFrame, category: str) -> list[str]:
    """Distinct category values in order, for naming columns. Runs a job.

    More than ``MOST_COLUMNS`` are an error: they would not make a table one can work with.
    """
    found = df.filter(F.col(category).isNotNull()).select(category).distinct().orderBy(category)
    rows = found.limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"{category} has more than {MOST_COLUMNS} values; use the long mix")
    return [r[0] for r in rows]


def dominant_category(df: DataFrame, period: str, category: str) -> DataFrame:
    """Most frequent category of each period, the first by name on ties."""
    return top_of_counts(category_counts(df, period, category), period, category)


def top_of_counts(counts: DataFrame, period: str, category: str) -> DataFrame:
    best = F.min(F.struct(-F.col("category_count"), F.col(category)))
    return counts.groupBy(period).agg(best.alias("_b")).select(
        period,
        F.col(f"_b.{category}").alias(f"dominant_{category}"),
        (-F.col("_b.col1")).alias(f"dominant_{category}_count"),
    )


def stacked_share(mix: DataFrame, period: str, category: str, order: Sequence[str], share: str = "share") -> DataFrame:
    """Lower and upper edge of each category's band when the shares are stacked in the given order."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(category))
    bands = mix.filter(F.col(category).isin(list(order))).withColumn("position", position.cast("int"))
    upper = F.sum(share).over(W.partitionBy(period).orderBy("position").rowsBetween(W.unboundedPreceding, 0))
    return bands.withColumn("upper", upper).withColumn("lower", F.col("upper") - F.col(share))
