"""Equi-join of many rows to one row per key when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a key that one task should join at most. On very large tables it is this share of all rows instead, which
# bounds the number of hot keys, and with it what is broadcast, by the share.
ROWS_PER_TASK = 50_000
HOT_SHARE = 100_000


def key_hash(keys: Sequence[str]):
    return F.xxhash64(*keys)


def hot_keys(counted: DataFrame, keys: Sequence[str], copies: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Hashes of the keys with too many rows for a task, and over how many tasks to spread each.

    ``counted`` has one row per key with its number of copies. There are never more than ``HOT_SHARE`` hot keys.
    """
    total = counted.agg(F.sum(copies)).scalar()
    most = F.greatest(F.lit(rows_per_task), F.ceil(total / HOT_SHARE))
    return counted.filter(F.col(copies) > most).select(
        key_hash(keys).alias("_h"), F.ceil(F.col(copies) / most).cast("int").alias("_salts")
    )


def join_unique(
    rows: DataFrame,
    unique: DataFrame,
    keys: Sequence[str],
    hot: DataFrame,
    spread: Sequence[str],
    copies: str,
    how: str = "inner",
) -> DataFrame:
    """Join ``rows`` to ``unique`` (one row per key, with its ``copies``), keeping every row. NULL keys meet NULL keys.

    Rows of a hot key are spread over as many tasks as its copies ask for, by a hash of the ``spread`` columns, and
    only the hot rows of ``unique`` are repeated to meet them. The shuffle key is a 64-bit hash; equality of the keys
    themselves is checked as well, so a hash collision cannot join wrong rows. The set of hot hashes is bounded by
    its definition (:func:`hot_keys`), which is what makes broadcasting it safe.
    """
    hot = F.broadcast(hot.groupBy("_h").agg(F.max("_salts").alias("_salts")))
    left = rows.withColumn("_h", key_hash(keys)).join(hot, "_h", "left")
    left = left.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    # The condition on the count is always true. It keeps the count in the plan, so that the shuffle behind
    # ``unique`` is the one behind ``hot`` and runs once.
    right = unique.filter(F.col(copies) > 0).drop(copies).withColumn("_h", key_hash(keys)).join(hot, "_h", "left")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    right = right.withColumnsRenamed({**{k: f"_r_{k}" for k in keys}, "_h": "_rh", "_salt": "_rsalt"})
    same = (F.col("_h") == F.col("_rh")) & (F.col("_salt") == F.col("_rsalt"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, same, how).drop("_h", "_salt", "_rh", "_rsalt", *[f"_r_{k}" for k in keys])
