"""Sharding by a keyed permutation of global row numbers.

Rows get global numbers 0..n-1 that depend on the data alone. A Feistel network permutes the numbers of the next even
power of two, and numbers that land beyond n walk on along their cycle until they are below it, which permutes
exactly 0..n-1. The new number gives shard and slot by division, so both can be computed for any row number, and the
row number for any shard and slot. Shard sizes differ by at most one row.

Defined results: a null text counts no bytes and has the checksum of an empty one; rows with equal ids are numbered
each for itself, and rows equal in id, size and checksum are interchangeable; an empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodlens.llm.common import narrow
from periodlens.sources.tables import settle

SHARDS = 40
ROW_OVERHEAD = 16
SEED = 20
ROUNDS = 6
# Rows numbered together, the most buckets there are of them, and equal rows unfolded at once.
BUCKET_ROWS = 1 << 16
BUCKETS = 1 << 16
COPIES = 1 << 16


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _keys(seed: int) -> list[int]:
    state = np.random.SeedSequence(seed).generate_state(ROUNDS, np.uint64)
    return [int(k) for k in state]


def _feistel(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in keys:
        left, right = right, left ^ (_round(right, k) & mask)
    return (right << np.uint64(half)) | left


def _walk(numbers: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    x = _feistel(np.asarray(numbers).astype(np.uint64), half, keys)
    while (out := x >= n).any():
        x[out] = _feistel(x[out], half, keys)
    return x.astype(np.int64)


def permute(numbers: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Where the rows with these numbers go among ``n``."""
    return _walk(numbers, n, _keys(seed))


def restore(places: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The inverse of :func:`permute`. With its output halves swapped a Feistel network inverts itself by reversed keys."""
    return _walk(places, n, _keys(seed)[::-1])


def shard_and_slot(numbers: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    slot, shard = np.divmod(permute(numbers, n, seed), shards)
    return shard, slot


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """Row numbers of the rows at these shards and slots."""
    return restore(np.asarray(slot) * shards + np.asarray(shard), n, seed)


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with ``number``, gapless from 0 and given by the values alone, and their count.

    Rows are counted by value first, so any number of equal rows is one. Values are dealt to buckets by hash; a
    bucket's numbers begin after those of the buckets before it. There is one row of counts per bucket, at most
    ``BUCKETS``, for the running sum over buckets.
    """
    columns = rows.columns
    counted = settle(rows.groupBy(*columns).agg(F.count("*").alias("_copies")), "counted")
    n = counted.agg(F.sum("_copies")).first()[0] or 0
    buckets = max(1, min(BUCKETS, n // BUCKET_ROWS))
    dealt = counted.withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_bucket").agg(F.sum("_copies").alias("_held")).select(
        "_bucket", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("_bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_inner", F.coalesce(F.sum("_copies").over(within), F.lit(0))).join(F.broadcast(offsets), "_bucket")
    first = (F.col("_offset") + F.col("_inner")).alias("_first")
    single = placed.filter("_copies = 1").select(*columns, first.alias("number"))
    # Many equal rows are unfolded in stretches, so that no task unfolds them all.
    stretches = placed.filter("_copies > 1").select(
        *columns, first, "_copies", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / COPIES))).alias("_k")
    ).repartition("_first", "_k")
    last = F.least(F.col("_copies"), (F.col("_k") + 1) * COPIES) - 1
    several = stretches.select(*columns, F.explode(F.sequence(F.col("_first") + F.col("_k") * COPIES, F.col("_first") + last)).alias("number"))
    return single.union(several), n


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``(id, size, checksum, number, shard, slot)`` for every row. Texts are read once; what is shuffled are three numbers."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = narrow(docs, id=id_col, text=text_col).select(
        "id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("checksum")
    )
    given, n = numbered(rows)

    @F.pandas_udf("bigint")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series(permute(numbers.to_numpy(), n, seed))

    return given.withColumn("_place", place("number")).select(
        "id", "size", "checksum", "number", (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"),
    )
