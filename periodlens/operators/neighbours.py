"""Nearest neighbours of many seeds, leaving out the seed itself and what shares a group with it.

Rows and seeds meet by an equality join on what they share: a hash bucket in one of the tables, or, for exact search,
one bucket for all. A bucket is cut into blocks of bounded size on either side, however many rows or seeds it holds;
a task compares one block of rows with one block of seeds, leaving out rows whose surroundings are too far away, and keeps
the k nearest rows of each seed after the exclusions. Only those meet in the final ranking. No vector comes to the driver, and rows without a seed in their
buckets are not compared at all.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import BucketedRandomProjectionLSH, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from periodlens.sources.tables import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Hash width and number of hash tables of the recommender.
BUCKET_LENGTH, TABLES = 2.0, 5
SEED = 42
# Rows, and seeds, that one task compares with each other: at least, and at most, also by the numbers of their vectors.
# In between a bucket is cut into as many pairs of blocks as are good for ``TASKS``, so that rows are sent a fixed
# number of times however many they are.
BLOCK, MOST_ROWS, MOST_NUMBERS, TASKS = 4096, 1 << 17, 1 << 23, 64
# Distances held at a time.
CELLS = 1 << 22
# Rows, and seeds, in a leaf, and leaves that give the first distances.
LEAF, SEED_LEAF, FIRST = 256, 64, 4


@dataclass(frozen=True)
class Index:
    """Fitted pipeline and catalog with ``id``, ``vec``, ``hashes`` (one bucket per table) and ``grp`` columns."""

    model: PipelineModel
    catalog: DataFrame


def _vector(df: DataFrame, features: Sequence[str] | str) -> tuple[DataFrame, list]:
    """Feature columns or one array column → stages that build ``rawFeatures``. Rows with a NULL are dropped."""
    if isinstance(features, str):
        return df.filter(F.col(features).isNotNull()).withColumn(
            "rawFeatures", array_to_vector(F.col(features).cast("array<double>"))
        ), []
    assembler = VectorAssembler(inputCols=list(features), outputCol="rawFeatures")
    return df.dropna("any", subset=list(features)), [assembler]


def _groups(df: DataFrame, exclude: str | None):
    """Exclusion groups of a row as array of strings: one value, a list, or none."""
    if exclude is None:
        return F.lit(None).cast("array<string>")
    col = F.col(exclude)
    if df.schema[exclude].dataType.typeName() == "array":
        return col.cast("array<string>")
    return F.when(col.isNotNull(), F.array(col.cast("string")))


def build(
    df: DataFrame,
    id_col: str,
    features: Sequence[str] | str,
    exclude: str | None = None,
    bucket_length: float = BUCKET_LENGTH,
    tables: int = TABLES,
    seed: int = SEED,
    standardise: bool = True,
    keep: Sequence[str] = (),
) -> Index:
    """Fit scaler and hash functions and hash the catalog. Eager for the fit; persist ``catalog`` for repeated use."""
    prepared, stages = _vector(df, features)
    if standardise:
        stages.append(StandardScaler(inputCol="rawFeatures", outputCol="features", withMean=True, withStd=True))
    stages.append(
        BucketedRandomProjectionLSH(
            inputCol="features" if standardise else "rawFeatures", outputCol="lsh", bucketLength=bucket_length,
            numHashTables=tables, seed=seed,
        )
    )
    model = Pipeline(stages=stages).fit(prepared)
    hashed = model.transform(prepared)
    catalog = hashed.select(
        F.col(id_col).alias("id"),
        vector_to_array("features" if standardise else "rawFeatures").alias("vec"),
        F.transform("lsh", lambda v: F.get(vector_to_array(v), F.lit(0)).cast("bigint")).alias("hashes"),
        _groups(df, exclude).alias("grp"),
        *keep,
    )
    return Index(model, catalog)


def plain(df: DataFrame, id_col: str, vector: str, exclude: str | None = None) -> DataFrame:
    """Catalog without scaling or hashes, for exact search over an array column."""
    return df.filter(F.col(vector).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vec"), _groups(df, exclude).alias("grp")
    )


def _leaves(x: np.ndarray, kind: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in leaves of at most ``size``, each of one kind and near each other: halved along the longest side."""
    out, left = [], [np.flatnonzero(kind == c) for c in np.unique(kind)]
    while left:
        at = left.pop()
        if len(at) <= size:
            out.append(at)
            continue
        part = x[at]
        side = part[:, np.argmax(part.max(axis=0) - part.min(axis=0))]
        order, half = np.argpartition(side, len(at) // 2), len(at) // 2
        left += [at[order[:half]], at[order[half:]]]
    return out


class _Groups:
    """Exclusion groups of a block of rows and a block of seeds, their names as numbers."""

    def __init__(self, rows: pa.ListArray, seeds: pa.ListArray):
        sizes = [np.asarray(a.value_lengths().fill_null(0)) for a in (rows, seeds)]
        names = pa.concat_arrays([rows.flatten(), seeds.flatten()]).dictionary_encode()
        codes = np.asarray(names.indices.fill_null(len(names.dictionary)))
        self.names = np.split(codes, [sizes[0].sum()])
        self.ends = [np.concatenate(([0], np.cumsum(n))) for n in sizes]
        self.single = all((n <= 1).all() for n in sizes)
        # The only name of a row or seed; what has none shares it with nothing.
        self.own = [np.full(len(n), -1 - i) for i, n in enumerate(sizes)]
        if self.single:
            for own, n, c in zip(self.own, sizes, self.names):
                own[n > 0] = c
        else:
            self.row_of = np.repeat(np.arange(len(sizes[0])), sizes[0])
            self.by = np.argsort(self.names[0], kind="stable")
            self.sorted = self.names[0][self.by]

    def shared(self, seeds: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(seeds x rows) mask: the row shares a group with the seed."""
        if self.single:
            return self.own[1][seeds, None] == self.own[0][None, rows]
        mask = np.zeros((len(seeds), len(rows)), dtype=bool)
        for i, s in enumerate(seeds):
            mine = np.unique(self.names[1][self.ends[1][s] : self.ends[1][s + 1]])
            if len(mine):
                barred = np.zeros(len(self.own[0]), dtype=bool)
                for a, b in zip(np.searchsorted(self.sorted, mine), np.searchsorted(self.sorted, mine, "right")):
                    barred[self.row_of[self.by[a:b]]] = True
                mask[i] = barred[rows]
        return mask


def _squares(y: np.ndarray, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """(seeds x rows) squared distances, from the rows' squared norms."""
    return norms[None, :] + (y * y).sum(axis=1)[:, None] - 2 * y @ x.T


def _block_top_k(k: int):
    """Function of a block of rows and a block of seeds (Arrow tables): the k nearest rows of every seed.

    Rows are held in leaves with a box around each. A few leaves near some seeds give each of these seeds a distance that
    k rows keep to; only leaves whose boxes come as near are compared. Where boxes tell nothing apart, that is all of them.
    """

    def column(table: pa.Table, name: str) -> pa.Array:
        flat = table[name].combine_chunks()
        return flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat

    def usable(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """Rows whose numbers are finite, and their vectors."""
        x = column(table, "vec")
        x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        finite = np.isfinite(x).all(axis=1)
        return (table, x) if finite.all() else (table.filter(pa.array(finite)), x[finite])

    def top(rows: pa.Table, seeds: pa.Table) -> pa.Table:
        schema = pa.schema([("seed", seeds.schema.field("id").type), ("id", rows.schema.field("id").type), ("dist", pa.float64())])
        if not rows.num_rows or not seeds.num_rows:
            return schema.empty_table()
        (rows, x), (seeds, y) = usable(rows), usable(seeds)
        if not rows.num_rows or not seeds.num_rows:
            return schema.empty_table()
        groups = _Groups(column(rows, "grp"), column(seeds, "grp"))
        # Leaves of one group each, where there are few groups, are passed over as a whole.
        apart = groups.single and len(np.unique(groups.own[0])) * LEAF <= len(x)
        kinds = groups.own if apart else [np.zeros(len(own), int) for own in groups.own]
        leaves = _leaves(x, kinds[0], LEAF)
        order = np.concatenate(leaves)
        ends = np.cumsum([len(leaf) for leaf in leaves])
        kind = np.array([kinds[0][leaf[0]] for leaf in leaves])
        low, high = (np.array([f(x[leaf], axis=0) for leaf in leaves]) for f in (np.min, np.max))
        x, ids, seed_ids = x[order], np.array(rows["id"].to_pylist())[order], np.array(seeds["id"].to_pylist())
        norms = (x * x).sum(axis=1)
        most, found = norms.max(), []

        def rough(some: np.ndarray, at: np.ndarray) -> np.ndarray:
            # The expanded square loses digits on close points. It only picks rows that may belong to the k nearest.
            out = _squares(y[some], x[at], norms[at])
            barred = seed_ids[some, None] == ids[None, at]
            if not apart:
                barred |= groups.shared(some, order[at])
            out[barred] = np.inf
            return out

        def within(chosen: np.ndarray) -> np.ndarray:
            return np.concatenate([np.arange(ends[i] - len(leaves[i]), ends[i]) for i in chosen])

        for some in _leaves(y, kinds[1], SEED_LEAF):
            gap = np.maximum(np.maximum(low - y[some].max(axis=0), y[some].min(axis=0) - high), 0)
            far = (gap * gap).sum(axis=1)
            open_ = np.flatnonzero(kind != kinds[1][some[0]]) if apart else np.arange(len(leaves))
            if not len(open_):
                continue
            slack = 2e-9 * ((y[some] * y[some]).sum(axis=1) + most + 1)
            first = within(open_[np.argsort(far[open_], kind="stable")[: max(FIRST, 2 * k // LEAF + 1)]])
            limit = np.full(len(some), np.inf)
            if len(first) >= k:
                limit = np.partition(rough(some, first), k - 1, axis=1)[:, k - 1]
            at = within(open_[far[open_] <= (limit + slack).max() * (1 + 1e-9)])
            step = max(1, CELLS // len(at))
            for begin in range(0, len(some), step):
                part = some[begin : begin + step]
                for s, away, least, more in zip(part, rough(part, at), limit[begin:], slack[begin:]):
                    if not np.isfinite(least):
                        least = np.partition(away, min(k, len(at)) - 1)[min(k, len(at)) - 1]
                    near = np.flatnonzero((away <= least + more) & np.isfinite(away))
                    dist = np.sqrt(((x[at[near]] - y[s]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[at[near]], dist))[:k]
                    found.append((np.repeat(seed_ids[s], len(best)), ids[at[near[best]]], dist[best]))
        columns = [np.concatenate(c).tolist() for c in zip(*found)] if found else ([], [], [])
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return top


def _keyed(df: DataFrame, by_hash: bool) -> DataFrame:
    """Rows once for each hash table with their bucket in it, or once in the one bucket of an exact search."""
    own = [F.col(c).alias(c) for c in ("id", "vec", "grp")]
    if by_hash:
        return df.select(*own, F.posexplode("hashes").alias("tab", "bucket"))
    return df.select(*own, F.lit(0).alias("tab"), F.lit(0).cast("bigint").alias("bucket"))


def meet(rows: DataFrame, wanted: DataFrame, bucket: Sequence[str], k: int) -> DataFrame:
    """``seed, id, dist``: for every block of rows and seeds in a bucket the k nearest rows of each seed.

    Both sides have ``id``, ``vec``, ``grp`` and the bucket's columns. Runs one job for the sizes of the buckets.
    """
    types, bucket = dict(rows.dtypes), list(bucket)
    # One row per bucket with a seed: into how many blocks either side of it is cut.
    sizes = wanted.groupBy(*bucket).agg(F.count("*").alias("_seeds")).join(
        rows.groupBy(*bucket).agg(F.count("*").alias("_rows"), F.max(F.size("vec")).alias("_dims")), bucket
    )
    most = F.greatest(F.lit(float(BLOCK)), F.least(F.lit(float(MOST_ROWS)), MOST_NUMBERS / F.greatest("_dims", F.lit(1))))
    even = F.sqrt(F.col("_rows").cast("double") * F.col("_seeds") / TASKS)
    block = F.least(F.greatest(even, F.lit(float(BLOCK))), most)
    blocks = settle(sizes.select(*bucket, F.ceil(F.col("_rows") / block).alias("_nr"), F.ceil(F.col("_seeds") / block).alias("_ns")), "blocks")

    def cut(df: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        parted = df.join(blocks, bucket).withColumn(own, F.pmod(F.xxhash64("id"), F.col(own_blocks)))
        return parted.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other_blocks) - 1))).drop("_nr", "_ns")

    keys = [*bucket, "_r", "_s"]
    left = cut(rows, "_r", "_nr", "_s", "_ns").groupBy(*keys)
    right = cut(wanted, "_s", "_ns", "_r", "_nr").groupBy(*keys)
    return left.cogroup(right).applyInArrow(_block_top_k(k), f"seed {types['id']}, id {types['id']}, dist double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of what was found for every seed, with their rank."""
    order = F.row_number().over(W.partitionBy("seed").orderBy("dist", "id"))
    return found.withColumn("rank", order).filter(F.col("rank") <= k)


def _search(catalog: DataFrame, seeds: DataFrame, k: int, by_hash: bool) -> DataFrame:
    # Columns of the seeds get new identities, since they may come from the catalog itself.
    apart = seeds.select(*[F.col(c).alias(c) for c in ("id", "vec", "grp", *(["hashes"] if by_hash else []))])
    found = meet(_keyed(catalog, by_hash), _keyed(apart, by_hash), ["tab", "bucket"], k)
    # A pair may have met in several tables.
    return ranked(found.groupBy("seed", "id").agg(F.min("dist").alias("dist")) if by_hash else found, k)


def exact(catalog: DataFrame, seeds: DataFrame, k: int = 10) -> DataFrame:
    """``seed, id, dist, rank``: the k nearest catalog rows of every seed by Euclidean distance, nearer id first on ties.

    ``seeds`` has the catalog's columns. Runs one job for the sizes of the two sides.
    """
    return _search(catalog, seeds, k, by_hash=False)


def recommend(index: Index, seeds: DataFrame, k: int = 10, fill: bool = True) -> DataFrame:
    """Nearest among the rows that share a hash bucket with the seed in at least one table.

    ``seeds`` is a table with a column ``id``; unknown ids give no rows. Exclusions come before the cut to k,
    so no over-fetch is needed. ``fill`` searches exactly for seeds whose buckets hold fewer than k rows. The
    hashed search is settled, so that it runs once for both.
    """
    wanted = index.catalog.join(seeds.select("id").distinct(), "id", "left_semi")
    found = _search(index.catalog, wanted, k, by_hash=True)
    if not fill:
        return found
    found = settle(found, "hashed")
    full = found.filter(F.col("rank") == k).select("seed")
    short = wanted.join(full, wanted["id"] == full["seed"], "left_anti")
    if short.isEmpty():
        return found
    return found.join(full, "seed", "left_semi").unionByName(_search(index.catalog, short, k, by_hash=False))


def with_display(found: DataFrame, catalog: DataFrame, id_col: str, display: Sequence[str]) -> DataFrame:
    """Add display columns of the neighbours, read from the source table after the search."""
    shown = catalog.select(F.col(id_col).alias("id"), *[c for c in display if c != id_col])
    return found.join(shown, "id")
