"""A neighbour index that is written once, opened by many searches and appended to.

Every table of the index projects the standardised vectors on two directions at right angles and cuts that plane into
square cells. The store holds the rows of every table under ``rows``, one folder per table and range of cells, sorted
by cell; the number of rows per cell under ``cells``; and features, scaling, directions and cell width under
``manifest``. A search reads the folders its cells lie in and nothing else.

A projection shortens no distance, so a row in a cell whose border lies farther from the seed than r is farther away than
r. A search therefore probes, in the table where they hold the fewest rows, all cells that come within r of the seed,
nearest borders included by that rule: if the k nearest rows found lie within r, they are the k nearest there are.
Otherwise r becomes the distance of the k-th, or grows where fewer than k were found, and those seeds are searched again.
Results are exact after exclusions; cells only decide how many rows are compared.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from periodlens.operators.neighbours import BUCKET_LENGTH, SEED, TABLES, _groups, meet, ranked
from periodlens.sources.tables import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cells along the first direction that share a folder.
RANGE = 8
GROWTH = 3.0
_CELL = ("tab", "c0", "c1")


@dataclass(frozen=True)
class Store:
    """An opened index."""

    spark: SparkSession
    path: str
    manifest: dict

    @property
    def rows(self) -> DataFrame:
        kind = self.manifest["id_type"]
        schema = f"c0 bigint, c1 bigint, id {kind}, vec array<double>, grp array<string>, tab int, slab bigint"
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    @property
    def cells(self) -> DataFrame:
        """Rows per cell; every append adds its own."""
        read = self.spark.read.schema("tab int, c0 bigint, c1 bigint, n bigint").parquet(f"{self.path}/cells")
        return read.groupBy(*_CELL).agg(F.sum("n").alias("n"))


def _features(df: DataFrame, features: Sequence[str] | str):
    if isinstance(features, str):
        return df.filter(F.col(features).isNotNull()), F.col(features).cast("array<double>")
    return df.dropna("any", subset=list(features)), F.array(*[F.col(c).cast("double") for c in features])


def _directions(dims: int, tables: int, seed: int) -> np.ndarray:
    """Two orthonormal directions per table; in one dimension the second one is empty."""
    rng = np.random.default_rng(seed)
    made = [np.linalg.qr(rng.normal(size=(dims, min(2, dims))))[0].T for _ in range(tables)]
    return np.array([np.vstack([d, np.zeros((2 - len(d), dims))]) for d in made])


def create(
    df: DataFrame, path: str, id_col: str, features: Sequence[str] | str, exclude: str | None = None,
    bucket_length: float = BUCKET_LENGTH, tables: int = TABLES, seed: int = SEED,
) -> Store:
    """Fit the scaling, write the index of ``df`` and open it. ``path`` must not exist; the manifest is written last.

    ``bucket_length`` is the width of a cell in standard deviations. Rows with a NULL feature are left out.
    """
    usable, vector = _features(df, features)
    long = usable.select(F.posexplode(vector).alias("dim", "x"))
    found = long.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")).orderBy("dim").collect()
    manifest = {
        "id_col": id_col, "id_type": dict(df.dtypes)[id_col], "features": features if isinstance(features, str) else list(features),
        "exclude": exclude, "width": bucket_length, "tables": tables, "mean": [r["mean"] for r in found],
        "deviation": [r["sd"] or 0.0 for r in found], "directions": _directions(len(found), tables, seed).tolist(),
    }
    store = Store(df.sparkSession, path.rstrip("/"), manifest)
    _write(store, df, "errorifexists")
    store.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{store.path}/manifest")
    return store


def open_store(spark: SparkSession, path: str) -> Store:
    """The index at a path; reads its manifest only."""
    path = path.rstrip("/")
    return Store(spark, path, json.loads(spark.read.text(f"{path}/manifest").first()["value"]))


def append(store: Store, df: DataFrame) -> None:
    """Add rows under the scaling and directions of the store. Ids are not checked against those it has."""
    _write(store, df, "append")


def _write(store: Store, df: DataFrame, mode: str) -> None:
    tables = _projected(store, df).select("id", "vec", "grp", F.inline("tabs"))
    width = store.manifest["width"]
    cell = tables.select(
        "id", "vec", "grp", "tab", F.floor(F.col("y0") / width).alias("c0"), F.floor(F.col("y1") / width).alias("c1")
    ).withColumn("slab", F.floor(F.col("c0") / RANGE))
    dealt = cell.repartitionByRange("tab", "c0", "c1", F.xxhash64("id")).sortWithinPartitions("tab", "slab", "c0", "c1")
    dealt.write.mode(mode).partitionBy("tab", "slab").parquet(f"{store.path}/rows")
    cell.groupBy(*_CELL).agg(F.count("*").alias("n")).write.mode(mode).parquet(f"{store.path}/cells")


def _projected(store: Store, df: DataFrame) -> DataFrame:
    """``(id, vec, grp, tabs)``: standardised vectors, and their place ``(tab, y0, y1)`` in every table."""
    m = store.manifest
    mean, deviation, directions = (np.array(m[c]) for c in ("mean", "deviation", "directions"))
    usable, vector = _features(df, m["features"])
    plain = usable.select(F.col(m["id_col"]).alias("id"), vector.alias("vec"), _groups(df, m["exclude"]).alias("grp"))
    schema = T.StructType([*plain.schema.fields, T.StructField("tabs", T.ArrayType(T.StructType([
        T.StructField("tab", T.IntegerType()), T.StructField("y0", T.DoubleType()), T.StructField("y1", T.DoubleType()),
    ])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, tables = batch.num_rows, len(directions)
            x = batch["vec"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            z = np.where(deviation > 0, (x - mean) / np.where(deviation > 0, deviation, 1.0), 0.0)
            y = np.einsum("nd,thd->nth", z, directions)

            def lists(values: pa.Array, size: int) -> pa.ListArray:
                return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), values)

            tab = pa.array(np.tile(np.arange(tables, dtype=np.int32), n))
            places = pa.StructArray.from_arrays([tab, pa.array(y[:, :, 0].ravel()), pa.array(y[:, :, 1].ravel())], ["tab", "y0", "y1"])
            yield pa.RecordBatch.from_arrays(
                [batch["id"], lists(pa.array(z.ravel()), z.shape[1]), batch["grp"], lists(places, tables)], ["id", "vec", "grp", "tabs"]
            )

    return plain.mapInArrow(run, schema)


def recommend(store: Store, seeds: DataFrame, k: int = 10) -> DataFrame:
    """``seed, id, dist, rank, compared``: the k nearest rows of every seed, smaller ids first on ties.

    ``seeds`` has the columns the index was built from and need not be in it; a seed's own id and rows that share its
    group are passed over. ``compared`` is the number of rows that were compared with the seed. Eager: the searches of a
    round share its jobs, and a seed mostly takes two rounds.
    """
    width = store.manifest["width"]
    cells = settle(store.cells, "cells")
    ends = {r["tab"]: r for r in cells.groupBy("tab").agg(F.min("c0").alias("lo"), F.max("c0").alias("hi"), F.sum("n").alias("n")).collect()}
    left = settle(_projected(store, seeds).withColumn("r", F.lit(float(width))).withColumn("before", F.lit(0).cast("long")), "seeds")
    if not ends:
        return _none(store)
    total = next(iter(ends.values()))["n"]
    lowest, highest = (F.create_map(*[F.lit(x) for t, e in ends.items() for x in (t, e[c])])[F.col("tab")] for c in ("lo", "hi"))
    parts: list[DataFrame] = []
    while not left.isEmpty():
        probes = _probes(left, cells, width, lowest, highest)
        found = settle(ranked(_compared(store, probes, left, k), k), "found")
        cost = probes.groupBy("id").agg(F.sum("n").alias("n"))
        reached = found.groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("got"), F.max("dist").alias("far"))
        after = left.join(cost, "id", "left").join(reached, "id", "left").withColumn("spent", F.col("before") + F.coalesce("n", F.lit(0)))
        after = settle(after.withColumn("full", F.coalesce(F.col("got") == k, F.lit(False))), "rounds")
        # All rows have been seen, or none that has not can be nearer.
        done = (F.coalesce("n", F.lit(0)) >= total) | (F.col("full") & (F.col("far") <= F.col("r")))
        parts.append(found.join(after.filter(done).select(F.col("id").alias("seed"), F.col("spent").alias("compared")), "seed"))
        wider = F.when(F.col("full"), F.col("far")).otherwise(F.col("r") * GROWTH)
        left = after.filter(~done).select("id", "vec", "grp", "tabs", wider.alias("r"), F.col("spent").alias("before"))
    return reduce(DataFrame.unionByName, parts) if parts else _none(store)


def _none(store: Store) -> DataFrame:
    kind = store.manifest["id_type"]
    return store.spark.createDataFrame([], f"seed {kind}, id {kind}, dist double, rank int, compared bigint")


def _probes(left: DataFrame, cells: DataFrame, width: float, lowest, highest) -> DataFrame:
    """``(id, tab, c0, c1, n)``: the cells within r of every seed, in the table where they hold the fewest rows."""
    # Rounding must not lose a cell on the border.
    reach = F.col("r") * (1 + 1e-9) + 1e-9
    places = left.select("id", reach.alias("reach"), F.inline("tabs"))
    lo = F.greatest(F.floor((F.col("y0") - F.col("reach")) / width), lowest)
    hi = F.least(F.floor((F.col("y0") + F.col("reach")) / width), highest)
    spread = places.withColumn("c0", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))

    def border(y: str, c: str):
        return F.greatest(F.col(c) * width - F.col(y), F.col(y) - (F.col(c) + 1) * width, F.lit(0.0))

    near = spread.join(cells, ["tab", "c0"]).filter(
        border("y0", "c0") * border("y0", "c0") + border("y1", "c1") * border("y1", "c1") <= F.col("reach") * F.col("reach")
    )
    near = settle(near.select("id", *_CELL, "n"), "probes")
    best = near.groupBy("id", "tab").agg(F.sum("n").alias("n")).groupBy("id").agg(F.min(F.struct("n", "tab"))["tab"].alias("tab"))
    return near.join(best, ["id", "tab"])


def _compared(store: Store, probes: DataFrame, left: DataFrame, k: int) -> DataFrame:
    folders = probes.select("tab", F.floor(F.col("c0") / RANGE).alias("slab")).distinct().collect()
    # As many as the store has folders at most.
    slabs: dict[int, list[int]] = {}
    for r in folders:
        slabs.setdefault(r["tab"], []).append(r["slab"])
    wanted = reduce(lambda a, b: a | b, ((F.col("tab") == t) & F.col("slab").isin(s) for t, s in sorted(slabs.items())), F.lit(False))
    seeds = probes.select("id", *_CELL).join(left.select("id", "vec", "grp"), "id")
    return meet(store.rows.filter(wanted).select("id", "vec", "grp", *_CELL), seeds, _CELL, k)
