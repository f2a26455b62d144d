"""K-Means whose outcome depends on the data alone: not on partitions, their number or a random start.

Points are rows with a dense array or, for many dimensions of which few are set, arrays of positions and values. Their
standard scores are taken on a grid of 1e-9, so that sums of scores are sums of integers and come out the same in any
order. A fit starts from centres that are far apart: the first one is the point at the seed's rank in the order of
periods, each further one the point farthest from those chosen, the earliest on ties. Lloyd's steps follow until no
centre moves, ``ROUNDS`` at most; a point that is equally near to two centres goes to the one chosen first, and a centre
without points stays where it is.

All fits advance in the same pass over the points: one job for every further centre and one for every step, whatever
the number of fits. Points stay distributed; tasks hold a block of them, the centres, and sums per centre. Only sums and
centres reach the driver, ``MOST_CELLS`` numbers at most. Where one block holds all points, one task takes all steps.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS = 20
GRID = 1e9
# Numbers of all centres together, and of a block of points in a task.
MOST_CELLS, BLOCK_CELLS = 1 << 24, 1 << 20


@dataclass(frozen=True)
class Scaling:
    """Mean and sample deviation of every dimension. A dimension that does not vary scores 0."""

    mean: np.ndarray
    deviation: np.ndarray

    def grid(self, x: np.ndarray) -> np.ndarray:
        """Standard scores as whole numbers of grid steps."""
        flat = self.deviation <= 1e-12 * np.abs(self.mean)
        return np.where(flat, 0.0, np.floor((x - self.mean) / np.where(flat, 1.0, self.deviation) * GRID + 0.5))


def measure(points: DataFrame, dims: int) -> Scaling:
    """Scaling of ``vec``, or of ``idx`` and ``val`` where what is not set is 0. One aggregate per dimension."""
    size = points.count()
    if "vec" in points.columns:
        long = points.select(F.posexplode("vec").alias("dim", "x"))
    else:
        long = points.select(F.explode(F.arrays_zip("idx", "val")).alias("p")).select(F.col("p.idx").alias("dim"), F.col("p.val").alias("x"))
    found = long.groupBy("dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")).collect()
    mean, squares = np.zeros(dims), np.zeros(dims)
    for r in found:
        # What is set, merged with the zeros.
        mean[r["dim"]] = r["mean"] * r["n"] / size
        squares[r["dim"]] = r["var"] * r["n"] + r["mean"] ** 2 * r["n"] * (size - r["n"]) / size
    return Scaling(mean, np.sqrt(squares / max(size - 1, 1)))


def _blocks(batches: Iterator[pa.RecordBatch], scaling: Scaling) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows with their scores on the grid."""
    dims = len(scaling.mean)
    step = max(1, BLOCK_CELLS // max(dims, 1))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            x = np.zeros((batch.num_rows, dims))
            if "vec" in batch.schema.names:
                x[:] = batch["vec"].flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            else:
                sizes = np.array(batch["idx"].value_lengths().to_pylist(), np.int64)
                x[np.repeat(np.arange(len(x)), sizes), batch["idx"].flatten().to_numpy()] = batch["val"].flatten().to_numpy()
            yield batch, scaling.grid(x)


def _squares(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of points and centres; dimensions are added in their order, so that equal inputs give equal bits."""
    out = np.zeros((len(z), len(centres)))
    for j in range(z.shape[1]):
        d = (z[:, j, None] - centres[None, :, j]) / GRID
        out += d * d
    return out


@dataclass(frozen=True)
class Fit:
    """A fitted K-Means: centres in standard scores, and the sum of the points' squared distances to theirs."""

    k: int
    centres: np.ndarray
    cost: float
    scaling: Scaling

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802 - named as in spark.ml
        return list(self.centres / GRID)

    def transform(self, points: DataFrame) -> DataFrame:
        """Adds ``prediction`` and the vector ``features`` of standard scores."""
        return scored(points, self.scaling, self.centres)


def scored(points: DataFrame, scaling: Scaling, centres: np.ndarray | None = None) -> DataFrame:
    """Adds the vector ``features``, and ``prediction`` if centres are given."""
    plain = points.drop("features")
    added = [T.StructField("features", T.ArrayType(T.DoubleType())), T.StructField("prediction", T.IntegerType())]
    schema = T.StructType([*plain.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, z in _blocks(batches, scaling):
            nearest = np.zeros(len(z), np.int32) if centres is None else _squares(z, centres).argmin(axis=1).astype(np.int32)
            flat = pa.array((z / GRID).ravel())
            at = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            columns = [*batch.columns, pa.ListArray.from_arrays(at, flat), pa.array(nearest)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "features", "prediction"])

    out = plain.mapInArrow(run, schema).withColumn("features", array_to_vector("features"))
    return out if centres is not None else out.drop("prediction")


def _farthest(blocks: Iterable[tuple[list, np.ndarray]], centres: dict[int, np.ndarray]) -> dict[int, tuple[tuple, np.ndarray]]:
    """For every seed the point farthest from its centres, the earliest on ties: its rank for comparison, and its scores."""
    best: dict[int, tuple[tuple, np.ndarray]] = {}
    for periods, z in blocks:
        for seed, c in centres.items():
            away = _squares(z, c).min(axis=1)
            top = away.max()
            for i in np.flatnonzero(away == top).tolist():
                key = (-top, periods[i] is not None, periods[i])
                if seed not in best or key < best[seed][0]:
                    best[seed] = key, z[i]
    return best


def _partial_sums(blocks: Iterable[np.ndarray], every: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, costs and sums of scores for every centre of every fit; ``edges`` cut ``every`` into fits."""
    counts, cost, total = (np.zeros(n, np.int64) for n in (len(every), len(every), every.shape))
    for z in blocks:
        away, whole = _squares(z, every), z.astype(np.int64)
        for a, b in zip(edges[:-1], edges[1:]):
            own = away[:, a:b].argmin(axis=1)
            least = np.floor(away[np.arange(len(z)), a + own] * GRID + 0.5).astype(np.int64)
            np.add.at(total[a:b], own, whole)
            np.add.at(cost[a:b], own, least)
            counts[a:b] += np.bincount(own, minlength=b - a)
    return counts, cost, total


class _Block:
    """All points in the memory of one task, or on the driver of a test."""

    def __init__(self, blocks: list[tuple[list, np.ndarray]]):
        self.blocks = blocks

    def first(self, seed: int) -> np.ndarray:
        ranked = sorted((p is not None, p, b, i) for b, (periods, _) in enumerate(self.blocks) for i, p in enumerate(periods))
        *_, b, i = ranked[seed % len(ranked)]
        return self.blocks[b][1][i]

    def farthest(self, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        return {seed: z for seed, (_, z) in _farthest(self.blocks, centres).items()}

    def sums(self, every: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _partial_sums((z for _, z in self.blocks), every, edges)


class _Table:
    """Points in a table; every question is a job."""

    def __init__(self, points: DataFrame, period: str, scaling: Scaling):
        self.data = [c for c in ("vec", "idx", "val") if c in points.columns]
        self.points, self.period, self.scaling = points.select(period, *self.data), period, scaling
        self.size = points.count()

    def _ask(self, schema: str, rows: Callable[[Iterator], list | None]) -> DataFrame:
        """``rows`` gets the blocks ``(batch, scores)`` of a task and returns columns."""
        scaling = self.scaling

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            wanted = to_arrow_schema(parsed)
            if columns := rows(_blocks(batches, scaling)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, wanted)], schema=wanted)

        from pyspark.sql.types import _parse_datatype_string

        parsed = _parse_datatype_string(schema)
        return self.points.mapInArrow(run, parsed)

    def first(self, seed: int) -> np.ndarray:
        row = self.points.orderBy(F.col(self.period).asc_nulls_first()).offset(seed % self.size).limit(1)
        return next(_blocks(iter(row.toArrow().to_batches()), self.scaling))[1][0]

    def farthest(self, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        period = self.period

        def rows(blocks: Iterator) -> list | None:
            best = _farthest(((batch[period].to_pylist(), z) for batch, z in blocks), centres)
            return [list(best), *zip(*[(k[0], k[2], z.astype(np.int64)) for k, z in best.values()])] if best else None

        found = self._ask(f"seed int, away double, period {dict(self.points.dtypes)[period]}, z array<bigint>", rows)
        least = found.groupBy("seed").agg(F.min(F.struct("away", "period", "z")).alias("x")).collect()
        return {r["seed"]: np.array(r["x"]["z"], float) for r in least}

    def sums(self, every: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def rows(blocks: Iterator) -> list | None:
            counts, cost, total = _partial_sums((z for _, z in blocks), every, edges)
            at = np.flatnonzero(counts)
            return [at.tolist(), counts[at].tolist(), cost[at].tolist(), list(total[at])] if len(at) else None

        parts = self._ask("centre int, n bigint, cost bigint, sums array<bigint>", rows)
        long = parts.select("centre", "n", "cost", F.posexplode("sums").alias("dim", "s"))
        found = long.groupBy("centre", "dim").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum("s").alias("s")).toArrow()
        counts, cost, total = (np.zeros(n, np.int64) for n in (len(every), len(every), every.shape))
        centre, dim = found["centre"].to_numpy(), found["dim"].to_numpy()
        counts[centre], cost[centre], total[centre, dim] = (found[c].to_numpy() for c in ("n", "cost", "s"))
        return counts, cost, total


def _solve(points: _Block | _Table, ks: Sequence[int], seeds: Sequence[int], rounds: int) -> dict[int, tuple[float, np.ndarray]]:
    """Cost and centres of the best fit for every K."""
    begin = {seed: points.first(seed)[None] for seed in seeds}
    for _ in range(max(ks) - 1):
        begin = {seed: np.vstack([begin[seed], z]) for seed, z in points.farthest(begin).items()}
    centres = {(seed, k): begin[seed][:k] for seed in seeds for k in ks}
    costs: dict[tuple[int, int], float] = {}
    moving = list(centres)
    for at in range(rounds + 1):
        edges = np.cumsum([0, *(len(centres[f]) for f in moving)])
        counts, cost, total = points.sums(np.concatenate([centres[f] for f in moving]), edges)
        still = []
        for f, a, b in zip(moving, edges[:-1], edges[1:]):
            n = counts[a:b, None]
            moved = np.where(n > 0, np.floor(total[a:b] / np.maximum(n, 1) + 0.5), centres[f])
            # The last round only measures.
            if at < rounds and (moved != centres[f]).any():
                still.append(f)
                centres[f] = moved
            else:
                costs[f] = int(cost[a:b].sum()) / GRID
        if not (moving := still):
            break
    best = {k: min(((s, k) for s in seeds), key=costs.__getitem__) for k in ks}
    return {k: (costs[f], centres[f]) for k, f in best.items()}


def fit(
    points: DataFrame, period: str, scaling: Scaling, ks: Sequence[int], seeds: Sequence[int] = (0,), rounds: int = ROUNDS,
    in_one: int = BLOCK_CELLS,
) -> dict[int, Fit]:
    """For every K the fit of least cost over the seeds, the first seed on ties. Eager.

    Points of at most ``in_one`` numbers, the size of one block, are solved by one task; more of them stay in their table
    and every step is a job. Both ways take the same steps on the same whole numbers, so the outcome is the same.
    """
    dims = len(scaling.mean)
    if sum(ks) * len(seeds) * dims > MOST_CELLS:
        raise ValueError(f"{sum(ks) * len(seeds)} centres of {dims} dimensions are more than {MOST_CELLS} numbers")
    table = _Table(points, period, scaling)
    if table.size * dims > in_one:
        solved = _solve(table, ks, seeds, rounds)
    else:
        ks, seeds = list(ks), list(seeds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = [(batch[period].to_pylist(), z) for batch, z in _blocks(batches, scaling)]
            found = _solve(_Block(blocks), ks, seeds, rounds)
            yield pa.RecordBatch.from_pydict({"k": pa.array(list(found), pa.int32()), "cost": [c for c, _ in found.values()], "z": [c.ravel() for _, c in found.values()]})

        rows = table.points.coalesce(1).mapInArrow(run, "k int, cost double, z array<double>").collect()
        solved = {r["k"]: (r["cost"], np.array(r["z"]).reshape(r["k"], dims)) for r in rows}
    return {k: Fit(k, solved[k][1], solved[k][0], scaling) for k in ks}
