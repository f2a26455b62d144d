"""K-Means of points with more dimensions than there are points: the steps of :mod:`periodlens.operators.lloyd`.

The table has one row per dimension, with the numbers of the points that are set there and their values; everything that
concerns a dimension, its scaling and its share of every distance, comes from that row. A centre is the mean of some
points, so the numbers of these points stand for it: neither centres nor dimensions reach the driver, only the points'
distances to the centres that are new in a step, ``lloyd.MOST_CELLS`` numbers at most. Scores and centres lie on the
grid of that module; a distance is a sum of grid steps, one per dimension, and comes out the same in any order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.operators.lloyd import GRID, MOST_CELLS, Scaling

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Numbers of a block of dimensions in a task.
CELLS = 1 << 17


@dataclass(frozen=True)
class Table:
    """Rows ``(dim, at, val)``: the numbers of the points that are set in a dimension, each once, and their values."""

    rows: DataFrame
    size: int


@dataclass(frozen=True)
class Fit:
    """A fitted K-Means: the cluster of every point by its number, and the points whose mean each centre is."""

    k: int
    cost: float
    owner: np.ndarray
    members: list[np.ndarray]
    table: Table

    def transform(self, points: DataFrame) -> DataFrame:
        """Adds ``prediction`` to rows with a point's number ``_at``."""
        owners = pa.table({"_at": pa.array(np.arange(len(self.owner)), pa.int32()), "prediction": pa.array(self.owner, pa.int32())})
        return points.join(points.sparkSession.createDataFrame(owners), "_at")

    def centres(self) -> DataFrame:
        """``(dim, centre)``: the coordinates of the k centres in standard scores."""
        size, members = self.table.size, self.members

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, z in _blocks(batches, size):
                flat = np.stack([_mean(z, s) for s in members], axis=1).ravel() / GRID
                at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(members))
                yield pa.RecordBatch.from_arrays([batch["dim"], pa.ListArray.from_arrays(at, pa.array(flat))], ["dim", "centre"])

        return self.table.rows.mapInArrow(run, f"dim {dict(self.table.rows.dtypes)['dim']}, centre array<double>")


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of dimensions with the scores of all points there, (points x dimensions)."""
    step = max(1, CELLS // size)
    for whole in batches:
        for start in range(0, whole.num_rows, step):
            batch = whole.slice(start, step)
            n = np.asarray(batch["at"].value_lengths())
            at, val = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("at", "val"))
            dim = np.repeat(np.arange(len(n)), n)
            x = np.zeros((size, len(n)))
            x[at, dim] = val
            # What is set, merged with the zeros.
            mean = np.bincount(dim, val, len(n)) / n
            squares = np.bincount(dim, (val - mean[dim]) ** 2, len(n)) + mean**2 * n * (size - n) / size
            yield batch, Scaling(mean * n / size, np.sqrt(squares / max(size - 1, 1))).grid(x)


def _mean(z: np.ndarray, members: np.ndarray) -> np.ndarray:
    return np.floor(z[members].sum(axis=0, dtype=np.int64) / len(members) + 0.5)


def _away(table: Table, sets: Sequence[np.ndarray]) -> np.ndarray:
    """(points x sets) squared distances of all points to the means of some sets of points, in grid steps. One job."""
    size = table.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, len(sets)), np.int64)
        for _, z in _blocks(batches, size):
            for i, s in enumerate(sets):
                d = (z - _mean(z, s)) / GRID
                total[:, i] += np.floor(d * d * GRID + 0.5).astype(np.int64).sum(axis=1)
        at, nth = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(nth), pa.array(total.ravel())], ["at", "nth", "away"])

    parts = table.rows.select("at", "val").mapInArrow(run, "at int, nth int, away bigint")
    found = parts.groupBy("at", "nth").agg(F.sum("away").alias("away")).toArrow()
    out = np.zeros((size, len(sets)), np.int64)
    out[found["at"].to_numpy(), found["nth"].to_numpy()] = found["away"].to_numpy()
    return out


def fit(table: Table, ks: Sequence[int], seeds: Sequence[int], rounds: int) -> dict[int, Fit]:
    """For every K the fit of least cost over the seeds, the first seed on ties. Points are numbered in the order of periods. Eager."""
    if sum(ks) * len(seeds) * table.size > MOST_CELLS:
        raise ValueError(f"distances of {table.size} points to {sum(ks) * len(seeds)} centres are more than {MOST_CELLS} numbers")
    known: dict[bytes, np.ndarray] = {}

    def distances(sets: Sequence[np.ndarray]) -> np.ndarray:
        """Only sets that were not asked for in the step before are measured."""
        wanted = {s.tobytes(): s for s in sets}
        new = [key for key in wanted if key not in known]
        measured = dict(zip(new, _away(table, [wanted[key] for key in new]).T)) if new else {}
        kept = {key: measured[key] if key in measured else known[key] for key in wanted}
        known.clear()
        known.update(kept)
        return np.stack([known[s.tobytes()] for s in sets], axis=1)

    begin = {seed: [np.array([seed % table.size])] for seed in seeds}
    for n in range(1, max(ks)):
        away = distances([s for chosen in begin.values() for s in chosen])
        for i, chosen in enumerate(begin.values()):
            # The earliest point on ties.
            chosen.append(np.array([away[:, i * n : (i + 1) * n].min(axis=1).argmax()]))
    centres = {(seed, k): begin[seed][:k] for seed in seeds for k in ks}
    fits: dict[tuple[int, int], Fit] = {}
    moving = list(centres)
    for at in range(rounds + 1):
        away = distances([s for f in moving for s in centres[f]])
        edges, still = np.cumsum([0, *(len(centres[f]) for f in moving)]), []
        for f, a, b in zip(moving, edges[:-1], edges[1:]):
            owner = away[:, a:b].argmin(axis=1)
            # A centre without points stays where it is.
            moved = [s if not (owner == i).any() else np.flatnonzero(owner == i) for i, s in enumerate(centres[f])]
            # The last round only measures.
            if at < rounds and any(not np.array_equal(x, y) for x, y in zip(moved, centres[f])):
                still.append(f)
                centres[f] = moved
            else:
                cost = sum(away[:, a:b].min(axis=1).tolist()) / GRID
                fits[f] = Fit(f[1], cost, owner.astype(np.int32), centres[f], table)
        if not (moving := still):
            break
    return {k: min((fits[s, k] for s in seeds), key=lambda f: f.cost) for k in ks}
