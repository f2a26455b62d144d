"""K-Means over periods with an automatic number of clusters.

Fitting runs Spark jobs, so the functions that fit are eager. The raw table is read once: its period table is
settled, and scaling, fits and top categories start from there. The fits for all K advance together, from centres that
the data give, so the outcome is the same on any number of partitions; see :mod:`periodlens.operators.lloyd`. Points stay
distributed throughout. A mix of more categories than periods that one task cannot solve is held by category; see
:mod:`periodlens.operators.wide_lloyd`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from periodlens.operators import lloyd, mix, series, wide_lloyd
from periodlens.sources.tables import settle

# Fixed value: the scanned K.
KS = range(2, 11)
# Ranks of the periods that fits start from.
SEEDS = (0,)


@dataclass
class Eras:
    """Result of a clustering: the clustered points, the elbow curve, the chosen K and its model.

    ``points`` have a vector of standard scores; of a mix that is held by category they are its table, a row per category.
    """

    clusters: DataFrame
    elbow: DataFrame
    best_k: int
    best_cost: float
    model: lloyd.Fit | wide_lloyd.Fit
    models: dict[int, lloyd.Fit] | dict[int, wide_lloyd.Fit]
    points: DataFrame

    def best(self) -> DataFrame:
        spark = self.clusters.sparkSession
        return spark.createDataFrame([(self.best_k, self.best_cost)], "best_k int, best_wssse double")

    def release(self) -> None:
        self.points.unpersist()


def scale(df: DataFrame, features: Sequence[str]) -> tuple[PipelineModel, DataFrame]:
    """Assemble the columns into ``rawFeatures`` and standardise them (mean, sample deviation) into ``features``."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="rawFeatures")
    scaler = StandardScaler(inputCol="rawFeatures", outputCol="features", withMean=True, withStd=True)
    assembled = assembler.transform(df)
    fitted = scaler.fit(assembled)
    return PipelineModel([assembler, fitted]), fitted.transform(assembled)


def elbow(costs: DataFrame, keys: Sequence[str] = (), k: str = "k", cost: str = "cost", scaled: bool = False) -> DataFrame:
    """K with the greatest distance from the chord between the first and last point of its curve.

    Input: ``(keys…, k, cost)``; output ``keys…, best_k, best_cost``, the smaller K on ties. Curves of fewer
    than three points have no elbow and are left out. ``scaled`` brings both axes to 0..1 first.
    """
    ends = costs.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.min(k).alias("_x1"),
        F.max(k).alias("_x2"),
        F.min_by(cost, k).alias("_y1"),
        F.max_by(cost, k).alias("_y2"),
        F.max(cost).alias("_hi"),
        F.min(cost).alias("_lo"),
        F.collect_list(F.struct(F.col(k).alias("k"), F.col(cost).alias("y"))).alias("_curve"),
    )

    def x(v):
        return F.try_divide((v - F.col("_x1")).cast("double"), (F.col("_x2") - F.col("_x1")).cast("double")) if scaled else v

    def y(v):
        return F.try_divide(v - F.col("_lo"), F.col("_hi") - F.col("_lo")) if scaled else v

    x1, x2, y1, y2 = x(F.col("_x1")), x(F.col("_x2")), y(F.col("_y1")), y(F.col("_y2"))
    far = F.transform(
        "_curve",
        lambda p: F.struct(
            (-F.abs((y2 - y1) * x(p["k"]) - (x2 - x1) * y(p["y"]) + (x2 * y1 - x1 * y2))).alias("d"), p["k"], p["y"]
        ),
    )
    best = ends.filter("_n >= 3").withColumn("_best", F.array_min(far))
    return best.select(*keys, F.col("_best.k").alias("best_k"), F.col("_best.y").alias("best_cost"))


def _by_first(assigned: DataFrame, period: str) -> DataFrame:
    """Renumber clusters by the first period they hold, so that equal groupings get equal numbers."""
    firsts = assigned.groupBy("prediction").agg(F.min(period).alias("_first"))
    # One row per cluster, at most max(ks) of them.
    order = F.row_number().over(W.orderBy("_first")) - 1
    numbers = firsts.select("prediction", order.alias("cluster"))
    return assigned.join(F.broadcast(numbers), "prediction").drop("prediction")


def cluster(
    df: DataFrame, period: str, features: Sequence[str], keep: Sequence[str], ks: Sequence[int] = KS,
    seeds: Sequence[int] = SEEDS, rounds: int = lloyd.ROUNDS,
) -> Eras:
    """Scale, fit every K, pick the elbow and assign each row its cluster. Eager; see :class:`Eras`.

    With more than one seed the best fit of each K counts.
    """
    vec = F.array(*[F.col(c).cast("double") for c in features]).alias("vec")
    # Columns to keep may be features as well.
    return _cluster(df.dropna("any", subset=list(features)).select(period, *keep, vec), period, len(features), keep, ks, seeds, rounds)


def _cluster(
    rows: DataFrame, period: str, dims: int, keep: Sequence[str], ks: Sequence[int], seeds: Sequence[int], rounds: int
) -> Eras:
    """Clusters of rows with ``vec``, or with ``idx`` and ``val``."""
    points = settle(rows, "periods")
    ks = _checked(ks, points.count())
    scaling = lloyd.measure(points, dims)
    models = lloyd.fit(points, period, scaling, ks, seeds, rounds)
    return _picked(points, period, keep, models, lloyd.scored(points, scaling))


def _checked(ks: Sequence[int], size: int) -> list[int]:
    if len(ks) < 3 or max(ks) > size:
        raise ValueError(f"need at least three values of K, none above the number of points, {size}")
    return list(ks)


def _picked(points: DataFrame, period: str, keep: Sequence[str], models: dict, shown: DataFrame) -> Eras:
    """Clusters of the points by the model at the elbow."""
    curve = points.sparkSession.createDataFrame([(k, float(m.cost)) for k, m in sorted(models.items())], "k int, wssse double")
    picked = elbow(curve, k="k", cost="wssse").first()
    model = models[picked["best_k"]]
    assigned = model.transform(points).select(period, *keep, "prediction")
    return Eras(_by_first(assigned, period), curve, picked["best_k"], picked["best_cost"], model, models, shown)


def by_means(
    df: DataFrame, period: str, features: Sequence[str], ks: Sequence[int] = KS, seeds: Sequence[int] = SEEDS,
    rounds: int = lloyd.ROUNDS,
) -> Eras:
    """Group periods by the means of some features. Clusters: ``period, avg_<feature>…, num_songs, cluster``."""
    means = series.period_mean(df, period, features).withColumnRenamed(f"num_{features[0]}", "num_songs")
    names = [f"avg_{f}" for f in features]
    return cluster(means.select(period, *names, "num_songs"), period, names, [*names, "num_songs"], ks, seeds, rounds)


def by_mix(
    df: DataFrame, period: str, category: str, ks: Sequence[int] = KS, seeds: Sequence[int] = SEEDS, rounds: int = lloyd.ROUNDS
) -> Eras:
    """Group periods by their category shares; adds each period's top category.

    Clusters: ``period, num_songs, dominant_<category>, dominant_<category>_count, cluster``. Shares are a sparse vector per
    period, in the order of the categories; of more categories than periods, and more shares than one task solves, they
    are a sparse vector per category, so there may be any number of categories.
    """
    counts = settle(mix.category_counts(df, period, category), "mix")
    size, dims = (counts.select(c).distinct().count() for c in (period, category))
    if dims < 2:
        raise ValueError("a mix needs at least two categories")
    if dims > size and size * dims > lloyd.BLOCK_CELLS:
        ks = _checked(ks, size)
        numbered, rows = mix.by_category(counts, period, category)
        models = wide_lloyd.fit(wide_lloyd.Table(rows, size), ks, seeds, rounds)
        eras = _picked(numbered.withColumnRenamed("num_rows", "num_songs"), period, ["num_songs"], models, rows)
    else:
        vectors, dims = mix.vectors(counts, period, category)
        eras = _cluster(vectors.withColumnRenamed("num_rows", "num_songs"), period, dims, ["num_songs"], ks, seeds, rounds)
    top = mix.top_of_counts(counts, period, category)
    eras.clusters = eras.clusters.join(top, period).select(period, "num_songs", *top.columns[1:], "cluster")
    return eras


def centroids(clustered: DataFrame, coords: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean of the members' coordinates and number of members per cluster."""
    return clustered.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in coords], F.count("*").alias("members"))


def vector_centroids(clustered: DataFrame, vector: str, cluster: str = "cluster") -> DataFrame:
    """Centroids of an array column, long: ``cluster, dim, center``; averages are partial per task."""
    long = clustered.select(cluster, F.posexplode(vector).alias("dim", "v"))
    return long.groupBy(cluster, "dim").agg(F.avg("v").alias("center"))


def categories_per_cluster(clustered: DataFrame, category: str, cluster: str = "cluster") -> DataFrame:
    """Sorted distinct categories seen in each cluster."""
    distinct = clustered.filter(F.col(category).isNotNull()).select(cluster, category).distinct()
    return distinct.groupBy(cluster).agg(F.array_sort(F.collect_list(category)).alias("categories"))
