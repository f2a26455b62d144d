"""K-Means from the data: against a plain version, and the same on any layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodlens.operators import cluster, lloyd, wide_lloyd


def plain(z, k, rounds, first=0):
    """Farthest starts and Lloyd's steps on whole numbers."""
    chosen = [first]
    while len(chosen) < k:
        away = [min(sum(((a - b) / 1e9) ** 2 for a, b in zip(p, z[c])) for c in chosen) for p in z]
        chosen.append(away.index(max(away)))
    centres = [list(z[c]) for c in chosen]
    for _ in range(rounds + 1):
        own = []
        for p in z:
            away = [sum(((a - b) / 1e9) ** 2 for a, b in zip(p, c)) for c in centres]
            own.append((away.index(min(away)), min(away)))
        moved = []
        for i, c in enumerate(centres):
            mine = [p for p, (o, _) in zip(z, own) if o == i]
            moved.append([np.floor(sum(x) / len(mine) + 0.5) for x in zip(*mine)] if mine else c)
        if moved == centres:
            break
        centres = moved
    return [o for o, _ in own], sum(int(np.floor(d * 1e9 + 0.5)) for _, d in own) / 1e9


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1.0, (20, 3)) for c in (0, 3, 7)])
    # Ties, repeated points and a dimension that does not vary.
    x[30:34], x[:, 2] = x[3], 4.5
    return [(i, *v) for i, v in enumerate(x.tolist())]


@pytest.mark.parametrize("parts", [1, 8, 50])
@pytest.mark.parametrize("in_one", [0, lloyd.BLOCK_CELLS])
def test_fits_are_those_of_a_plain_version(spark, rows, parts, in_one):
    df = spark.createDataFrame(rows, "t int, a double, b double, c double").repartition(parts)
    points = df.select("t", F.array("a", "b", "c").alias("vec"))
    scaling = lloyd.measure(points, 3)
    x = np.array([r[1:] for r in rows])
    assert np.allclose(scaling.mean, x.mean(0)) and np.allclose(scaling.deviation, x.std(0, ddof=1))
    z = scaling.grid(x).tolist()
    assert not any(p[2] for p in z)
    fits = lloyd.fit(points, "t", scaling, [2, 3, 5], seeds=(0, 7), in_one=in_one)
    for k, found in fits.items():
        each = {first: plain(z, k, lloyd.ROUNDS, first) for first in (0, 7)}
        first = min(each, key=lambda s: each[s][1])
        assert found.cost == each[first][1]
        assert [r["prediction"] for r in found.transform(points).orderBy("t").collect()] == each[first][0]


def test_clusters_do_not_depend_on_layout(spark, rows):
    df = spark.createDataFrame(rows, "t int, a double, b double, c double")
    got = []
    for parts in (1, 8, 50):
        eras = cluster.by_means(df.repartition(parts), "t", ["a", "b"])
        got.append((eras.best_k, eras.best_cost, [tuple(r) for r in eras.clusters.orderBy("t").collect()]))
    assert got[0] == got[1] == got[2]


def test_more_clusters_than_different_points(spark):
    points = spark.createDataFrame([(t, [float(t % 2)]) for t in range(9)], "t int, vec array<double>")
    fits = lloyd.fit(points, "t", lloyd.measure(points, 1), [2, 5])
    assert fits[2].cost == fits[5].cost == 0
    assert {r["prediction"] for r in fits[5].transform(points).collect()} == {0, 1}


def test_sparse_points_are_dense_ones_with_zeros(spark):
    rng = np.random.default_rng(9)
    x = rng.random((25, 40)) * (rng.random((25, 40)) < 0.2)
    x[:, 7] = 0
    dense = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "t int, vec array<double>")
    sparse = spark.createDataFrame(
        [(i, np.flatnonzero(v).tolist(), v[v > 0].tolist()) for i, v in enumerate(x)], "t int, idx array<int>, val array<double>"
    )
    a, b = lloyd.measure(dense, 40), lloyd.measure(sparse, 40)
    assert np.allclose(a.mean, b.mean) and np.allclose(a.deviation, b.deviation)
    one, other = lloyd.fit(dense, "t", b, [3]), lloyd.fit(sparse, "t", b, [3], in_one=0)
    assert one[3].cost == other[3].cost and (one[3].centres == other[3].centres).all()


def test_many_categories(spark):
    rows = [(t, f"{t // 10}.{i}") for t in range(40) for i in range(800)]
    eras = cluster.by_mix(spark.createDataFrame(rows, "t int, g string"), "t", "g", range(2, 7))
    assert eras.best_k == 4
    assert [r["cluster"] for r in eras.clusters.orderBy("t").collect()] == [t // 10 for t in range(40)]


def test_too_many_numbers_are_an_error(spark):
    points = spark.createDataFrame([(0, [1.0])], "t int, vec array<double>")
    with pytest.raises(ValueError):
        lloyd.fit(points, "t", lloyd.Scaling(np.zeros(10**7), np.ones(10**7)), [2])


def by_category(spark, x, periods):
    """Points in the rows of ``x`` as a table with a row per dimension."""
    rows = [(j, np.flatnonzero(v).tolist(), v[v > 0].tolist()) for j, v in enumerate(x.T) if v.any()]
    return wide_lloyd.Table(spark.createDataFrame(rows, "dim int, at array<int>, val array<double>").repartition(periods), len(x))


def test_points_held_by_category_have_the_same_fits(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.random((25, 40)) * (rng.random((25, 40)) < 0.2)
    # Equal points, and a dimension that is nowhere set.
    x[11:14], x[:, 7] = x[3], 0
    sparse = spark.createDataFrame(
        [(i, np.flatnonzero(v).tolist(), v[v > 0].tolist()) for i, v in enumerate(x)], "t int, idx array<int>, val array<double>"
    )
    expected = lloyd.fit(sparse, "t", lloyd.measure(sparse, 40), [2, 3, 6, 24], seeds=(0, 7))
    owners = {k: [r["prediction"] for r in f.transform(sparse).orderBy("t").collect()] for k, f in expected.items()}
    for parts, cells in ((1, 1 << 17), (8, 90)):
        monkeypatch.setattr(wide_lloyd, "CELLS", cells)
        fits = wide_lloyd.fit(by_category(spark, x, parts), [2, 3, 6, 24], (0, 7), lloyd.ROUNDS)
        for k, f in fits.items():
            assert f.owner.tolist() == owners[k] and f.cost == pytest.approx(expected[k].cost, abs=1e-6)
            z = np.array([r["centre"] for r in f.centres().orderBy("dim").collect()]).T
            assert np.allclose(z, np.delete(expected[k].centres / lloyd.GRID, 7, axis=1), atol=3e-9)


def test_more_categories_than_centres_may_have_numbers(spark, monkeypatch):
    """The limit on numbers of centres is no limit on categories."""
    monkeypatch.setattr(lloyd, "BLOCK_CELLS", 1000)
    monkeypatch.setattr(lloyd, "MOST_CELLS", 1000)
    monkeypatch.setattr(wide_lloyd, "MOST_CELLS", 1000)
    rows = [(t, f"{(t or 0) // 10}.{i}") for t in [None, *range(1, 40)] for i in range(60)]
    eras = cluster.by_mix(spark.createDataFrame(rows, "t int, g string"), "t", "g", range(2, 7))
    assert eras.best_k == 4
    # A period without a name takes part but is not among the clusters, which are numbered from it.
    got = eras.clusters.orderBy("t").collect()
    assert [r["cluster"] for r in got] == [t // 10 for t in range(1, 40)]
    assert {(r["num_songs"], r["dominant_g"], r["dominant_g_count"]) for r in got} == {(60, f"{i}.0", 1) for i in range(4)}
