from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from periodlens.operators import cluster, neighbours


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(29)
    centres = [(0, 0), (10, 0), (0, 10)]
    rows = [
        (1990 + i, *(rng.normal(0, 0.3, 2) + centres[i // 10]).tolist()) for i in range(30) for _ in range(3)
    ]
    return spark.createDataFrame(rows, "year int, a double, b double")


def test_means_clusters(points):
    eras = cluster.by_means(points, "year", ["a", "b"], range(2, 7))
    rows = {r["year"]: r for r in eras.clusters.collect()}
    assert eras.best_k == 3 and eras.best().first()["best_k"] == 3
    assert [rows[1990 + i]["cluster"] for i in range(30)] == [i // 10 for i in range(30)]
    assert rows[1990]["num_songs"] == 3
    # Each point sits with its nearest centre, and the cost is the sum of those squared distances.
    centres = np.array(eras.model.clusterCenters())
    pts = np.array([r["v"] for r in eras.points.select(vector_to_array("features").alias("v")).collect()])
    d = ((pts[:, None] - centres[None]) ** 2).sum(axis=2)
    assert d.min(axis=1).sum() == pytest.approx(eras.best_cost)
    by_k = [r["wssse"] for r in eras.elbow.orderBy("k").collect()]
    assert by_k[0] > by_k[1] > by_k[-1]
    eras.release()


def test_too_few_points_are_an_error(points):
    with pytest.raises(ValueError):
        cluster.by_means(points.filter("year < 1996"), "year", ["a", "b"])


def test_raw_table_is_read_once(spark, points, folder):
    points.write.parquet(f"{folder}/p")
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    for fit, args in ((cluster.by_means, (["a", "b"],)), (cluster.by_mix, ("g",))):
        before = seen.value
        df = spark.read.parquet(f"{folder}/p").withColumn("g", (F.col("a") > 5).cast("string"))
        eras = fit(df.mapInArrow(note, df.schema), "year", *args, range(2, 6))
        assert eras.clusters.count() == 30 and seen.value - before == 90
        eras.release()


def test_mix_clusters(spark):
    rows = [(y, g) for y in range(1990, 2010) for g in (["x.1"] * 8 + ["y"] * 2 if y < 2000 else ["x.1"] * (y % 3) + ["y"] * 9)]
    eras = cluster.by_mix(spark.createDataFrame(rows, "year int, genre string"), "year", "genre", range(2, 5))
    got = {r["year"]: r for r in eras.clusters.collect()}
    assert got[1990]["dominant_genre"] == "x.1" and got[1990]["dominant_genre_count"] == 8 and got[1990]["cluster"] == 0
    assert got[2005]["dominant_genre"] == "y" and got[2005]["cluster"] > 0
    with pytest.raises(ValueError):
        cluster.by_mix(spark.createDataFrame([(1, "a")], "year int, genre string"), "year", "genre")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(31)
    rows = [
        (i, rng.normal(size=6).tolist(), None if i % 11 == 0 else [f"a{i % 7}", f"b{i % 5}"][: 1 + i % 2]) for i in range(400)
    ]
    # A third of the catalog is the same point, so it shares every bucket.
    rows = [(i, rows[0][1] if i % 3 == 0 else v, g) for i, v, g in rows]
    return rows, spark.createDataFrame(rows, "id int, v array<double>, artists array<string>").repartition(5)


def _brute(rows, seed, k):
    _, sv, sg = rows[seed]
    found = sorted(
        (float(np.sqrt(((np.array(v) - np.array(sv)) ** 2).sum())), i)
        for i, v, g in rows if i != seed and not (set(g or []) & set(sg or []))
    )
    return [i for _, i in found[:k]]


def test_exact_neighbours(vectors):
    rows, df = vectors
    catalog = neighbours.plain(df, "id", "v", exclude="artists")
    seeds = [0, 1, 5, 66, 399]
    got = neighbours.exact(catalog, catalog.filter(F.col("id").isin(seeds)), 7).collect()
    for s in seeds:
        assert [r["id"] for r in sorted((r for r in got if r["seed"] == s), key=lambda r: r["rank"])] == _brute(rows, s, 7)


def test_exact_in_several_blocks(vectors, monkeypatch):
    rows, df = vectors
    catalog = neighbours.plain(df, "id", "v", exclude="artists")
    monkeypatch.setattr(neighbours, "BLOCK", 30)
    monkeypatch.setattr(neighbours, "CELLS", 50)
    seeds = list(range(0, 40, 4))
    got = neighbours.exact(catalog, catalog.filter(F.col("id").isin(seeds)), 3).collect()
    for s in seeds:
        assert [r["id"] for r in sorted((r for r in got if r["seed"] == s), key=lambda r: r["rank"])] == _brute(rows, s, 3)


def test_recommend(spark, vectors):
    rows, df = vectors
    index = neighbours.build(df, "id", "v", exclude="artists")
    seeds = spark.createDataFrame([(1,), (5,), (66,), (9999,)], "id int")
    got = neighbours.recommend(index, seeds, 10).collect()
    assert {r["seed"] for r in got} == {1, 5, 66}
    exact = neighbours.exact(index.catalog, index.catalog.join(seeds, "id", "left_semi"), 10).collect()
    hits = 0
    for s in (1, 5, 66):
        mine = [r for r in got if r["seed"] == s]
        assert sorted(r["rank"] for r in mine) == list(range(1, 11))
        for r in mine:
            assert r["id"] != s and not set(rows[r["id"]][2] or []) & set(rows[s][2] or [])
        hits += len({r["id"] for r in mine} & {r["id"] for r in exact if r["seed"] == s})
    assert hits >= 24


def test_recommend_fills_up_exactly(spark, vectors):
    rows, df = vectors
    # Buckets so narrow that hardly anything is shared.
    index = neighbours.build(df, "id", "v", exclude="artists", bucket_length=1e-6, tables=1, standardise=False)
    got = neighbours.recommend(index, spark.createDataFrame([(1,)], "id int"), 5).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == _brute(rows, 1, 5)
    assert neighbours.recommend(index, spark.createDataFrame([(1,)], "id int"), 5, fill=False).count() < 5


def test_song_features(spark):
    df = spark.createDataFrame(
        [(f"s{i}", float(i % 7), i % 12, ["x"] if i % 2 else ["y"], "t") for i in range(40)] + [("n", None, 1, ["z"], "t")],
        "id string, energy double, key int, artist_list array<string>, name string",
    )
    from periodlens.functions.lists import fold_circular

    prepared = df.withColumn("key_folded", fold_circular("key"))
    index = neighbours.build(prepared, "id", ["energy", "key_folded"], exclude="artist_list")
    assert index.catalog.count() == 40
    found = neighbours.recommend(index, spark.createDataFrame([("s3",)], "id string"), 4)
    shown = neighbours.with_display(found, df, "id", ["id", "name", "energy"]).collect()
    assert len(shown) == 4 and all(int(r["id"][1:]) % 2 == 0 and r["name"] == "t" for r in shown)


def block(x, groups):
    return pa.table({
        "id": pa.array(range(len(x)), pa.int64()), "vec": pa.array(x.tolist(), pa.list_(pa.float64())), "grp": pa.array(groups, pa.list_(pa.string())),
    })


@pytest.mark.parametrize("names", [lambda i: None, lambda i: [f"g{i % 3}"][: i % 11], lambda i: [f"g{i % 900}"], lambda i: [f"a{i % 7}", f"b{i % 3}"][: i % 3]])
@pytest.mark.parametrize("dims", [1, 3, 20])
def test_leaves_lose_no_neighbour(names, dims):
    """Against all pairs, with ties, and a row that is no number, which takes no part."""
    x = np.round(np.random.default_rng(dims).normal(size=(1500, dims)), 1)
    x[700, 0] = np.nan
    groups = [names(i) for i in range(len(x))]
    rows = block(x, groups)
    seeds = np.arange(0, 1500, 20)
    found = neighbours._block_top_k(5)(rows, rows.take(seeds)).to_pylist()
    for s in set(seeds.tolist()) - {700}:
        dist = np.sqrt(((x - x[s]) ** 2).sum(axis=1))
        fit = [i for i in range(1500) if i not in (s, 700) and not set(groups[i] or ()) & set(groups[s] or ())]
        best = sorted((dist[i], i) for i in fit)[:5]
        assert sorted((r["dist"], r["id"]) for r in found if r["seed"] == s) == best
    assert not [r for r in found if 700 in (r["seed"], r["id"])]


def test_far_rows_are_not_compared(monkeypatch):
    compared, squares = Counter(), neighbours._squares
    monkeypatch.setattr(neighbours, "_squares", lambda y, x, n: compared.update(n=len(y) * len(x)) or squares(y, x, n))
    x = np.random.default_rng(3).normal(size=(20_000, 3))
    rows = block(x, [[f"g{int(v > 0)}"] for v in x[:, 0]])
    assert neighbours._block_top_k(10)(rows, rows.slice(0, 8000)).num_rows == 80_000
    assert compared["n"] < 20_000 * 8000 / 2


def test_rows_are_sent_a_fixed_number_of_times(spark, monkeypatch):
    """However many blocks of the least size there are: what is found grows with the rows, not with their square."""
    monkeypatch.setattr(neighbours, "BLOCK", 10)
    x = np.random.default_rng(8).normal(size=(800, 2))
    rows = spark.createDataFrame([(i, v.tolist(), None, 0) for i, v in enumerate(x)], "id bigint, vec array<double>, grp array<string>, b int")
    for n in (400, 800):
        some = rows.filter(F.col("id") < n)
        seeds = some.select(*[F.col(c).alias(c) for c in some.columns])
        assert neighbours.meet(some, seeds, ["b"], 3).count() <= n * 8 * 3
    got = neighbours.exact(rows, rows.filter("id % 100 = 0"), 3).collect()
    for s in range(0, 800, 100):
        dist = np.sqrt(((x - x[s]) ** 2).sum(axis=1))
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["seed"] == s] == np.argsort(dist)[1:4].tolist()
