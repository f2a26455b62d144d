"""The stored neighbour index: exact after exclusions, appended to, and read by folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodlens.operators import neighbour_store as store

SCHEMA = "id bigint, a double, b double, c double, who array<string>"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 3)) * (1, 50, 0.01)
    # A third of the rows is one point; one row is far away, one has a NULL.
    x[::3] = x[0]
    x[7] = 40, 900, 3
    out = [(i, *v, None if i % 13 == 0 else [f"w{i % 7}", f"v{i % 5}"][: 1 + i % 2]) for i, v in enumerate(x.tolist())]
    return [*out, (9999, None, 1.0, 1.0, None)]


@pytest.fixture(scope="module")
def opened(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "index")
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    first = store.create(df.filter("id % 2 = 0"), path, "id", ["a", "b", "c"], exclude="who", bucket_length=0.3, tables=3)
    store.append(first, df.filter("id % 2 = 1"))
    return store.open_store(spark, path)


def brute(rows, seed, k):
    known = [r for r in rows if r[1] is not None]
    base = np.array([r[1:4] for r in known if r[0] % 2 == 0])
    scale = lambda v: (np.array(v) - base.mean(0)) / base.std(0, ddof=1)
    own, barred = scale(seed[1:4]), set(seed[4] or ())
    found = sorted(
        (float(np.sqrt(((scale(r[1:4]) - own) ** 2).sum())), r[0]) for r in known if r[0] != seed[0] and not barred & set(r[4] or ())
    )
    return found[:k]


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_results_are_exact(spark, opened, rows, k):
    seeds = [rows[i] for i in (0, 1, 7, 26, 599)] + [(-5, 0.3, -20.0, 0.004, ["w1"]), (-6, 1e3, 0.0, 0.0, None)]
    got = store.recommend(opened, spark.createDataFrame([*seeds, rows[-1]], SCHEMA), k).collect()
    assert {r["seed"] for r in got} == {s[0] for s in seeds}
    for s in seeds:
        mine = sorted((r for r in got if r["seed"] == s[0]), key=lambda r: r["rank"])
        expected = brute(rows, s, k)
        assert [r["rank"] for r in mine] == list(range(1, len(expected) + 1))
        assert np.allclose([r["dist"] for r in mine], [d for d, _ in expected], rtol=1e-9, atol=1e-9)
        # Equal distances may differ in their last bits between the two ways of computing them.
        assert {r["id"] for r in mine if r["dist"] < expected[-1][0] - 1e-6} == {i for d, i in expected if d < expected[-1][0] - 1e-6}


def test_counts_and_manifest(spark, opened, rows):
    assert opened.rows.count() == 3 * 600 == opened.cells.agg(F.sum("n")).first()[0]
    assert opened.manifest["features"] == ["a", "b", "c"] and len(opened.manifest["directions"]) == 3


def test_only_the_folders_of_the_seeds_are_read(spark, opened, rows):
    left = store._projected(opened, spark.createDataFrame([rows[1]], SCHEMA)).withColumn("r", F.lit(0.1))
    cells = opened.cells
    probes = store._probes(left, cells, 0.3, F.lit(-100), F.lit(100))
    plan = opened.rows.filter((F.col("tab") == 1) & F.col("slab").isin([0, 1]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tab" in plan and "slab" in plan.split("PartitionFilters")[1][:200]
    everything = cells.filter("tab = 0").agg(F.sum("n")).first()[0]
    assert probes.select("tab").distinct().count() == 1 and probes.agg(F.sum("n")).first()[0] < everything / 2


def test_an_index_is_not_overwritten_and_may_be_empty(spark, opened, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    with pytest.raises(Exception, match="already exists"):
        store.create(spark.createDataFrame([(1, 1.0, 2.0, 3.0, None)], SCHEMA), opened.path, "id", ["a", "b", "c"])
    empty = store.create(none, str(tmp_path / "none"), "id", ["a", "b", "c"])
    assert store.recommend(empty, none, 3).count() == 0
    assert store.recommend(opened, none, 3).count() == 0
