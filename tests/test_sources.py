import subprocess
import sys
from pathlib import Path

import pytest

from periodlens.operators import clean, mix
from periodlens.sources import progress, tables


def test_csv_with_awkward_text(spark, folder):
    (path := f"{folder}/songs.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('id,name,year,valence,lyrics\n')
        f.write('1,"Say ""yes"", now",1990,0.5,"line one\nline ""two"", é\n"\n')
        f.write("2,plain,nineteen,1.1,\n")
    rows = tables.read_csv_by_name(spark, path, tables.SONG_SCHEMA, multi_line=True).orderBy("id").collect()
    assert rows[0]["name"] == 'Say "yes", now' and rows[0]["lyrics"] == 'line one\nline "two", é\n'
    assert rows[1]["year"] is None and rows[1]["lyrics"] is None and rows[1]["tempo"] is None
    kept = clean.window(tables.read_csv_by_name(spark, path, tables.SONG_SCHEMA, multi_line=True), "year", 1990, 2022, {"valence": (0, 1)}, ["lyrics"])
    assert [r["id"] for r in kept.collect()] == ["1"]
    inferred = tables.read_csv(spark, path, multi_line=True)
    assert dict(inferred.dtypes)["valence"] == "double"


def test_window_edges(spark):
    rows = [(y, v) for y in (1989, 1990, 2022, 2023, None) for v in (-0.1, 0.0, 1.0, 1.1, None)]
    df = spark.createDataFrame(rows, "year int, valence double")
    kept = {tuple(r) for r in clean.window(df, "year", 1990, 2022, {"valence": (0, 1)}).collect()}
    assert kept == {(1990, 0.0), (1990, 1.0), (2022, 0.0), (2022, 1.0)}


def test_periods_are_replaced_one_by_one(spark, folder):
    path = f"{folder}/t"
    tables.write_periods(spark.createDataFrame([(1, "a"), (2, "b")], "year int, v string"), path, "year")
    tables.write_periods(spark.createDataFrame([(2, "c")], "year int, v string"), path, "year")
    back = tables.read_parquet(spark, path)
    assert sorted((r["year"], r["v"]) for r in back.collect()) == [(1, "a"), (2, "c")]
    assert tables.read_parquet(spark, path, leaves=True).columns == ["v"]
    only = back.filter("year = 2")
    assert "PartitionFilters: [isnotnull(year" in only._jdf.queryExecution().executedPlan().toString()


def test_work_dir_follows_the_session(spark, folder):
    """The setting is fixed when Spark starts, so a session with it is started apart."""
    script = (
        "from pyspark.sql import SparkSession; from periodlens.sources import tables; "
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false')"
        f".config('spark.checkpoint.dir', '{folder}').getOrCreate(); "
        "t = tables.settle(s.range(5), 'x'); print('AT', tables.work_dir(s, 'x'), t.count())"
    )
    root = Path(__file__).resolve().parents[1]
    out = subprocess.run([sys.executable, "-c", script], cwd=root, capture_output=True, text=True, timeout=120, check=True)
    at = next(line for line in out.stdout.splitlines() if line.startswith("AT")).split()
    assert at[1].startswith(f"{folder}/x-") and at[2] == "5" and len(list(Path(folder).glob("x-*"))) == 1


def test_one_scan_reads_only_needed_columns(spark):
    import __spark_entry__ as e

    plan = e.queries()["feature_by_period"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<l_quantity:double,l_shipdate:timestamp_ntz>" in plan
    wide = e.queries()["period_mean"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert wide.count("Exchange hashpartitioning") == 1


def test_dominant_category_breaks_ties_by_name(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (2, "c")], "t int, g string")
    got = {r["t"]: (r["dominant_g"], r["dominant_g_count"]) for r in mix.dominant_category(df, "t", "g").collect()}
    assert got == {1: ("a", 1), 2: ("c", 1)}
    wide = {r["t"]: r for r in mix.category_mix_wide(df, "t", "g", ["a", "b", "c"]).collect()}
    assert (wide[1]["g0"], wide[1]["share_g0"], wide[2]["g0"]) == (1, 0.5, 0)


def test_release_deletes_what_was_settled(spark, folder):
    from pathlib import Path as P

    tables.settle(spark.range(3), "gone").count()
    made = tables._MADE[-1]
    assert any(P(made).glob("*.parquet"))
    kept, tables._MADE[:] = tables._MADE[:-1], tables._MADE[-1:]
    tables.release(spark)
    tables._MADE[:] = kept
    assert not P(made).exists()


def test_too_many_pending_periods_are_an_error(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i % 5,) for i in range(20)], "p int")
    monkeypatch.setattr(progress, "MOST_PENDING", 5)
    assert progress.pending(df, str(tmp_path / "m"), "p") == [(i, 4) for i in range(5)]
    monkeypatch.setattr(progress, "MOST_PENDING", 4)
    with pytest.raises(ValueError):
        progress.pending(df, str(tmp_path / "m"), "p")
