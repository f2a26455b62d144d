import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodlens.functions import stats
from periodlens.functions.stats import slope_quantiles
from periodlens.operators import series, trend
from periodlens.plans import trends


def _brute(xs):
    n, s = len(xs), sum((b > a) - (b < a) for i, a in enumerate(xs) for b in xs[i + 1:])
    ties = [xs.count(v) for v in set(xs)]
    var = (n * (n - 1) * (2 * n + 5) - sum(c * (c - 1) * (2 * c + 5) for c in ties)) / 18
    n0 = n * (n - 1) / 2
    den = (n0 - sum(c * (c - 1) / 2 for c in ties)) * n0
    z = 0 if s == 0 else (s - math.copysign(1, s)) / math.sqrt(var)
    return s, var, z, s / math.sqrt(den) if den else None


def test_known_answers(long_of):
    up = [3, 4, 8, 9, 11, 15, 30]
    got = {r["series"]: r for r in trend.with_p(trend.mann_kendall(long_of(
        {"up": up, "down": up[::-1], "mixed": [2, 5, 3, 7, 4, 6], "flat": [2] * 5, "short": [1, 2]}
    ))).collect()}
    assert got["up"]["s"] == 21 and got["up"]["tau"] == 1 and got["up"]["p_raw"] < 3e-3
    assert got["down"]["tau"] == -1
    # By hand, of the 15 pairs: 5, 2 less 2, 3, less 2 and 1.
    assert got["mixed"]["s"] == 7 and got["mixed"]["tau"] == pytest.approx(7 / 15)
    assert (got["flat"]["s"], got["flat"]["z"], got["flat"]["tau"], got["flat"]["p_raw"]) == (0, 0, None, 1)
    assert "short" not in got


def test_against_all_pairs(long_of):
    rng = random.Random(1)
    data = {f"s{i}": [rng.randint(0, 6) for _ in range(rng.randint(3, 40))] for i in range(30)}
    for r in trend.mann_kendall(long_of(data)).collect():
        s, var, z, tau = _brute(data[r["series"]])
        assert r["s"] == s and r["var_s"] == pytest.approx(var) and r["z"] == pytest.approx(z)
        assert (r["tau"] is None and tau is None) or r["tau"] == pytest.approx(tau)


def test_normal_tail(spark):
    df = trend.with_p(spark.createDataFrame([(0.0,), (1.959963985,), (-3.0,), (None,)], "z double"))
    assert [r["p_raw"] for r in df.collect()] == [
        1.0, pytest.approx(0.05, abs=1e-8), pytest.approx(0.0026997960632601866), None
    ]


def test_slope_of_a_line_with_one_outlier(long_of):
    values = [40 - 0.75 * t for t in range(14)]
    values[5] += 100
    r = trend.sens_slope(long_of({"line": values}, 300)).first()
    assert r["slope"] == pytest.approx(-0.75) and r["ci_lo"] <= r["slope"] <= r["ci_hi"]


@pytest.mark.parametrize("cells", [1, 300, 1 << 20])
def test_selected_slopes_are_slopes(cells):
    """Exactly the values that sorting all slopes gives, ties and large levels included."""
    rng = np.random.default_rng(3)
    for n in (2, 5, 64, 120):
        t = np.cumsum(rng.integers(1, 4, n)).astype(float)
        for x in (rng.normal(size=n), rng.integers(0, 4, n).astype(float), 1e9 + rng.integers(0, 5, n)):
            i, j = np.triu_indices(n, k=1)
            slopes = np.sort((x[j] - x[i]) / (t[j] - t[i]))
            ranks = list(range(1, len(slopes) + 1, max(1, len(slopes) // 7)))
            assert slope_quantiles(t, x, [float(k) for k in ranks], cells) == [slopes[k - 1] for k in ranks]


def test_flat_steps_have_slope_zero_however_long(long_of):
    rng = np.random.default_rng(4)
    r = trend.sens_slope(long_of({"s": 1e9 + rng.integers(0, 3, 1700)})).first()
    assert r["slope"] == 0.0


def test_bh(spark):
    rng = random.Random(5)
    # One family holds most tests, a third of them with the same p; another is small; one p is missing.
    ps = [("big", rng.random() ** 8) for _ in range(400)] + [("big", 1.0)] * 200 + [("big", 0.0)] * 3
    ps += [("small", p) for p in (0.0004, 0.013, 0.013, 0.02, 0.3, 0.66)]
    df = spark.createDataFrame([(i, f, p) for i, (f, p) in enumerate(ps)] + [(-1, "small", None)], "id int, fam string, p double")
    got = {r["id"]: r for r in trend.bh(df, "p", ["fam"]).collect()}
    assert len(got) == len(ps) + 1 and got[-1]["p_bh"] is None
    for fam in ("big", "small"):
        mine = sorted((p, i) for i, (f, p) in enumerate(ps) if f == fam)
        low = 1.0
        for rank in range(len(mine), 0, -1):
            p, i = mine[rank - 1]
            low = min(low, p * len(mine) / rank)
            assert got[i]["p_bh"] == pytest.approx(low) and got[i]["p_bh"] >= p - 1e-12
            assert got[i]["significant_fdr"] == (got[i]["p_bh"] <= 0.05)


def test_table(long_of):
    rows = trends.table(long_of({"up": range(5, 15), "below": range(-20, -10), "saw": [1, 2] * 5})).collect()
    by = {r["series"]: r for r in rows}
    assert by["up"]["direction"] == "increasing" and by["up"]["total_change"] == pytest.approx(9)
    assert by["up"]["pct_change_vs_first"] == pytest.approx(180) and by["below"]["pct_change_vs_first"] is None
    assert by["up"]["change_per_decade"] == pytest.approx(10)
    assert [r["p_bh"] for r in rows] == sorted(r["p_bh"] for r in rows)


def test_series_helpers(spark, long_of):
    flat = series.min_max(long_of({"a": [1, 1], "b": [0, 4]})).orderBy("series", "t").collect()
    assert [r["x_norm"] for r in flat] == [None, None, 0.0, 1.0]
    lab = spark.createDataFrame([("s", t, c) for t, c in enumerate("aabbca")], "series string, t int, label string")
    assert sorted(r["t"] for r in series.boundaries(lab).collect()) == [2, 4, 5]
    wide = spark.createDataFrame([(1990, 0.5, None), (1990, None, 2.0), (1991, 1.0, 4.0)], "year int, a double, b double")
    means = {r["year"]: r for r in series.period_mean(wide, "year", ["a", "b"]).collect()}
    assert (means[1990]["avg_a"], means[1990]["num_a"], means[1990]["num_rows"]) == (0.5, 1, 2)
    long = series.to_long(series.period_mean(wide, "year", ["a", "b"]), "year", ["a", "b"])
    assert long.filter(F.col("series") == "b").count() == 2


def plain_slopes(t, x, ranks):
    slopes = sorted((x[j] - x[i]) / (t[j] - t[i]) for i in range(len(t)) for j in range(i + 1, len(t)))
    return [slopes[int(r) - 1] for r in ranks]


@pytest.mark.parametrize("kind", ["noise", "whole", "halves on a high level", "flat", "tiny", "line"])
def test_slopes_are_counted_as_inversions(kind):
    rng = np.random.default_rng(7)
    for n in (2, 3, 17, 90):
        t = np.sort(rng.choice(500, n, replace=False)).astype(float)
        x = {
            "noise": rng.normal(size=n), "whole": rng.integers(0, 4, n).astype(float), "halves on a high level": rng.integers(0, 9, n) / 2 + 1e6,
            "flat": np.full(n, 3.3), "tiny": rng.normal(size=n).round(6) * 1e-9, "line": np.arange(n) * -2.5,
        }[kind]
        total = n * (n - 1) // 2
        ranks = sorted({1, (total + 1) // 2, max(1, total // 3), total})
        for cells in (0, 1 << 20):
            assert stats.slope_quantiles(t, x, ranks, cells) == pytest.approx(plain_slopes(t, x, ranks), rel=1e-14)


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 64, 100):
        p = rng.permutation(n)
        assert stats._inversions(p) == sum(p[i] > p[j] for i in range(n) for j in range(i + 1, n))


def test_slope_of_a_very_long_series(long_of):
    rng = np.random.default_rng(3)
    n = 30_000
    df = long_of({"long": (0.25 * np.arange(n) + rng.normal(size=n)).tolist()})
    r = trend.sens_slope(df).first()
    assert r["n"] == n and r["ci_lo"] < r["slope"] < r["ci_hi"] and abs(r["slope"] - 0.25) < 1e-5
