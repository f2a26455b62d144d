import itertools
import math

import numpy as np
import pytest

from periodlens.functions import stats
from periodlens.functions.stats import best_partitions
from periodlens.operators import changepoint as cp
from periodlens.operators import cluster, series
from periodlens.plans import changes


def _sse(x, breaks):
    edges = [0, *breaks, len(x)]
    return sum(((x[a:b] - x[a:b].mean(axis=0)) ** 2).sum() for a, b in itertools.pairwise(edges))


def test_partition_is_the_exhaustive_minimum(long_of):
    rng = np.random.default_rng(7)
    data = {f"s{i}": rng.normal(size=9) for i in range(20)}
    for r in cp.partition(long_of(data), 3).collect():
        x = data[r["series"]]
        best = min(itertools.combinations(range(1, 9), r["m"]), key=lambda b: _sse(x, b))
        assert r["sse"] == pytest.approx(_sse(x, best), abs=1e-9) and tuple(r["breaks"]) == best


def test_blocks_do_not_matter():
    rng = np.random.default_rng(41)
    x = rng.normal(size=(2, 150))
    p1, p2 = (np.c_[np.zeros(2), v.cumsum(axis=1)] for v in (x, x * x))
    whole, small = best_partitions(p1, p2, 4), best_partitions(p1, p2, 4, cells=500)
    assert whole[1] == small[1] and whole[0] == pytest.approx(small[0])
    assert whole[0][2] == pytest.approx(_sse(x.T, whole[1][2]))


def test_more_breaks_than_points(long_of):
    rows = cp.partition(long_of({"s": [1.0, 2.0, 5.0], "one": [1.0]}), 5).collect()
    assert sorted((r["series"], r["m"]) for r in rows) == [("one", 0), ("s", 0), ("s", 1), ("s", 2)]


def _steps(rng, levels, lengths, noise):
    return np.concatenate([rng.normal(level, noise, n) for level, n in zip(levels, lengths)])


@pytest.mark.parametrize("level", [0.0, 1e7, 1e9, -3e9])
def test_steps_are_found_on_any_level(long_of, level):
    rng = np.random.default_rng(12)
    lengths = (9, 22, 14)
    data = {"up": _steps(rng, (0, 1, 2.5), lengths, 0.1), "back": _steps(rng, (3, 1, 3), lengths, 0.15)}
    raised = long_of({k: v + level for k, v in data.items()})
    found, plain = ({r["series"]: r for r in cp.detect(long).collect()} for long in (raised, long_of(data)))
    for name in data:
        # The criterion may add a break that noise suggests, but the same one on every level.
        assert found[name]["breaks"] == plain[name]["breaks"] and {9, 31} <= set(found[name]["breaks"])
        assert found[name]["sse"] == pytest.approx(plain[name]["sse"], rel=1e-4) and found[name]["sse"] >= 0
    assert all(r["breaks"] == [9, 31] for r in cp.partition(raised, 2).filter("m = 2").collect())


def test_no_number_no_point(long_of):
    rng = np.random.default_rng(14)
    x = _steps(rng, (0, 4), (12, 12), 0.1)
    holes = np.insert(x, [3, 17], [np.nan, np.inf])
    long = long_of({"s": holes})
    found = cp.detect(long).first()
    assert (found["n"], found["breaks"]) == (24, [13])
    assert cp.pettitt(long).first()["n"] == 24


def test_one_point_stays_in_the_report(long_of):
    rows = {r["series"]: r for r in changes.report(long_of({"one": [5.0], "flat": [2.0] * 6})).collect()}
    assert rows["one"]["n_change_points"] == 0 and rows["one"]["pettitt_t"] is None and set(rows) == {"one", "flat"}


def test_most_pure_noise_has_no_break(long_of):
    rng = np.random.default_rng(15)
    found = cp.detect(long_of({f"n{i}": rng.uniform(-1, 1, size=40) for i in range(150)})).collect()
    assert sum(r["m"] == 0 for r in found) > 0.7 * len(found)


def test_joint_series(long_of):
    rng = np.random.default_rng(17)
    a, b = np.r_[rng.normal(0, 0.1, 12), rng.normal(2, 0.1, 12)], rng.normal(0, 0.1, 24)
    b[18:] += 3
    found = cp.detect(changes.standardised(long_of({"a": a, "b": b, "other": b}), ("a", "b"), "ab")).first()
    assert (found["d"], found["breaks"]) == (2, [12, 18])


def test_pettitt_by_definition(long_of):
    rng = np.random.default_rng(19)
    data = {f"s{i}": rng.integers(0, 5, 15).astype(float) for i in range(20)}
    for r in cp.pettitt(long_of(data)).collect():
        x = data[r["series"]]
        u = [abs(np.sign(x[:t, None] - x[None, t:]).sum()) for t in range(1, 15)]
        assert (r["k"], r["break_t"]) == (max(u), u.index(max(u)) + 1)


def test_report_flags_the_cap(long_of):
    stairs = np.repeat(np.arange(6.0), 5) + np.tile([0, 0.01, 0, 0.01, 0], 6)
    rows = {c: changes.report(long_of({"stairs": stairs}), cap=c).first() for c in (3, 8)}
    assert not rows[3]["reliable"] and rows[8]["reliable"] and rows[8]["breaks"] == [5, 10, 15, 20, 25]


def test_segment_cost_equals_sse(spark, long_of):
    x = np.random.default_rng(23).normal(size=12)
    breaks = spark.createDataFrame([("s", 4), ("s", 9)], "series string, t int")
    rows = cp.segment_cost(long_of({"s": x}), breaks).orderBy("t_from").collect()
    assert [(r["t_from"], r["t_to"], r["points"]) for r in rows] == [(0, 3, 4), (4, 8, 5), (9, 11, 3)]
    assert sum(r["cost"] for r in rows) == pytest.approx(_sse(x, [4, 9]))


def test_agreement(spark):
    def ts(*v):
        return spark.createDataFrame([(t,) for t in v], "t int")

    assert sorted(r["t"] for r in cp.agreement(ts(1994, 2000, 2007, 2012), ts(1995, 2003, 2011, 2013)).collect()) == [1994, 2012]


def test_elbow_of_two_published_curves(spark):
    # Training cost for K = 2..10 of two clusterings with a known choice of K = 5.
    curves = {
        "means": [13.7232, 6.6950, 4.9716, 3.0134, 2.5145, 2.3038, 1.4892, 1.3917, 1.0502],
        "mix": [227.1988, 194.7135, 136.3590, 104.4034, 89.1694, 89.6076, 67.9840, 58.1721, 52.7128],
    }
    df = spark.createDataFrame([(s, k + 2, c) for s, cs in curves.items() for k, c in enumerate(cs)], "s string, k int, cost double")
    assert {r["s"]: r["best_k"] for r in cluster.elbow(df, ("s",)).collect()} == {"means": 5, "mix": 5}
    assert cluster.elbow(df.filter("k < 4"), ("s",)).count() == 0


def _sums(x):
    x = np.atleast_2d(np.asarray(x, dtype=float))
    x = x - x.mean(axis=1, keepdims=True)
    zero = np.zeros((len(x), 1))
    return np.hstack((zero, x.cumsum(axis=1))), np.hstack((zero, (x * x).cumsum(axis=1)))


def _all_starts(p1, p2, max_breaks):
    """The programme over every last break, end by end."""
    n = p1.shape[1] - 1
    top = min(max_breaks, n - 1)
    cost = np.full((top + 1, n + 1), math.inf)
    for e in range(1, n + 1):
        s = np.arange(e)
        segment = sum(np.maximum(b[e] - b[s] - (a[e] - a[s]) ** 2 / (e - s), 0) for a, b in zip(p1, p2))
        cost[0, e] = segment[0]
        for j in range(1, top + 1):
            cost[j, e] = (cost[j - 1, s] + segment).min()
    return cost[:, n]


@pytest.mark.parametrize("kind", range(6))
def test_given_up_breaks_were_not_needed(kind):
    """Errors are those of all last breaks, and the breaks found have these errors."""
    rng = np.random.default_rng(kind)
    for n, d in ((1, 1), (2, 1), (7, 1), (60, 1), (150, 1), (400, 1), (30, 2), (90, 3)):
        x = (
            rng.normal(size=(d, n)), rng.integers(0, 3, (d, n)), np.repeat(rng.integers(0, 2, (d, n // 10 + 1)), 10, axis=1)[:, :n],
            np.full((d, n), 0.1), 1e9 + rng.normal(size=(d, n)), np.cumsum(rng.integers(-1, 2, (d, n)), axis=1) * 1e-8,
        )[kind]
        p1, p2 = _sums(x)
        want = _all_starts(p1, p2, 5)
        for block in (1, 16, 64):
            sse, breaks = stats.best_partitions(p1, p2, 5, block=block)
            near = 1e-12 * max(1e-12, float(p2[:, -1].sum()))
            assert np.allclose(sse, want, rtol=1e-9, atol=near)
            for m, path in enumerate(breaks):
                ends = [0, *path, n]
                assert len(path) == m and ends == sorted(set(ends))
                cost = sum(((x[:, a:b] - x[:, a:b].mean(axis=1, keepdims=True)) ** 2).sum() for a, b in zip(ends, ends[1:]))
                assert cost == pytest.approx(sse[m], rel=1e-6, abs=max(near, 1e-4 if kind == 4 else 0))


def test_a_hundred_thousand_points(monkeypatch):
    """Few last breaks are looked at per end, with breaks as in noise alone, and in long stretches of equal values."""
    looked = []
    segments = stats._segments
    monkeypatch.setattr(stats, "_segments", lambda p1, p2, s, e: looked.append(s.size * e.size) or segments(p1, p2, s, e))
    rng = np.random.default_rng(5)
    n = 100_000
    x = rng.normal(size=n)
    x[n // 3 :] += 1
    x[n // 2 :] -= 2
    _, breaks = stats.best_partitions(*_sums(x), 2)
    assert abs(breaks[2][0] - n // 3) < 20 and abs(breaks[2][1] - n // 2) < 20
    assert sum(looked) < 1000 * 2 * n
    for flat in (np.zeros(20_000), np.r_[rng.normal(size=500), np.full(19_000, 0.1), rng.normal(size=500)]):
        looked.clear()
        stats.best_partitions(*_sums(flat), 2)
        assert sum(looked) < 1000 * 2 * flat.size
