"""Published results for two yearly series of song features."""

import pytest

from periodlens.operators import changepoint, cluster
from periodlens.plans import changes, trends

# Yearly means 1990..2022, rounded to ten digits.
VALENCE = [
    0.5286800815, 0.5202183211, 0.5088689635, 0.5144898868, 0.5169748584, 0.5027977763, 0.5283620697, 0.5162977137,
    0.5080143687, 0.5061190128, 0.4912254924, 0.4792238617, 0.4803463388, 0.4758234287, 0.4710819010, 0.4813642993,
    0.4706006986, 0.4636172537, 0.4610175696, 0.4586104408, 0.4527093083, 0.4488043979, 0.4340067560, 0.4375911932,
    0.4346238210, 0.4207625486, 0.4169968511, 0.4260843075, 0.4279515886, 0.4314927695, 0.4248817307, 0.4304250524,
    0.4527241106,
]
ENERGY = [
    0.5969722362, 0.5824531759, 0.6042160759, 0.5851872002, 0.6220848592, 0.6137209666, 0.6193744508, 0.6046389538,
    0.6250307504, 0.6460775598, 0.6830347536, 0.6760040066, 0.6851271912, 0.6920467851, 0.6837535637, 0.6756299251,
    0.6855644071, 0.7004644779, 0.7101816777, 0.7057967381, 0.7173660528, 0.7164614329, 0.7142879969, 0.7064729755,
    0.6996169408, 0.6908950820, 0.6962183104, 0.6790234752, 0.6744527684, 0.6824930466, 0.6826312621, 0.6998389538,
    0.6965772088,
]
# Published S, tau, Z, p, slope and its interval.
TRENDS = {
    "valence": (-432, -0.8181818181818182, -6.67809186905389, 2.4207328315895318e-11, -0.0036339555938857656,
                -0.004043855964724185, -0.003219553903280625),
    "energy": (272, 0.5151515151515151, 4.198985838778664, 2.681130854238712e-05, 0.003400378915411116,
               0.002319540270867637, 0.004711096789308039),
}


@pytest.fixture(scope="module")
def long(long_of):
    return long_of({"valence": VALENCE, "energy": ENERGY}, 1990).persist()


def test_trends(long):
    for r in trends.table(long).collect():
        s, tau, z, p, slope, lo, hi = TRENDS[r["series"]]
        assert r["s"] == s and r["tau"] == pytest.approx(tau) and r["z"] == pytest.approx(z)
        assert r["p_raw"] == pytest.approx(p, rel=1e-9)
        assert (r["sen_slope"], r["ci_lo"], r["ci_hi"]) == pytest.approx((slope, lo, hi), rel=1e-6)


def test_joint_breaks_and_ranked_breaks(long):
    joint = changepoint.detect(changes.standardised(long, ("valence", "energy"), "both")).first()
    assert joint["breaks"] == [1994, 2000, 2007, 2012]
    ranked = {r["series"]: r for r in changepoint.pettitt(long).collect()}
    assert ranked["valence"]["break_t"] == 2006 and ranked["valence"]["p"] == pytest.approx(1.242458315182204e-05)
    assert ranked["energy"]["break_t"] == 2002 and ranked["energy"]["p"] == pytest.approx(0.000206354255278862)


def test_agreement_with_clusters(spark, long):
    edges = spark.createDataFrame([(y,) for y in (1994, 1996, 1998, 2000, 2007, 2012, 2022)], "t int")
    breaks = spark.createDataFrame([(y,) for y in (1994, 2000, 2007, 2012)], "t int")
    assert changepoint.agreement(breaks, edges).count() == 4


def test_clustering_comes_close_to_the_published_cost(long):
    wide = long.groupBy("t").pivot("series", ["valence", "energy"]).max("x")
    eras = cluster.cluster(wide, "t", ["valence", "energy"], [], seeds=range(6))
    cost = {r["k"]: r["wssse"] for r in eras.elbow.collect()}
    # The outcome for larger K depends on the seed and the partitions; two clusters are unambiguous.
    assert cost[2] == pytest.approx(13.7232, abs=1e-3) and cost[5] <= 3.1
