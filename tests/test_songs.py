"""The whole song analysis on a small made-up table read from CSV."""

import random

import pytest

from periodlens.functions.words import AUDIO_FEATURES, EMOTIONS
from periodlens.operators import consensus, labels
from periodlens.plans import songs as plan
from periodlens.sources import tables


@pytest.fixture(scope="module")
def songs(spark, tmp_path_factory):
    rng = random.Random(37)
    rows = []
    for i in range(330):
        year = 1990 + i % 33
        late = year >= 2006
        row = {f: round(rng.uniform(0.2, 0.4) + (0.4 if late else 0), 4) for f in AUDIO_FEATURES}
        row |= {
            "id": f"s{i}", "name": f"Song, \"{i}\"", "artists": f"['A{i % 40}', 'B{i % 9}']",
            "genre": ("Rock", "Pop", "Jazz")[i % 3 if late else 0], "niche_genres": "n", "year": year,
            "popularity": i % 5, "key": i % 13 - 1, "mode": i % 2, "duration_ms": 180000.0 + 1000 * (year - 1990),
            "lyrics": "\n".join(f"my {'love' if late else 'lonely'} heart {j}" for j in range(i % 18 + 1)),
        }
        rows.append(row)
    rows[0]["valence"], rows[1]["lyrics"], rows[2]["year"] = 1.1, None, 1989
    schema = tables.SONG_SCHEMA
    df = spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema)
    path = str(tmp_path_factory.mktemp("songs") / "csv")
    tables.write_delimited(df.select(*sorted(df.columns)), path, sep=",")
    return plan.usable(plan.load(spark, path)).persist()


def test_reads_and_cleans(songs):
    assert songs.count() == 327 and plan.popular(songs).filter("popularity <= 0").count() == 0


def test_averages_and_themes(songs):
    by_year = {r["year"]: r for r in plan.features_by_year(songs).collect()}
    assert len(by_year) == 33 and by_year[2000]["avg_duration_sec"] == pytest.approx(190) and by_year[1992]["num_valence"] == 9
    assert {r["genre"] for r in plan.tempo_by_genre(songs).collect()} == {"Rock", "Pop", "Jazz"}
    assert [r["year"] for r in plan.love_and_lust(songs, "year").collect()] == list(range(2022, 1989, -1))
    lonely = {r["year"]: r["normalized_lonely"] for r in plan.loneliness_by_year(songs).collect()}
    assert lonely[2010] == 0 and max(lonely.values()) == 1


def test_trends_and_changes(songs):
    trend = {r["series"]: r for r in plan.feature_trends(songs).collect()}
    assert len(trend) == 10 and trend["duration_sec"]["tau"] == 1 and trend["duration_sec"]["sen_slope"] == pytest.approx(1)
    report = {r["series"]: r for r in plan.feature_changes(songs).collect()}
    assert set(report) == set(plan.REPORTED) and report["danceability"]["pettitt_t"] == 2006
    assert not report["duration_sec"]["reliable"]


def test_eras_emotions_and_consensus(songs, spark, folder):
    mood, genre = plan.mood_eras(songs, range(2, 5)), plan.genre_eras(songs, range(2, 5))
    changes = {(r["method"], r["target"]): r for r in plan.mood_changes(songs, mood).collect()}
    assert len(changes) == 5 and "2006" in changes[("optimal_partition_bic", "valence+energy")]["break_periods"]
    lexicon = labels.LexiconLabeller({e: {"love": ["love"], "sadness": ["lonely"]}.get(e, [f"{e}word"]) for e in EMOTIONS})
    assert len(plan.label_emotions(songs, folder, lexicon)) == 33
    emotions = plan.song_emotions(spark, folder)
    got = {(r["year"] >= 2006, r["song_emotion"]) for r in emotions.collect()}
    assert got == {(True, "love"), (False, "sadness")}
    tested = {r["label"]: r for r in plan.emotion_trends(emotions).collect()}
    assert tested["love"]["direction"] == "increasing" and tested["love"]["share_last"] == 1
    votes = plan.consensus_years(songs, emotions, mood, genre)
    best = consensus.top(votes).first()
    assert votes.count() == 33 and best["t"] == 2006 and "genre clusters" in best["signals"]


def test_recommender(songs):
    index = plan.neighbour_index(songs)
    rows = plan.recommend(index, songs, ["s50"], 5).collect()
    assert len(rows) == 5 and set(plan.DISPLAY) <= set(rows[0].asDict())
    seed = songs.filter("id = 's50'").first()["artists"]
    assert all(not set(eval(r["artists"])) & set(eval(seed)) for r in rows)  # noqa: S307
