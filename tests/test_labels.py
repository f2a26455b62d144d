import math

import pytest
from pyspark.sql import functions as F

from periodlens.functions import labels as fx
from periodlens.functions.words import EMOTIONS
from periodlens.operators import agreement, consensus, labels, skew
from periodlens.plans import label_job
from periodlens.sources import progress

JOY, SAD, ANGER, LOVE, FEAR = EMOTIONS


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(1, 1990, 2, 0, 0, 2, 0), (2, 1990, 0, 0, 0, 0, 0), (3, 1991, 0, 1, 3, 0, 0), (4, 1991, 1, 1, 1, 0, 0)]
    return spark.createDataFrame(rows, "id int, year int, " + ", ".join(f"{e} bigint" for e in EMOTIONS))


def test_argmax_over_counts(counts):
    got = counts.select("id", fx.argmax_counts(EMOTIONS).alias("f"), fx.argmax_counts(EMOTIONS, "null").alias("n"),
                        fx.tied_set(EMOTIONS).alias("t"), fx.tie_size(EMOTIONS).alias("k")).orderBy("id").collect()
    assert [r["f"] for r in got] == [JOY, None, ANGER, JOY]
    assert [r["n"] for r in got] == [None, None, ANGER, None]
    assert [r["t"] for r in got] == ["joy+love", None, None, "joy+sadness+anger"]
    assert [r["k"] for r in got] == [2, 0, 1, 3]


def test_ties_by_confidence(counts):
    df = counts.withColumns({f"sum_conf_{e}": F.lit(c) for e, c in zip(EMOTIONS, (0.5, 0.9, 0.2, 0.8, 0.99))})
    got = labels.dominant(df, EMOTIONS, "confidence").orderBy("id").collect()
    assert [r["entity_label"] for r in got] == [LOVE, None, ANGER, SAD]


def test_weights_and_shares(counts):
    w = labels.tie_weights(counts, EMOTIONS).orderBy("id").collect()
    assert [w[0][e] for e in EMOTIONS] == [0.5, 0, 0, 0.5, 0] and [w[1][e] for e in EMOTIONS] == [0] * 5
    for level in ("entity", "chunk"):
        for r in labels.shares(counts, "year", EMOTIONS, level).collect():
            assert sum(r[e] for e in EMOTIONS) == pytest.approx(1)
    report = {r["year"]: r for r in labels.share_report(counts, "year", EMOTIONS).collect()}
    assert report[1991]["song_anger"] == pytest.approx(2 / 3) and report[1991]["chunk_anger"] == pytest.approx(4 / 7)
    audit = labels.tie_audit(counts, EMOTIONS).first()
    assert (audit["entities"], audit["tied"], audit["unlabelled"], audit["tied_pct"]) == (4, 2, 1, 50.0)


def test_argmax_over_confidences(spark):
    rows = [({"joy": "0.2", "fear": "0.7", "noise": "0.9"},), ({"joy": "x", "fear": "0.0"},), ({"noise": "1"},), (None,)]
    df = spark.createDataFrame(rows, "m map<string,string>")
    got = df.select(fx.argmax_confidence("m", EMOTIONS).alias("l"), fx.confidence("m", "joy").alias("j")).collect()
    assert [r["l"] for r in got] == [FEAR, JOY, None, None] and [r["j"] for r in got] == [0.2, None, None, None]


class Counting:
    """A labeller that notes how many texts it was given."""

    def __init__(self, spark):
        self.seen = spark.sparkContext.accumulator(0)

    def transform(self, df, text):
        seen = self.seen

        @F.pandas_udf("string")
        def pick(s):
            seen.add(len(s))
            return s.str.len().map(lambda n: "joy" if n % 2 else "fear")

        return df.withColumn("label", pick(F.col(text))).withColumn("scores", F.create_map(F.col("label"), F.lit(1.0)))


def test_hot_text_keeps_its_rows_and_is_labelled_once(spark, monkeypatch):
    rows = [(i, 0, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    chunks = spark.createDataFrame(rows, "id int, chunk_no int, chunk string")
    distinct = labels.distinct_texts(chunks)
    hot = skew.hot_keys(distinct, ["chunk"], "copies", rows_per_task=100).collect()
    assert len(hot) == 1 and hot[0]["_salts"] == 20
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (100,))
    for keep_text in (False, True):
        labeller = Counting(spark)
        out = labels.label_chunks(chunks, labeller, EMOTIONS, ["id", "chunk_no"], keep_text=keep_text)
        assert ("chunk" in out.columns) == keep_text
        got = out.collect()
        assert len(got) == 3000 and labeller.seen.value == 1001
        by_id = {r["id"]: r for r in got}
        assert all(by_id[i]["dominant_label"] == (JOY if len(c) % 2 else FEAR) for i, _, c in rows)
        assert not keep_text or all(by_id[i]["chunk"] == c for i, _, c in rows)


def test_restart_takes_only_what_is_left(spark, folder):
    docs = spark.createDataFrame(
        [(i, 2000 + i % 4, "\n".join(f"joyful line {j % (i + 1)}" for j in range(i % 20))) for i in range(60)],
        "id int, year int, text string",
    )
    lexicon = labels.LexiconLabeller({e: [e + "ful"] for e in EMOTIONS})
    run = lambda d, **kw: label_job.run(d, folder, ["id"], "year", "text", lexicon, EMOTIONS, **kw)
    assert run(docs.filter("year < 2002")) == [2000, 2001]
    # A run that broke off after writing but before recording is done again and leaves no second copy.
    broken = docs.filter("year = 2002")
    first = label_job.saved_chunks(spark, folder).count()
    record, progress.record = progress.record, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        with pytest.raises(RuntimeError):
            run(broken)
    finally:
        progress.record = record
    assert label_job.saved_chunks(spark, folder).count() > first
    assert run(docs, rows_per_commit=1) == [2002, 2003]
    assert run(docs) == []
    rolled = label_job.roll_up(spark, folder, ["id", "year"], EMOTIONS).collect()
    expected = {i: -(-(i % 20) // 8) for i in range(60) if i % 20}
    assert {r["id"]: r["joy"] for r in rolled} == expected and {r["entity_label"] for r in rolled} == {JOY}


def test_texts_are_labelled_once_over_all_commits(spark, folder):
    docs = spark.createDataFrame(
        [(i, None if i % 5 == 4 else 2000 + i % 5, f"joyful text {i % 3}" if i else None) for i in range(30)],
        "id int, year int, text string",
    )
    labeller = Counting(spark)
    run = lambda rows: label_job.run(rows, folder, ["id"], "year", "text", labeller, EMOTIONS, rows_per_commit=6)
    # The job breaks off after its second commit and is started again. NULL is the first period.
    record, calls = progress.record, []

    def breaking(spark, manifest, *a):
        calls.append(manifest)
        if len(calls) > 4:
            raise RuntimeError("lost")
        record(spark, manifest, *a)

    progress.record = breaking
    try:
        with pytest.raises(RuntimeError):
            run(docs)
    finally:
        progress.record = record
    assert run(docs) == [2001, 2002, 2003]
    assert label_job.saved_chunks(spark, folder).count() == 29 and labeller.seen.value == 3
    assert sorted(r["texts"] for r in label_job.labelled_texts(spark, folder).collect()) == [0, 0, 0, 0, 3]


def test_null_texts_keep_their_rows(spark):
    chunks = spark.createDataFrame([(1, 0, None), (2, 0, "joyful"), (3, 0, None)], "id int, chunk_no int, chunk string")
    lexicon = labels.LexiconLabeller({e: [e + "ful"] for e in EMOTIONS})
    got = {r["id"]: r["dominant_label"] for r in labels.label_chunks(chunks, lexicon, EMOTIONS, ["id"]).collect()}
    assert got == {1: None, 2: JOY, 3: None}


def test_agreement(spark):
    df = spark.createDataFrame([("a", "a", True), ("a", "b", False), ("a", "b", False), ("c", "a", False)], "x string, y string, t boolean")
    s = agreement.summary(df, "x", "y", "t").first()
    assert (s["entities"], s["agreements"], s["disagreements"], s["ties"], s["agreement_pct"]) == (4, 1, 3, 1, 25.0)
    assert [tuple(r) for r in agreement.confusion(df, "x", "y").collect()] == [("a", "b", 2), ("c", "a", 1)]
    assert [tuple(r) for r in agreement.involvement(df, "x", "y").collect()] == [("a", 3), ("b", 2), ("c", 1)]


def test_missing_labels_are_labels(spark):
    pairs = [("a", None), (None, None), (None, "b"), ("a", "a"), ("b", "a"), (None, "b")]
    df = spark.createDataFrame(pairs, "x string, y string")
    s = agreement.summary(df, "x", "y").first()
    assert (s["entities"], s["agreements"], s["disagreements"]) == (6, 2, 4)
    confused = {(r["x"], r["y"]): r["count"] for r in agreement.confusion(df, "x", "y").collect()}
    assert confused == {("a", None): 1, (None, "b"): 2, ("b", "a"): 1} and sum(confused.values()) == s["disagreements"]
    sides = {r["label"]: r["count"] for r in agreement.involvement(df, "x", "y").collect()}
    assert sides == {"a": 2, "b": 3, None: 3} and sum(sides.values()) == 2 * s["disagreements"]


def test_votes(spark):
    sig = spark.createDataFrame(
        [("late", "g", 2, 2000), ("early", "f", 1, 2000), ("early", "f", 1, 2001), ("far", "f", 1, 1980), ("edge", "f", 1, 1989)],
        "signal string, grp string, ord int, t int",
    )
    spine = spark.range(1990, 2004).selectExpr("cast(id AS int) AS t")
    got = {r["t"]: r for r in consensus.vote(sig, spine, names=True).collect()}
    assert len(got) == 14
    assert (got[2000]["votes"], got[2000]["votes_pm1"], got[2000]["signals"]) == (2, 3, "early; late")
    assert (got[2002]["votes"], got[2002]["votes_pm1"], got[2002]["signals"]) == (0, 1, "")
    assert got[1990]["votes_pm1"] == 0
    assert [r["t"] for r in consensus.top(consensus.vote(sig, spine)).collect()] == [2000, 2001]
    assert [r["signal"] for r in consensus.listing(sig).collect()] == ["early", "edge", "far", "late"]


def test_word_bayes_by_definition(spark):
    train = [("good fine good", "a"), ("bad poor", "b"), ("fine", "a"), ("poor poor good", "b"), ("other", None)]
    model = labels.WordBayesLabeller.fit(spark.createDataFrame(train, "t string, y string"), "t", "y", ["a", "b"])
    asked = spark.createDataFrame([("Good, FINE!",), ("poor bad",), ("new words",), (None,), ("poor bad",)], "t string")
    got = [(r["t"], r["label"], r["scores"]["a"]) for r in model.transform(asked, "t").collect()]
    count = {"a": {"good": 2, "fine": 2}, "b": {"bad": 1, "poor": 3, "good": 1}}
    def share(words):
        p = {y: 0.5 for y in count}
        for y in count:
            for w in words:
                p[y] *= (count[y].get(w, 0) + 1) / (sum(count[y].values()) + 4)
        return p["a"] / (p["a"] + p["b"])
    want = {"Good, FINE!": share(["good", "fine"]), "poor bad": share(["poor", "bad"]), "new words": 0.5, None: 0.5}
    assert len(got) == 5
    for text, label, fine in got:
        assert fine == pytest.approx(want[text]) and label == ("a" if want[text] >= 0.5 else "b")


def test_batches_score_as_the_joined_words_do(spark, monkeypatch):
    """Both ways of scoring agree with the definition: unknown words, no words, NULL texts and repeated rows included."""
    train = [("good fine day", "a"), ("bad day day", "b"), ("fine", "a"), (None, "b"), ("neither", "c")]
    texts = ["fine day", "", None, "unknown only", "Day, DAY; bad", "fine day", "good " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    model = labels.WordBayesLabeller.fit(spark.createDataFrame(train, "t string, y string"), "t", "y", ["a", "b"])
    counts = {"a": {"good": 1, "fine": 2, "day": 1}, "b": {"bad": 1, "day": 2}}

    def expected(text):
        words = [w for w in (text or "").lower().replace(",", " ").replace(";", " ").split() if w in {"good", "fine", "day", "bad"}]
        logs = [math.log(3 / 6) + sum(math.log((c.get(w, 0) + 1) / (sum(c.values()) + 4)) for w in words) for c in counts.values()]
        return 1 / (1 + math.exp(min(700, logs[1] - logs[0])))

    for most in (labels.MOST_BYTES, 0):
        monkeypatch.setattr(labels, "MOST_BYTES", most)
        for parts in (1, 4):
            rows = {r["i"]: r for r in model.transform(df.repartition(parts), "t").collect()}
            assert len(rows) == len(texts)
            for i, t in enumerate(texts):
                assert rows[i]["scores"]["a"] == pytest.approx(expected(t), abs=1e-9)
                assert rows[i]["label"] == ("a" if expected(t) >= 0.5 else "b")
    empty = labels.WordBayesLabeller.fit(spark.createDataFrame([], "t string, y string"), "t", "y", ["a", "b"])
    assert {r["scores"]["a"] for r in empty.transform(df, "t").collect()} == {0.5}
