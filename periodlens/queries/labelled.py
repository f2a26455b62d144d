"""Labelling document chunks, roll-up per document, shares, ties and agreement of labellers."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodlens.functions import labels as fx
from periodlens.operators import agreement, labels, text
from periodlens.queries.inputs import LABELS, NAMES, documents, r, read, rounded
from periodlens.queries.sql import COUNTS, CHUNKS, FIRST, TIED, TOP, WORDS, scored, weight
from periodlens.sources.tables import settle

KEYS = ["doc_id", "lang", "period"]
LEXICON = labels.LexiconLabeller(LABELS)


def _chunks(spark, sf):
    return text.chunks(documents(spark, sf), KEYS, "text")


def _labelled(spark, sf):
    return labels.label_chunks(_chunks(spark, sf), LEXICON, NAMES, ["doc_id", "chunk_no"])


def _counts(spark, sf, confidences=False):
    return labels.count_labels(_labelled(spark, sf), KEYS, NAMES, confidences=confidences)


def distinct_chunks(spark, sf):
    return labels.distinct_texts(_chunks(spark, sf))


def lexicon_label(spark, sf):
    """Each distinct chunk with its label and confidences."""
    return rounded(labels.label_distinct(_chunks(spark, sf), LEXICON, NAMES).drop("label"))


def dedupe_label_join(spark, sf):
    """Every chunk row with the label of its text."""
    return rounded(_labelled(spark, sf).drop("label"))


def label_counts(spark, sf):
    return _counts(spark, sf)


def dominant_label(spark, sf):
    out = _counts(spark, sf)
    for ties in ("first", "null"):
        out = labels.dominant(out, NAMES, ties, out=f"label_{ties}")
    return out.select("doc_id", "label_first", "label_null")


def tie_break_by_confidence(spark, sf):
    return labels.dominant(_counts(spark, sf, confidences=True), NAMES, "confidence", out="label_confidence").select("doc_id", "label_confidence")


def tied_set(spark, sf):
    return _counts(spark, sf).select("doc_id", fx.tie_size(NAMES).alias("k"), fx.tied_set(NAMES).alias("tied_set"))


def label_distribution(spark, sf):
    return labels.label_distribution(labels.dominant(_counts(spark, sf), NAMES))


def tie_weights(spark, sf):
    return rounded(labels.tie_weights(_counts(spark, sf), NAMES))


def tie_share(spark, sf):
    return rounded(labels.shares(_counts(spark, sf), "period", NAMES, "entity", "tieaware_"))


def share_totals(spark, sf):
    """The shares of a period add up to one."""
    shares = labels.shares(_counts(spark, sf), "period", NAMES, "entity")
    return shares.select("period", r(sum((F.col(n) for n in NAMES[1:]), F.col(NAMES[0]))).alias("total"))


def chunk_share(spark, sf):
    return rounded(labels.shares(_counts(spark, sf), "period", NAMES, "chunk"))


def share_report(spark, sf):
    return rounded(labels.share_report(_counts(spark, sf), "period", NAMES))


def overall_share(spark, sf):
    return rounded(labels.overall_share(_counts(spark, sf), NAMES))


def tie_audit(spark, sf):
    return rounded(labels.tie_audit(_counts(spark, sf), NAMES))


def tie_multiplicity(spark, sf):
    return labels.tie_multiplicity(_counts(spark, sf), NAMES)


def _two_labellers(spark, sf):
    """Per document: the label most of its chunks have, and the label of its text as a whole."""
    by_chunk = labels.dominant(_counts(spark, sf), NAMES, out="a").withColumn("tied", fx.tie_size(NAMES) > 1)
    whole = labels.run_labeller(documents(spark, sf).select("doc_id", "text"), LEXICON, NAMES, "text")
    # A text without a chunk has no label by chunks; one without a match has none either way. Both count as "none".
    both = whole.select("doc_id", F.col("dominant_label").alias("b")).join(by_chunk, "doc_id", "left")
    none = F.lit("none")
    both = both.select("doc_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"), F.coalesce("tied", F.lit(False)).alias("tied"))
    # Written out first: a filter on a label would otherwise move below the join and work the label out twice.
    return settle(both, "labellers")


def label_agreement(spark, sf):
    return rounded(agreement.summary(_two_labellers(spark, sf), "a", "b", "tied"))


def label_confusion(spark, sf):
    return agreement.confusion(_two_labellers(spark, sf), "a", "b")


def label_involvement(spark, sf):
    return agreement.involvement(_two_labellers(spark, sf), "a", "b")


def label_histogram(spark, sf):
    return agreement.histogram(_two_labellers(spark, sf), "b")


def quality_agreement(spark, sf):
    """Two outside label columns against each other."""
    marks = read(spark, sf, "labels").select(
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("a"),
        F.when(F.col("toxic") == 0, "good").otherwise("bad").alias("b"),
    )
    return rounded(agreement.summary(marks, "a", "b"))


def model_label(spark, sf):
    """Naive Bayes over all words of the labelled documents, applied to every distinct chunk."""
    docs = documents(spark, sf)
    train = docs.join(read(spark, sf, "labels"), "doc_id").select(
        "text", F.when(F.col("quality") == 1, "fine").otherwise("poor").alias("y")
    )
    model = labels.WordBayesLabeller.fit(train, "text", "y", ["poor", "fine"])
    chunks = text.chunks(docs, KEYS, "text")
    return labels.label_distinct(chunks, model, ["poor", "fine"]).groupBy("dominant_label").agg(
        F.count("*").alias("texts"), F.sum("copies").alias("chunks"), r(F.avg("conf_fine")).alias("avg_conf_fine")
    )


QUERIES = {
    f.__name__: f
    for f in (
        distinct_chunks, lexicon_label, dedupe_label_join, label_counts, dominant_label, tie_break_by_confidence,
        tied_set, label_distribution, tie_weights, tie_share, share_totals, chunk_share, share_report, overall_share, tie_audit,
        tie_multiplicity, label_agreement, label_confusion, label_involvement, label_histogram, quality_agreement,
        model_label,
    )
}

_confs = ", ".join(f"round(conf_{n}, 6) AS conf_{n}" for n in NAMES)
_counts_out = ", ".join(NAMES)
_total = " + ".join(NAMES)
_weights = ", ".join(f"{weight(n)} AS w_{n}" for n in NAMES)
_wsum = " + ".join(f"sum(w_{n})" for n in NAMES)
_csum = " + ".join(f"sum({n})" for n in NAMES)
_WEIGHTED = f"{COUNTS}, weighted AS (SELECT *, {_weights}, {TIED} AS k FROM counts)"
_conf_pick = "CASE " + " ".join(
    f"WHEN {n} = {TOP} AND {TOP} > 0 AND round(sum_conf_{n}, 9) = best THEN '{n}'" for n in NAMES
) + " END"
_best_conf = "greatest(" + ", ".join(
    f"CASE WHEN {n} = {TOP} AND {TOP} > 0 THEN round(sum_conf_{n}, 9) END" for n in NAMES
) + ")"
_names = " || ".join(f"CASE WHEN {n} = {TOP} THEN '+{n}' ELSE '' END" for n in NAMES)
_TWO = f"""{COUNTS}, docs AS (SELECT doc_id, text FROM documents), {scored('docs', 'text', 'whole')},
    two AS (SELECT doc_id, {FIRST} AS a, {TIED} > 1 AS tied, w.dominant_label AS b
            FROM whole w LEFT JOIN counts c USING (doc_id)),
    both_set AS (SELECT doc_id, coalesce(a, 'none') AS a, coalesce(b, 'none') AS b, coalesce(tied, false) AS tied FROM two)"""
_AGREE = """count(*) AS entities, count(*) FILTER (a = b) AS agreements, count(*) FILTER (a <> b) AS disagreements,
    round(count(*) FILTER (a = b) * 100.0::DOUBLE / count(*), 6) AS agreement_pct"""

ORACLES = {
    "model_label": f"""WITH {CHUNKS}, train AS (SELECT text, quality = 1 AS fine FROM documents JOIN labels USING (doc_id)),
        spoken AS (SELECT fine, unnest({WORDS.format(text='text')}) AS w FROM train),
        c AS (SELECT w, count(*) FILTER (NOT fine) AS c0, count(*) FILTER (fine) AS c1 FROM spoken WHERE w <> '' GROUP BY 1),
        t AS (SELECT sum(c0)::BIGINT AS n0, sum(c1)::BIGINT AS n1, count(*) AS v FROM c),
        p AS (SELECT ln((count(*) FILTER (NOT fine) + 1)::DOUBLE / (count(*) + 2)) AS l0,
                     ln((count(*) FILTER (fine) + 1)::DOUBLE / (count(*) + 2)) AS l1 FROM train),
        d AS (SELECT chunk, count(*) AS copies FROM chunks GROUP BY 1),
        dw AS (SELECT chunk, unnest({WORDS.format(text='chunk')}) AS w FROM d),
        s AS (SELECT chunk, sum(ln((c0 + 1)::DOUBLE / (n0 + v))) AS s0, sum(ln((c1 + 1)::DOUBLE / (n1 + v))) AS s1
              FROM dw JOIN c USING (w) CROSS JOIN t GROUP BY 1),
        f AS (SELECT copies, 1 / (1 + exp(least(700.0::DOUBLE, (coalesce(s0, 0) + l0) - (coalesce(s1, 0) + l1)))) AS fine
              FROM d LEFT JOIN s USING (chunk) CROSS JOIN p)
        SELECT CASE WHEN fine > 0.5 THEN 'fine' ELSE 'poor' END AS dominant_label, count(*) AS texts,
            sum(copies)::BIGINT AS chunks, round(avg(fine), 6) AS avg_conf_fine FROM f GROUP BY 1""",
    "distinct_chunks": f"WITH {CHUNKS} SELECT chunk, count(*) AS copies FROM chunks GROUP BY 1",
    "lexicon_label": f"""WITH {CHUNKS}, d AS (SELECT chunk, count(*) AS copies FROM chunks GROUP BY 1), {scored('d', 'chunk', 'lab')}
        SELECT chunk, copies, {_confs}, dominant_label FROM lab""",
    "dedupe_label_join": f"""WITH {CHUNKS}, {scored('chunks', 'chunk', 'lab')}
        SELECT doc_id, lang, period, chunk_no, {_confs}, dominant_label FROM lab""",
    "label_counts": f"WITH {COUNTS} SELECT doc_id, lang, period, {_counts_out} FROM counts",
    "dominant_label": f"""WITH {COUNTS} SELECT doc_id, {FIRST} AS label_first,
        CASE WHEN {TIED} = 1 THEN {FIRST} END AS label_null FROM counts""",
    "tie_break_by_confidence": f"""WITH {COUNTS}, b AS (SELECT *, {_best_conf} AS best FROM counts)
        SELECT doc_id, {_conf_pick} AS label_confidence FROM b""",
    "tied_set": f"""WITH {COUNTS} SELECT doc_id, {TIED} AS k,
        CASE WHEN {TIED} > 1 THEN substr({_names}, 2) END AS tied_set FROM counts""",
    "label_distribution": f"WITH {COUNTS} SELECT {FIRST} AS entity_label, count(*) AS count FROM counts GROUP BY 1",
    "tie_weights": f"WITH {_WEIGHTED} SELECT doc_id, lang, period, "
        + ", ".join(f"round(w_{n}, 6) AS {n}" for n in NAMES) + " FROM weighted",
    "tie_share": f"WITH {_WEIGHTED} SELECT period, "
        + ", ".join(f"round(sum(w_{n}) / nullif({_wsum}, 0), 6) AS tieaware_{n}" for n in NAMES) + " FROM weighted GROUP BY 1",
    "share_totals": f"WITH {_WEIGHTED} SELECT period, CASE WHEN {_wsum} > 0 THEN 1.0::DOUBLE END AS total FROM weighted GROUP BY 1",
    "chunk_share": f"WITH {COUNTS} SELECT period, "
        + ", ".join(f"round(sum({n})::DOUBLE / nullif({_csum}, 0), 6) AS {n}" for n in NAMES) + " FROM counts GROUP BY 1",
    "share_report": f"WITH {_WEIGHTED} SELECT period, "
        + ", ".join(f"round(sum(w_{n}) / nullif({_wsum}, 0), 6) AS song_{n}" for n in NAMES) + ", "
        + ", ".join(f"round(sum({n})::DOUBLE / nullif({_csum}, 0), 6) AS chunk_{n}" for n in NAMES)
        + " FROM weighted GROUP BY 1",
    "overall_share": f"WITH {_WEIGHTED}, s AS (SELECT "
        + ", ".join(f"sum(w_{n}) AS s_{n}" for n in NAMES) + " FROM weighted) "
        + " UNION ALL ".join(
            f"SELECT '{n}' AS label, round(s_{n}, 6) AS weight, round(s_{n} * 100 / ("
            + " + ".join(f"s_{o}" for o in NAMES) + "), 6) AS pct FROM s" for n in NAMES
        ),
    "tie_audit": f"""WITH {_WEIGHTED} SELECT count(*) AS entities, count(*) FILTER (k > 1) AS tied,
        count(*) FILTER (k = 0) AS unlabelled, round(count(*) FILTER (k > 1) * 100.0::DOUBLE / count(*), 6) AS tied_pct
        FROM weighted""",
    "tie_multiplicity": f"WITH {_WEIGHTED} SELECT k AS tied_labels, count(*) AS entities FROM weighted WHERE k > 1 GROUP BY 1",
    "label_agreement": f"WITH {_TWO} SELECT {_AGREE}, count(*) FILTER (tied) AS ties FROM both_set",
    "label_confusion": f"WITH {_TWO} SELECT a, b, count(*) AS count FROM both_set WHERE a <> b GROUP BY 1, 2",
    "label_involvement": f"""WITH {_TWO} SELECT label, count(*) AS count FROM (
        SELECT a AS label FROM both_set WHERE a <> b UNION ALL SELECT b FROM both_set WHERE a <> b) GROUP BY 1""",
    "label_histogram": f"WITH {_TWO} SELECT b AS label, count(*) AS count FROM both_set GROUP BY 1",
    "quality_agreement": f"""WITH m AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS a,
        CASE WHEN toxic = 0 THEN 'good' ELSE 'bad' END AS b FROM labels) SELECT {_AGREE} FROM m""",
}
