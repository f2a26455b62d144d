"""Picking a label from confidences or counts, with a choice of tie rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from periodlens.functions.text import let


def confidence(scores: Column | str, label: str) -> Column:
    """Confidence of one label from a map; text that is no number and a missing label give NULL."""
    scores = F.col(scores) if isinstance(scores, str) else scores
    return F.try_element_at(scores, F.lit(label)).try_cast("double")


def argmax_confidence(scores: Column | str, labels: Sequence[str]) -> Column:
    """Label of ``labels`` with the greatest confidence, the earlier one on ties.

    Labels outside the list are ignored, unreadable confidences count as 0, and a map that is NULL or
    has none of the labels gives NULL.
    """
    scores = F.col(scores) if isinstance(scores, str) else scores

    def pick(bound: Column) -> Column:
        ranked = [
            F.when(
                F.map_contains_key(bound, name),
                F.struct(
                    F.coalesce(confidence(bound, name), F.lit(0.0)).alias("conf"),
                    F.lit(-pos).alias("pos"),
                    F.lit(name).alias("label"),
                ),
            )
            for pos, name in enumerate(labels)
        ]
        return F.array_max(F.array(*ranked))["label"]

    return let(scores, pick)


def _top(labels: Sequence[str]) -> Column:
    counts = [F.coalesce(F.col(name), F.lit(0)) for name in labels]
    return F.greatest(*counts) if len(counts) > 1 else counts[0]


def _is_top(name: str, labels: Sequence[str]) -> Column:
    top = _top(labels)
    return (F.coalesce(F.col(name), F.lit(0)) == top) & (top > 0)


def tie_size(labels: Sequence[str]) -> Column:
    """How many labels share the greatest count; 0 where all counts are zero."""
    return sum((_is_top(name, labels).cast("int") for name in labels[1:]), _is_top(labels[0], labels).cast("int"))


def argmax_counts(labels: Sequence[str], ties: str = "first", confidences: Sequence[str] | None = None) -> Column:
    """Label whose count column is greatest; NULL if all are zero.

    ``ties``: ``"first"`` takes the earlier label, ``"null"`` gives no label, ``"confidence"`` takes the
    tied label with the greatest value in the matching ``confidences`` column.
    """
    if ties == "confidence":
        if confidences is None or len(confidences) != len(labels):
            raise ValueError("ties='confidence' needs one confidence column per label")
        ranked = [
            F.when(
                _is_top(name, labels),
                F.struct(
                    F.coalesce(F.col(conf), F.lit(0.0)).cast("double").alias("conf"),
                    F.lit(-pos).alias("pos"),
                    F.lit(name).alias("label"),
                ),
            )
            for pos, (name, conf) in enumerate(zip(labels, confidences))
        ]
        return F.array_max(F.array(*ranked))["label"]
    first = F.coalesce(*[F.when(_is_top(name, labels), F.lit(name)) for name in labels])
    if ties == "first":
        return first
    if ties == "null":
        return F.when(tie_size(labels) == 1, first)
    raise ValueError(f"unknown tie rule: {ties}")


def tie_weight(name: str, labels: Sequence[str]) -> Column:
    """1/k for each of the k labels tied for the greatest count, 0 for the others and for all-zero rows."""
    return F.when(_is_top(name, labels), F.lit(1.0) / tie_size(labels)).otherwise(F.lit(0.0))


def tied_set(labels: Sequence[str], sep: str = "+") -> Column:
    """Tied labels joined by ``sep`` in label order; NULL where there is no tie."""
    names = F.concat_ws(sep, *[F.when(_is_top(name, labels), F.lit(name)) for name in labels])
    return F.when(tie_size(labels) > 1, names)
