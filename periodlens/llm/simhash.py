"""SimHash near-duplicates: fingerprints, all links within two bits, connected groups.

Two 64-bit fingerprints that differ in at most two bits differ in at most one bit in one of their two 32-bit
segments. Every fingerprint is indexed under the 64 variants of its segments with one bit deleted; equal variants
meet by an equality shuffle and are verified. Linking is complete: no pair within two bits is missed.

Defined results: a null or empty text (or one of separators only) has fingerprint 0 and is linked like any other; a
text of fewer than ``words`` words is one shingle; rows may repeat; a null id takes part but never names a group
unless all ids of the group are null; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.llm.common import arrow_map, narrow
from periodlens.llm.components import roots
from periodlens.sources.tables import settle

SEED = 42
SHINGLE_BLOCK = 1 << 16
# Buckets with more fingerprints are cut once more; the parts then hold 2 ** 18 fingerprints at the very most.
BUCKET = 1 << 14


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint of one text as an unsigned integer."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    words = min(words, len(w))
    total, ones = len(w) - words + 1, np.zeros(64, np.int64)
    for at in range(0, total, SHINGLE_BLOCK):
        part = w[at : at + SHINGLE_BLOCK + words - 1]
        joined = b" ".join(part)
        end = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        start = np.concatenate(([0], end[:-1] + 1))
        spans = zip(start[: len(part) - words + 1].tolist(), end[words - 1 :].tolist())
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id, key, fp)`` for every row; ``key`` is a hash of id and text that tells rows with equal ids apart."""

    def rows(columns: list[list]) -> dict:
        ids, keys, texts = columns
        fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
        return {"id": ids, "key": keys, "fp": fps}

    kind = dict(docs.dtypes)[id_col]
    cut = narrow(docs, id=id_col, text=text_col).select("id", row_key("id", "text").alias("key"), "text")
    return arrow_map(cut, f"id {kind}, key bigint, fp bigint", rows)


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[..., :, None] ^ b[..., None, :]) <= 2


def _stars(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups connected by links within one bucket, as pairs from each group's first member to the others."""
    left, out = fps, []
    while len(left):
        seed, group, left = left[:1], [], left[1:]
        edge = seed
        while len(edge) and len(left):
            hit = np.zeros(len(left), bool)
            for at in range(0, len(edge), block := max(1, (1 << 22) // len(left))):
                hit |= _close(edge[at : at + block], left).any(0)
            edge, left = left[hit], left[~hit]
            group.append(edge)
        if group and (members := np.concatenate(group)).size:
            out.append((np.repeat(seed, len(members)), members))
    return out


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket → links. Holds one bucket at a time; most buckets have one row and are passed over."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes, found = np.diff(np.append(start, len(keys))), []
        pairs = start[sizes == 2]
        near = np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= 2
        found.append((fps[pairs][near], fps[pairs + 1][near]))
        for at, n in zip(start[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            found += _stars(fps[at : at + n])
        a, b = (np.concatenate([x[i] for x in found]).view(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema) if len(a) else None

    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy()))
        fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
        done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if done and (out := links(keys[:done], fps[:done])) is not None:
            yield out
        keys, fps = keys[done:], fps[done:]
    if len(keys) and (out := links(keys, fps)) is not None:
        yield out


def _variants(fps: DataFrame) -> DataFrame:
    """``(bucket, fp)``: 64 one-wildcard segments. The bucket is the wildcard's place and the segment without it."""
    every = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    segment = F.expr("shiftrightunsigned(fp, 32 * (i div 32)) & 4294967295L & ~shiftleft(1L, i % 32)")
    return every.select((F.expr("shiftleft(cast(i as bigint), 32)").bitwiseOR(segment)).alias("bucket"), "fp")


def _cut_again(variants: DataFrame) -> DataFrame:
    """Second cut of crowded buckets: the other segment by halves of 16 bits, again with one bit deleted."""
    every = variants.select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j"))
    other = "shiftrightunsigned(fp, 32 - 32 * cast(shiftright(bucket, 32) div 32 as int) + 16 * (j div 16))"
    half = F.expr(f"{other} & 65535L & ~shiftleft(1L, j % 16)")
    bucket = F.expr("shiftleft(bucket, 21) | shiftleft(cast(j as bigint), 16)").bitwiseOR(half)
    return every.select(bucket.alias("bucket"), "fp")


def _linked(variants: DataFrame) -> DataFrame:
    return variants.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_link_runs, "a bigint, b bigint")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` that connect exactly what all pairs of different fingerprints within two bits connect.

    ``fps`` has one column ``fp`` of distinct fingerprints. A bucket gives at most one link less than its members, so
    the result does not grow with the square of a group. Buckets of more than ``bucket`` fingerprints (found from
    counts by segment, before anything meets) are cut once more by the other segment.
    """
    variants = _variants(fps)
    segments = fps.select(
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("s"), F.expr(f"shiftrightunsigned(fp, {32 * s}) & 4294967295L").alias("v"))
            for s in (0, 1)
        ])).alias("x")
    ).select("x.*")
    crowded = segments.groupBy("s", "v").count().filter(F.col("count") > bucket // 2)
    hot = settle(crowded.select(
        F.explode(F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda i: F.shiftleft((F.col("s") * 32 + i).cast("long"), 32)
            + F.col("v").bitwiseAND(F.bitwise_not(F.pow(F.lit(2), i).cast("long"))),
        )).alias("bucket")
    ).distinct(), "crowded")
    if hot.isEmpty():
        return _linked(variants)
    rest = variants.join(hot, "bucket", "left_anti")
    return _linked(rest).union(_linked(_cut_again(variants.join(hot, "bucket", "left_semi"))))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id, key, fp, component_id, root)`` for every row; ``component_id`` is the smallest id reachable by links.

    ``root`` is the fingerprint that stands for the component. It alone tells components apart: ids may be null, and
    may come more than once. Fingerprints are written once and read for the links and for the result. Copies share a fingerprint, so only
    distinct fingerprints are linked, and the last join has one row per fingerprint on one side; rows of a frequent
    fingerprint are split by the adaptive skew join.
    """
    rows = settle(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = settle(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    root = roots(links(distinct.select("fp")))
    # The links name a few fingerprints only; those without a link are groups of their own.
    named = distinct.join(root, distinct.fp == root.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = settle(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id", "root")
    return rows.join(by_fp, "fp").select("id", "key", "fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The rows of ``docs`` (all columns) with one document of each group: the one with the smallest id.

    Among rows with the same id the smallest row hash stays, and of rows equal in id and text the one whose other columns
    have the smallest hash.
    """
    return one_of_each(docs, groups(docs, id_col, text_col, words), id_col, text_col)


def one_of_each(docs: DataFrame, grouped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` chosen as in :func:`keep_one` from groups ``(id, key, root)``."""
    kept = grouped.groupBy("root").agg(F.min_by("key", F.struct(F.col("id").isNull(), "id", "key")).alias("_keep"))
    key = row_key(id_col, text_col)
    stay = docs.join(kept.select("_keep"), key == F.col("_keep"), "left_semi")
    repeated = grouped.groupBy("key").count().filter("count > 1").select(F.col("key").alias("_twice"))
    repeated = settle(repeated, "repeated")
    if repeated.isEmpty():
        return stay
    once = stay.join(repeated, key == F.col("_twice"), "left_anti")
    twice = stay.join(repeated, key == F.col("_twice"), "left_semi")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    order = F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0)
    # Rows equal in id and text are grouped by partial aggregates, however many they are.
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("_row")
    picked = twice.groupBy(F.col(f"`{id_col}`").alias("_a"), F.col(f"`{text_col}`").alias("_b")).agg(row).select("_row.*")
    return once.unionByName(picked)
