"""Repairing the turn structure of conversations at the least cost, by Knuth's lightest-derivation agenda.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Rows are kept (0), given the other role (2) or
deleted (3, a must for blank and repeated ones), turns without text are inserted anywhere (2), and a truncated row that
stays costs 1. Among the cheapest repairs the one whose audit, the edits' initials in order, is least in ASCII wins;
an audit settles its repair, as all initials after the first follow from the one before.

Deduction. Item ``(start, i, state)`` says that rows 0 to i-1, begun in ``start``, can be made to end in ``state``; its
weight is (cost, audit). ``Keep``, ``Rerole`` and ``Delete`` derive ``(start, i + 1, state')`` from it and the axiom
``row i``; ``Insert`` derives ``(start, i, state')``. Each adds to the cost and appends a letter, so no conclusion is
lighter than its premises, and of two weights of one item the lighter one stays lighter whatever is appended: audits of
one item at one cost read the same rows, hence none is a prefix of another. The agenda pops the lightest item, whose
weight is then final, until the goals are.

Scale. Rows are dealt by range of (conversation, turn, role, text), not by conversation, so that one conversation may
fill many tasks. A task cuts what it sees of a conversation into pieces of at most ``PIECE`` rows and finishes the goals
``(start, state)`` of every piece. Pieces are then premises themselves: ``(k, state)`` and a piece's ``(state, state')``
derive ``(k + 1, state')``. Only costs, audits and counts reach the task that chains a conversation, which holds no more
than four audits besides the one being read. Rows that are alike in all four columns are counted before they are dealt.

Defined results: a null in any of the four columns reads as one blank where text is asked for (a null text is thus
blank, a null role is no role that may stay), but a null turn sorts first and counts in no gap; a null conversation is
one of its own; rows of one turn go by role, then text. Other columns are not looked at; an empty table has no results.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodlens.llm.common import SEPARATORS, narrow
from periodlens.sources.tables import settle

PIECE = 256
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
# States by what has been written: nothing, a system turn, an open user turn, a finished pair.
NOTHING, SYSTEM, OPEN, PAIR = range(4)
STATES = range(4)
FINAL = (NOTHING, PAIR)
# The one turn of the two that may follow, and what a kept initial leads to.
NEXT = {NOTHING: ("user", OPEN), SYSTEM: ("user", OPEN), OPEN: ("assistant", PAIR), PAIR: ("user", OPEN)}
KEPT = {(NOTHING, "s"): SYSTEM, **{(q, role[0]): to for q, (role, to) in NEXT.items()}}
LEGAL = ("su", "ua", "au")

BLANK, REPEATED, CUT, SOUND = "b", "d", "t", "-"


def _written(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def turns_of(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv, turn, role, text)`` with a blank for a null role or text."""
    cut = narrow(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    return cut.select("conv", "turn", _written("role").alias("role"), _written("text").alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``turns_of`` with faults by the CRC-32 of conversation and turn: test material that grows with the table."""
    kind = F.crc32(F.concat(_written("conv"), F.lit(":"), _written("turn")).cast("binary")) % 20
    rows = rows.withColumn("kind", kind).filter("kind <> 0")
    return rows.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def marked(rows: DataFrame, piece_rows: int = PIECE) -> DataFrame:
    """Rows in order with their faults, and the goals of every piece. Settled.

    ``(conv, piece, place, role, text, fault, summary)``: pieces are numbered in the order of the conversation, places
    count its rows from 0. Of rows that are alike only the first is there, the others are repeats and go anyway. A row
    at place -1 has the piece's summary and nothing else.

    A row repeats an earlier one unless its turn is the first with its role and text. First turns are found by partial
    aggregates, so that no key's rows come together, and are dealt along with the rows as markers, not joined to them.
    """
    digest = F.sha2("text", 256)
    counted = settle(rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")), "repair-rows")
    counted = counted.withColumn("turn", F.col("turn").cast("long")).withColumn("digest", digest)
    # False sorts before true, so turns that are null come first.
    at = F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn"))
    firsts = counted.groupBy("conv", "role", "digest").agg(F.min(at).alias("at"))
    markers = firsts.select(
        "conv", F.col("at.turn").alias("turn"), "role", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), "digest"
    )
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.select(*markers.columns).unionByName(markers).repartitionByRange(parts, *keys)
    ordered = dealt.sortWithinPartitions(*keys, "copies").withColumn("part", F.spark_partition_id())
    kind = dict(rows.dtypes)["conv"]
    schema = f"conv {kind}, piece bigint, place int, role string, text string, fault string, summary {_SUMMARY}"
    return settle(ordered.mapInArrow(_marker(schema, piece_rows), schema), "repair-marked")


_SUMMARY = (
    "struct<blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, first: string, last: string, "
    "turns: bigint, least: bigint, most: bigint, costs: array<bigint>, audits: array<string>>"
)
_SIGN = re.compile(r"[^\x20\x09-\x0D]")


def _fault(text: str, first: bool) -> str:
    if not _SIGN.search(text):
        return BLANK
    if not first:
        return REPEATED
    return SOUND if text.rstrip(SEPARATORS)[-1] in ".!?" else CUT


def _marker(schema: str, piece_rows: int):
    wanted = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in wanted]
        number, conv, open_ = 0, None, False
        rows: list[tuple[str, str, int | None]] = []
        marker = None

        def close(piece: int) -> None:
            if rows:
                for column, value in zip(out, (conv, piece, -1, None, None, None, _summary(rows))):
                    column.append(value)
                rows.clear()

        part = 0
        for batch in batches:
            for c, turn, role, text, copies, digest, part in zip(*(x.to_pylist() for x in batch.columns)):
                if not open_ or c != conv:
                    close(part << 32 | number)
                    open_, conv, number = True, c, number + 1
                if not copies:
                    marker = (c, turn, role, digest)
                    continue
                fault = _fault(text, marker == (c, turn, role, digest))
                for k in range(copies):
                    if len(rows) == piece_rows:
                        close(part << 32 | number)
                        number += 1
                    if not k:
                        for column, value in zip(out, (c, part << 32 | number, len(rows), role, text, fault, None)):
                            column.append(value)
                    rows.append((role[:1], fault if not k or fault == BLANK else REPEATED, turn))
            if len(out[0]) >= 2000:
                yield _emit(out, wanted)
        close(part << 32 | number)
        if out[0]:
            yield _emit(out, wanted)

    return run


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _emit(out: list[list], wanted: pa.Schema) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, wanted)], schema=wanted)
    for c in out:
        c.clear()
    return batch


def _summary(rows: list[tuple[str, str, int | None]]) -> dict:
    initials, faults = [r[0] for r in rows], [r[1] for r in rows]
    turns = [t for *_, t in rows if t is not None]
    goals = lightest(tuple(initials), "".join(faults))
    return {
        "blank": faults.count(BLANK), "duplicate": faults.count(REPEATED), "truncated": faults.count(CUT),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "first": initials[0], "last": initials[-1],
        "turns": len(set(turns)), "least": min(turns, default=None), "most": max(turns, default=None),
        "costs": [c for c, _ in goals], "audits": [a for _, a in goals],
    }


@lru_cache(1000)
def lightest(initials: tuple[str, ...], faults: str) -> list[tuple[int | None, str | None]]:
    """Weights of the goals ``(start, state)`` of some rows, at ``4 * start + state``; by the agenda."""
    n, done, left = len(initials), set(), len(STATES) ** 2
    goals: list[tuple[int | None, str | None]] = [(None, None)] * left
    agenda = [(0, "", 0, q, q) for q in STATES]
    while agenda and left:
        cost, audit, i, q, start = heapq.heappop(agenda)
        if (item := (start, i, q)) in done:
            continue
        done.add(item)
        role, to = NEXT[q]
        heapq.heappush(agenda, (cost + INSERT, audit + "I", i, to, start))
        if i == n:
            goals[4 * start + q] = cost, audit
            left -= 1
            continue
        heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, q, start))
        if faults[i] not in (BLANK, REPEATED):
            stays = cost + TRUNCATED * (faults[i] == CUT)
            if (kept := KEPT.get((q, initials[i]))) is not None:
                heapq.heappush(agenda, (stays, audit + "K", i + 1, kept, start))
            heapq.heappush(agenda, (stays + REROLE, audit + "R", i + 1, to, start))
    return goals


def chained(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``marked``: ``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, edits)``.

    ``edits`` has for every piece the state it begins in and its part of the audit.
    """
    pieces = rows.filter("place < 0").select("conv", "piece", "summary.*")
    kind = dict(rows.dtypes)["conv"]
    schema = (
        f"conv {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
        "edits array<struct<piece: bigint, state: int, audit: string>>"
    )
    wanted = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in wanted]
        open_, conv, chain = False, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if not open_ or row["conv"] != conv:
                    if open_:
                        chain.close(conv, out)
                    open_, conv, chain = True, row["conv"], _Chain()
                chain.add(row)
            if len(out[0]) >= 2000:
                yield _emit(out, wanted)
        if open_:
            chain.close(conv, out)
        if out[0]:
            yield _emit(out, wanted)

    return pieces.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(run, schema)


class _Chain:
    """The lightest derivations of a conversation's pieces so far, one for each state."""

    def __init__(self):
        # Cost, and audits of the pieces, the last one first: (audit, piece, state at its beginning, those before).
        self.weights: dict[int, tuple[int, tuple | None]] = {NOTHING: (0, None)}
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.last = self.least = self.most = None

    def add(self, piece: dict) -> None:
        derived: dict[int, tuple[int, tuple | None]] = {}
        for q, (cost, before) in self.weights.items():
            for to in STATES:
                if (more := piece["costs"][4 * q + to]) is not None:
                    made = cost + more, (piece["audits"][4 * q + to], piece["piece"], q, before)
                    if to not in derived or made[0] < derived[to][0] or made[0] == derived[to][0] and _audit(made[1]) < _audit(derived[to][1]):
                        derived[to] = made
        self.weights = derived
        joint = int(self.last is not None and self.last + piece["first"] not in LEGAL)
        # A turn that goes on in the next piece is one turn.
        same = int(self.most is not None and self.most == piece["least"])
        for k in self.sums:
            self.sums[k] += piece[k] + (joint if k == "illegal" else -same if k == "turns" else 0)
        self.last = piece["last"]
        self.least = piece["least"] if self.least is None else self.least
        self.most = self.most if piece["most"] is None else piece["most"]

    def close(self, conv: object, out: list[list]) -> None:
        cost, audit, at = min((c, _audit(x), q) for q, (c, x) in self.weights.items() if q in FINAL)
        edits, link = [], self.weights[at][1]
        while link:
            edits.append({"piece": link[1], "state": link[2], "audit": link[0]})
            link = link[3]
        s = self.sums
        gaps = 0 if self.least is None else self.most - self.least + 1 - s["turns"]
        for column, value in zip(out, (conv, gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], cost, audit, edits[::-1])):
            column.append(value)


def _audit(link: tuple | None) -> str:
    parts = []
    while link:
        parts.append(link[0])
        link = link[3]
    return "".join(reversed(parts))


def repaired(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """``(conv, piece, place, edit, role, text)``: the repaired conversations, in that order, from ``marked`` and ``chained``."""
    kind = dict(rows.dtypes)["conv"]
    none = F.lit(None)
    edits = chains.select("conv", F.inline("edits")).select(
        "conv", "piece", F.lit(-1).alias("place"), none.cast("string").alias("role"), F.col("audit").alias("text"), "state"
    )
    texts = rows.filter("place >= 0").select("conv", "piece", "place", "role", "text", none.cast("int").alias("state"))
    schema = f"conv {kind}, piece bigint, place int, edit string, role string, text string"
    wanted = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in wanted]
        # A piece's edits come first, then its rows.
        piece, own = None, {}

        def close() -> None:
            for place, turn in enumerate(_edited(*piece[2:], own) if piece else ()):
                for column, value in zip(out, (*piece[:2], place, *turn)):
                    column.append(value)
            own.clear()

        for batch in batches:
            for conv, number, place, role, text, state in zip(*(x.to_pylist() for x in batch.columns)):
                if place < 0:
                    close()
                    piece = conv, number, state, text
                else:
                    own[place] = role, text
            if len(out[0]) >= 2000:
                yield _emit(out, wanted)
        close()
        if out[0]:
            yield _emit(out, wanted)

    return texts.unionByName(edits).repartition("conv", "piece").sortWithinPartitions("conv", "piece", "place").mapInArrow(run, schema)


def _edited(state: int, audit: str, rows: dict[int, tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of every turn that is left of a piece."""
    at = 0
    for edit in audit:
        if edit in "IR":
            role, to = NEXT[state]
            yield edit, role, rows[at][1] if edit == "R" else ""
            state = to
        elif edit == "K":
            yield edit, *rows[at]
            state = KEPT[state, rows[at][0][0]]
        at += edit != "I"


def digests(turns: DataFrame) -> DataFrame:
    """``(conv, sha256)`` of the repaired turns of a conversation, ``role:text`` joined by newlines.

    A hash of a sequence has to see it in order: the rows of a conversation stream through one task, which holds a hash.
    """
    schema = f"conv {dict(turns.dtypes)['conv']}, sha256 string"
    wanted = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], []]
        open_, conv, state = False, None, None

        def close() -> None:
            if open_:
                out[0].append(conv)
                out[1].append(state.hexdigest())

        for batch in batches:
            for c, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if not open_ or c != conv:
                    close()
                    open_, conv, state = True, c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if len(out[0]) >= 2000:
                yield _emit(out, wanted)
        close()
        if out[0]:
            yield _emit(out, wanted)

    ordered = turns.repartition("conv").sortWithinPartitions("conv", "piece", "place")
    return ordered.select("conv", "role", "text").mapInArrow(run, schema)


def report(original: DataFrame, rows: DataFrame, piece_rows: int = PIECE) -> DataFrame:
    """Counts, cost, audit and digest of every conversation of ``original``, whose rows now are ``rows`` (see ``turns_of``)."""
    ready = marked(rows, piece_rows)
    chains = settle(chained(ready), "repair-chains")
    hashed = digests(repaired(ready, chains))
    sums = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    # Conversations meet by grouping, where a null id is a key like any other.
    parts = [original.select("conv").distinct(), chains.drop("edits"), hashed]
    whole = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    return whole.groupBy("conv").agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in sums], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
