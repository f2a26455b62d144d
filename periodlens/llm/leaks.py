"""Passages of a benchmark inside documents: one Aho-Corasick automaton over the benchmark's normalised windows.

Normalising lower-cases A-Z and turns every other ASCII character that is neither letter nor digit into a blank; what
is left between blanks are the words, characters beyond ASCII included. A window is ten consecutive words of an item;
an item of fewer words is one window. A normalised text keeps its length in bytes, so the places of its words are their
places in the original as well. The automaton reads a text once, whole; matches are words, bytes and characters of the
original by counting word starts.

The automaton is built by every worker from broadcast items. ``BLOCK_BYTES`` bounds the windows of one automaton; a
benchmark with more is dealt to as many as it takes, and the documents pass each in turn, with what was found so far
written in between. No item is left out.

Defined results: a null or empty text, or one without words, is not hit; an item that is null or has no words has no
window; items with the same id count once, an item without an id is named by the empty string; rows of documents that
repeat are rows of their own; empty tables give an empty result or nothing hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodlens.llm.common import narrow
from periodlens.sources.tables import settle

WINDOW = 10
# Bytes of windows in one automaton, some 50 bytes of memory each.
BLOCK_BYTES = 8 << 20

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_STATE = "n_words bigint, hits array<struct<start: bigint, end: bigint>>, items array<string>"


def words(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").translate(_PLAIN).split()


def windows(text: str | None, width: int = WINDOW) -> list[bytes]:
    w = words(text)
    return [b" ".join(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)] if w else []


class Automaton:
    """All windows of some items, each with the items it belongs to."""

    def __init__(self, items: list[tuple[str, str]], width: int = WINDOW):
        import ahocorasick

        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for window in windows(text, width):
                owners.setdefault(window, set()).add(item)
        # A blank on both sides: matches begin and end with words. Bytes are written as characters of the same number.
        self.trie = ahocorasick.Automaton()
        for window, ids in owners.items():
            self.trie.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, frozenset(ids)))
        self.trie.make_automaton()
        self.any = bool(owners)

    def scan(self, own: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items that occur."""
        steps, items = None, set()
        if self.any and own:
            line = f" {b' '.join(own).decode('latin-1')} "
            for end, (n, ids) in self.trie.iter(line):
                if steps is None:
                    steps = np.zeros(len(own) + 1, np.int64)
                    # The blank after word k stands where the words so far and k + 1 blanks end.
                    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own))) + np.arange(1, len(own) + 1)
                last = int(np.searchsorted(ends, end))
                steps[last + 1 - n] += 1
                steps[last + 1] -= 1
                items |= ids
        return (np.zeros(len(own), bool) if steps is None else np.cumsum(steps[:-1]) > 0), items


def intervals(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches of words that are hit, ends exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def characters(text: str, stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches of words as code points of the original text, ends exclusive."""
    if not stretches:
        return []
    data = np.frombuffer(text.encode(), np.uint8)
    inside = np.concatenate([[0], (np.frombuffer(_PLAIN, np.uint8)[data] != 32).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(inside))
    # Code points before each byte: all bytes but those that go on with one.
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first, last = before[edges[::2]].tolist(), before[edges[1::2]].tolist()
    return [(first[a], last[b - 1]) for a, b in stretches]


def _blocks(items: DataFrame, width: int) -> list[DataFrame]:
    """The items in parts whose windows are bounded in size. Its sizes are known from the rows' lengths alone."""
    # An item's windows hold each word up to width times; one item alone may exceed the bound, as it can't be dealt.
    size = F.octet_length("text").cast("long") * width + 1
    total = items.agg(F.sum(size)).first()[0] or 0
    parts = -(-total // BLOCK_BYTES)
    if parts <= 1:
        return [items]
    dealt = settle(items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts))), "leaks-items")
    return [dealt.filter(F.col("part") == p).select("item", "text") for p in range(parts)]


def scan(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", width: int = WINDOW,
) -> DataFrame:
    """``(id, text, n_words, hits, items, spans)`` for every document.

    ``hits`` are stretches of words that are hit, ``spans`` the same as code points of the original text, ``items`` the
    ids of the items that occur, sorted as strings. One scan of the documents, no shuffle.
    """
    asked = narrow(items, item=item_col, text=item_text_col)
    asked = asked.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "text").filter("text IS NOT NULL").distinct()
    kind = dict(docs.dtypes)[id_col]
    state = narrow(docs, id=id_col, text=text_col)
    blocks = _blocks(asked, width)
    for at, block in enumerate(blocks):
        if at:
            state = settle(state, "leaks-documents")
        state = _pass(state, block, kind, width)
    return state


def _pass(state: DataFrame, block: DataFrame, kind: str, width: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    context = state.sparkSession.sparkContext
    sent = context.broadcast([(r["item"], r["text"]) for r in block.collect()])
    schema = f"id {kind}, text string, {_STATE}, spans array<struct<start: bigint, end: bigint>>"
    wanted = to_arrow_schema(_parse_datatype_string(schema))
    going_on = "hits" in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sent.value, width)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                out: list[list] = [[] for _ in range(4)]
                for i, scalar in enumerate(batch.column(1)):
                    text = scalar.as_py() or ""
                    own = words(text)
                    hit, ids = automaton.scan(own)
                    if going_on:
                        for x in batch.column(3)[i].as_py():
                            hit[x["start"] : x["end"]] = True
                        ids |= set(batch.column(4)[i].as_py())
                    stretches = intervals(hit)
                    for column, value in zip(out, (
                        len(own), _structs(stretches), sorted(ids), _structs(characters(text, stretches)),
                    )):
                        column.append(value)
                made = [pa.array(x, f.type) for x, f in zip(out, list(wanted)[2:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], schema=wanted)

    return state.mapInArrow(run, schema)


def _structs(pairs: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in pairs]


def removed(scanned: DataFrame, mark: str = "") -> DataFrame:
    """``(id, text)`` with the spans of ``scan`` cut out of the texts, a mark in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                pieces, at = [], 0
                for x in spans:
                    pieces += (text[at : x["start"]], mark)
                    at = x["end"]
                texts.append(text if text is None else "".join((*pieces, text[at:])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return scanned.select("id", "text", "spans").mapInArrow(run, f"id {dict(scanned.dtypes)['id']}, text string")
