"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

The graph starts from blocks of nodes that are close on a random line, compared in full, and improves by rounds of
joins: every node gathers its neighbours and the nodes that have it as a neighbour, with their vectors, and offers
each of them the closest of the others. Searching keeps a beam of the best nodes found per query and looks at the
neighbours of those not yet looked at, a round for all queries at once, until nothing is left to look at. What is
returned has been measured again on the original vectors.

Graph and search work on vectors as exact as they come: floats for a column of floats, else doubles; distances are
worked out on doubles, so that near copies and small components beside a large one keep their order. Equal vectors are one node, so that copies, however many,
are one neighbour; a node lists the smallest ids that have its vector, as many as a result can name.

Defined results: vectors that are null, zero, of another length than most (the longer of equally frequent lengths
counts), or that hold null or non-finite components take no part, nor do rows without an id. An id that comes more
than once counts once, with its smallest vector. Ties go to the smaller id. With fewer candidates than asked for, all
are returned. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodlens.llm.common import narrow
from periodlens.sources.tables import settle

NEIGHBOURS = 24
# Of the nodes that have a node as neighbour, so many of the closest take part in its round.
REVERSE = 16
OFFERS = 8
ROUNDS = 3
BLOCK = 2048
LINES = 3
# Most quantiles by which nodes on a line are cut into blocks; larger cells are parted by hash.
QUANTILES = 1024
BEAM = 512
HOPS = 16
ENTRIES = 32
MEASURED = 64
# Bytes of neighbours' vectors in one row, so that batches of rows stay small.
WIDE = 1 << 11
SEED = 42

_GRAPH = "node bigint, code binary, ids binary, dists binary"


@dataclass
class Index:
    """Written tables: ``rows`` (id, vec) that take part, ``vectors`` (node, vec), ``members`` (node, ids), ``graph`` (node, code, ids, dists)."""

    rows: DataFrame
    vectors: DataFrame
    members: DataFrame
    graph: DataFrame
    nodes: int


def encode(vectors: np.ndarray, kind: str = "f8") -> np.ndarray:
    """Rows of bytes: the size of a component, then the components."""
    parts = np.ascontiguousarray(vectors, kind)
    return np.concatenate((np.full((len(parts), 1), parts.itemsize, np.uint8), parts.view(np.uint8)), axis=1)


def decode(codes: np.ndarray) -> np.ndarray:
    kind = f"f{codes.reshape(-1)[0]}" if codes.size else "f8"
    return np.ascontiguousarray(codes[..., 1:]).view(kind).astype(np.float64)


def _bytes(column: pa.Array) -> np.ndarray:
    """A column of equally long binaries as rows of bytes."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _usable(vec: str) -> Column:
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return F.col(vec).isNotNull() & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0)


def _pairwise(vectors: np.ndarray) -> np.ndarray:
    """Squared distances within each group of rows of the last two axes, measured from the group's first row."""
    vectors = vectors - vectors[..., :1, :]
    norms = (vectors * vectors).sum(-1)
    out = np.matmul(vectors, np.swapaxes(vectors, -1, -2))
    out *= -2
    out += norms[..., :, None]
    out += norms[..., None, :]
    return np.maximum(out, 0, out=out)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else []
    return zip(at[:-1], at[1:]) if len(at) else iter(())


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _merge(ids: np.ndarray, dists: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` closest different ids, closest first."""
    ids, first = np.unique(ids, return_index=True)
    dists = dists[first]
    order = np.lexsort((ids, dists))[:most]
    return ids[order], dists[order]


def _offers(rows: DataFrame) -> DataFrame:
    """Offers within blocks: rows ``(block, node, code, x)`` → ``(node, ids, dists)``. Crowded blocks are cut along ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(nodes: np.ndarray, codes: np.ndarray) -> pa.RecordBatch | None:
            if len(nodes) < 2:
                return None
            d = _pairwise(decode(codes))
            np.fill_diagonal(d, np.inf)
            k = min(NEIGHBOURS, len(nodes) - 1)
            at = np.argpartition(d, k - 1, axis=1)[:, :k]
            ids, dists = nodes[at], np.take_along_axis(d, at, 1).astype(np.float32)
            return _batch(["node", "ids", "dists"], [nodes, [x.tobytes() for x in ids], [x.tobytes() for x in dists]])

        blocks, nodes, codes = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _bytes(batch.column(2))
            blocks = np.concatenate((blocks, batch.column(0).to_numpy()))
            nodes = np.concatenate((nodes, batch.column(1).to_numpy()))
            codes = new if codes is None else np.concatenate((codes, new))
            done = int(np.searchsorted(blocks, blocks[-1]))
            if len(blocks) - done >= 2 * BLOCK:
                done = len(blocks)
            for a, b in _runs(blocks[:done]):
                for at in range(a, b, BLOCK):
                    if (out := close(nodes[at : min(b, at + BLOCK)], codes[at : min(b, at + BLOCK)])) is not None:
                        yield out
            blocks, nodes, codes = blocks[done:], nodes[done:], codes[done:]
        for a, b in _runs(blocks):
            for at in range(a, b, BLOCK):
                if (out := close(nodes[at : min(b, at + BLOCK)], codes[at : min(b, at + BLOCK)])) is not None:
                    yield out

    ordered = rows.repartition("block").sortWithinPartitions("block", "x", "node")
    return ordered.mapInArrow(run, "node bigint, ids binary, dists binary")


def _first_offers(codes: DataFrame, nodes: int, length: int) -> DataFrame:
    """Neighbours on random lines. Quantiles of the projections, ``QUANTILES`` at most, come to the driver."""
    lines = np.random.default_rng(SEED).normal(size=(LINES, length)).astype(np.float32)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                on = decode(_bytes(batch.column(1))) @ lines.T
                yield _batch(["node", "code", "line", "x"], [
                    batch.column(0).take(rows := np.repeat(np.arange(batch.num_rows), LINES)), batch.column(1).take(rows),
                    np.tile(np.arange(LINES), batch.num_rows), on.astype(np.float64).ravel(),
                ])

    placed = codes.mapInArrow(project, "node bigint, code binary, line bigint, x double")
    cells = max(1, min(QUANTILES, nodes // BLOCK))
    parts = max(1, round(nodes / cells / BLOCK))
    bounds = {r["line"]: np.array(r["q"]) for r in placed.groupBy("line").agg(
        F.percentile_approx("x", [(i + 1) / cells for i in range(cells - 1)], 10_000).alias("q")
    ).collect()} if cells > 1 else {}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, line, x = (batch.column(i).to_numpy() for i in (0, 2, 3))
            cell = np.zeros(len(node), np.int64)
            for i, q in bounds.items():
                cell[line == i] = np.searchsorted(q, x[line == i])
            # Another mix for each line, so that nodes in one cell of all lines are not always parted alike.
            mixed = ((node ^ (line << 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block = (line * QUANTILES + cell) * parts + (mixed % np.uint64(parts)).astype(np.int64)
            yield _batch(["block", "node", "code", "x"], [block, batch.column(0), batch.column(1), x])

    return _offers(placed.mapInArrow(deal, "block bigint, node bigint, code binary, x double"))


def _updated(graph: DataFrame, offers: DataFrame) -> DataFrame:
    """The graph with offers taken in: each node keeps the closest. A node's offers are folded in as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "code", "ids", "dists"]
        out: list[list] = [[] for _ in names]
        node = code = None
        ids, dists, waiting, held = np.empty(0, np.int64), np.empty(0, np.float32), [], 0

        def fold() -> None:
            nonlocal ids, dists, waiting, held
            if waiting:
                all_ids = np.concatenate([ids, *(np.frombuffer(i, np.int64) for i, _ in waiting)])
                all_dists = np.concatenate([dists, *(np.frombuffer(d, np.float32) for _, d in waiting)])
                ids, dists = _merge(all_ids, all_dists, NEIGHBOURS)
                waiting, held = [], 0

        def close() -> None:
            fold()
            for column, value in zip(out, (node, code, ids.tobytes(), dists.tobytes())):
                column.append(value)

        for batch in batches:
            for n, c, i, d in zip(*(x.to_pylist() for x in batch.columns)):
                if n != node:
                    if node is not None:
                        close()
                    node, code, ids, dists = n, c, np.frombuffer(i, np.int64), np.frombuffer(d, np.float32)
                else:
                    waiting.append((i, d))
                    held += len(i)
                    if held >= 1 << 16:
                        fold()
            if len(out[0]) >= 4096:
                yield _batch(names, out)
                out = [[] for _ in names]
        if node is not None:
            close()
            yield _batch(names, out)

    rows = graph.select("node", "code", "ids", "dists").unionByName(
        offers.select("node", F.lit(None).cast("binary").alias("code"), "ids", "dists")
    )
    # The node's own row comes first.
    return rows.repartition("node").sortWithinPartitions("node", F.col("code").isNull()).mapInArrow(run, _GRAPH)


def _edges(graph: DataFrame) -> DataFrame:
    """``(owner, member, d)`` in the direction of the graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dists = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            each = [len(i) // 8 for i in ids]
            yield _batch(["owner", "member", "d"], [
                np.repeat(batch.column(0).to_numpy(), each), np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(dists), np.float32)
            ])

    return graph.select("node", "ids", "dists").mapInArrow(run, "owner bigint, member bigint, d float")


def _round_offers(graph: DataFrame) -> DataFrame:
    """One round: neighbours of a node are offered to each other."""
    forward = settle(_edges(graph), "edges")
    closest = Window.partitionBy("owner").orderBy("d", "member")
    back = forward.select(F.col("member").alias("owner"), F.col("owner").alias("member"), "d").withColumn(
        "nth", F.row_number().over(closest)
    ).filter(F.col("nth") <= REVERSE)
    both = forward.select("owner", "member").union(back.select("owner", "member"))
    # The farthest neighbour a member has bounds what is worth offering to it; below the full number all is.
    worst = F.when(
        F.length("dists") >= 4 * NEIGHBOURS, F.substring("dists", 4 * NEIGHBOURS - 3, 4)
    ).otherwise(F.lit(np.float32(np.inf).tobytes()))
    held = graph.select(F.col("node").alias("member"), "code", worst.alias("worst"))
    gathered = both.join(held, "member").select("owner", "member", "code", "worst")
    width = NEIGHBOURS + REVERSE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def offers(owners: np.ndarray, members: np.ndarray, codes: np.ndarray, worst: np.ndarray) -> pa.RecordBatch | None:
            """Groups are laid out as rows of equal width and compared together."""
            starts = np.array([a for a, _ in _runs(owners)])
            group = np.cumsum(np.concatenate(([0], owners[1:] != owners[:-1])))
            place = np.arange(len(owners)) - starts[group]
            at = np.full((len(starts), width), -1)
            at[group, place] = np.arange(len(owners))
            empty = at < 0
            d = _pairwise(decode(codes)[at])
            ids = np.where(empty, -1 - np.arange(width), members[at])
            d[empty[:, :, None] | empty[:, None, :] | (ids[:, :, None] == ids[:, None, :])] = np.inf
            best = np.argpartition(d, OFFERS - 1, axis=2)[:, :, :OFFERS]
            dists = np.take_along_axis(d, best, 2).astype(np.float32)
            offered = np.take_along_axis(np.broadcast_to(ids[:, None, :], d.shape), best, 2)
            good = (dists < np.where(empty, -1, worst[at])[:, :, None]) & np.isfinite(dists)
            g, w = np.nonzero(good.any(2))
            if not len(g):
                return None
            picked = [(offered[i, j][good[i, j]].tobytes(), dists[i, j][good[i, j]].tobytes()) for i, j in zip(g, w)]
            return _batch(["node", "ids", "dists"], [ids[g, w], *zip(*picked)])

        owners, members, worst, codes = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32), None
        for batch in batches:
            if not batch.num_rows:
                continue
            owners = np.concatenate((owners, batch.column(0).to_numpy()))
            members = np.concatenate((members, batch.column(1).to_numpy()))
            new = _bytes(batch.column(2))
            codes = new if codes is None else np.concatenate((codes, new))
            worst = np.concatenate((worst, _bytes(batch.column(3)).view(np.float32).ravel()))
            done = int(np.searchsorted(owners, owners[-1]))
            if done >= 20_000:
                if (out := offers(owners[:done], members[:done], codes[:done], worst[:done])) is not None:
                    yield out
                owners, members, codes, worst = owners[done:], members[done:], codes[done:], worst[done:]
        if len(owners) and (out := offers(owners, members, codes, worst)) is not None:
            yield out

    ordered = gathered.repartition("owner").sortWithinPartitions("owner")
    return ordered.mapInArrow(run, "node bigint, ids binary, dists binary")


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 10, rounds: int = ROUNDS) -> Index:
    """The index of all rows that take part. ``most`` is the largest number of neighbours a search will ask for."""
    rows = narrow(vectors, id=id_col, vec=vec_col)
    kind = "f4" if dict(rows.dtypes)["vec"] == "array<float>" else "f8"
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & _usable("vec")).groupBy("id").agg(F.min("vec").alias("vec"))
    rows = settle(rows, "rows")
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = sizes["n"] if sizes else 1
    same = Window.partitionBy("vec").orderBy("id")
    rows = rows.filter(F.size("vec") == length)
    nth = rows.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= most + 1)
    nth = settle(nth, "nth")
    nodes = settle(nth.filter("nth = 1").select(F.col("id").alias("node"), "vec"), "nodes")
    members = settle(nth.groupBy("vec").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("ids")).select("node", "ids"), "members")
    count = nodes.count()

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vecs = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                empty = pa.array([b""] * batch.num_rows)
                yield _batch(["node", "code", "ids", "dists"], [batch.column(0), [x.tobytes() for x in encode(vecs, kind)], empty, empty])

    graph = settle(nodes.mapInArrow(codes, _GRAPH), "codes")
    graph = settle(_updated(graph, _first_offers(graph.select("node", "code"), count, length)), "graph")
    for _ in range(rounds):
        graph = settle(_updated(graph, _round_offers(graph)), "graph")
    return Index(rows, nodes, members, graph, count)


def _with_codes(graph: DataFrame) -> DataFrame:
    """``(node, ids, codes)``: the graph with the vectors of the neighbours beside their ids, in rows of ``WIDE`` bytes."""
    own = graph.select(F.col("node").alias("member"), "code")
    joined = _edges(graph).join(own, "member").repartition("owner").sortWithinPartitions("owner", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(owners: np.ndarray, members: np.ndarray, codes: list[bytes]) -> pa.RecordBatch:
            step = max(1, WIDE // len(codes[0]))
            runs = [(at, min(b, at + step)) for a, b in _runs(owners) for at in range(a, b, step)]
            return _batch(["node", "ids", "codes"], [
                [owners[a] for a, _ in runs], [members[a:b].tobytes() for a, b in runs], [b"".join(codes[a:b]) for a, b in runs]
            ])

        owners, members, codes = np.empty(0, np.int64), np.empty(0, np.int64), []
        for batch in batches:
            if not batch.num_rows:
                continue
            owners = np.concatenate((owners, batch.column(1).to_numpy()))
            members = np.concatenate((members, batch.column(0).to_numpy()))
            codes += batch.column(2).to_pylist()
            if done := int(np.searchsorted(owners, owners[-1])):
                yield rows(owners[:done], members[:done], codes[:done])
                owners, members, codes = owners[done:], members[done:], codes[done:]
        if len(owners):
            yield rows(owners, members, codes)

    return joined.select("member", "owner", "code").mapInArrow(run, "node bigint, ids binary, codes binary")


def _looked_at(frontier: DataFrame, graph: DataFrame) -> DataFrame:
    """Neighbours of the nodes a query looks at, with their distances from it, as far as they can enter its beam."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            ids, codes = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            each = np.array([len(i) // 8 for i in ids])
            row = np.repeat(np.arange(len(each)), each)
            ids = np.frombuffer(b"".join(ids), np.int64)
            codes = np.frombuffer(b"".join(codes), np.uint8).reshape(len(ids), -1)
            d = ((decode(codes) - decode(_bytes(batch.column(1)))[row]) ** 2).sum(1).astype(np.float32)
            good = d < batch.column(2).to_numpy()[row]
            yield _batch(["query", "node", "d"], [batch.column(0).to_numpy()[row[good]], ids[good], d[good]])

    return frontier.join(graph, "node").select("query", "qcode", "worst", "ids", "codes").mapInArrow(
        run, "query bigint, node bigint, d float"
    )


def _beams(state: DataFrame, found: DataFrame, beam: int) -> DataFrame:
    """Beams with what was found: ``(query, qcode, ids, dists, looked)``; ``looked`` marks nodes already looked at."""
    rows = state.select(
        "query", "qcode", "ids", "dists", "looked", F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("float").alias("d")
    ).unionByName(found, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query", "qcode", "ids", "dists", "looked"]
        query = code = ids = dists = looked = None
        new_ids, new_dists = [], []

        def fold() -> None:
            nonlocal ids, dists, looked, new_ids, new_dists
            all_ids, all_dists = np.concatenate((ids, *new_ids)), np.concatenate((dists, *new_dists))
            done = np.concatenate((looked, np.zeros(len(all_ids) - len(looked), np.uint8)))
            # Of equal ids the first stays, which is the one already in the beam.
            _, first = np.unique(all_ids, return_index=True)
            order = first[np.lexsort((all_ids[first], all_dists[first]))][:beam]
            ids, dists, looked, new_ids, new_dists = all_ids[order], all_dists[order], done[order], [], []

        def close() -> pa.RecordBatch:
            fold()
            return _batch(names, [[query], [code], [ids.tobytes()], [dists.tobytes()], [looked.tobytes()]])

        for batch in batches:
            queries = batch.column(0).to_numpy()
            for a, b in _runs(queries):
                if queries[a] != query:
                    if query is not None:
                        yield close()
                    query, code = queries[a], batch.column(1)[a].as_py()
                    ids = np.frombuffer(batch.column(2)[a].as_py(), np.int64)
                    dists = np.frombuffer(batch.column(3)[a].as_py(), np.float32)
                    looked = np.frombuffer(batch.column(4)[a].as_py(), np.uint8)
                    a += 1
                new_ids.append(batch.column(5).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64))
                new_dists.append(batch.column(6).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.float32))
                if sum(map(len, new_ids)) >= 1 << 16:
                    fold()
        if query is not None:
            yield close()

    return rows.repartition("query").sortWithinPartitions("query", F.col("qcode").isNull(), "node").mapInArrow(
        run, "query bigint, qcode binary, ids binary, dists binary, looked binary"
    )


def _frontier(state: DataFrame, beam: int) -> DataFrame:
    """``(query, qcode, worst, node)``: the nodes to look at next, in the closer half of each beam."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, nodes, worst = [], [], []
            for i, (ids, dists, looked) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                ids, dists, looked = np.frombuffer(ids, np.int64), np.frombuffer(dists, np.float32), np.frombuffer(looked, np.uint8)
                at = np.flatnonzero(looked == 0)[: max(1, beam // 2)]
                nodes.append(ids[at])
                rows.append(np.full(len(at), i))
                worst.append(np.full(len(at), dists[-1] if len(ids) >= beam else np.inf, np.float32))
            if rows:
                at = np.concatenate(rows)
                yield _batch(["query", "qcode", "worst", "node"], [
                    batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), np.concatenate(worst), np.concatenate(nodes)
                ])

    return state.mapInArrow(run, "query bigint, qcode binary, worst float, node bigint")


def _marked(state: DataFrame, beam: int) -> DataFrame:
    """The state with the nodes of the frontier marked as looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for looked in batch.column(4).to_pylist():
                looked = np.frombuffer(looked, np.uint8).copy()
                looked[np.flatnonzero(looked == 0)[: max(1, beam // 2)]] = 1
                out.append(looked.tobytes())
            yield _batch(["query", "qcode", "ids", "dists", "looked"], [*batch.columns[:4], pa.array(out, pa.binary())])

    return state.mapInArrow(run, state.schema)


def search(index: Index, queries: DataFrame, most: int = 10, beam: int = BEAM, hops: int = HOPS) -> DataFrame:
    """``(query_id, rank, id, score)``: the nearest ids found for each query ``(query, vec)``, never the query's own id.

    A query that has an indexed vector starts from that node's neighbours; any other from a few fixed nodes.
    """
    queries = settle(queries.select(F.col("query").cast("long").alias("query"), F.col("vec").cast("array<double>").alias("vec")), "queries")
    spark = queries.sparkSession
    if not index.nodes:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vecs = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield _batch(["query", "qcode", "node"], [batch.column(0), [x.tobytes() for x in encode(vecs)], batch.column(2)])

    known = queries.join(index.vectors, "vec", "left").select("query", "vec", "node")
    coded = settle(known.mapInArrow(codes, "query bigint, qcode binary, node bigint"), "coded")
    entries = [r["node"] for r in index.graph.select("node").orderBy(F.xxhash64("node")).limit(ENTRIES).collect()]
    starts = F.when(F.col("node").isNotNull(), F.array("node")).otherwise(F.array(*[F.lit(e).cast("bigint") for e in entries]))
    graph = settle(_with_codes(index.graph), "wide")
    empty = F.lit(b"")
    state = coded.select("query", "qcode", empty.alias("ids"), empty.alias("dists"), empty.alias("looked"))
    frontier = coded.select("query", "qcode", F.lit(float("inf")).cast("float").alias("worst"), F.explode(starts).alias("node"))
    # The start itself is a find too, if it is not the query's own node.
    own = index.graph.select("node", F.col("code"))
    start_codes = frontier.join(own, "node").select("query", "qcode", "worst", F.col("node"), "code")
    found = _looked_at(frontier, graph).union(_distances(start_codes))
    for _ in range(hops):
        state = settle(_beams(state, found, beam), "beams")
        # A byte 0 among the marks: a node in some beam that has not been looked at.
        if state.filter(F.hex("looked").rlike("^(01)*00")).isEmpty():
            break
        found, state = _looked_at(_frontier(state, beam), graph), _marked(state, beam)
    else:
        state = settle(_beams(state, found, beam), "beams")
    return _measured(index, queries, state, most)


def _distances(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = ((decode(_bytes(batch.column(4))) - decode(_bytes(batch.column(1)))) ** 2).sum(1).astype(np.float32)
                yield _batch(["query", "node", "d"], [batch.column(0), batch.column(3), d])

    return rows.mapInArrow(run, "query bigint, node bigint, d float")


def _measured(index: Index, queries: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """The closest of each beam measured on the original vectors, with the ids of their nodes, ranked."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, np.int64)[: max(MEASURED, 2 * most)] for x in batch.column(1).to_pylist()]
            if ids:
                yield _batch(["query", "node"], [np.repeat(batch.column(0).to_numpy(), list(map(len, ids))), np.concatenate(ids)])

    named = state.select("query", "ids").mapInArrow(nodes, "query bigint, node bigint")
    vectors = index.vectors.withColumnRenamed("vec", "other").join(index.members, "node")
    pairs = named.join(vectors, "node").join(queries, "query")
    squared = F.aggregate(F.zip_with("vec", "other", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    rows = pairs.select(F.col("query").alias("query_id"), F.sqrt(squared).alias("score"), F.explode("ids").alias("id"))
    nearest = Window.partitionBy("query_id").orderBy("score", "id")
    return rows.filter("id != query_id").withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= most).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "id", "score"
    )
