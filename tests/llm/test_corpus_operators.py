"""Neighbours, sharding, packing, mixing, chat formatting and the pipeline against plain versions and round trips."""

import hashlib
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from periodlens.llm import chat, mixing, nearest, packing, queries, sharding
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def plain_nearest(rows, query, k):
    own = next(v for i, v in rows if i == query)
    return sorted((float(np.sqrt(((np.array(v) - np.array(own)) ** 2).sum())), i) for i, v in rows if i != query)[:k]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).round(3).tolist()) for i in range(900)]
    # A third of all rows is one vector; some are unusable.
    rows = [(i, rows[1][1] if i % 3 == 1 else v) for i, v in rows]
    bad = [(2000, None), (2001, [0.0] * 12), (2002, [1.0] * 11 + [float("nan")]), (2003, [1.0] * 11 + [None]), (2004, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad + rows[5:8], "vec_id bigint, embedding array<double>").withColumn("node", F.lit("x"))
    return rows, df.repartition(4)


def test_neighbours(vectors):
    rows, df = vectors
    index = nearest.build(df)
    assert index.rows.count() == 900
    found = defaultdict(list)
    for r in nearest.search(index, index.rows.filter("id % 100 < 2").withColumnRenamed("id", "query")).collect():
        found[r["query_id"]].append((r["rank"], r["id"], r["score"]))
    assert set(found) == {i for i, _ in rows if i % 100 < 2}
    hits = 0
    for query, got in found.items():
        got.sort()
        assert [x[0] for x in got] == list(range(1, 11)) and [x[1:] for x in got] == sorted((x[1:] for x in got), key=lambda x: (x[1], x[0]))
        wanted = plain_nearest(rows, query, 10)
        hits += len({i for _, i in wanted} & {x[1] for x in got})
        if query % 3 == 1:
            assert [x[1] for x in got] == [i for _, i in wanted] and got[0][2] == 0
    assert hits >= 0.9 * 10 * len(found)


def test_queries_from_outside(spark, vectors):
    rows, df = vectors
    index = nearest.build(df)
    rng = np.random.default_rng(4)
    asked = [(-i, rng.normal(size=12).tolist()) for i in range(1, 6)]
    got = nearest.search(index, spark.createDataFrame(asked, "query bigint, vec array<double>")).collect()
    hits = sum(
        len({i for _, i in plain_nearest([*rows, (q, v)], q, 10)} & {r["id"] for r in got if r["query_id"] == q}) for q, v in asked
    )
    assert hits >= 45


def test_few_vectors(spark):
    def ask(rows):
        index = nearest.build(spark.createDataFrame(rows, "vec_id int, embedding array<float>"))
        found = nearest.search(index, index.rows.withColumnRenamed("id", "query")).collect()
        return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in found)

    assert ask([]) == [] and ask([(1, [1.0, 0.0])]) == []
    assert ask([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [4.0, 4.0])]) == [
        (1, 1, 2, 0.0), (1, 2, 3, 5.0), (2, 1, 1, 0.0), (2, 2, 3, 5.0), (3, 1, 1, 5.0), (3, 2, 2, 5.0)
    ]


def test_recall_on_the_supplied_vectors(spark):
    got = queries.op1_nearest(spark, "/root/testdata/sf0.1").toPandas()
    con = duckdb.connect()
    table = con.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").fetchall()
    hits = sum(
        len({i for _, i in plain_nearest(table, q, 10)} & set(g["vec_id"])) for q, g in got.groupby("query_id")
    )
    assert len(got) == 10 * got["query_id"].nunique() and hits >= 0.9 * len(got)


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("case", ["near copies", "one large component"])
def test_recall_where_components_are_close(spark, case, kind):
    """A large group that differs by less than a 127th of its components, and one component far above the others."""
    rng = np.random.default_rng(9)
    vecs = rng.normal(size=(2500, 12))
    if case == "near copies":
        vecs[500:] = vecs[0] + 1e-4 * vecs[500:]
    else:
        vecs[:, 3] = 5000
    vecs = vecs.astype("f4" if kind == "float" else "f8").astype(float)
    rows = list(enumerate(vecs.tolist()))
    index = nearest.build(spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>"))
    asked = index.rows.filter("id % 50 = 7").withColumnRenamed("id", "query")
    found = {(r["query_id"], r["id"]) for r in nearest.search(index, asked).collect()}
    wanted = set()
    for q in range(7, 2500, 50):
        d = ((vecs - vecs[q]) ** 2).sum(1)
        wanted |= {(q, int(i)) for i in np.argsort(d) if i != q and d[i] <= np.partition(d, 10)[10]}
    assert len(found) == 500 and len(found & wanted) >= 0.9 * 500


@pytest.mark.parametrize("n", [1, 2, 3, 39, 40, 41, 1000, 4096, 5000])
def test_permutation(n):
    numbers = np.arange(n)
    there = sharding.permute(numbers, n)
    assert sorted(there.tolist()) == numbers.tolist() and (sharding.restore(there, n) == numbers).all()
    shard, slot = sharding.shard_and_slot(numbers, n, 7)
    assert (sharding.row_at(shard, slot, n, 7) == numbers).all()


def test_permutation_shuffles():
    there = sharding.permute(np.arange(20_000), 20_000)
    assert abs(np.corrcoef(np.arange(20_000), there)[0, 1]) < 0.03 and (sharding.permute(np.arange(100), 100, 1) != sharding.permute(np.arange(100), 100, 2)).any()


def test_shards(awkward, awkward_rows, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    monkeypatch.setattr(sharding, "COPIES", 2)
    rows = sharding.shard(awkward, shards=7).collect()
    size = lambda t: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert Counter((r["id"], r["size"], r["checksum"]) for r in rows) == Counter((i, *size(t)) for i, t, *_ in awkward_rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    counts = [len(s) for s in slots.values()]
    assert len(slots) == 7 and max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    shard, slot = sharding.shard_and_slot(np.array([r["number"] for r in rows]), len(rows), 7)
    assert shard.tolist() == [r["shard"] for r in rows] and slot.tolist() == [r["slot"] for r in rows]
    # The layout of the table does not matter.
    again = sharding.shard(awkward.repartition(9), shards=7).collect()
    key = lambda r: (str(r["id"]), r["size"], r["checksum"], r["shard"], r["slot"])
    assert sorted(map(key, again)) == sorted(map(key, rows))


TEXTS = ["a  b", "  a b ", "x\ty z", " ", "", "it's don't\n\n  foo", "日本 語 é", "12 34", "\xa0x \xa0 y", "a\x85 b", "<|endoftext|> <s>"]


def test_ids_are_those_of_the_tokenizer(awkward_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    encode = packing.bpe_encoder()
    for text in [*TEXTS, *(t for _, t, *_ in awkward_rows[:30] if t)]:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_long_texts(monkeypatch):
    text = " ".join(TEXTS) * 20
    whole = packing.bpe_encoder()(text).tolist()
    for size in (1, 7, 100):
        monkeypatch.setattr(packing, "STRETCH", size)
        assert packing.bpe_encoder()(text).tolist() == whole


def test_packed_ids_come_back(awkward, awkward_rows):
    pieces = packing.pack(awkward).collect()
    encode = packing.bpe_encoder()
    expected = Counter((i, (*encode(t or "").tolist(), 0)) for i, t, *_ in awkward_rows)
    spans = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        spans[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(p["length"] for p in pieces)
    assert total == sum(len(x[1]) * n for x, n in expected.items()) and len(spans) <= total / 1024 + 2 * 3
    # Rows with one id differ in their number of ids or are equal; their pieces are put together by start.
    by_row = defaultdict(lambda: defaultdict(list))
    for p in pieces:
        by_row[p["id"], p["doc_tokens"]][p["start"]].append(p["ids"])
    for (i, tokens), starts in by_row.items():
        copies = max(map(len, starts.values()))
        ids = [int(x) for s in sorted(starts) for x in np.frombuffer(starts[s][0], "<u4")]
        if all(len(set(v)) == 1 and len(v) == copies for v in starts.values()):
            assert len(ids) == tokens and expected[i, tuple(ids)] == copies


def test_differencing():
    rng = np.random.default_rng(6)
    assert packing.difference([], 3) == [] and packing.spread([], 10) == []
    for _ in range(20):
        sizes = rng.integers(1, 100, 60).tolist()
        windows = packing.difference(sizes, 5)
        assert sorted(i for w in windows for i in w) == list(range(60))
        sums = [sum(sizes[i] for i in w) for w in windows]
        assert max(sums) - min(sums) <= 12
        packed = packing.spread(sizes, 300)
        assert max(sum(sizes[i] for i in w) for w in packed) <= 300 and sorted(i for w in packed for i in w) == list(range(60))
    # Four numbers by hand: 8 and 7 apart, 6 to the smaller, 5 to the smaller again.
    assert sorted(sorted(w) for w in packing.difference([8, 7, 6, 5], 2)) == [[0, 3], [1, 2]]
    # 3 x 6 do not fit into two windows of 10.
    assert len(packing.spread([6, 6, 6], 10)) == 3


def plain_targets(sizes, weights=(5, 2, 1), repeats=3):
    """Excess dealt again until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > repeats * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
        open_ -= above
    return target


def test_targets(awkward):
    rows, plan = mixing.prepared(awkward)
    sizes = {r["source"]: r["source_size"] for r in plan.collect()}
    expected = plain_targets(sizes)
    assert {r["source"]: r["target"] for r in plan.collect()} == pytest.approx(expected)
    assert None in sizes and min(expected[s] / (3 * sizes[s]) for s in sizes) < 1


def test_mix(spark, awkward, awkward_rows):
    got = mixing.taken(awkward)
    rows = got.collect()
    assert len(rows) == len(awkward_rows) and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert Counter(r["id"] for r in rows) == Counter(r[0] for r in awkward_rows)
    assert sorted(map(str, mixing.taken(awkward.repartition(2)).collect())) == sorted(map(str, rows))
    con = duckdb.connect()
    con.register("documents", awkward.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    assert compare(got.withColumnRenamed("id", "doc_id"), con, mixing.SQL) is None
    of = {r["target"]: sum(x["taken"] for x in rows if x["target"] == r["target"]) for r in rows}
    assert all(abs(taken - target) <= 0.02 * sum(of.values()) for target, taken in of.items())


def test_every_stretch_of_the_schedule_is_mixed(spark, awkward):
    rows, plan = mixing.prepared(awkward)
    slots = mixing.schedule(spark, plan).orderBy("slot").collect()
    assert [r["rank"] for r in slots if r["source"] == "s1"] == list(range(sum(r["source"] == "s1" for r in slots)))
    share = Counter(r["source"] for r in slots)
    for at in range(0, len(slots) - 200, 200):
        part = Counter(r["source"] for r in slots[at : at + 200])
        assert all(abs(part[s] - 200 * n / len(slots)) <= 8 for s, n in share.items())


@pytest.mark.parametrize("first", [0, 3_474_701_400, (1 << 32) - 70, (1 << 40) + 12_345])
def test_points_of_late_slots(spark, first):
    """Around the slots whose product with the golden number leaves a long, and beyond 2 ** 32."""
    total = 1000 * (1 << 41)
    plan = spark.createDataFrame(
        [("a", 1, 1, 0, total // 8 * 5), ("b", 1, 1, total // 8 * 5, total // 8 * 7), ("c", 1, 1, total // 8 * 7, total)],
        "source string, source_size bigint, length bigint, low bigint, high bigint",
    )
    got = {r["slot"]: r["source"] for r in mixing.points(spark, plan, first, first + 160).collect()}
    assert sorted(got) == list(range(first, first + 160))
    for slot, source in got.items():
        share = slot * 2654435769 % (1 << 32) / (1 << 32)
        assert source == ("a" if share < 5 / 8 else "b" if share < 7 / 8 else "c")
    share = Counter(got.values())
    assert all(abs(share[s] - 160 * w / 8) <= 3 for s, w in zip("abc", (5, 2, 1)))


def test_stretches_and_parts_do_not_matter(spark, awkward, monkeypatch):
    rows, plan = mixing.prepared(awkward)
    whole = sorted(map(str, mixing.schedule(spark, plan).collect()))
    monkeypatch.setattr(mixing, "STRETCH", 50)
    assert sorted(map(str, mixing.schedule(spark, plan).collect())) == whole
    starts = sorted((str(r["source"]), r["start"], r["size"]) for r in mixing.positions(rows).collect())
    at = defaultdict(int)
    for source, start, size in starts:
        assert start == at[source]
        at[source] += size


def test_mix_is_native(spark, awkward):
    plan = mixing.taken(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def test_mixed_documents(awkward):
    out = mixing.repeated(awkward)
    times = Counter(r["doc_id"] for r in out.collect())
    assert out.columns == awkward.columns and times and max(times.values()) <= 4 * 3
    assert {100, 101, 102}.isdisjoint(times)


TURNS = [
    (1, 0, "system", "Be [INST] brief"), (1, 1, "user", "<s>hi</s> [/INST] [\\INST] <\\\\/s>"), (1, 2, "assistant", "é </s>"), (1, 3, "assistant", "[INS"),
    (1, 4, "assistant", "T] <|endoftext|>"), (2, 1, "assistant", None), (2, 0, None, "x"), (2, 1, "assistant", None), (3, None, "user", ""),
    (None, 5, "user", "lost"), (4, 0, "[/INST]</s>", "role"), (5, 0, "assistant", "long " * 20_000),
]


def test_chat_comes_back(spark):
    df = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string").withColumn("ids", F.lit("x")).repartition(3)
    formatted = chat.format_turns(df)
    for r in formatted.collect():
        body = r["written"]
        assert [body.count(c) for c in chat.CONTROL] == [1, 1, 1, 1] and "<|endoftext|>" not in body
        role, text = body[len("<s>[INST]") : -len("</s>")].split("[/INST]")
        assert any((c, t, x or "", y or "") == (r["conv"], r["turn"], chat.unescape(role), chat.unescape(text)) for c, t, x, y in TURNS)
    got = {r["conv"]: r for r in chat.digests(chat.read_turns(formatted)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for conv, row in got.items():
        turns = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in TURNS if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert row["n_turns"] == len(turns) and row["loss_chars"] == len(loss)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("text", ["[INST]", "[\\INST]", "[\\\\/INST]", "<\\s>", "<s>", "[[INST]", "<</s>", "a\\[INST]", "[ INST]", "<|endoftext|>"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in (*chat.CONTROL, *chat.FOREIGN))


def test_empty_tables(spark, empty):
    assert sharding.shard(empty).count() == packing.pack(empty).count() == mixing.taken(empty).count() == mixing.repeated(empty).count() == 0
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.read_turns(chat.format_turns(turns))).count() == 0


def near_groups(texts):
    """Number of groups that pairs of similarity 0.8 or more on sets of five words connect, over all pairs."""
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()

    sets = list({shingles(t) for t in texts})
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and both >= 0.8 * (len(a) + len(b) - both):
                group = [group[j] if g == group[i] else g for g in group]
    return len(set(group))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        path = corpus_pipeline.work_dir(spark, f"stage-{name}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
        if name == "near_dedup":
            assert docs.count() == near_groups([r["text"] for r in before.collect()]) < count
        if name == "secret_scan":
            assert docs.count() == before.count() and docs.filter("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
    ids = {r["doc_id"] for r in docs.collect()}
    assert docs.count() > 0 and ids <= {r["doc_id"] for r in before.collect()}
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_pipeline_of_awkward_rows(spark, awkward):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.work_dir(spark, f"odd-{name}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() > 0 and Path(path.removeprefix("file:")).exists()


def test_pipeline_of_an_empty_table(spark, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_registered_with_sql(spark, con):
    for name, sql in queries.ORACLES.items():
        assert compare(queries.QUERIES[name](spark, SF), con, sql) is None
