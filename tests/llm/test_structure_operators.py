"""Periodic runs, repaired conversations and benchmark passages against plain versions of the same definitions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from periodlens.llm import leaks, periodic, queries, repair
from tests.oracle import connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_runs(words, least=6, periods=4):
    out = []
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            n = i - start + q
            if n >= max(least, periods * q) and i > start:
                part = words[start : start + n]
                if all(part[d:] != part[:-d] for d in range(1, q)):
                    out.append((start, n, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


@pytest.mark.parametrize("least, periods", [(6, 4), (2, 2), (9, 3)])
def test_runs_are_all_found(least, periods):
    rng = random.Random(least)
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(4)):
            n, kinds = rng.randrange(50), rng.randrange(1, 4)
            words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randrange(3, 11)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        for words, (runs, text) in zip(texts, periodic._batch_runs(texts, least, periods)):
            expected = plain_runs(words, least, periods)
            assert runs == expected and text == plain_collapsed([w.decode() for w in words], expected)


def test_long_periodic_texts():
    assert periodic._batch_runs([[b"a"] * 100_000], 6, 4)[0] == ([(0, 100_000, 1)], "a")
    words = [b"%d" % (i % 977) for i in range(50_000)]
    assert periodic._batch_runs([words], 6, 4)[0][0] == [(0, 50_000, 977)]


def plain_planted(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_planted_runs_of_awkward_rows(awkward, awkward_rows):
    got = Counter(
        (r["id"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in periodic.runs(periodic.planted(awkward), "id", "text").collect()
    )
    expected = Counter()
    for i, t, *_ in awkward_rows:
        words = plain_planted(i, t)
        if len(words) < 2000:
            runs = plain_runs(words)
        else:
            runs = [tuple(x) for x in periodic._batch_runs([[w.encode() for w in words]], 6, 4)[0][0]]
        expected[i, tuple(runs), plain_collapsed(words, runs)] += 1
    assert got == expected and any(key[1] for key in got)
    with pytest.raises(ValueError):
        periodic.runs(awkward, least_periods=1)


def test_batches_are_cut_by_words(spark, monkeypatch):
    texts = [f"x{i} " * (i % 9) for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    got = {r["id"]: [tuple(x) for x in r["runs"]] for r in periodic.runs(df).collect()}
    assert got == {i: plain_runs(t.split()) for i, t in enumerate(texts)}


# --- conversations


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("b" if not last else "d" if (role, text) in seen else "-" if last[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """All repairs by breadth, the lightest by cost and audit: turns are inserted at most twice in a row."""
    faults = plain_faults(rows)
    best = {(): (0, "", [])}

    def better(table, key, value):
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value

    def state(initials):
        # Only what has been written last matters, and whether anything has.
        return initials[-1:]

    def inserted(table):
        out = dict(table)
        for _ in range(2):
            for s, (c, a, w) in list(out.items()):
                for role in ("user", "assistant"):
                    if allowed(s, role[0]):
                        better(out, state((role[0],)), (c + 2, a + "I", [*w, f"{role}:"]))
        return out

    def allowed(s, x):
        last = s[0] if s else ""
        return {"": "su", "s": "u", "u": "a", "a": "u"}[last].find(x) >= 0 and x != ""

    for (role, text), fault in zip(rows, faults):
        after = {}
        for s, (c, a, w) in inserted(best).items():
            better(after, s, (c + 3, a + "D", w))
            if fault not in "bd":
                extra = fault == "t"
                if allowed(s, role[:1]):
                    better(after, (role[0],), (c + extra, a + "K", [*w, f"{role}:{text}"]))
                for other in ("user", "assistant"):
                    if allowed(s, other[0]):
                        better(after, (other[0],), (c + extra + 2, a + "R", [*w, f"{other}:{text}"]))
        best = after
    cost, audit, written = min((v for s, v in inserted(best).items() if s in ((), ("a",))), key=lambda v: v[:2])
    return cost, audit, hashlib.sha256("\n".join(written).encode()).hexdigest()


def invented_turns(rng, n):
    roles = ["user", "assistant", "system", "tool", "umpire", ""]
    texts = ["Yes.", "no", "", " \n", "What?  ", "Then. so", "Ünd!"]
    return [(rng.choice(roles[: rng.randrange(2, 7)]), rng.choice(texts) + rng.choice(["", str(rng.randrange(40)) + "."])) for _ in range(n)]


def test_lightest_repairs():
    rng = random.Random(3)
    for _ in range(400):
        rows = invented_turns(rng, rng.randrange(9))
        goals = repair.lightest(tuple(r[:1] for r, _ in rows), "".join({"d": "d"}.get(f, f) for f in plain_faults(rows)))
        assert min(goals[q] for q in repair.FINAL) == plain_repair(rows)[:2]


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))


def plain_report(rows):
    """Rows ``(conv, turn, role, text)`` of one conversation, none of them null in role or text."""
    rows = by_turn(rows)
    turns = [t for _, t, *_ in rows if t is not None]
    faults = plain_faults([r[2:] for r in rows])
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(rows)]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
        sum(p not in ("su", "ua", "au") for p in pairs), *plain_repair([r[2:] for r in rows]),
    )


@pytest.mark.parametrize("piece", [3, 256])
def test_repairs_of_awkward_rows(spark, piece):
    rng = random.Random(5)
    rows = []
    for conv in (1, 2, 3, None, 7):
        n = 120 if conv == 7 else rng.randrange(1, 12)
        for role, text in invented_turns(rng, n):
            rows.append((conv, rng.choice([None, *range(n // 2 + 2)]), role, text))
    rows += rows[:4] + [rows[-1]] * 9 + [(9, None, None, None), (9, 4, "user", None), (9, 4, "assistant", "long " * 30_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, conv int, fault string").repartition(5)
    turns = repair.turns_of(df)
    gone = spark.createDataFrame([(50,)], "conv bigint")
    got = {r["conv"]: tuple(r)[1:] for r in repair.report(turns.select("conv").union(gone), turns, piece).collect()}
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got.pop(50) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: plain_report([r for r in plain if r[0] == c]) for c in {r[0] for r in rows}}


def test_repaired_conversations_are_sound(spark):
    turns = repair.turns_of(queries.read(spark, "/root/testdata/sf0.001", "conversations"))
    ready = repair.marked(repair.damaged(turns))
    fixed = repair.repaired(ready, repair.chained(ready)).orderBy("conv", "piece", "place").collect()
    for _, rows in itertools.groupby(fixed, key=lambda r: r["conv"]):
        assert re.fullmatch("s?(ua)+", "".join(r["role"][0] for r in rows))
    whole = Counter((r["conv"], r["role"], r["text"]) for r in turns.collect())
    assert sum((r["conv"], r["role"], r["text"]) in whole for r in fixed) > len(fixed) * 0.6


def test_one_conversation_fills_many_tasks(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"Turn {i}.") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    ready = repair.marked(repair.turns_of(df), 50)
    assert ready.filter("place < 0").count() >= 60
    assert ready.select(F.shiftright("piece", 32).alias("task")).distinct().count() == 8
    chain = repair.chained(ready).first()
    assert (chain["cost"], chain["audit"]) == (0, "K" * 3000)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(3)] + [(None, None, "system", "x.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    expected = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        expected[row] += 0 if kind == 0 else 2 if kind == 3 else 1
    assert Counter(tuple(r) for r in repair.damaged(repair.turns_of(df)).collect()) == +expected


# --- benchmark passages


def plain_words(text):
    return PLAIN_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_leaks(text, items, width):
    words, hit, found = plain_words(text), set(), set()
    for item, own in items:
        own = plain_words(own)
        k = min(width, len(own))
        for a in range(len(own) - k + 1 if own else 0):
            for b in range(len(words) - k + 1):
                if own[a : a + k] == words[b : b + k]:
                    hit |= set(range(b, b + k))
                    found.add("" if item is None else str(item))
    return len(words), hit, sorted(found)


@pytest.mark.parametrize("block", [1 << 23, 200])
def test_leaks_against_a_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", block)
    rng = random.Random(block)

    def text(n):
        return "".join(rng.choice(["A", "b", "É", "1c", "ü", "—"]) + rng.choice([" ", ". ", "\n", "'", "\x00"]) for _ in range(n))

    items = [(i, text(rng.randrange(2, 9))) for i in range(6)] + [(None, "b A, b"), (3, "1c 1c 1c"), (8, None), (9, ".,;"), (10, "")]
    docs = [(i, text(rng.randrange(60))) for i in range(40)] + [(40, None), (41, ""), (None, "b a b"), (None, "b a b"), (42, text(20_000))]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id int, text string, n_words int, hits string, item int").repartition(3)
    asked = spark.createDataFrame([(*x, 5) for x in items], "item_id int, text string, part int")
    got = leaks.scan(df, asked, width=4)
    cut = Counter((r["id"], r["text"]) for r in leaks.removed(got, "#").collect())
    rows, expected = Counter(), Counter()
    for r in got.collect():
        places = {x for s in r["hits"] for x in range(s["start"], s["end"])}
        rows[r["id"], r["text"], r["n_words"], frozenset(places), tuple(r["items"])] += 1
        words = plain_words(r["text"])
        assert len(r["spans"]) == len(r["hits"])
        for s, h in zip(r["spans"], r["hits"]):
            assert plain_words(r["text"][s["start"] : s["end"]]) == words[h["start"] : h["end"]]
        if not r["spans"]:
            assert cut[r["id"], r["text"]]
    for i, t in docs:
        if i != 42:
            n, hit, found = plain_leaks(t, items, 4)
            expected[i, t, n, frozenset(hit), tuple(found)] += 1
    assert Counter({k: v for k, v in rows.items() if k[0] != 42}) == expected
    n, hit, found = plain_leaks(docs[-1][1][:3000], items, 4)
    long = next(k for k in rows if k[0] == 42)
    assert {x for x in long[3] if x < n - 4} == {x for x in hit if x < n - 4} and set(found) <= set(long[4])


def test_leaks_of_empty_tables(spark, empty, awkward, awkward_rows):
    none = spark.createDataFrame([], "item_id int, text string")
    assert leaks.scan(empty, none).count() == periodic.runs(periodic.planted(empty), "id", "text").count() == 0
    assert leaks.scan(awkward, none).filter("size(hits) > 0 OR size(items) > 0").count() == 0
    assert leaks.scan(awkward, none).count() == len(awkward_rows)
    turns = repair.turns_of(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    assert repair.report(turns, repair.damaged(turns)).count() == 0


def test_items_given_whole_are_found(spark):
    con = connect("/root/testdata/sf0.01")
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    docs = [(i, f"Before that, {t.upper() if t.isascii() else t}\nand after") for i, t in items]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = leaks.scan(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(str(r["id"]) in r["items"] and len(r["spans"]) == 1 for r in rows) and len(rows) == len(items)
