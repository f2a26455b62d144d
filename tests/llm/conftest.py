import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, fp bigint, size int, id string, spans int, block int"


def invented(rng, words=60, vocabulary=400):
    return " ".join(rng.choice("aeiou") + rng.choice("bdfg") * (rng.randrange(vocabulary) % 3) + str(rng.randrange(vocabulary)) for _ in range(words))


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows; ids not in order."""
    rng = random.Random(8)
    texts = [invented(rng, rng.randrange(5, 120)) for _ in range(40)]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t ", None, "s1", 4), (None, texts[0], "de", "s2", 1)]
    rows += [(103, "123 456 !", "en", "s0", 9), (104, "one", "en", None, 3), (105, "Zwei Wörter", "de", "s3", 11)]
    rows += [(106, "long " * 3 + invented(rng, 30_000), "en", "s1", 1), (107, "x" * 70_000, "en", "s1", 70_000)]
    rows += [rows[3]] * 3 + [(108, texts[5], "en", "s2", 2), (109, texts[5].upper(), "en", "s2", 2), (-4, texts[7] + " more", "de", "s0", 3)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    """The rows in three partitions, with further columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, "k", 7, 1, "i", 2, 3) for r in awkward_rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
