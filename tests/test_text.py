from pyspark.sql import Row

from periodlens.functions import lists
from periodlens.functions import text as fx
from periodlens.operators import text


def _one(spark, value, col):
    return spark.createDataFrame([(value,)], "v string").select(col.alias("o")).first()["o"]


def test_flatten(spark):
    assert _one(spark, None, fx.flatten("v")) == ""
    assert _one(spark, " \t\n ", fx.flatten("v")) == ""
    assert _one(spark, "\ta b \r\n\n c\\nd", fx.flatten("v")) == "a b c d"


def test_chunk_sizes(spark):
    for n in (1, 7, 8, 9, 17):
        got = _one(spark, "\n\n".join(f"\tl{i} " for i in range(n)), fx.chunk("v"))
        assert got == [" ".join(f"l{i}" for i in range(s, min(s + 8, n))) for s in range(0, n, 8)]
    assert _one(spark, None, fx.chunk("v")) == []
    assert _one(spark, "  ", fx.chunk("v")) == []
    assert _one(spark, "a\nb\nc", fx.chunk("v", 2)) == ["a b", "c"]


def test_chunk_rows_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, " "), (3, None)], "id int, v string")
    assert text.chunks(df, ["id"], "v").collect() == [Row(id=1, chunk_no=0, chunk="a b")]
    assert {r["id"] for r in text.chunks(df, ["id"], "v", keep_empty=True).collect()} == {1, 2, 3}
    assert [r["text"] for r in text.lines(df, "v").collect()] == ["a", "b"]


def test_lexicon(spark):
    words = ["love", "heart", "the"]
    assert _one(spark, "Love, lovely LOVE! heart's\nthe_the thé the", fx.lexicon_count("v", words)) == 4
    assert _one(spark, None, fx.lexicon_count("v", words)) is None
    assert _one(spark, "", fx.lexicon_count("v", words)) == 0
    both = fx.lexicon_counts("v", [["love"], ["love", "of you"], ["x.y"]])
    assert _one(spark, "love of you, loveof you X.Y xzy", both) == [1, 2, 1]


def test_lists(spark):
    assert _one(spark, "['A B', \"C\"]; D,, ", lists.parse_list("v")) == ["A B", "C", "D"]
    assert _one(spark, "Guns N' Roses", lists.parse_list("v")) == ["Guns N", "Roses"]
    assert _one(spark, "1994; 2000.0;;x", lists.parse_periods("v")) == [1994, 2000]
    assert _one(spark, None, lists.parse_periods("v")) == []
    keys = spark.createDataFrame([(k,) for k in (-1, 0, 5, 6, 11, 12, None)], "k int")
    assert [r[0] for r in keys.select(lists.fold_circular("k")).collect()] == [None, 0, 5, 5, 0, None, None]
