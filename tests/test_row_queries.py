"""Results that each row gives by itself: no joins of rows, and odd rows."""

from pyspark.sql import functions as F

from fathomry.operators import chunking, grounding


def test_best_chunks_need_no_join(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, ""), (3, None), (4, "x y")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "E f G"), (8, ""), (9, "b e")], "qid long, text string")
    got = chunking.best_chunks(docs, asked, 4, 1)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(7, 1, 1, 3), (7, 4, 0, 0), (8, 1, 0, 0), (8, 4, 0, 0), (9, 1, 0, 1), (9, 4, 0, 0)]


def test_overlap_looks_each_word_up_once(spark):
    pairs = spark.createDataFrame([("word word other", "Word"), (None, "x"), ("word", None), ("", "x"), ("of it", "of it")], "a string, b string")
    share = pairs.select(F.round(grounding.lexical_overlap("a", "b"), 6).alias("s"))
    assert "array_contains" not in share._jdf.queryExecution().executedPlan().toString()
    assert [round(r.s, 3) for r in share.collect()] == [0.642, 0.0, 0.0, 0.0, 0.0]
