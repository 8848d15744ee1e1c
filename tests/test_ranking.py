"""Rankings against the same by relations, with odd rows, and the shapes of their plans."""

import pytest
from pyspark.sql import functions as F

from fathomry.operators import bm25, evaluate, grounding
from fathomry.sources.workspace import Workspace

ROWS = [(1, "a", "cars drive to the ocean"), (2, "a", "the Ocean"), (2, "a", "the ocean is the ocean"), (2, "b", "the car"), (3, "b", None), (4, "b", ""), (5, None, "cars"), (6, "b", "cars well-known"), (6, "b", "cars wellknown it"), (7, "c", "nothing of it"), (None, "a", "ocean ocean")]
ASKED = [(1, "cars and the ocean"), (2, "wellknown Cars"), (3, "absent"), (4, None), (5, "the the it")]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "qid long, text string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, source string, text string")


@pytest.fixture(scope="module")
def whole(spark, docs):
    """Without null texts, whose length the relations take as 0 and the SQL leaves out."""
    return docs.filter("text is not null")


def same(a, b, columns):
    rows = lambda d: sorted((tuple(r) for r in d.select(*columns).collect()), key=str)
    assert rows(a) == rows(b)


@pytest.mark.parametrize(("corpus", "at_once"), [("source", 1 << 20), (None, 8)])
def test_best_equals_the_relations(whole, asked, corpus, at_once, monkeypatch):
    monkeypatch.setattr(bm25, "AT_ONCE", at_once)
    by_joins = bm25.top(bm25.scores(*bm25.index(whole, corpus), bm25.query_terms(asked)), 2, ("corpus", "qid"))
    same(bm25.search(whole, asked, 2, corpus), by_joins, ["corpus", "qid", "doc_id", "score", "rank"])


def test_runs_equal_the_relations(whole, asked):
    posts, stats = bm25.index(whole)
    terms = bm25.query_terms(asked)
    wide = asked.select("qid", F.concat_ws(" ", "text", F.lit("it")).alias("text"))
    got = bm25.best(whole, asked, {"words": 1, "overlap": 3, "expanded": 2}, wider=wide)
    hits = posts.select("doc_id", "term").distinct().join(terms, "term").groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("score"))
    same(got.filter("run = 'overlap'"), bm25.top(hits, 3), ["qid", "doc_id", "rank"])
    same(got.filter("run = 'words'"), bm25.top(bm25.scores(posts, stats, terms), 1), ["qid", "doc_id", "rank"])
    merged = bm25.expanded(bm25.scores(posts, stats, terms), bm25.scores(posts, stats, bm25.query_terms(wide)))
    same(got.filter("run = 'expanded'"), bm25.top(merged, 2), ["qid", "doc_id", "score", "rank"])


def test_null_texts_count_but_have_no_length(docs, asked):
    got = {(r.qid, r.doc_id) for r in bm25.search(docs, asked, 10).collect()}
    assert {(1, 1), (1, 5), (2, 6), (5, 7)} <= got and not any(d in (3, 4) for _, d in got)


def test_pairs_of_query_and_document_are_not_shuffled(spark, asked):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the ocean "), F.col("id").cast("string")).alias("text"))
    got = Workspace(spark, "plan").save(bm25.search(docs, asked, 2))
    plan = bm25.search(docs, asked, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and {(r.qid, r.doc_id) for r in got.collect()} == {(1, 0), (1, 1), (5, 0), (5, 1)}


def test_a_worker_holds_few_cells(whole, asked, monkeypatch):
    expected = bm25.search(whole, asked, 3).collect()
    monkeypatch.setattr(bm25, "CELLS", 1 << 13)
    monkeypatch.setattr(bm25, "PAIRS", 1)
    assert sorted(bm25.search(whole, asked, 3).collect(), key=str) == sorted(expected, key=str)


def test_passages_are_found_wherever_they_begin(spark, monkeypatch):
    passages = ["the quick brown fox jumps", "short", "héllo wörld, this is a ॐ passage", "", None, "quick brown fox jumps over it all the time"]
    texts = ["x" * 40 + "xthe quick brown fox jumpsy", "a short one", "say héllo wörld, this is a ॐ passage", None, "", "the quick brown fox", "he quick brown fox jumps over it all the time"]
    expected = {(q, d) for q, p in enumerate(passages) for d, t in enumerate(texts) if p is not None and t is not None and p in t}
    frame = lambda rows, key: spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string")
    for at_once in (4 << 20, 1):
        monkeypatch.setattr(evaluate, "LOOKED", at_once)
        assert {tuple(r) for r in evaluate.holders(frame(texts, "doc_id"), frame(passages, "qid")).collect()} == expected


def test_vocabulary_counts_words_and_texts(spark, docs):
    by_rows = bm25.postings(docs.filter("text is not null").withColumn("doc_id", F.monotonically_increasing_id())).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    same(bm25.vocabulary(docs), by_rows, ["term", "df", "cf"])


def test_known_words_do_not_shuffle_the_vocabulary(spark):
    vocabulary = spark.range(1000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("term")).union(spark.createDataFrame([("policies",), ("walk",)], "term string"))
    asked = spark.createDataFrame([("word7",), ("policing",), ("walking",), ("zzz",), (None,)], "term string")
    got = grounding.known_terms(asked, vocabulary)
    assert {r.term: r.known for r in got.collect() if r.term} == {"word7": True, "policing": True, "walking": True, "zzz": False}


def test_dense_search_equals_every_product(spark, monkeypatch):
    from fathomry.operators import dense

    rows = [(i, [float((i * 7 + j * 3) % 5 - 2) for j in range(8)]) for i in range(60)] + [(60, [0.0] * 8)]  # with many ties
    v = dense.normalised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    q = v.filter("doc_id % 9 = 0").selectExpr("doc_id AS qid", "v AS q")
    expected = bm25.top(dense.cosine_scores(v, q), 7)
    same(dense.search(v, q, 7), expected, ["qid", "doc_id", "score", "rank"])
    monkeypatch.setattr(dense, "CELLS", 1)
    monkeypatch.setattr(dense, "AT_ONCE", 200)
    same(dense.search(v, q, 7), expected, ["qid", "doc_id", "score", "rank"])
    assert "NestedLoop" not in dense.search(v, q, 7)._jdf.queryExecution().executedPlan().toString()
