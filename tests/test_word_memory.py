"""Word memory and signatures: vectors drawn at once, and nothing that depends on the size of the corpus."""

from fathomry.functions import hashing
from fathomry.operators import vectors


def test_vectors_drawn_at_once_are_those_of_single_words(monkeypatch):
    words = [f"word{i}" for i in range(400)]
    for nnz in (16, 32, 64):
        places, signs = hashing.arrays([f"0\x1f{w}" for w in words], nnz)
        assert all(tuple(zip(p, s, strict=True)) == hashing.vector(w, 0, nnz) for w, p, s in zip(words, places.tolist(), signs.tolist(), strict=True))
    monkeypatch.setattr(hashing.Drawn, "MOST", 7)
    drawn = hashing.Drawn(0, 16)
    for at in (words[:3], words[2:9], words[1:2], words[:20]):
        assert [list(map(int, p)) for p in drawn.of(at)[0]] == [[x for x, _ in hashing.vector(w, 0, 16)] for w in at]


def test_every_pair_teaches_and_every_chunk_is_compared(spark):
    """Over 30,000 pairs, those that occur once were left out; over 1,500 chunks, 400 were compared."""
    n = 6000
    docs = spark.createDataFrame([(i, f"common w{i} x{i} common") for i in range(n)], "doc_id long, text string")
    chunks = docs.selectExpr("doc_id", "0 AS chunk_no", "split(text, ' ') AS tokens")
    index = vectors.build(docs, chunks)
    assert index.memory.context.count() == 2 * n + 1
    hits = vectors.search(index, spark.createDataFrame([(1, f"w{n - 1}"), (2, "common")], "qid long, text string"), 3).collect()
    assert {(r.qid, r.doc_id) for r in hits if r.rank == 1 and r.qid == 1} == {(1, n - 1)} and sum(r.qid == 2 for r in hits) == 3
