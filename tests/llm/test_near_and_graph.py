"""Near duplicates and components against brute force."""

import random
import re
from itertools import combinations

import pytest

from fathomry.llm import near
from fathomry.llm.graph import components
from fathomry.llm.scratch import Scratch

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k, percent=80):
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def varied(base, share, rng):
    return " ".join(rng.choice("pqrstuvwxyz") * rng.randint(1, 9) if rng.random() < share else w for w in base)


@pytest.mark.parametrize(("k", "share", "with_base"), [(2, 0.03, True), (2, 0.055, False), (5, 0.02, True)])
def test_components_equal_brute_force(spark, k, share, with_base):
    rng = random.Random(k)
    base = [f"w{rng.randint(0, 500)}" for _ in range(150)]
    texts = [varied(base, share, rng) for _ in range(90)] + [" ".join(base)] * (2 * with_base)
    texts += [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 40))) for _ in range(40)]
    texts += ["", None, "one", "ONE", "a b", "  ", "x " * 3000]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int"), Scratch(spark, "t"), k)
    assert sorted(map(tuple, got.collect())) == brute(rows, k)


def test_blocks_find_links_that_hubs_miss(spark, monkeypatch):
    """Without hub rounds, the members of open buckets find each other in blocks of three."""
    monkeypatch.setattr(near, "ROUNDS", 0)
    monkeypatch.setattr(near, "BLOCK", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    chain = [list(base)]
    for step in range(12):  # neighbours are near, the ends are not
        nxt = list(chain[-1])
        for j in range(step * 5, step * 5 + 5):
            nxt[j] = f"n{step}-{j}"
        chain.append(nxt)
    texts = [" ".join(c) for c in chain]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), 2)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2)


def test_null_ids_repeated_rows_and_no_rows(spark):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (None, None)]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert len(got) == 4 and [r.component_id for r in got if r.doc_id == 1] == [1, 1]
    assert near.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark, "t")).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(50, 40), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(edges, Scratch(spark, "t"), "c").collect()))
    assert got == {**dict.fromkeys(range(21), 0), 40: 40, 50: 40}


def test_min_and_max_are_those_of_every_function():
    import numpy as np

    a, b = near.functions_of(7)
    x = np.random.default_rng(1).integers(0, 1 << 63, 50, np.uint64)
    each = [(x * p + q) for p, q in zip(a, b, strict=True)]
    assert near.min_max(x, a, b).tolist() == [e.min() for e in each] + [e.max() for e in each]


def test_shared_counts_are_those_of_intersections(monkeypatch):
    import numpy as np

    draw = np.random.default_rng(3)
    for common in (2, 5, 64):
        monkeypatch.setattr(near, "COMMON", common)
        own = [np.unique(draw.integers(0, 60, draw.integers(1, 50))) for _ in range(25)]
        got = near.shared_counts(own)
        assert all(got[i, j] == len(np.intersect1d(own[i], own[j])) for i in range(25) for j in range(25) if i != j)


def test_rows_of_one_id_are_in_one_component(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (5, "w x y z"), (5, ""), (9, "w x y z"), (8, "q r s"), (8, None), (7, "other words here"), (7, "more of other words"), (2, "more of other words")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, cid int, label int")
    got = near.near_duplicates(docs, Scratch(spark, "t"), 2).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (3, 3), (5, 3), (5, 3), (5, 3), (7, 2), (7, 2), (8, 8), (8, 8), (9, 3)]
    assert {(r.doc_id, r.kept) for r in got} == {(2, True), (3, True), (5, False), (7, False), (8, True), (9, False)}


@pytest.mark.parametrize("k", [2, 5])
def test_recall_on_a_table(spark, k):
    """All links of brute force at sf0.01 are found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingle_set(r.text, k) for r in docs.collect()}
    posts, shared, parent = {}, {}, {i: i for i in sets}
    for i, own in sets.items():
        for x in own:
            for j in posts.setdefault(x, []):
                shared[j, i] = shared.get((j, i), 0) + 1
            posts[x].append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = near.near_duplicates(docs, Scratch(spark, "t"), k).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}
