"""Greedy string tiling: tiles against brute force, the seed join against all pairs, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry.llm import tiling as T
from fathomry.llm.scratch import Scratch

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def brute_tiles(item, text, k):
    """Greedy string tiling by comparing every place with every place; ties at the smaller places."""
    a, b, tiles = [False] * len(item), [False] * len(text), []
    while True:
        best, found = k, []
        for p in range(len(item)):
            for t in range(len(text)):
                j = 0
                while p + j < len(item) and t + j < len(text) and item[p + j] == text[t + j] and not a[p + j] and not b[t + j]:
                    j += 1
                if j > best:
                    best, found = j, [(p, t)]
                elif j == best:
                    found.append((p, t))
        if not found:
            return tiles
        for p, t in found:
            if not any(a[p : p + best]) and not any(b[t : t + best]):
                a[p : p + best] = b[t : t + best] = [True] * best
                tiles.append((p, t, best))


def numbers(item, text):
    known = {w: i for i, w in enumerate(dict.fromkeys(item))}
    return np.array([known[w] for w in item]), np.array([known.get(w, -1) for w in text])


@pytest.mark.parametrize("search", [1, 5, 20, 200])
def test_tiles_are_those_of_brute_force(search, monkeypatch):
    monkeypatch.setattr(T, "SEARCH", search)
    draw = random.Random(search)
    for n in range(80):
        letters = ("abc", "abcdefgh", "a")[n % 3]
        item = [draw.choice(letters) for _ in range(draw.randint(5, 50))]
        text = []
        for _ in range(draw.randint(0, 9)):
            at = draw.randrange(len(item))
            text += item[at : at + draw.randint(1, 30)] + [draw.choice(letters + "xyz") for _ in range(draw.randint(0, 3))]
        k = draw.choice([2, 3, 5])
        assert T.tile(*numbers(item, text), k) == brute_tiles(item, text, k)


def test_hashes_roll():
    values = np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64)
    for k in (1, 5, 299, 300):
        expected = [sum(int(v) * pow(int(T.BASE), j, 1 << 64) for j, v in enumerate(values[i : i + k])) % (1 << 64) for i in range(len(values) - k + 1)]
        assert T.rolling(values, k).tolist() == expected
    assert len(T.rolling(values, 301)) == 0


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(T, "rolling", lambda values, k: np.zeros(max(len(values) - k + 1, 0), np.uint64))  # all collide
    draw = random.Random(2)
    for _ in range(20):
        item, text = ([draw.choice("abcdef") for _ in range(30)] for _ in range(2))
        assert T.tile(*numbers(item, text), 2) == brute_tiles(item, text, 2)


def test_join_finds_every_covered_item(spark):
    """Against tiles of all pairs: no pair at the threshold is lost, whatever the phrases that items share."""
    draw = random.Random(6)
    phrase = [f"p{i}" for i in range(6)]
    items = [[draw.choice("abcdefghijklmnop") for _ in range(draw.randint(5, 40))] + (phrase if i % 2 else []) for i in range(20)]
    items += [items[0], ["one", "two"]]
    rows = []
    for i in range(60):
        item = items[i % len(items)]
        parts = [item[j : j + 8] for j in range(0, len(item), 8)]
        draw.shuffle(parts)
        text = [w for p in parts[: draw.randint(max(0, len(parts) - 2), len(parts))] for w in [*p, *(draw.choice("xyz") for _ in range(draw.randint(0, 2)))]]
        rows.append((i, " ".join(text + phrase * (i % 3)).upper()))
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in enumerate(items)], ITEMS)
    docs = spark.createDataFrame(rows, DOCS)
    scratch = Scratch(spark, "t")
    found = T.all_tiles(docs, bench, scratch)
    got = {(r.doc_id, r.item_id): (r.coverage, [tuple(t) for t in r.tiles]) for r in docs.select("doc_id", T.text_key().alias("key")).join(found, "key").collect()}
    contaminated = 0
    for i, text in rows:
        words = text.lower().split()
        for n, item in enumerate(items):
            tiles = brute_tiles(item, words, T.MIN_MATCH) if len(item) >= T.MIN_MATCH else [(0, 0, len(item))] if words == item else []
            cover = sum(t[2] for t in tiles) / len(item)
            if (i, n) in got:
                assert got[i, n] == (cover, tiles)
            else:
                assert cover < T.THRESHOLD
            contaminated += cover >= T.THRESHOLD
    assert contaminated > 10
    # a phrase that half of the items share brings nothing together
    plain = spark.createDataFrame([(1, " ".join(phrase))], DOCS)
    long_items = bench.filter(F.size(F.split("text", " ")) > 37)
    assert T.all_tiles(plain, long_items, scratch).count() == 0


def test_cases(spark):
    b = " ".join(f"w{i}" for i in range(40))
    turned = " ".join(b.split()[20:] + ["x"] + b.split()[:20])
    bench = spark.createDataFrame([(1, b), (1, b), (1, "yes"), (2, "short one"), (None, None), (3, ""), (None, "null items count as any other")], ITEMS)
    long_text = "filler " * 200_000 + b + " filler" * 10
    rows = [(1, turned, 0), (2, "Short ONE", 0), (3, "a short one here, yes", 0), (4, None, 0), (5, "", 0), (6, " ".join(b.split()[:25]), 0), (None, b.upper(), 0), (7, b, 0), (7, b, 1), (7, "clean", 2), (8, long_text, 0), (9, "null items count as any other", 0)]
    docs = spark.createDataFrame(rows, DOCS + ", fathomry_key int").withColumns({c: F.lit(1) for c in ("key", "tiles", "item_id", "coverage", "seed")})
    kept = T.decontaminate(docs, bench, Scratch(spark, "t"))
    assert kept.columns == docs.columns and sorted((r.doc_id, r.fathomry_key) for r in kept.collect()) == [(3, 0), (4, 0), (5, 0), (6, 0), (7, 2)]
    for d, i, n in ((docs, bench.limit(0), len(rows)), (docs.limit(0), bench, 0), (docs, spark.createDataFrame([(1, None), (2, " ")], ITEMS), len(rows))):
        assert T.decontaminate(d, i, Scratch(spark, "t")).count() == n
