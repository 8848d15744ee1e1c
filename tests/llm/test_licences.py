"""Licence scan against plain cosines and a walk up the directories, and odd rows."""

import math
import re
from collections import Counter

import pytest

from fathomry.llm import licences as L
from fathomry.llm.scratch import Scratch

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(L.WORD, text.lower())


class Plain:
    """Cosines of texts to templates, all of them, without anything ruled out."""

    def __init__(self, templates):
        self.texts = [(name, Counter(words(t))) for name, ts in templates.items() for t in ts]
        df = Counter(t for _, c in self.texts for t in c)
        self.idf = lambda t: math.log((1 + len(self.texts)) / (1 + df[t])) + 1
        self.vectors = [(name, self.vector(c)) for name, c in self.texts]

    def vector(self, counts):
        return {t: (1 + math.log(n)) * self.idf(t) for t, n in counts.items()}

    def best(self, found, threshold):
        own = self.vector(Counter(found))
        size = math.sqrt(sum(v * v for v in own.values()))
        cosines = [(round(sum(w * v.get(t, 0) for t, w in own.items()) / size / math.sqrt(sum(x * x for x in v.values())), 9), name) for name, v in self.vectors if len(own.keys() & v.keys()) >= L.MIN_TERMS]
        cosine, name = max(cosines, key=lambda x: (x[0], [-ord(c) for c in x[1]]), default=(0, None))
        return (name, cosine) if cosine >= threshold else None


SHORT, FULL = Plain(L.TEMPLATES), Plain(L.full_texts())


def own_licence(text):
    whole = words(text or "")
    if found := len(whole) >= L.MIN_TERMS and FULL.best(whole, L.FULL_THRESHOLD):
        return found[0], True
    blocks = re.split(r"\n(?:[^\S\n]*\n)+", (text or "").lower())
    pieces = (text or "").lower().split("\n") + blocks + [s for b in blocks for s in re.split(r"(?<=[.!?;])\s+", b)] + [(text or "").lower()]
    met, longest = Counter({name: 1 for name in L.tagged(text or "")}), 0
    for own in {tuple(words(p)) for p in pieces}:
        if len(own) >= L.MIN_TERMS and (best := SHORT.best(own, L.THRESHOLD)):
            met[best[0]] += 1
            longest = max(longest, len(own))
    return (min(met, key=lambda x: (-met[x], x)), longest >= L.FILE_SHARE * len(whole)) if met else (None, False)


def expected(files):
    own = [own_licence(t) for _, t in files]
    of = {}
    for (path, _), (licence, is_file) in zip(files, own, strict=True):
        if is_file and path and "/" in path:
            of.setdefault(path.rsplit("/", 1)[0], Counter())[licence] += 1
    out = []
    for (path, _), (licence, _) in zip(files, own, strict=True):
        where, at = None, path or ""
        while licence is None and "/" in at:
            at = at.rsplit("/", 1)[0]
            if at in of:
                licence, where = min(of[at], key=lambda x: (-of[at][x], x)), at
                break
        out.append((path, licence, None if licence is None else "own" if where is None else "inherited", where))
    return out


def result(spark, files):
    got = L.scan(spark.createDataFrame(files, "path string, text string"), Scratch(spark, "t")).collect()
    return [(r.path, r.licence, r.origin, r.from_directory) for r in got]


def test_scan_is_that_of_plain_cosines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    files = [(f"{r.source}/{r.lang}/{r.doc_id}", r.text) for r in docs if len(r.text or "") < 6000]
    got = result(spark, files)
    assert sorted(got, key=str) == sorted(expected(files), key=str) and sum(r[2] == "own" for r in got) > 10


@pytest.mark.parametrize("header", ["# This Source Code Form is subject to the terms\n# of the Mozilla Public License, v. 2.0.\n", "/*\n * Permission to use, copy, modify, and/or distribute\n * this software for any purpose with or without fee\n * is hereby granted\n */\n"])
def test_wrapped_headers_of_long_files(spark, header):
    files = [("a/x.py", header + "\n" + "x = 1\n" * 5000), ("a/y.py", "x = 1\n" * 500 + "\n" + header)]
    got = result(spark, files)
    assert sorted(got, key=str) == sorted(expected(files), key=str) and len({r[1] for r in got}) == 1 and got[0][1]


def test_ties_repeated_rows_and_very_long_texts(spark):
    mit, isc = "Released under the MIT License.", "Released under the ISC License."
    long_text = "plain words of a story. " * 200_000
    files = [("d/1", mit), ("d/2", isc), ("d/x", "no"), ("e/1", mit), ("e/1", mit), ("e/2", isc), ("e/3/y", "no"), ("f/x", long_text + "\n" + mit), ("f/y", f"{mit}\n{isc}"), ("", mit), ("/root", "no"), (None, None), ("g//h", "no"), ("g/1", mit)]
    got = result(spark, files)
    assert sorted(got, key=str) == sorted(expected(files), key=str)
    assert {r[0]: r[1] for r in got}["d/x"] == "ISC" and {r[0]: r[1] for r in got}["e/3/y"] == "MIT"
