"""Language model, fingerprints, main text, archives, licences, quality, tiling and the pipeline."""

import collections
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathomry.llm import archives, class_model, fingerprints, licences, quality
from fathomry.llm.scratch import Scratch
from tests.llm.test_near_and_graph import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


# --- language model


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_scores_against_plain_counts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "Mat.", "a,", f"rare{rng.randint(0, 300)}"]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(None, "the cat"), (500, None), (7, "the cat"), (7, "the cat")]
    docs = spark.createDataFrame(rows, DOCS)
    scratch = Scratch(spark, "t")
    model, counts = class_model.train(docs.filter(~class_model.held_out()), scratch, clustered=5, classes=3, head=8)
    got = class_model.score(docs, model, counts, scratch).collect()
    c = collections.Counter(w for i, t in rows if not held(i) for w in [*plain_words(t), None])
    n, v = sum(c.values()), len(c)
    expected = sorted((str(i), held(i), len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]), 6)) for i, t in rows for w in [plain_words(t)])
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    tested = [r for r in got if r.held_out]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested)


def test_emissions_and_transitions_sum_to_one(spark):
    docs = spark.createDataFrame([(i, f"a b c{i % 9} d, e. f{i % 4}") for i in range(60)], DOCS)
    scratch = Scratch(spark, "t")
    m, counts = class_model.train(docs, scratch, clustered=3, classes=2, head=5)
    assert np.allclose((10**m.transitions).sum(1), 1)
    known = counts.collect()
    top = set(m.head.view(np.int64).tolist())
    for kind in range(1, class_model.KINDS):
        own = [r for r in known if r.kind == kind]
        total = sum(10 ** m.head_emit[np.searchsorted(m.head, np.int64(r.h).astype(np.uint64))] for r in own if r.h in top and m.head_class[np.searchsorted(m.head, np.int64(r.h).astype(np.uint64))] == kind)
        total += sum((r.c - m.discount[kind]) / m.kind_total[kind] for r in own if r.h not in top)
        assert not own or m.kind_total[kind] == 0 or math.isclose(total + 10 ** m.unknown_emit[kind], 1, rel_tol=1e-6)


def class_likelihood(b, of, k):
    hot = np.eye(k)[of]
    g = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    n = hot.T @ b @ hot
    return g(n) - g(n.sum(0)) - g(n.sum(1))


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(8)
    b = rng.poisson(rng.gamma(0.3, 6, (24, 24))).astype(float)
    start = np.concatenate([[0, 1], 2 + np.arange(22) % 4])
    of = class_model.exchange(b, 4, 2, sweeps=50)
    found = class_likelihood(b, of, 6)
    assert found > class_likelihood(b, start, 6) and of[:2].tolist() == [0, 1] and of[2:].min() >= 2
    for w in range(2, 24):
        for k in range(2, 6):
            other = of.copy()
            other[w] = k
            assert class_likelihood(b, other, 6) <= found + 1e-6


def test_rarer_words_get_the_class_an_exchange_step_gives(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "a", "cat", "dog", "sat", "ran", f"w{rng.randint(0, 9)}", f"v{rng.randint(0, 9)},"]) for _ in range(20)) for _ in range(40)] + ["once the w1 w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    m, counts = class_model.train(docs, Scratch(spark, "t"), clustered=6, classes=3, head=100)
    rows = {np.int64(r.h).astype(np.uint64): r for r in counts.collect()}
    for h, n, group in zip(m.head, m.head_count, m.head_class, strict=True):
        assert group == rows[h].kind if n == 1 else group >= class_model.KINDS
    b = np.random.default_rng(9).poisson(3, (12, 12)).astype(float)
    of = np.array([0, 1, *(2 + np.arange(7) % 3), 1, 0, 1])
    counts = np.eye(5)[of].T @ b @ np.eye(5)[of]
    right, left, self_ = [], [], []
    for w in (9, 10, 11):
        apart = np.arange(12) != w
        right.append(np.bincount(of[apart], b[w, apart], 5))
        left.append(np.bincount(of[apart], b[apart, w], 5))
        self_.append(b[w, w])
    best = class_model.best_classes(counts, of[9:], np.array(right), np.array(left), np.array(self_), 2)
    for w, found in zip((9, 10, 11), best, strict=True):
        moved = [class_likelihood(b, np.where(np.arange(12) == w, x, of), 5) for x in (2, 3, 4)]
        assert found == 2 + int(np.argmax(moved))


def test_words_beyond_the_head_are_classed_and_scored_alike(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["the", "a", "cat", "dog", f"w{rng.randint(0, 30)}", f"v{rng.randint(0, 30)},", f"x{rng.randint(0, 500)}"]) for _ in range(rng.randint(0, 40))) for _ in range(90)]
    docs = spark.createDataFrame([*enumerate(texts), (500, None), (501, "w1 w1 w2 unseen1 unseen2. w3 x1")], DOCS)
    trained = docs.filter("doc_id < 70")
    got = {}
    for head in (2, 10_000):
        scratch = Scratch(spark, "t")
        m, words = class_model.train(trained, scratch, clustered=4, classes=3, head=head)
        got[head] = {r.doc_id: r for r in class_model.score(docs, m, words, scratch).collect()}
        if head == 2:
            assert len(m.head) == 2
            model, table = m, words
    for i, r in got[2].items():
        assert (r.n_tokens, r.n_known) == (got[10_000][i].n_tokens, got[10_000][i].n_known)
        assert math.isclose(r.base_score, got[10_000][i].base_score, abs_tol=1e-9) and math.isclose(r.score, got[10_000][i].score, abs_tol=1e-9)
    # the same by plain Python, from each word's class
    c = collections.Counter(w for t in texts[:70] for w in plain_words(t))
    of = {r.h: r for r in table.collect()}
    assert len(of) == len(c)

    def found(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        split = class_model.split(raw, np.array([0, len(raw)]))
        return of.get(int(split.hashes.view(np.int64)[0])), int(class_model.kinds_of(split)[0])

    known = {w: found(w) for w in {w for t in texts for w in plain_words(t)} | set(plain_words("unseen1 unseen2. w1 w2 w3 x1"))}
    for w, n in c.items():
        row, kind = known[w]
        assert row.c == n and row.kind == kind and (row["class"] >= class_model.KINDS if n > 1 else row["class"] == kind)
    group = lambda w: known[w][0]["class"] if known[w][0] else known[w][1]
    chain = lambda t: [0, *(group(w) for w in plain_words(t)), 0]
    k = len(model.transitions)
    pairs, inside = np.zeros((k, k)), np.zeros(k)
    for t in texts[:70]:
        np.add.at(pairs, (chain(t)[:-1], chain(t)[1:]), 1)
    for w, n in c.items():
        inside[group(w)] += n
    frequency = (pairs.sum(0) + 1) / (pairs.sum() + k)
    weight = class_model.TRANSITION_WEIGHT
    transitions = np.log10((pairs + weight * frequency) / (pairs.sum(1, keepdims=True) + weight))
    assert np.allclose(transitions, model.transitions)

    def emission(w):
        kind = known[w][1]
        if group(w) >= class_model.KINDS:
            return math.log10(c[w] / inside[group(w)])
        once = [x for x in c if known[x][1] == kind and c[x] == 1]
        twice = sum(known[x][1] == kind and c[x] == 2 for x in c)
        d = min(max(len(once) / (len(once) + 2 * twice), 0.1), 0.9) if once or twice else 0.5
        return math.log10((1 - d if w in c else d) * (1 / len(once) if w in c else 1)) if once else 0.0

    for i, t in [*enumerate(texts), (500, ""), (501, "w1 w1 w2 unseen1 unseen2. w3 x1")]:
        row = chain(t)
        assert math.isclose(got[2][i].score, sum(transitions[a, b] for a, b in zip(row, row[1:])) + sum(map(emission, plain_words(t))), abs_tol=1e-6), (i, t)


def test_empty_tables_score_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    scratch = Scratch(spark, "t")
    model, counts = class_model.train(docs, scratch)
    assert class_model.score(docs, model, counts, scratch).count() == 0
    one = class_model.score(spark.createDataFrame([(1, "a")], DOCS), model, counts, scratch).first()
    assert (one.n_known, one.train_tokens, one.base_score) == (0, 0, 0.0)


# --- fingerprints


def test_fingerprints_are_homomorphic():
    f = fingerprints.Fingerprint.of
    a, b = "one two three\nfour five six seven eight nine\nx", "x\none two three\nfour five six seven eight nine"
    assert f(a) == f(b) and f(a) - f("x") == f("one two three\nfour five six seven eight nine")
    assert f(a) + f("new") == f("new\n" + a) and f(a) != f("one two three") and fingerprints.Fingerprint.parse(str(f(a))) == f(a)
    assert f("").likeness(f(None)) == 1.0 and f("").likeness(f("a")) == 0.0


def test_likeness_follows_what_is_shared():
    rng = random.Random(2)
    text = lambda: "\n".join(" ".join(f"w{rng.randint(0, 9999)}" for _ in range(30)) for _ in range(20))
    a, b = text(), text()
    f = fingerprints.Fingerprint.of
    half = f(fingerprints.edited(a, b))
    assert f(a).likeness(f(a)) == 1 and f(a).likeness(f(b)) < 0.25 < 0.35 < f(a).likeness(half) < 0.65


@pytest.mark.parametrize("rows", [[(i * 3, f"text {i} " * (i % 5)) for i in range(60)], [(5, "only one")], [(None, None), (1, "x"), (2, ""), (-4, "y z")], []])
def test_each_document_meets_the_next(spark, rows):
    got = {r.doc_id: r for r in fingerprints.compare_with_next(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", key int")).collect()}
    order = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        changed = fingerprints.edited(t or "", u or "")
        assert got[i].n_chars == len(t or "") and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i].fingerprint == str(fingerprints.Fingerprint.of(t)) and got[i].edited_fingerprint == str(fingerprints.Fingerprint.of(changed))


# --- archives


def test_pages_survive_both_versions(spark):
    big = "x" * 1200
    rows = [(1, "http://a/b c", big), (2, "http://a/é", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "a\n\nb\r\n\r\nHTTP/1.1 200\n\n" + big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int").repartition(3)
    scratch = Scratch(spark, "t")
    got = {r.page_id: r for r in archives.read_warcs(archives.convert(archives.write_arcs(pages, scratch), scratch)).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and i != 3
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)
    assert got[1].target_uri == "http://a/b%20c" and got[3].target_uri == "urn:page:3" and got[1].warc_date == "2024-01-01T00:00:00Z"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_reader(version):
    data = archives.arc_version_block("f.arc", version, "19961104142103")
    for i, block in enumerate((b"HTTP/1.0 200 OK\r\n\r\nbody\nwith lines\n", b"", b"no header")):
        data += archives.arc_record(version, "f.arc", len(data), f"http://h/{i} odd", "19961104", block)
    got = list(archives.read_arc(io.BytesIO(data)))
    assert [r.block for r in got[1:]] == [b"HTTP/1.0 200 OK\r\n\r\nbody\nwith lines\n", b"", b"no header"]
    assert [data[r.offset :].startswith(r.fields["URL"].encode()) for r in got] == [True] * 4
    assert [archives.kind_of(r) for r in got] == ["warcinfo", "response", "resource", "resource"] and got[0].fields["URL"] == "filedesc://f.arc"
    records = [next(archives.read_warc(io.BytesIO(archives.warc_record("f.arc", r)))) for r in got]
    assert [f["Content-Type"] for f, _ in records] == ["application/warc-fields", "application/http; msgtype=response", "text/html", "text/html"]
    assert records[0][0]["WARC-Filename"] == "f.warc.gz" and b"conformsTo" in records[0][1] and [b for _, b in records[1:]] == [r.block for r in got[1:]]
    original = archives.Original(7, "<urn:uuid:1>", "http://o", "1996-01-01T00:00:00Z")
    fields, block = next(archives.read_warc(io.BytesIO(archives.warc_record("f.arc", got[1], original))))
    assert (fields["WARC-Type"], fields["WARC-Refers-To"], fields["WARC-Refers-To-Target-URI"], fields["WARC-Refers-To-Date"], block) == ("revisit", *original[1:], b"HTTP/1.0 200 OK\r\n\r\n")
    assert archives.warc_date("19961104") == "1996-11-04T00:00:00Z" and archives.split_http(got[1].block)[1] == b"body\nwith lines\n"
    with pytest.raises(ValueError):
        list(archives.read_arc(io.BytesIO(data[:-5])))


def test_equal_largest_pages_and_long_payloads(spark):
    """Rows that repeat the largest page id are all responses; revisits name the record of one of them."""
    long_one, other = "y" * 3_000_000, "z" * 1000
    rows = [(9, "u", long_one), (9, "v", long_one), (4, "w", long_one), (1, "a", other), (2, "b", other), (3, "c", other[:-1]), (5, "d", other[:-1])]
    scratch = Scratch(spark, "t")
    warcs = archives.convert(archives.write_arcs(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), scratch), scratch)
    got = archives.read_warcs(warcs).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "revisit", 9), (5, "response", None), (9, "response", None), (9, "response", None)]
    ids = {r.record_id: r.page_id for r in got}
    heads = []
    for path in [r.path for r in warcs.collect()]:
        with archives._read(path) as f:
            heads += [fields for fields, _ in archives.read_warc(f)]
    assert {ids[f["WARC-Refers-To"]] for f in heads if f["WARC-Type"] == "revisit"} == {2, 9} and sum(f["WARC-Type"] == "warcinfo" for f in heads) == warcs.count() > 1


def test_no_pages(spark):
    scratch = Scratch(spark, "t")
    none = archives.write_arcs(spark.createDataFrame([], "page_id long, url string, html string"), scratch)
    assert archives.read_warcs(archives.convert(none, scratch)).count() == 0


# --- licences


def test_licences_and_inheritance(spark):
    rows = [
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("a/b/c/x.py", "no statement here"),
        ("a/b/LICENSE", "Released under the MIT License."),
        ("a/y.py", "code code code\n# Licensed under CC BY-NC 4.0.\nmore " + "words " * 300),
        ("z/q.py", "mit der frau und mit dem hund"),
        ("a/e", None),
        (None, "Released under the MIT License."),
        ("top", ""),
    ]
    files = spark.createDataFrame([(*r, "x") for r in rows], "path string, text string, licence string")
    got = {r.path: (r.licence, r.origin, r.from_directory) for r in licences.scan(files, Scratch(spark, "t")).collect()}
    assert got == {
        "a/LICENSE": ("Apache-2.0", "own", None),
        "a/b/c/x.py": ("MIT", "inherited", "a/b"),
        "a/b/LICENSE": ("MIT", "own", None),
        "a/y.py": ("CC-BY-NC-4.0", "own", None),
        "z/q.py": (None, None, None),
        "a/e": ("Apache-2.0", "inherited", "a"),
        None: ("MIT", "own", None),
        "top": (None, None, None),
    }


def test_every_template_reaches_itself(spark):
    rows = [(f"{n}/{i}", t, n) for n, ts in licences.TEMPLATES.items() for i, t in enumerate(ts)]
    got = licences.scan(spark.createDataFrame(rows, "path string, text string, name string"), Scratch(spark, "t"), ["name"]).collect()
    assert [(r.name, r.licence) for r in got if r.name != r.licence] == []
    assert licences.scan(spark.createDataFrame([], "path string, text string"), Scratch(spark, "t")).count() == 0


def test_statements_need_no_picked_word(spark):
    said = {
        "u/a": ("This software is released into the public domain.", "Unlicense"),
        "u/b": ("This is free software released into the public domain.", "Unlicense"),
        "b/a": ("Neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software", "BSD-3-Clause"),
        "u/c": ("/*_this_is_free_and_unencumbered_software_released_into_the_public_domain_*/", "Unlicense"),
    }
    files = spark.createDataFrame([(p, t) for p, (t, _) in said.items()], "path string, text string")
    assert {r.path: r.licence for r in licences.scan(files, Scratch(spark, "t")).collect()} == {p: n for p, (_, n) in said.items()}


def test_full_texts_and_tags(spark):
    full = {n: t for n, (t,) in licences.full_texts().items()}
    rows = [(f"{n}/LICENSE", t) for n, t in full.items()] + [(f"{n}/src/a.py", "x = 1") for n in full]
    rows += [("c/LICENSE", "Copyright (c) 2031 A. Holder\n\n" + full["Apache-2.0"].replace("\n", "\r\n")), ("c/d/x.py", "x = 1")]
    rows += [("t/mit.py", "# SPDX-License-Identifier: MIT\nx = 1"), ("t/apache.py", "// SPDX-License-Identifier: Apache-2.0"), ("t/gpl.c", "/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */"), ("t/nd", "SPDX-License-Identifier: CC-BY-ND-4.0")]
    got = {r.path: (r.licence, r.origin) for r in licences.scan(spark.createDataFrame(rows, "path string, text string"), Scratch(spark, "t")).collect()}
    for n in full:
        assert got[f"{n}/LICENSE"] == (n, "own") and got[f"{n}/src/a.py"] == (n, "inherited")
    assert got["c/LICENSE"] == ("Apache-2.0", "own") and got["c/d/x.py"] == ("Apache-2.0", "inherited")
    assert [got[f"t/{x}"][0] for x in ("mit.py", "apache.py", "gpl.c", "nd")] == ["MIT", "Apache-2.0", "GPL-2.0", None]


# --- quality


def test_junk_and_insults_go_and_clean_texts_stay(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "a", "of", "house", "tree", "river", "green", "walks", "sees", f"n{rng.randint(0, 99)}"]) for _ in range(60))
    rows, labels = [], []
    for i in range(600):
        kind = "junk" if i % 6 == 0 else "toxic" if i % 6 == 1 else "good"
        text = good()
        if kind == "junk":
            text = " ".join(w + "%%%" for w in text.split())
        if kind == "toxic":
            text += " " + rng.choice(["vermin", "scumbag"])
        rows.append((i, text, kind))
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
        elif i % 6 == 0 and i % 4 == 0:
            labels.append((i, 0, 0))
    rows += [(700, "", "good"), (701, None, "good"), (None, good(), "good"), (3, rows[3][1], "good")]
    docs = spark.createDataFrame(rows, DOCS + ", key string")
    kept = quality.select_quality(docs, spark.createDataFrame([*labels, (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int"), Scratch(spark, "t"))
    assert kept.columns == ["doc_id", "text", "key"]
    left = collections.Counter(r.key for r in kept.collect())
    assert left["junk"] == 0 and left["toxic"] == 0 and left["good"] == sum(r[2] == "good" for r in rows)


def test_selection_of_the_kth(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=3000), [0.5] * 50])
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    for k in (1, 10, 700, 2999):
        t = quality.kth_largest(df, "x", k)
        assert (v >= t).sum() >= k and (v > np.sort(v)[-k] + 1e-9).sum() <= k
    assert quality.kth_largest(df, "x", 5000) == -np.inf


def test_without_labels_nothing_but_all_is_kept(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.select_quality(docs, none, Scratch(spark, "t")).count() == 2
    assert quality.select_quality(docs.limit(0), none, Scratch(spark, "t")).count() == 0


# --- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, seen = Scratch(spark, "t"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch.save(stage(spark, docs, SF), str(i))
        if i < 3:
            assert out.columns == docs.columns
            assert out.join(docs, out.columns, "left_anti").count() == 0
        if i == 1:
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert sorted(r.doc_id for r in out.collect()) == [r[0] for r in brute(rows, 5) if r[3]]
        if i == 2:
            gone = docs.join(out.select("doc_id"), "doc_id", "left_anti").collect()
            passages = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert all(any(p in r.text.lower() for p in passages) for r in gone)
            assert not any(p in r.text.lower() for r in out.collect() for p in passages)
        seen.append(out.count())
        docs = out
    assert seen[0] > seen[1] >= seen[2] > 0 and docs.select("doc_id").distinct().count() == seen[2]


def tables(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("out_id", "fathomry_gone", "cid", "key", "toxic", "kept", "label", "half", "good", "item_id")}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_with_clashing_names_nulls_and_nothing(spark, tmp_path):
    passage = " ".join(f"q{i}" for i in range(30))
    words = " ".join(f"w{i}" for i in range(60))
    docs = [(1, words, "en", "a", 1), (2, words, "en", "a", 1), (2, words, "en", "a", 1), (3, passage, None, None, None), (4, None, None, None, None), (5, "", "", "", 0), (None, "some text without an id", "en", "b", 2), (6, "long " * 300_000, "en", "c", 3)]
    labels = [(1, 1, 0), (None, None, None), (5, None, 1)]
    run = corpus_pipeline.run(spark, tables(spark, tmp_path / "full", docs, labels, [(1, passage), (None, None)]))
    assert sorted({str(r.doc_id) for r in run.collect()}) == ["1", "4", "5", "6", "None"]
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "none", [], [], [])).count() == 0
    nulls = [(None,) * 5] * 3
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "nulls", nulls, [(None,) * 3], [(None,) * 2])).count() == 3
