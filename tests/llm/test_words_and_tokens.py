"""Words, tokens, token files and packing against plain Python and exact round trips."""

import io
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomry.llm import packing, token_files, tokens, words
from fathomry.llm.scratch import Scratch

TEXTS = ["Hello  wOrld\n x", "", None, "  a", "b ", "É Été a\tb", "a   b\n \nc d", " lead", "it's don't 'll x", "a\n\nb c", "x" * 3000, "One, two. %%% !!", "same", "same"]
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOCS = "doc_id long, text string"


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def split_all(texts, size):
    out, hashes = [], []
    for first, end, raw, offsets in words.chunks(pa.array(texts, pa.string()), size):
        w = words.split(raw, offsets)
        for i in range(end - first):
            out.append([w.word(j) for j in range(w.bounds[i], w.bounds[i + 1])])
            hashes.append(w.hashes[w.bounds[i] : w.bounds[i + 1]].tolist())
    return out, hashes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t.漢", max_size=30)), max_size=8), st.integers(1, 50))
def test_words_match_a_regular_expression(texts, size):
    found, hashes = split_all(texts, size)
    assert found == [plain_words(t) for t in texts]
    assert hashes == split_all(texts, 1 << 20)[1]  # a word's hash does not depend on where it stands


def test_shingles_of_short_texts():
    _, _, raw, offsets = next(words.chunks(pa.array(["a", "", "a b", "a b c", None])))
    _, bounds = words.shingles(words.split(raw, offsets), 2)
    assert np.diff(bounds).tolist() == [1, 0, 1, 2, 0]


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder(tokens.default_vocabulary())


def library_ids(encoder, texts):
    return [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdeéß '.,\n\t %1漢", max_size=60), min_size=1, max_size=6))
def test_encoding_by_words_equals_the_library(texts):
    encoder = tokens.encoder(tokens.default_vocabulary())
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == library_ids(encoder, texts)


def test_long_runs_of_words_equal_the_library(encoder):
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcdefg"), 5)) + rng.choice(["", ".", "\n"]) for _ in range(400)) for _ in range(4)]
    ids, at = encoder.encode(pa.array(texts))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(4)] == library_ids(encoder, texts)


def expected_rows(encoder, rows):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library_ids(encoder, [text])[0] + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(spark, encoder):
    rows = [(i * 7 % 11, t) for i, t in enumerate(TEXTS[:11])] + [(None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], DOCS + ", tokens int")
    shards = token_files.write_token_files(docs, Scratch(spark, "t"))
    got = [tuple(r) for r in token_files.read_token_files(spark, shards).collect()]
    key = lambda r: (r[1], r[2])
    assert sorted(got, key=key) == expected_rows(encoder, rows)
    assert {r[0] for r in token_files.read_token_files(spark, shards, [4, 8]).collect()} == {4, 8}


def test_empty_table_has_no_token_files(spark):
    shards = token_files.write_token_files(spark.createDataFrame([], DOCS), Scratch(spark, "t"))
    assert shards == [] and token_files.read_token_files(spark, shards).count() == 0


def test_reader_decompresses_only_what_is_asked_for_and_sees_damage():
    stream = io.BytesIO()
    writer = token_files.TokenFileWriter(stream, np.uint16, frame_bytes=20)
    for i in range(10):
        writer.add(i, np.arange(8, dtype=np.uint16) + i)
    writer.close()
    reader = token_files.TokenFileReader(stream)
    assert [d for d, _ in reader.documents([7])] == [7] and reader.frames_read == 1
    data = bytearray(stream.getvalue())
    data[4] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017  the frame's or the table's checksum
        list(token_files.TokenFileReader(io.BytesIO(bytes(data))).documents())


def test_cut_pieces():
    assert packing.cut(5, 4) == [0, 1, 5] and packing.cut(8, 4) == [0, 4, 8] and packing.cut(3, 4) == [0, 3] and packing.cut(1, 4) == [0, 1]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=200))
def test_plan_uses_every_length_once(lengths):
    histogram = np.bincount(lengths, minlength=33).astype(np.int64)
    groups = packing.plan(histogram, 32)
    used = np.zeros(33, np.int64)
    for own, n in groups:
        assert sum(own) <= 32 and n > 0
        for v in own:
            used[v] += n
    assert (used == histogram).all()
    # the sum of lengths alone is no bound that can be met: 16, 17, 17, 17, 17 need five sequences
    room: list[int] = []
    for v in sorted(lengths, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= v), None)
        if at is None:
            room.append(32 - v)
        else:
            room[at] -= v
    assert 9 * sum(n for _, n in groups) <= 11 * len(room) + 6


def check_packing(rows, capacity):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return pieces, sequences


def test_packing_places_every_piece(spark, encoder):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(i, "same") for i in range(100, 160)] + [(None, "no id")]
    out = packing.pack(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", length int"), Scratch(spark, "t"), capacity=64).collect()
    pieces, sequences = check_packing(out, 64)
    for doc_id, text in rows:
        n = len(library_ids(encoder, [text])[0]) + 1
        own = sorted(pieces[doc_id])
        assert [p[0] for p in own] == list(range(len(own))) and sum(p[2] for p in own) == n
        assert all(p[2] == 64 for p in own[1:])
    total = sum(r.length for r in out)
    assert len(sequences) <= -(-total // 64) + 1


def test_packing_of_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), Scratch(spark, "t")).count() == 0


def test_rows_of_one_id_have_places_of_their_own(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three"), (2, "three four five"), (3, "six")], "doc_id long, text string")
    shards = token_files.write_token_files(docs, Scratch(spark, "t"))
    whole = [r for r in token_files.read_token_files(spark, shards).orderBy("start").collect()]
    some = token_files.read_token_files(spark, shards, [2]).orderBy("start").collect()
    assert some == [r for r in whole if r.doc_id == 2] and len({r.start for r in some}) == 2
