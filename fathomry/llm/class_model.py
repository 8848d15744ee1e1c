"""A class-based bigram language model: exchange clustering of words, smoothed class transitions and emissions.

Training counts every token (words, then one end for each text) of the training rows: the tables of words grow with
the corpus and stay in the shared folder. The ``clustered`` most frequent words get one of ``classes`` classes by the
exchange algorithm on their bigrams; each other word that occurs at least twice, however rare, gets the class to which
the same exchange step moves it against the counts of those classes, distributed by word. The end token and the words
that occur once (by the kind of their last byte: letter, full stop, comma, other mark) are classes of their own, since
unknown words are estimated from words that occur once. A text's score is the sum over its tokens of

    log10 P(class | class before) + log10 P(word | class)

where transitions are smoothed towards the class frequencies. In a class of words that occur once, emissions are
discounted by n1 / (n1 + 2 n2), n1 and n2 counting all words of the kind that occur once and twice, and what that frees
is the probability of any unknown word, which counts as one outcome.

The ``head`` most frequent words (a bounded number), their counts and classes go to every executor; those of all rarer
words meet the texts in a shuffle, so no key of that join is frequent. Which way a word goes changes no result.

Cases: a null or wordless text is its end token; a null document id trains and is scored, not held out; repeated rows
train and are scored each; with an empty training set N and V are 0, every word is unknown, and P(unknown) is 1 in its
class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_partitions
from .words import Words, chunks, split

CLUSTERED, CLASSES, HEAD, SWEEPS = 2000, 64, 200_000, 6
TRANSITION_WEIGHT = 20.0
#: Kinds of the end token and of words outside the clustered ones.
END_KIND, LETTER, STOP, COMMA, OTHER = 0, 1, 2, 3, 4
KINDS = 5
END_HASH = np.uint64(0xE9D0F7B2C4A61835)
_KIND_OF_BYTE = np.full(256, OTHER, np.int8)
_KIND_OF_BYTE[np.r_[48:58, 97:123, 128:256]] = LETTER
_KIND_OF_BYTE[[46, 33, 63]] = STOP
_KIND_OF_BYTE[[44, 58, 59]] = COMMA


def kinds_of(words: Words) -> np.ndarray:
    return _KIND_OF_BYTE[words.data[words.ends - 1]]


def held_out() -> Column:
    """crc32(doc_id as text) mod 7 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Model(NamedTuple):
    """What every executor needs for scoring; its size is bounded by head and classes."""

    total: int  # N
    distinct: int  # V
    end_count: int
    head: np.ndarray  # sorted hashes of the most frequent words
    head_count: np.ndarray
    head_class: np.ndarray
    head_emit: np.ndarray  # log10 P(word | class)
    transitions: np.ndarray  # log10 P(class | class before)
    unknown_emit: np.ndarray  # by kind
    discount: np.ndarray  # by kind
    kind_total: np.ndarray
    kind_distinct: np.ndarray
    class_total: np.ndarray  # tokens of the words that were given each class


def token_counts(docs: DataFrame) -> DataFrame:
    """h, kind, c: hash, kind and count of each distinct token of docs' texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, kinds = [np.full(batch.num_rows, END_HASH)], [np.full(batch.num_rows, END_KIND, np.int8)]
            for _, _, raw, offsets in chunks(batch.column("text")):
                words = split(raw, offsets)
                hashes.append(words.hashes)
                kinds.append(kinds_of(words))
            h, first, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate(kinds)[first].astype(np.int32)), pa.array(n)], ["h", "kind", "n"])

    return docs.select("text").mapInArrow(count, "h long, kind int, n long").groupBy("h").agg(F.min("kind").alias("kind"), F.sum("n").alias("c"))


def symbols(words: Words, sorted_hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each word's symbol: place of a clustered word, or its kind."""
    if not len(sorted_hashes):
        return kinds_of(words).astype(np.int64)
    i = np.minimum(np.searchsorted(sorted_hashes, words.hashes), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[i] == words.hashes, place[i], kinds_of(words))


def with_ends(values: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """values of the texts in a row, an end before the first and after each."""
    return np.concatenate([[end], np.insert(values, bounds[1:], end)])


def bigram_counts(docs: DataFrame, sorted_hashes: np.ndarray, place: np.ndarray, size: int) -> DataFrame:
    """pair (before * size + symbol), n; at most size * size rows."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = []
            for _, _, raw, offsets in chunks(batch.column("text")):
                words = split(raw, offsets)
                row = with_ends(symbols(words, sorted_hashes, place), words.bounds, END_KIND)
                pairs.append(row[:-1] * size + row[1:])
            pair, n = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    return docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def exchange(bigrams: np.ndarray, classes: int, fixed: int, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each symbol: the first ``fixed`` symbols keep classes of their own, the others move, in order of
    their place, to the class that raises the class-bigram likelihood most, until nothing moves or sweeps are over."""
    size = len(bigrams)
    of = np.concatenate([np.arange(fixed), fixed + np.arange(size - fixed) % classes])
    k = fixed + classes
    hot = np.zeros((size, k))
    hot[np.arange(size), of] = 1
    counts = hot.T @ bigrams @ hot
    g = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps):
        moved = 0
        for w in range(fixed, size):
            own = of[w]
            right = np.bincount(of, weights=bigrams[w], minlength=k)
            left = np.bincount(of, weights=bigrams[:, w], minlength=k)
            self_ = bigrams[w, w]
            right[own] -= self_
            left[own] -= self_
            counts[own] -= right
            counts[:, own] -= left
            counts[own, own] -= self_
            rows, cols = counts.sum(1), counts.sum(0)
            out, into = right.sum() + self_, left.sum() + self_
            gain = (g(counts + right) - g(counts)).sum(1) + (g(counts + left[:, None]) - g(counts)).sum(0)
            diagonal = np.diag(counts)
            gain += g(diagonal + right + left + self_) - g(diagonal + right) - g(diagonal + left) + g(diagonal)
            gain -= g(rows + out) - g(rows) + g(cols + into) - g(cols)
            best = fixed + int(np.argmax(gain[fixed:]))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            of[w] = best
            counts[best] += right
            counts[:, best] += left
            counts[best, best] += self_
        if not moved:
            break
    return of


def context_counts(docs: DataFrame, sorted_hashes: np.ndarray, place: np.ndarray, group: np.ndarray, k: int) -> DataFrame:
    """h, code, n: how often the word of hash h, outside sorted_hashes, meets a group after it (code: the group), a
    group before it (k + the group) or itself (2 * k); the word's kind times 2 * k + 1 is added to code. ``group`` is
    that of each place; others have their kind's."""
    width = 2 * k + 1
    shipped = docs.sparkSession.sparkContext.broadcast((sorted_hashes, place, np.concatenate([np.arange(KINDS), group])))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, groups = shipped.value
        for batch in batches:
            of, met = [], []
            for _, _, raw, offsets in chunks(batch.column("text")):
                words = split(raw, offsets)
                row = with_ends(symbols(words, hashes, KINDS + at), words.bounds, END_KIND)
                word = with_ends(words.hashes, words.bounds, END_HASH)
                others = (row != END_KIND) & (row < KINDS)
                same, facing = word[:-1] == word[1:], groups[row]
                i = np.flatnonzero(others[:-1])
                of.append(word[i])
                met.append(row[i] * width + np.where(same[i], 2 * k, facing[i + 1]))
                i = np.flatnonzero(others[1:] & ~same) + 1
                of.append(word[i])
                met.append(row[i] * width + k + facing[i - 1])
            distinct, index = np.unique(np.concatenate(of), return_inverse=True) if of else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            key, n = np.unique(index * (KINDS * width) + np.concatenate(met), return_counts=True) if of else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(distinct[key // (KINDS * width)].view(np.int64)), pa.array((key % (KINDS * width)).astype(np.int32)), pa.array(n)], ["h", "code", "n"])

    return docs.select("text").mapInArrow(count, "h long, code int, n long").groupBy("h", "code").agg(F.sum("n").alias("n"))


def best_classes(counts: np.ndarray, own: np.ndarray, right: np.ndarray, left: np.ndarray, self_: np.ndarray, fixed: int) -> np.ndarray:
    """For each word, the class from ``fixed`` on to which an exchange step moves it out of its own (below ``fixed``),
    the class bigrams being ``counts`` (of all words). ``right`` and ``left`` count the classes after and before it,
    itself apart; only classes that it meets are looked at, since the others change nothing."""
    g = lambda x: x * np.log(np.maximum(x, 1e-300))

    def met_gain(table: np.ndarray, met: np.ndarray, other: np.ndarray, o: np.ndarray) -> np.ndarray:
        gain = np.zeros((len(o), table.shape[0] - fixed))
        i, c = np.nonzero(met)
        if len(i):
            # the word's own class loses the counts with the word on its other side
            have = table.T[c, fixed:] - np.where(c == o[i], 1.0, 0.0)[:, None] * other[i, fixed:]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            gain[i[first]] = np.add.reduceat(g(have + met[i, c][:, None]) - g(have), first)
        return gain

    best = np.zeros(len(own), np.int64)
    rows, cols, diagonal = (x[fixed:] for x in (counts.sum(1), counts.sum(0), np.diag(counts)))
    for a in range(0, len(own), 64):
        o, r, l, s = own[a : a + 64], right[a : a + 64], left[a : a + 64], self_[a : a + 64, None]
        gain = met_gain(counts, r, l, o) + met_gain(counts.T, l, r, o)
        out, into = r.sum(1, keepdims=True) + s, l.sum(1, keepdims=True) + s
        r, l = r[:, fixed:], l[:, fixed:]
        gain += g(diagonal + r + l + s) - g(diagonal + r) - g(diagonal + l) + g(diagonal)
        # what others have before and after the word stays in their sums, whatever its class
        gain -= g(rows + out) - g(rows) + g(cols + into) - g(cols)
        best[a : a + 64] = fixed + np.argmax(gain, axis=1)
    return best


def rarer_classes(contexts: DataFrame, counts: np.ndarray, fixed: int) -> DataFrame:
    """h, kind, c, class of each word of contexts: the best class of a word that occurs twice or more, else its kind."""
    width = 2 * len(counts) + 1
    shipped = contexts.sparkSession.sparkContext.broadcast(counts)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shipped.value
        k = len(counts)
        for batch in batches:
            met = batch.column("met")
            size = np.diff(met.offsets.to_numpy())
            code, n = (met.flatten().field(x).to_numpy() for x in ("code", "n"))
            dense = np.zeros((len(size), width))
            np.add.at(dense, (np.repeat(np.arange(len(size)), size), code % width), n)
            kind = code[np.cumsum(size) - size].astype(np.int64) // width
            c = dense[:, :k].sum(1) + dense[:, 2 * k]
            best = kind.copy()
            i = np.flatnonzero(c > 1)
            best[i] = best_classes(counts, kind[i], dense[i, :k], dense[i, k : 2 * k], dense[i, 2 * k], fixed)
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(kind.astype(np.int32)), pa.array(c.astype(np.int64)), pa.array(best.astype(np.int32))], ["h", "kind", "c", "class"])

    return contexts.groupBy("h").agg(F.collect_list(F.struct("code", "n")).alias("met")).mapInArrow(assign, "h long, kind int, c long, class int")


RARE = "array<struct<h:long,kind:int,before:int,after:int>>"


class Chain(NamedTuple):
    """The classes of some texts' words in a row, an end before the first and after each; -1 at words outside the head."""

    row: np.ndarray
    place: np.ndarray  # of each word in the sorted head
    frequent: np.ndarray  # words in the head
    rare: tuple[np.ndarray, ...]  # of each other word: hash, kind, class before, class after


def chain_of(words: Words, head: np.ndarray, head_class: np.ndarray) -> Chain:
    place, frequent = np.zeros(len(words.hashes), np.int64), np.zeros(len(words.hashes), bool)
    group = np.full(len(words.hashes), -1)
    if len(head):
        place = np.minimum(np.searchsorted(head, words.hashes), len(head) - 1)
        frequent = head[place] == words.hashes
        group = np.where(frequent, head_class[place], -1)
    row = with_ends(group, words.bounds, END_KIND)
    i = np.flatnonzero(~frequent)
    at = 1 + i + np.searchsorted(words.bounds[1:], i, "right")
    rare = words.hashes[i].view(np.int64), kinds_of(words)[i].astype(np.int32), row[at - 1].astype(np.int32), row[at + 1].astype(np.int32)
    return Chain(row, place, frequent, rare)


def rare_lists(sizes: list[np.ndarray], parts: list[tuple[np.ndarray, ...]]) -> pa.Array:
    """An Arrow array of RARE from the number of rare words of each text and the words of all."""
    fields = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int32)]
    ends = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x) for x in fields], ["h", "kind", "before", "after"]))


def rare_words(rows: DataFrame, words: DataFrame) -> DataFrame:
    """row_key, class, kind, c (0: unknown), before, after of the rare words of rows (row_key, rare); all of a row are in
    one partition, in their order."""
    rare = rows.select("row_key", F.posexplode("rare").alias("at", "word")).select("row_key", "at", "word.*")
    met = rare.join(words.select("h", "c", "class"), "h", "left")
    known = met.select("row_key", "at", F.coalesce("class", "kind").alias("class"), "kind", F.coalesce("c", F.lit(0)).alias("c"), "before", "after")
    return known.repartition(shuffle_partitions(rows.sparkSession), "row_key").sortWithinPartitions("row_key", "at")


def classes_met(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of rare_words with the class before each word, its own, and the class after it, or -1 where that is rare
    and has the pair itself. A rare word before is the last one of the order."""
    last = np.zeros(1, np.int64)
    for batch in batches:
        own, before, after = (batch.column(x).to_numpy().astype(np.int64) for x in ("class", "before", "after"))
        yield batch, np.where(before >= 0, before, np.concatenate([last, own])[:-1]), own, after
        last = np.concatenate([last, own])[-1:]


def class_bigrams(docs: DataFrame, head: np.ndarray, head_class: np.ndarray, words: DataFrame, k: int, scratch: Scratch) -> np.ndarray:
    """Counts of classes next to each other in docs' texts, k by k."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((head, head_class))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_class = shipped.value
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            pairs, sizes, parts = [], [], []
            for first, end, raw, offsets in chunks(batch.column("text")):
                split_words = split(raw, offsets)
                chain = chain_of(split_words, head, head_class)
                a, b = chain.row[:-1], chain.row[1:]
                pairs.append((a * k + b)[(a >= 0) & (b >= 0)])
                doc = np.repeat(np.arange(end - first), np.diff(split_words.bounds))
                sizes.append(np.bincount(doc[~chain.frequent], minlength=end - first))
                parts.append(chain.rare)
            pair, n = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.int64),) * 2
            # the batch's pairs go with its first row
            met = pa.ListArray.from_arrays(pa.array(np.array([0, *[len(pair)] * batch.num_rows], np.int32)), pa.StructArray.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"]))
            yield pa.RecordBatch.from_arrays([pa.array(key + np.arange(batch.num_rows)), rare_lists(sizes, parts), met], ["row_key", "rare", "pairs"])
            key += batch.num_rows

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, before, own, after in classes_met(batches):
            pair, n = np.unique(np.concatenate([before * k + own, (own * k + after)[after >= 0]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    # written once: row_key is what the task that was kept has given
    rows = scratch.save(docs.select("text").mapInArrow(run, f"row_key long, rare {RARE}, pairs array<struct<pair:long,n:long>>"), "bigrams")
    both = rows.select(F.explode("pairs").alias("p")).select("p.*").unionByName(rare_words(rows, words).mapInArrow(count, "pair long, n long"))
    got = both.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros((k, k))
    pairs.ravel()[got["pair"].to_numpy()] = got["n"].to_numpy()
    scratch.discard("bigrams")
    return pairs


def train(docs: DataFrame, scratch: Scratch, clustered: int = CLUSTERED, classes: int = CLASSES, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model of docs' texts, and the table of all words (h, kind, c, class)."""
    spark = docs.sparkSession
    counts = scratch.save(token_counts(docs), "counts")
    top = counts.filter(F.col("kind") != END_KIND).orderBy(F.col("c").desc(), "h").limit(clustered).toArrow()
    h = top["h"].to_numpy().astype(np.int64).view(np.uint64)
    m = len(h)
    order = np.argsort(h)
    size = KINDS + m
    bigrams = np.zeros((size, size))
    got = bigram_counts(docs, h[order], (KINDS + order).astype(np.int64), size).toArrow()
    bigrams.ravel()[got["pair"].to_numpy()] = got["n"].to_numpy()
    of = exchange(bigrams, classes, KINDS)
    k = KINDS + classes
    hot = np.zeros((size, k))
    hot[np.arange(size), of] = 1
    others = rarer_classes(context_counts(docs, h[order], order, of[KINDS:], k), hot.T @ bigrams @ hot, KINDS)
    first = spark.createDataFrame(top.select(["h", "kind", "c"]).append_column("class", pa.array(of[KINDS:].astype(np.int32))), others.schema)
    words = scratch.save(others.unionByName(first), "words")
    top = words.orderBy(F.col("c").desc(), "h").limit(head).toArrow()
    h, c, kind, group = (top[x].to_numpy().astype(np.int64) for x in ("h", "c", "kind", "class"))
    h = h.view(np.uint64)
    by_hash = np.argsort(h)
    pairs = class_bigrams(docs, h[by_hash], group[by_hash], words, k, scratch)
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).collect()}
    figures = np.array([[sums[t][x] if t in sums else 0 for x in ("n", "v", "n1", "n2")] for t in range(KINDS)], np.int64)
    scratch.discard("counts")
    total, distinct = int(figures[:, 0].sum()), int(figures[:, 1].sum())
    n1, n2 = figures[:, 2], figures[:, 3]
    discount = np.clip(np.divide(n1, n1 + 2 * n2, out=np.full(KINDS, 0.5), where=n1 + n2 > 0), 0.1, 0.9)
    frequency = (pairs.sum(0) + 1) / (pairs.sum() + k)
    transitions = np.log10((pairs + TRANSITION_WEIGHT * frequency) / (pairs.sum(1, keepdims=True) + TRANSITION_WEIGHT))
    class_total, class_distinct = np.zeros(k), np.zeros(k)
    for r in words.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        class_total[r["class"]], class_distinct[r["class"]] = r["n"], r["v"]
    kind_total, kind_distinct = class_total[:KINDS], class_distinct[:KINDS]
    unknown = np.log10(np.where(kind_total > 0, discount * kind_distinct / np.maximum(kind_total, 1), 1.0))
    learned = group >= KINDS
    emit = np.log10(np.maximum(c - discount[kind], 1e-9)) - np.log10(np.maximum(kind_total[kind], 1))
    emit[learned] = np.log10(c[learned]) - np.log10(class_total[group[learned]])
    end_count = int(sums[END_KIND]["n"]) if END_KIND in sums else 0
    return Model(total, distinct, end_count, h[by_hash], c[by_hash], group[by_hash], emit[by_hash], transitions, unknown, discount, kind_total, kind_distinct, class_total), words


SCORED = f"row_key long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare {RARE}"


def score(docs: DataFrame, model: Model, words: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        head_log = np.log10(m.head_count + 1.0)
        per_token = np.log10(m.total + m.distinct + 1.0)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(4)]
            sizes, parts = [], []
            for first, end, raw, offsets in chunks(batch.column("text")):
                split_words = split(raw, offsets)
                n = end - first
                bounds = split_words.bounds
                doc = np.repeat(np.arange(n), np.diff(bounds))
                chain = chain_of(split_words, m.head, m.head_class)
                place, frequent_doc = chain.place[chain.frequent], doc[chain.frequent]
                a, b = chain.row[:-1], chain.row[1:]
                step = np.where((a >= 0) & (b >= 0), m.transitions[a, b], 0.0)
                owner = np.insert(doc, bounds[1:], np.arange(n))
                tokens = np.diff(bounds) + 1
                out[0].append(tokens)
                out[1].append(np.bincount(frequent_doc, minlength=n) + (m.end_count > 0))
                out[2].append(np.bincount(frequent_doc, weights=head_log[place], minlength=n) + np.log10(m.end_count + 1.0) - tokens * per_token)
                out[3].append(np.bincount(owner, weights=step, minlength=n) + np.bincount(frequent_doc, weights=m.head_emit[place], minlength=n))
                sizes.append(np.bincount(doc[~chain.frequent], minlength=n))
                parts.append(chain.rare)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
            keys = pa.array(key + np.arange(batch.num_rows))
            key += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [keys, batch.column("doc_id"), batch.column("held_out"), pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(float)), pa.array(flat[3].astype(float)), rare_lists(sizes, parts)],
                ["row_key", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
            )

    def run_rare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch, before, own, after in classes_met(batches):
            kind, c = (batch.column(x).to_numpy().astype(np.int64) for x in ("kind", "c"))
            once = np.log10(np.maximum(c - m.discount[kind], 1e-9)) - np.log10(np.maximum(m.kind_total[kind], 1))
            learned = np.log10(np.maximum(c, 1)) - np.log10(np.maximum(m.class_total[own], 1))
            emit = np.where(c == 0, m.unknown_emit[kind], np.where(own < KINDS, once, learned))
            step = m.transitions[before, own] + np.where(after >= 0, m.transitions[own, after], 0.0)
            row, at = np.unique(batch.column("row_key").to_numpy(), return_inverse=True)
            sums = [np.bincount(at, weights=x, minlength=len(row)) for x in (c > 0, np.log10(c + 1.0), step + emit)]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["row_key", "known", "base", "more"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    # written once: row_key is what the task that was kept has given
    scored = scratch.save(rows.mapInArrow(run, SCORED), "scored")
    met = rare_words(scored.select("row_key", "rare"), words).mapInArrow(run_rare, "row_key long, known long, base double, more double")
    sums = met.groupBy("row_key").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("more").alias("more_score"))
    both = scored.drop("rare").join(sums, "row_key", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return both.select("doc_id", "held_out", "n_tokens", plus("n_known", "more_known"), F.lit(model.total).cast("long").alias("train_tokens"), plus("base_score", "more_base"), plus("score", "more_score"))


def op9_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark, "op9")
    model, words = train(docs.filter(~held_out()), scratch)
    return score(docs, model, words, scratch)
