"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

A byte-level BPE pre-tokeniser never joins a non-blank character with a space after it, so a text whose every
space follows a non-blank character falls apart at its spaces: the ids of the whole are those of the parts
(each with its leading space) in order. Texts with other spacing are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words kept between batches by one worker.
CACHE_WORDS = 400_000
_ODD_SPACING = r"(^|[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]) "


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes Arrow arrays of texts with the tokenizer at path; a null text has no ids.

    by_words may hold only for byte-level BPE without prefix space, and is taken from the file. A special token's
    string inside a text is encoded as the library does by default, or as ordinary text with plain_specials.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_words = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(" " in s for s in specials)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.token_bytes = np.zeros(self.vocabulary, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.token_bytes[i] = len(token)  # byte-level: one character for each byte
        self.dtype = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, self.dtype), 0
        self.begin: list[int] = []
        self.length: list[int] = []

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, words: pa.Array, size: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, a space before each, and how many each has. Words are encoded in long runs, which are cut
        where the bytes of the tokens so far meet the bytes of the words so far; none may be empty or end in a blank."""
        edges = pa.array(np.unique(np.append(np.arange(0, len(words), size), len(words))).astype(np.int32))
        runs = pc.binary_join(pa.ListArray.from_arrays(edges, words), " ").to_pylist()
        ids = np.concatenate([np.array(x, self.dtype) for x in self._raw([" " + x for x in runs])])
        token_ends = np.cumsum(self.token_bytes[ids])
        word_ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        cuts = np.searchsorted(token_ends, word_ends, "right")
        if cuts[-1] != len(ids) or not np.array_equal(token_ends[cuts - 1], word_ends):
            raise ValueError("a token crosses two words")
        return ids, np.diff(cuts, prepend=0)

    def _codes(self, words: list[str]) -> np.ndarray:
        """Places of words in the table that lasts between batches."""
        known = self.known
        new = [w for w in words if w not in known]
        solid = [w[1:] for w in new if len(w) > 1 and w[0] == " " and not w[-1].isspace()]
        if len(solid) > 100:
            self._learn([" " + w for w in solid], *self._runs(pa.array(solid)))
            new = [w for w in new if w not in known]
        if new:
            each = self._raw(new)
            self._learn(new, np.array([i for ids in each for i in ids], self.dtype), np.array([len(ids) for ids in each]))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _learn(self, words: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(ids), self.dtype)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.known.update(zip(words, range(len(self.begin), len(self.begin) + len(words)), strict=True))
        self.begin.extend((self.used + np.cumsum(n) - n).tolist())
        self.length.extend(n.tolist())
        self.used += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the bounds of each text's ids."""
        texts = pc.fill_null(texts, "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        odd = pc.match_substring_regex(texts, _ODD_SPACING).to_numpy(zero_copy_only=False) if self.by_words else np.ones(len(texts), bool)
        if odd.any():
            parts = [self._raw([t])[0] if o else None for t, o in zip(texts.to_pylist(), odd, strict=True)]
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        ids, bounds = self._encode_plain(plain) if len(plain) else (np.zeros(0, self.dtype), np.zeros(1, np.int64))
        if not odd.any():
            return ids, bounds
        pieces, j = [], 0
        for p in parts:
            if p is None:
                pieces.append(ids[bounds[j] : bounds[j + 1]])
                j += 1
            else:
                pieces.append(np.array(p, self.dtype))
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.begin) > CACHE_WORDS:
            self._clear()
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary
        spaced = np.ones(len(code), bool)
        spaced[at[:-1]] = False  # a text's first word has no space before it
        often = np.bincount(code[spaced], minlength=len(words))
        solid = pc.and_(pc.equal(pc.utf8_rtrim_whitespace(words), words), pc.not_equal(words, "")).to_numpy(zero_copy_only=False)
        once = np.flatnonzero((often == 1) & solid)
        more = np.flatnonzero((often > 1) | (often == 1) & ~solid)
        first, where = np.unique(code[at[:-1]], return_inverse=True)
        # the batch's table: the lasting one, then words that the batch has once
        lasting = self._codes([" " + w for w in words.take(pa.array(more)).to_pylist()])
        index = np.zeros(len(words), np.int64)
        heads = self._codes(words.take(pa.array(first)).to_pylist())
        index[more] = lasting
        index[once] = len(self.begin) + np.arange(len(once))
        rare, n_rare = self._runs(words.take(pa.array(once))) if len(once) else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
        begin = np.concatenate([self.begin, self.used + np.cumsum(n_rare) - n_rare]).astype(np.int64)
        length = np.concatenate([self.length, n_rare]).astype(np.int64)
        each = index[code]
        each[at[:-1]] = heads[where]
        n = length[each]
        ends = np.cumsum(n)
        flat = np.concatenate([self.flat[: self.used], rare])
        ids = flat[np.repeat(begin[each] - (ends - n), n) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[at]


@lru_cache(maxsize=2)
def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path, plain_specials)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """batch in runs of about size bytes of a string column."""
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(length), 0
    while first < batch.num_rows:
        end = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, "right")))
        yield batch.slice(first, end - first)
        first = end


def merged(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = 14 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about size bytes of a string column: words that repeat are encoded once in each."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(column).nbytes
        if n >= size:
            yield from slices(pa.concat_batches(held), column, 2 * size)
            held, n = [], 0
    if held:
        yield from slices(pa.concat_batches(held), column, 2 * size)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append end_id to each text's ids."""
    return np.insert(ids, bounds[1:], np.array(end_id, ids.dtype)), bounds + np.arange(len(bounds))
