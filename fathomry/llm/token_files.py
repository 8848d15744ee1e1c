"""Token ids in seekable files: independent zstandard frames, an index frame and a trailing seek table.

A file holds, in order:

* data frames, each some whole documents' ids as little-endian unsigned integers, with the frame's own checksum;
* one index frame: ``TOKI``, the id width, the number of documents, then arrays of document ids (int64), null flags
  (uint8), frame numbers (uint32), positions in the frame (uint64, in ids) and lengths (uint64, in ids);
* the seek table of the public zstandard seekable format: a skippable frame with, for each frame before it, its
  compressed and its plain size and the low 32 bits of the XXH64 of its plain bytes.

A reader opens the table from the end of the file and decompresses only the frames of the documents asked for.

Cases: a null text has no ids but its end id; a null document id sorts first and is kept; repeated rows and ids are
all kept, next to each other; an empty table makes no file; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import block_of, filled, key_bounds
from .scratch import Scratch, block_count, open_store
from .tokens import default_vocabulary, encoder, merged, with_end

#: Fixed values of the public seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX_MAGIC = b"TOKI"
FRAME_BYTES = 256 << 10

SHARDS = "block int, path string, documents long, tokens long"


class TokenFileWriter:
    """Writes documents one after another to a binary stream; close() writes the index and the seek table."""

    def __init__(self, stream, dtype: np.dtype, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.stream, self.dtype, self.frame_bytes = stream, np.dtype(dtype).newbyteorder("<"), frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.pending: list[np.ndarray] = []
        self.in_frame, self.frames, self.documents = 0, [], []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.in_frame and (self.in_frame + len(ids)) * self.dtype.itemsize > self.frame_bytes:
            self._flush()
        self.documents.append((doc_id or 0, doc_id is None, len(self.frames), self.in_frame, len(ids)))
        self.pending.append(ids)
        self.in_frame += len(ids)
        self.tokens += len(ids)

    def _frame(self, plain: bytes) -> None:
        packed = self.zstd.compress(plain)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.stream.write(packed)

    def _flush(self) -> None:
        self._frame(np.concatenate(self.pending).astype(self.dtype, copy=False).tobytes())
        self.pending, self.in_frame = [], 0

    def close(self) -> None:
        if self.pending:
            self._flush()
        columns = list(zip(*self.documents, strict=True)) or [()] * 5
        kinds = ("<i8", "u1", "<u4", "<u8", "<u8")
        head = INDEX_MAGIC + struct.pack("<IQ", self.dtype.itemsize, len(self.documents))
        self._frame(head + b"".join(np.array(c, k).tobytes() for c, k in zip(columns, kinds, strict=True)))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        foot = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(foot)) + table + foot)


class TokenFileReader:
    """Reads documents of a seekable binary file. frames_read counts decompressed data frames."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table")
        self.table = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.begin = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        index = self.frame(n - 1)
        if index[:4] != INDEX_MAGIC:
            raise ValueError("no index frame")
        width, count = struct.unpack_from("<IQ", index, 4)
        self.dtype, at, self.frames_read = np.dtype(f"<u{width}"), 16, 0
        arrays = []
        for kind in ("<i8", "u1", "<u4", "<u8", "<u8"):
            arrays.append(np.frombuffer(index, kind, count, at))
            at += arrays[-1].nbytes
        self.doc_id, self.null, self.frame_no, self.position, self.length = arrays

    def _at(self, where: int, size: int) -> bytes:
        self.file.seek(where)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        packed, plain, checksum = map(int, self.table[k])
        got = zstandard.ZstdDecompressor().decompress(self._at(int(self.begin[k]), packed), max_output_size=plain)
        if len(got) != plain or xxhash.xxh64_intdigest(got) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return got

    def rows(self, which: Iterable[int] | None = None) -> np.ndarray:
        """Numbers of the file's documents, in file order; with which, of all that have these ids."""
        return np.arange(len(self.doc_id)) if which is None else np.flatnonzero(np.isin(self.doc_id, list(which)) & (self.null == 0))

    def documents(self, which: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(document id, ids) of rows(which)."""
        rows = self.rows(which)
        at, ids = -1, None
        for i in rows:
            if self.frame_no[i] != at:
                at = int(self.frame_no[i])
                ids = np.frombuffer(self.frame(at), self.dtype)
                self.frames_read += 1
            begin = int(self.position[i])
            yield (None if self.null[i] else int(self.doc_id[i])), ids[begin : begin + int(self.length[i])]


def write_token_files(df: DataFrame, scratch: Scratch, vocabulary: str | None = None, end_id: int = 0, folder: str | None = None) -> list:
    """Encode df's (doc_id, text) and write one file for each block of doc_id; returns a row of SHARDS for each file.

    The texts are shuffled once, by ranges of doc_id. A task that runs twice writes another file; the returned rows
    name the files that count. The driver holds one row for each file.
    """
    vocabulary = vocabulary or default_vocabulary()
    folder = folder or f"{scratch.path}/files"
    narrow = df.select("doc_id", "text")
    blocks = block_count(narrow)
    bounds = key_bounds(narrow, "doc_id", blocks)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for part in merged(batches):
            enc = encoder(vocabulary)
            if writer is None:
                block = part.column("block")[0].as_py()
                store, base = open_store(folder)
                store.create_dir(base, recursive=True)
                name = f"block-{block:07d}-{uuid.uuid4().hex}.tokens"
                stream = store.open_output_stream(f"{base}/{name}")
                writer = TokenFileWriter(stream, enc.dtype)
            ids, at = with_end(*enc.encode(part.column("text")), end_id)
            for j, doc_id in enumerate(part.column("doc_id").to_pylist()):
                writer.add(doc_id, ids[at[j] : at[j + 1]])
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"block": block, "path": f"{folder}/{name}", "documents": len(writer.documents), "tokens": writer.tokens}], schema=pa.schema([("block", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    placed = narrow.withColumn("block", block_of(filled("doc_id"), bounds)).repartitionById(len(bounds) + 1, "block").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return sorted(scratch.save(placed.mapInArrow(write, SHARDS), "shards").collect(), key=lambda r: r["block"])


def open_tokens(path: str) -> TokenFileReader:
    store, at = open_store(path)
    return TokenFileReader(store.open_input_file(at))


def read_token_files(spark: SparkSession, shards: list, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of the files' documents, or of doc_ids only.

    Start counts from the first file on; ids_crc32 is that of the ids as little-endian unsigned 32-bit integers.
    """
    base, rows = 0, []
    for r in shards:
        rows.append((r["path"], base))
        base += r["tokens"]
    wanted = None if doc_ids is None else sorted(set(doc_ids))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = open_tokens(path)
                start = begin + np.cumsum(reader.length, dtype=np.int64) - reader.length.astype(np.int64)
                found = zip(reader.rows(wanted).tolist(), reader.documents(wanted), strict=True)
                out = [(doc_id, int(start[i]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, (doc_id, ids) in found]
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from token files."""
    scratch = Scratch(spark, "op4")
    shards = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch)
    return read_token_files(spark, shards)
