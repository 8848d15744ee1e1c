"""Legacy ARC archives: writing them, reading versions 1 and 2, and converting their records to WARC.

An ARC file opens with a version block, ``filedesc://`` and its own header line, then the version line and the line
that names the fields of the URL records of that version (both are read from the file):

* version 1: URL, IP-address, Archive-date, Content-type, Archive-length;
* version 2: URL, IP-address, Archive-date, Content-type, Result-code, Checksum, Location, Offset, Filename, Archive-length.

Each record is a header line, as many bytes as the line declares, and a line feed. The converter makes for each one a
WARC record with a name-based identifier (from archive, offset and URL), a WARC-Date from the 14-digit archive date,
a type, and SHA-1 digests of block and payload. The version block becomes a warcinfo record, a block that opens with an
HTTP status line a response (or a revisit), any other a resource of its declared content type. Members are compressed
one by one, so any record can be read alone. Each archive is written, indexed and converted by a task of its own.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the largest page id is the response and
the others revisit it and name its identifier, URI and date; smaller payloads are always responses.

Cases: null html is an empty payload; a null url becomes ``urn:page:<id>``, blanks and controls in a url are percent-
encoded and ``WARC-Target-URI`` keeps that form; a null page id is kept, comes before all others, and never is what
others refer to; rows that repeat the largest page id of their payload are all responses; an empty table gives no
archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, open_store, plan_bytes

MIN_REVISIT = 1000
#: Payloads with copies, a row each, go to every executor up to this size, beyond it by a shuffle.
BROADCAST_BYTES = 32 << 20
#: The field names of the two record versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_UNSAFE = re.compile(r"[\x00-\x20\x7f-￿\U00010000-\U0010ffff]")
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:fathomry:arc")
#: Fields of this library, beside the standard ones: the page of a record, and of the one it revisits; its full length.
PAGE_FIELD, ORIGINAL_FIELD, LENGTH_FIELD = "X-Page-Id", "X-Refers-To-Page-Id", "X-Payload-Length"


def safe_url(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{'' if page_id is None else page_id}"
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), url)


class ArcRecord(NamedTuple):
    offset: int
    fields: dict[str, str]
    block: bytes  # HTTP header and payload


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 fathomry\n{FIELDS[version]}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(values[f] for f in FIELDS[version].split()).encode() + b"\n" + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, date: str, block: bytes) -> bytes:
    values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": hashlib.md5(block).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return " ".join(values[f] for f in FIELDS[version].split()).encode() + b"\n" + block + b"\n"


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """Records of an uncompressed ARC stream; the first is the version block, whose URL is ``filedesc://``. Its second line
    says which fields a header line has; the length is its last field, and blanks inside the URL do not matter, since
    fields count from the end."""
    offset, names = 0, None
    while line := stream.readline():
        if not line.strip():
            offset += len(line)
            continue
        if names is None:
            length = int(line.split()[-1])
            body = stream.read(length)
            version_line, field_line = body.split(b"\n")[:2]
            version = int(version_line.split()[0])
            names = field_line.decode("latin-1").split() or FIELDS[version].split()
            if version not in FIELDS or names != FIELDS[version].split():
                raise ValueError(f"unknown ARC version block {body[:80]!r}")
            head = line.rstrip(b"\n").decode("latin-1").rsplit(" ", len(names) - 1)
            yield ArcRecord(offset, dict(zip(names, head, strict=True)), body)
            offset += len(line) + length
            continue
        parts = line.rstrip(b"\n").decode("latin-1").rsplit(" ", len(names) - 1)
        if len(parts) != len(names):
            raise ValueError(f"an ARC header line with {len(parts)} fields at {offset}")
        fields = dict(zip(names, parts, strict=True))
        length = int(fields["Archive-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"an ARC record at {offset} is cut short")
        yield ArcRecord(offset, fields, block)
        offset += len(line) + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with its empty line) and payload of a block; without a status line all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(i + len(sep)) for sep in (b"\r\n\r\n", b"\n\n") if (i := block.find(sep)) >= 0]
    return (block[: min(ends)], block[min(ends) :]) if ends else (block, b"")


def warc_date(archive_date: str) -> str:
    """ISO time of an archive date of 4 to 14 digits."""
    d = archive_date.ljust(14, "0")
    month, day = (x if x != "00" else "01" for x in (d[4:6], d[6:8]))
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, offset: int, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive} {offset} {url}')}>"


def sha1_base32(data: bytes) -> str:
    import base64

    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


class Original(NamedTuple):
    """The record that a revisit refers to."""

    page_id: int
    record_id: str
    url: str
    date: str


def kind_of(record: ArcRecord) -> str:
    """warcinfo, response or resource."""
    if record.fields["URL"].startswith("filedesc:"):
        return "warcinfo"
    return "response" if record.block.startswith(b"HTTP/") else "resource"


def warc_record(archive: str, record: ArcRecord, original: Original | None = None) -> bytes:
    """The WARC record of an ARC record; with an original, a revisit of it without the payload."""
    kind, url = kind_of(record), record.fields["URL"]
    head, payload = split_http(record.block)
    block = record.block
    fields = [
        ("WARC-Type", kind if original is None else "revisit"),
        ("WARC-Record-ID", record_id(archive, record.offset, url)),
        ("WARC-Date", warc_date(record.fields["Archive-date"])),
    ]
    if kind == "warcinfo":
        about = {"software": "fathomry", "format": "WARC File Format 1.1", "conformsTo": "http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/", "description": f"converted from {archive}, {record.block.splitlines()[0].decode('latin-1')}"}
        block = "".join(f"{k}: {v}\r\n" for k, v in about.items()).encode()
        fields += [("WARC-Filename", archive.removesuffix(".gz").removesuffix(".arc") + ".warc.gz")]
    else:
        fields += [("WARC-Target-URI", url), ("WARC-IP-Address", record.fields["IP-address"]), ("WARC-Payload-Digest", sha1_base32(payload))]
    if original is not None:
        block = head
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", original.record_id),
            ("WARC-Refers-To-Target-URI", original.url),
            ("WARC-Refers-To-Date", original.date),
            (ORIGINAL_FIELD, str(original.page_id)),
            (LENGTH_FIELD, str(len(payload))),
        ]
    content = {"warcinfo": "application/warc-fields", "response": "application/http; msgtype=response", "resource": record.fields["Content-type"]}[kind]
    fields += [("WARC-Block-Digest", sha1_base32(block)), ("Content-Type", content), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of an uncompressed WARC stream; digests of blocks are checked."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.strip()] = v.strip()
        block = stream.read(int(fields["Content-Length"]))
        if sha1_base32(block) != fields["WARC-Block-Digest"]:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
        yield fields, block


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _read(path: str) -> BinaryIO:
    store, at = open_store(path)
    return io.BufferedReader(gzip.GzipFile(fileobj=store.open_input_file(at)))


def _new(folder: str, name: str):
    store, base = open_store(folder)
    store.create_dir(base, recursive=True)
    return store.open_output_stream(f"{base}/{name}", compression=None)


def write_arcs(pages: DataFrame, scratch: Scratch, date: str = "20240101000000") -> DataFrame:
    """One ARC file for each partition of pages (page_id, url, html), versions 1 and 2 in turn; path, records."""
    folder = f"{scratch.path}/arc"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"pages-{part:06d}-{uuid.uuid4().hex}.arc.gz"
        out, offset, n = None, 0, 0
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = _new(folder, name)
                    data = arc_version_block(name, version, date)
                    out.write(member(data))
                    offset = len(data)
                payload = (html or "").encode("utf-8", "surrogatepass")
                mark = "" if page_id is None else f"{PAGE_FIELD}: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{mark}\r\n".encode()
                data = arc_record(version, name, offset, safe_url(url, page_id), date, head + payload)
                out.write(member(data))
                offset += len(data)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n])], ["path", "records"])

    return scratch.save(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "path string, records long"), "arcs")


def page_of(head: bytes) -> int | None:
    m = re.search(rf"(?im)^{PAGE_FIELD}:\s*(-?\d+)".encode(), head)
    return int(m[1]) if m else None


def arc_index(paths: DataFrame) -> DataFrame:
    """path, offset, url, date, page_id, digest and length of the payload of every ARC record that has an HTTP header."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with _read(path) as f:
                    for r in read_arc(f):
                        if kind_of(r) == "response":
                            head, payload = split_http(r.block)
                            rows.append((path, r.offset, r.fields["URL"], warc_date(r.fields["Archive-date"]), page_of(head), hashlib.sha1(payload).hexdigest(), len(payload)))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "offset", "url", "date", "page_id", "digest", "length"])

    return paths.select("path").repartition(max(1, paths.count())).mapInArrow(run, "path string, offset long, url string, date string, page_id long, digest string, length long")


def convert(paths: DataFrame, scratch: Scratch, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Convert the ARC files named in paths (path) to WARC files; path, records of the WARC files.

    The index of payloads decides what revisits what; then each ARC file is read once more, beside the rows of the
    index that are revisits of its records, so payloads themselves are never shuffled.
    """
    folder = f"{scratch.path}/warc"
    index = scratch.save(arc_index(paths), "arc-index")
    first = F.struct("page_id", "path", "offset", "url", "date")
    last = index.filter(F.col("length") >= min_revisit).groupBy("digest", "length").agg(F.max(first).alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1 and original.page_id is not null")
    last = scratch.save(last.drop("n"), "arc-originals")
    known = F.broadcast(last) if plan_bytes(last) <= BROADCAST_BYTES else last
    revisits = index.select("path", "offset", "page_id", "digest", "length").join(known, ["digest", "length"]).filter("page_id is null or page_id <> original.page_id").select("path", "offset", "original")
    tasks = paths.select("path", F.lit(-1).cast("long").alias("offset"), F.lit(None).cast(last.schema["original"].dataType).alias("original")).union(revisits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted: a file's own row (offset -1), then its revisits
        path, refers = None, {}

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid5(NAMESPACE, path).hex}-{uuid.uuid4().hex}.warc.gz"
            archive, n = path.rsplit("/", 1)[-1], 0
            with _new(folder, name) as out, _read(path) as f:
                for r in read_arc(f):
                    out.write(member(warc_record(archive, r, refers.get(r.offset))))
                    n += 1
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n])], ["path", "records"])

        for batch in batches:
            for p, offset, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != path:
                    if path is not None:
                        yield flush()
                    path, refers = p, {}
                if offset >= 0:
                    o = original
                    refers[offset] = Original(o["page_id"], record_id(o["path"].rsplit("/", 1)[-1], o["offset"], o["url"]), o["url"], o["date"])
        if path is not None:
            yield flush()

    # a number of partitions keeps adaptive execution from merging them
    placed = tasks.repartition(max(1, paths.count()), "path").sortWithinPartitions("path", "offset")
    return scratch.save(placed.mapInArrow(run, "path string, records long"), "warcs")


def read_warcs(paths: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri, date of every record but
    warcinfo ones."""
    import base64

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with _read(path) as f:
                    for fields, block in read_warc(f):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        head, payload = split_http(block)
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        size = int(fields.get(LENGTH_FIELD, len(payload)))
                        if fields["WARC-Type"] != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                        refers = fields.get(ORIGINAL_FIELD)
                        rows.append((page_of(head), size, digest, fields["WARC-Type"], None if refers is None else int(refers), fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"]))
                columns = list(zip(*rows, strict=True)) or [()] * 8
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "warc_date")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, warc_date string"
    return paths.select("path").repartition(max(1, paths.count())).mapInArrow(run, schema)


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC records, converted to WARC and read back."""
    scratch = Scratch(spark, "op5")
    warcs = convert(write_arcs(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch), scratch)
    return read_warcs(warcs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Compares op5_arc_to_warc in DuckDB.
OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
