"""Documents from folders: text, PDF and office files, in batch or as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .office import docx_text, xlsx_text
from .pdf import page_texts, pdf_text

TEXT = ("txt", "md", "rst", "csv", "log", "json", "html", "")
READERS: dict[str, Callable[[bytes], str]] = {"pdf": pdf_text, "xlsx": xlsx_text, "docx": docx_text}
#: The columns of the binary file source.
BINARY = "path string, modificationTime timestamp, length long, content binary"


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def extract(path: str, content: bytes) -> str:
    """The text of a file by its extension; unknown ones are an error."""
    kind = extension(path)
    if kind in READERS:
        return READERS[kind](content)
    if kind in TEXT:
        return content.decode("utf-8", "ignore")
    raise ValueError(f"unsupported file type: {kind}")


def texts(files: DataFrame) -> DataFrame:
    """path, text, error of binary files; unsupported, hidden and blank ones are left out, damaged ones keep an error."""
    known = "|".join([*READERS, *(t for t in TEXT if t)])
    name = F.element_at(F.split("path", "/"), -1)
    wanted = files.filter(~name.startswith(".") & (~F.contains(name, F.lit(".")) | F.lower(name).rlike(rf"\.({known})$")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out.append((path, extract(path, content), None))
                except Exception as e:  # noqa: BLE001  any damage of a file is its row's error
                    out.append((path, "", str(e)[:200]))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "text", "error"])

    read = wanted.select("path", "content").mapInArrow(run, "path string, text string, error string")
    return read.filter(F.col("error").isNotNull() | (F.trim("text") != ""))


def read_folder(spark: SparkSession, *paths: str) -> DataFrame:
    """Texts of all files below paths, each path once."""
    return texts(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).dropDuplicates(["path"]))


def stream_folder(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Texts of files as they arrive."""
    return texts(spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(path))


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files of found (path, …) that known (path) has not."""
    return found.join(known.select("path"), "path", "left_anti")


def pages(files: DataFrame) -> DataFrame:
    """path, page_no (from 1), text of the pages of PDF files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, i, t) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, t in enumerate(page_texts(c), 1)]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string()), strict=True)], ["path", "page_no", "text"])

    return files.filter(F.lower("path").endswith(".pdf")).select("path", "content").mapInArrow(run, "path string, page_no int, text string")


def read_corpus(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """doc_id, text of a collection with _id, title and text, as JSON lines or CSV."""
    raw = spark.read.json(path) if kind == "json" else spark.read.csv(path, header=True, multiLine=True, escape='"')
    body = F.array_join("text", " ") if dict(raw.dtypes)["text"].startswith("array") else F.col("text")
    title = F.nullif(F.trim("title"), F.lit("")) if "title" in raw.columns else F.lit(None)
    return raw.select(F.col("_id").cast("string").alias("doc_id"), F.concat_ws(". ", title, body).alias("text"))


def read_qrels(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """qid, doc_id, grade of a table with query-id, corpus-id and score."""
    raw = spark.read.csv(path, header=True, sep=sep)
    return raw.select(F.col("query-id").alias("qid"), F.col("corpus-id").alias("doc_id"), F.col("score").cast("int").alias("grade"))
