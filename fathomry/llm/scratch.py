"""Tables that cut lineage, kept in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs on one machine."""
    root = spark.conf.get(SETTING, None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fathomry-")
        spark.conf.set(SETTING, root)
    return root.rstrip("/")


BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let no Arrow batch for a Python worker exceed BATCH_BYTES by more than a row, whatever the length of texts.

    The session keeps the setting, since DataFrames that are returned run later; a smaller one of the user's stays.
    """
    now = spark.conf.get(BATCH_SETTING).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI and the path in it, as workers open it; Hadoop's names for S3 are S3 too."""
    scheme, colon, rest = uri.partition(":")
    store, path = pafs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + colon + rest)
    return store, path


class Scratch:
    """A folder of its own under the shared root; its tables go at exit or when discarded."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        bounded_batches(spark)
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.places: dict[str, str] = {}
        atexit.register(self.discard)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a Parquet table and read it back: later steps no longer depend on its lineage.

        A name that is used again gets another table; discard removes the last one."""
        self.places[name] = f"{name}-{uuid.uuid4().hex[:8]}" if name in self.places else name
        where = f"{self.path}/{self.places[name]}"
        df.write.option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def discard(self, name: str = "") -> None:
        """Remove a table, or the whole folder; at exit, the session may be gone, and then the folder stays."""
        with contextlib.suppress(Py4JError, ConnectionError, AttributeError):
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.places.get(name, name)}".rstrip("/"))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(name: str, columns: list[str]) -> str:
    """A column name that no column has, in any case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for a scan, the size of its files in any store."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def block_count(df: DataFrame, block_bytes: int = 64 << 20) -> int:
    """As many blocks as shuffle partitions are set, or more where a block would exceed block_bytes of input.

    Catalyst has no size for rows that come from memory or an RDD (it says the largest number); then the setting holds."""
    size = plan_bytes(df)
    return max(shuffle_partitions(df.sparkSession), -(-size // block_bytes) if size < 1 << 55 else 1)
