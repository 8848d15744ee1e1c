"""Tables that an engine writes once and reads often, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


class Workspace:
    """A folder of its own under spark.checkpoint.dir, removed by close() or at exit. Where that is unset, a temporary
    folder serves a session on one machine; on a cluster it must be set."""

    def __init__(self, spark: SparkSession, label: str):
        root = spark.conf.get(SETTING, None)
        if not root:
            if not spark.conf.get("spark.master", "local").startswith("local"):
                raise ValueError(f"{SETTING} must name a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="fathomry-")
            spark.conf.set(SETTING, root)
        self.spark, self.path, self.n = spark, f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}", 0
        atexit.register(self.close)

    def save(self, df: DataFrame) -> DataFrame:
        """df, written as Parquet and read back: later plans are short and start from the table."""
        self.n += 1
        where = f"{self.path}/{self.n}"
        df.write.option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def close(self) -> None:
        try:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except (Py4JError, ConnectionError, AttributeError):
            return  # the session is gone
