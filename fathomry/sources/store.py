"""An index as a folder of Parquet tables with a manifest table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save(tables: dict[str, DataFrame], path: str, version: int = 1) -> None:
    """Write tables under path; the manifest comes last, so a folder without one is not complete."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(n, version) for n in tables], "name string, version int").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    rows = spark.read.schema("name string, version int").json(f"{path}/manifest").collect()  # one row for each table
    return {r["name"]: spark.read.parquet(f"{path}/{r['name']}") for r in rows}
