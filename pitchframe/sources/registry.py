"""Registry of small keyed JSON documents, one file ``<id>-<yyyyMMdd>.json`` per entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.operators.ordered import top_rows
from pitchframe.schemas import PARAMETER_SCHEMA

NAME = r"([^/]+)-(\d{8})\.json$"
PARAMETER_DAYS = 90
TABLE_DAYS = 180


def read_registry(spark: SparkSession, folder: str, schema: str = PARAMETER_SCHEMA) -> DataFrame:
    """All entries below ``<folder>/<model>/`` with model, id and creation date from the path."""
    raw = (
        spark.read.schema(schema)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .json(folder)
        .withColumn("_path", F.col("_metadata.file_path"))
    )
    return raw.select(
        F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1).alias("model"),
        F.regexp_extract("_path", NAME, 1).alias("id"),
        F.to_date(F.regexp_extract("_path", NAME, 2), "yyyyMMdd").alias("created"),
        *[c for c in raw.columns if c != "_path"],
    )


def write_registry(df: DataFrame, folder: str, *, model: str = "model", id: str = "id", created: str = "created") -> None:
    """Append entries as JSON under partition folders of model, id and creation date."""
    day = F.date_format(F.col(created), "yyyyMMdd")
    df.withColumn(created, day).write.mode("append").partitionBy(model, id, created).json(folder)


def read_written(spark: SparkSession, folder: str, schema: str = PARAMETER_SCHEMA) -> DataFrame:
    """Entries stored by :func:`write_registry`."""
    declared = f"{schema}, model string, id string, created string"
    df = spark.read.schema(declared).json(folder)
    return df.withColumn("created", F.to_date("created", "yyyyMMdd"))


def latest_valid(entries: DataFrame, keys: list[str], today: Column, days: int, created: str = "created") -> DataFrame:
    """The newest entry per key, if it is not older than ``days``."""
    newest = top_rows(entries, keys, [f"-{created}"], 1)
    return newest.where(F.datediff(today, F.col(created)) <= days)


def needs_refit(wanted: DataFrame, entries: DataFrame, keys: list[str], today: Column, days: int) -> DataFrame:
    """Wanted keys without a valid entry."""
    return wanted.select(*keys).distinct().join(latest_valid(entries, keys, today, days).select(*keys), keys, "left_anti")
