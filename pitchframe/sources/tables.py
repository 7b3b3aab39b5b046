"""Typed scans, stored tables and file sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchframe.schemas import PITCH_SCHEMA, REPEATED_COLUMNS
from pitchframe.session import compiled_small
from pitchframe.sources.checked import Checked, checked


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def check_pitches(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = PITCH_SCHEMA, keep: Sequence[str] = ()
) -> Checked:
    """Pitch files, Parquet or CSV with a header, in the declared columns; what does not fit is on the reject side."""
    raw = spark.read.csv(path, header=True) if fmt == "csv" else spark.read.format(fmt).load(path)
    return checked(raw, schema, REPEATED_COLUMNS, keep)


def conform(df: DataFrame, schema: T.StructType = PITCH_SCHEMA, extras: Sequence[str] = REPEATED_COLUMNS) -> DataFrame:
    """All rows in the declared columns: extras are dropped, absent columns are NULL.

    A value that does not fit its type becomes NULL, except that a NULL in a
    key column fails the job. To count and keep such values, use :func:`check_pitches`.
    """
    return checked(df, schema, extras).nulled()


def read_pitches(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = PITCH_SCHEMA) -> DataFrame:
    """Pitch table from Parquet or CSV, as :func:`conform` gives it. Predicates on columns of the declared type prune the scan."""
    return check_pitches(spark, path, fmt, schema).nulled()


def query(spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None, **parameters: object) -> DataFrame:
    """A SQL text over stored tables and the given frames, with bound parameters.

    Frames are referenced as ``{name}`` and parameters as ``:name``.
    """
    return spark.sql(text, args=parameters or None, **(tables or {}))


def read_dimension(spark: SparkSession, path: str, columns: Sequence[str], schema: str | None = None) -> DataFrame:
    """CSV with a header; an unnamed index column and everything undeclared is left out.

    ``schema`` types the declared columns by name; without it they are text.
    """
    raw = spark.read.csv(path, header=True)
    picked = raw.select(*[F.col(f"`{c}`") for c in columns])
    if schema is None:
        return picked
    types = T.StructType.fromDDL(schema)
    return picked.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in types.fields])


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def append_rows(df: DataFrame, target: str, partition_by: Sequence[str] = ("game_year",)) -> None:
    """Append to a Parquet table folder, partitioned for pruning.

    The rebalance step gathers each partition's rows into files of the advisory
    size at run time: small ones are merged and large ones split, instead of
    every task writing a file for every partition it meets.
    """
    rebalanced = df.hint("rebalance", *[F.col(c) for c in partition_by])
    rebalanced.write.mode("append").partitionBy(*partition_by).parquet(target)


def replace_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def replace_folder(df: DataFrame, target: str) -> None:
    df.write.mode("overwrite").parquet(target)


def write_csv(df: DataFrame, target: str) -> None:
    with compiled_small(df.sparkSession):
        df.write.mode("overwrite").csv(target, header=True)
