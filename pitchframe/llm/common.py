"""Helpers that the operators share: written tables, code on executors, texts in Arrow batches."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.session import shared_dir

# Characters of text that one step of an operator holds at a time; a longer single text is taken alone.
STEP_CHARS = 1_000_000


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per session, whatever folder the driver started in."""
    context = spark.sparkContext
    if getattr(context, "_pitchframe_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(), "pitchframe_code.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    context._pitchframe_shipped = True


def save(df: DataFrame, purpose: str, **settings: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: later steps restart from the files.

    Nothing reads the shuffles of a written table again, so they go when it is written. ``settings``
    (``__`` for dots) hold while it is written.
    """
    path = shared_dir(df.sparkSession, purpose)
    with during(df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | {k.replace("__", "."): v for k, v in settings.items()}):
        df.write.parquet(path)
    saved = df.sparkSession.read.schema(df.schema).parquet(path)
    saved._saved_as = path
    return saved


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`save` returned and that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._saved_as)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def during(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Set ``settings`` and put back what was there."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The key and the text alone, as ``doc_id`` and ``text``; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, step: int = STEP_CHARS) -> DataFrame:
    """Apply ``function`` to pieces of each partition that hold at most ``step`` bytes of the column ``text``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, step):
                done = function(piece)
                if done is not None and done.num_rows:
                    yield done

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, step: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    if "text" not in batch.schema.names:
        yield batch
        return
    sizes = pa.compute.binary_length(batch.column("text")).to_pylist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        size = size or 0
        if i > first and held + size > step:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)


def batch_of(types: dict[str, pa.DataType], columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], type=t) for k, t in types.items()], names=list(types))
