"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Observation, SparkSession

# Runtime re-planning does the work of hand tuning: it coalesces small shuffle
# partitions, turns joins with a small measured side into broadcast joins and
# splits skewed join partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "pitchframe", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the shared folder of the session.

    The parent is ``spark.checkpoint.dir``. Only a session in one process (a
    local test) may leave it unset and gets a temporary folder of this machine;
    on a cluster a machine's own folder would lose rows, so that is an error.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if not parent:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        parent = tempfile.mkdtemp(prefix="pitchframe-")
    return os.path.join(parent, f"{purpose}-{uuid.uuid4().hex}")


def ship(spark: SparkSession) -> None:
    """Give executors this package as a zip file, once per session; functions that run in their Python workers import it."""
    context = spark.sparkContext
    if getattr(context, "_pitchframe_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="pitchframe-code-"), "pitchframe.zip")
    with zipfile.ZipFile(archive, "w") as file:
        for folder, _, names in os.walk(root):
            for name in filter(lambda n: n.endswith(".py"), names):
                path = os.path.join(folder, name)
                file.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._pitchframe_shipped = True


@contextmanager
def compiled_small(spark: SparkSession) -> Iterator[None]:
    """For wide rows: generated methods above 8,000 bytes, which the JVM would only interpret, are cut into small ones."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def observed(observation: Observation, *names: str) -> dict[str, int]:
    """The counts of an observation whose action has ended.

    A plan that turns out to have no rows may be replaced by an empty one, which
    counts nothing at all: all of ``names`` are 0 then.
    """
    try:
        return dict(observation.get)
    except Py4JJavaError:
        return dict.fromkeys(names, 0)
