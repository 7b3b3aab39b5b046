"""Incremental load of new pitches, as a batch rule and as a stream."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pitchframe.operators.joins import first_of_key, only_new
from pitchframe.session import observed
from pitchframe.sources.tables import append_rows

LOOK_BACK_DAYS = 2
MOST_PARTITIONS = 1_000  # of one batch that are named in the filter on stored rows; a batch with more is compared by its dates alone


def stored_rows(spark: SparkSession, target: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The stored table, or None before the first load. With ``schema`` no file is opened to infer one."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(target)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def incremental_rows(
    incoming: DataFrame, stored: DataFrame | None, key: Sequence[str], date: str, today: datetime.date
) -> DataFrame:
    """Rows to append: everything at first, else the unseen rows from the stored maximum date on.

    Keys are compared strictly after the look-back of two days before that
    date. When more than one calendar year is missing, the comparison covers
    the whole year of the maximum, and rows from the start of that year on are
    taken.
    """
    if stored is None:
        return first_of_key(incoming, key)
    high_water = stored.agg(F.max(F.col(date).cast("date"))).first()[0]
    if high_water is None:
        return first_of_key(incoming, key)
    kind = incoming.schema[date].dataType
    stored_kind = stored.schema[date].dataType
    if today.year - high_water.year > 1:
        start = datetime.date(high_water.year, 1, 1)
        fresh = incoming.where(F.col(date) >= F.lit(start).cast(kind))
        return only_new(fresh, stored.where(F.col(date) >= F.lit(start).cast(stored_kind)), key)
    fresh = incoming.where(F.col(date) >= F.lit(high_water).cast(kind))
    return only_new(fresh, stored, key, date=date, look_back_days=LOOK_BACK_DAYS, high_water=high_water)


def near_keys(stored: DataFrame, spans: Sequence[Row], date: str, partition_by: Sequence[str]) -> DataFrame:
    """Stored rows that the batch behind ``spans`` can repeat: of its partitions and its date range."""
    kind = stored.schema[date].dataType
    low, high = min(s["low"] for s in spans), max(s["high"] for s in spans)
    near = stored.where(F.col(date).between(F.lit(low).cast(kind), F.lit(high).cast(kind)))
    for column in partition_by:
        values = {s[column] for s in spans}
        if None not in values:
            near = near.where(F.col(column).isin(sorted(values)))
    return near


def high_water_mark(stored: DataFrame, date: str, partition_by: Sequence[str]) -> object:
    """The newest stored date. Where partitions grow with the date, only the newest of them is read."""
    for column in partition_by[:1]:
        newest = stored.agg(F.max(column)).first()[0]
        stored = stored if newest is None else stored.where(F.col(column) == newest)
    return stored.agg(F.max(date)).first()[0]


def append_batch(
    batch: DataFrame, target: str, key: Sequence[str], date: str, partition_by: Sequence[str]
) -> dict[str, int]:
    """Append the rows of one micro-batch that are not stored, once each, and return what was counted.

    The batch is read once: its partitions with their dates come first, and
    stored keys are read for those partitions and dates only, so a late row is
    compared with its own day and neither lost nor doubled. Partition columns
    have to follow from the key. A batch that is repeated after a failure finds
    its rows stored and appends nothing. Counts: ``arrived``, ``late`` (before
    the newest stored date), ``without_date`` (kept, compared with stored rows
    without a date) and ``appended``.
    """
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        dates = [F.min(date).alias("low"), F.max(date).alias("high"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(date).isNull()).alias("without")]
        spans = batch.groupBy(*partition_by).agg(*dates).limit(MOST_PARTITIONS + 1).collect()
        if len(spans) > MOST_PARTITIONS:
            partition_by_near, spans = [], batch.agg(*dates).collect()
        else:
            partition_by_near = list(partition_by)
        counts = {"arrived": sum(s["n"] for s in spans), "late": 0, "without_date": sum(s["without"] for s in spans), "appended": 0}
        if not counts["arrived"]:
            return counts
        stored = stored_rows(spark, target, batch.schema)
        if stored is None:
            fresh = first_of_key(batch, key)
        else:
            dated = [s for s in spans if s["high"] is not None]
            near = near_keys(stored, dated, date, partition_by_near) if dated else stored.limit(0)
            if counts["without_date"]:
                near = near.unionByName(stored.where(F.col(date).isNull()))
            fresh = only_new(batch, near, key)
            mark = high_water_mark(stored, date, partition_by)
            if mark is not None and any(s["low"] is not None and s["low"] < mark for s in spans):
                counts["late"] = batch.where(F.col(date) < F.lit(mark)).count()
        seen = Observation()
        append_rows(fresh.observe(seen, F.count(F.lit(1)).alias("n")), target, partition_by)
        counts["appended"] = observed(seen, "n")["n"]
        return counts
    finally:
        batch.unpersist()


def pitch_stream(
    spark: SparkSession, source: str, schema: T.StructType | str, *, fmt: str = "parquet", **options: object
) -> DataFrame:
    """File stream of arriving pitch files."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(source)


def start_ingest(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    key: Sequence[str],
    date: str,
    *,
    partition_by: Sequence[str] = ("game_year",),
    watermark: str | None = None,
    report: Callable[[int, dict[str, int]], None] | None = None,
) -> StreamingQuery:
    """Load everything that has arrived and stop.

    With ``watermark`` (such as ``2 days``) repeats are also removed by
    streaming state before the comparison with the stored table; rows older
    than the watermark are then dropped and counted in the query progress.
    Without it every late row is kept. ``report`` gets the number and the counts
    of every batch.
    """

    def append(batch: DataFrame, number: int) -> None:
        counts = append_batch(batch, target, key, date, partition_by)
        if report:
            report(number, counts)

    if watermark is not None:
        stream = stream.withWatermark(date, watermark).dropDuplicatesWithinWatermark(list(key))
    return (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dropped_as_late(query: StreamingQuery) -> int:
    """Rows the watermark dropped, over the recent progress reports."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
