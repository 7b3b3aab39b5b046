"""Streams over the events table, run until all arrived rows are processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchframe.functions.categories import PITCH_CLASSES, collapse
from pitchframe.session import shared_dir
from pitchframe.sources.tables import read_table
from pitchframe.streaming import counts, ingest
from pitchframe.suite import SQL, register
from pitchframe.suite.ordering import running_counts
from pitchframe.suite.standin import as_pitches


def _arriving(spark, folder):
    schema = read_table(spark, folder, "events").schema
    return ingest.pitch_stream(spark, folder, schema, pathGlobFilter="events.parquet")


@register("X1 J1 A8", "SELECT event_id, user_id, event_type, value FROM events")
def streamed_ingest(spark, folder):
    """Half of the rows are stored; all of them arrive."""
    work = shared_dir(spark, "ingest")
    events = read_table(spark, folder, "events").withColumn("day", F.date_format("ts", "yyyy-MM"))
    events.where(F.col("value") < 50).write.partitionBy("day").parquet(f"{work}/table")
    stream = _arriving(spark, folder).withColumn("day", F.date_format("ts", "yyyy-MM"))
    query = ingest.start_ingest(stream, f"{work}/table", f"{work}/checkpoint", ["event_id"], "ts", partition_by=["day"])
    query.awaitTermination()
    return spark.read.parquet(f"{work}/table").select("event_id", "user_id", "event_type", "value")


@register("X1", "SELECT event_id, event_type FROM events WHERE event_id IS NOT NULL")
def incremental_batch(spark, folder):
    """The batch rule: stored rows up to a day, then everything from the stored maximum on."""
    import datetime

    events = read_table(spark, folder, "events")
    stored = events.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    fresh = ingest.incremental_rows(events, stored, ["event_id"], "ts", datetime.date(2024, 2, 1))
    return stored.unionByName(fresh).select("event_id", "event_type")


@register(
    "X1 J1",
    """WITH e AS (SELECT *, CASE WHEN value < 10 THEN ts - INTERVAL 2 YEAR ELSE ts END AS moved FROM events),
       m AS (SELECT max(moved) AS mark FROM e WHERE moved >= TIMESTAMP '2024-01-10')
       SELECT 0 AS batch, 2 * count(*) AS arrived, CAST(0 AS BIGINT) AS late, count(*) AS appended FROM e WHERE moved >= TIMESTAMP '2024-01-10'
       UNION ALL SELECT 1, count(*), count(*) FILTER (moved < (SELECT mark FROM m)), count(*) FILTER (moved < TIMESTAMP '2024-01-10') FROM e
       UNION ALL SELECT 2, count(*), count(*) FILTER (moved < (SELECT mark FROM m)), 0 FROM e""",
)
def late_batches(spark, folder):
    """What three batches met: rows that come twice, rows of days and of a year long stored, and a batch that came before."""
    target = f"{shared_dir(spark, 'late')}/table"
    moved = F.when(F.col("value") < 10, F.col("ts") - F.expr("INTERVAL 2 YEARS")).otherwise(F.col("ts"))
    events = read_table(spark, folder, "events").withColumn("at", moved).withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    recent = events.where(F.col("at") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    rows = []
    for number, batch in enumerate((recent.unionByName(recent), events, events)):
        seen = ingest.append_batch(batch, target, ["event_id"], "at", ["day"])
        rows.append((number, seen["arrived"], seen["late"], seen["appended"]))
    return spark.createDataFrame(rows, "batch int, arrived long, late long, appended long")


@register("X2 W12", SQL[running_counts.__name__])
def streamed_counts(spark, folder):
    work = shared_dir(spark, "counts")
    stream = as_pitches(_arriving(spark, folder)).withColumn("outcome", collapse("description", PITCH_CLASSES))
    query = counts.start_counts(
        stream, f"{work}/out", f"{work}/state", f"{work}/checkpoint", ["pitcher", "game_pk"], ["game_date", "event_id"], "outcome"
    )
    query.awaitTermination()
    return spark.read.parquet(f"{work}/out").select("event_id", "balls_after", "strikes_after", "event")
