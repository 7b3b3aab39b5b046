"""Ball/strike count on a live stream.

Each micro-batch runs the batch operator and starts from the running sums the
at-bats had before. Those sums only grow, so the sums to carry over are plain
maxima per at-bat: no Python state code and no group gathered in one task.

The carried sums live in a table next to the output. It is written once per
batch, and the first batch of every generation writes all open at-bats again,
so a batch never reads more than two generations. At-bats that have ended, or
that are too old to go on, are not written again and so leave the state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pitchframe.operators.aggregate import attach
from pitchframe.operators.state import COUNT_SUMS, count_sums, finish_count
from pitchframe.session import observed
from pitchframe.streaming.ingest import stored_rows

GENERATION = 50


def _latest(sums: DataFrame, at_bat: Sequence[str]) -> DataFrame:
    marks = [F.max("_last").alias("_last"), F.max("_done").alias("_done")]
    return sums.groupBy(*at_bat).agg(*[F.max(c).alias(c) for c in COUNT_SUMS], *marks)


def _open(carried: DataFrame, horizon: str | None) -> DataFrame:
    """At-bats that may go on: not ended, and not older than the newest one by more than ``horizon``."""
    rows = carried.where(~F.col("_done"))
    if horizon is None:
        return rows
    newest = carried.agg(F.max("_last")).scalar()
    return rows.where(F.col("_last") >= newest - F.expr(f"INTERVAL {horizon}"))


def count_batch(
    batch: DataFrame,
    number: int,
    output: str,
    state: str,
    at_bat: Sequence[str],
    order: Sequence[str],
    outcome: str,
    generation: int = GENERATION,
    *,
    ends: Column | None = None,
    horizon: str | None = None,
) -> dict[str, int]:
    """Count one micro-batch. Its output and state folders are overwritten when it is repeated.

    An at-bat leaves the state when a row of it meets ``ends``, or when its last
    row is older than the newest one by more than ``horizon`` (such as ``2
    days``): the next generation does not write it again. Returns the at-bats
    ``carried`` into the batch, its ``rows`` and how many of them were
    ``out_of_order``: earlier than a row of their at-bat in a previous batch.
    Those are counted with the sums known by then and marked in the output.
    """
    spark = batch.sparkSession
    current = number // generation
    carried = stored_rows(spark, state)
    before = 0
    if carried is not None:
        carried = _latest(
            carried.where((F.col("generation") >= current - 1) & (F.col("batch") < number)).select(*at_bat, *COUNT_SUMS, "_last", "_done"),
            at_bat,
        )
        carried = carried.persist()
        before = carried.count()
    marked = batch.withColumns({"_last": F.col(order[0]), "_done": F.coalesce(ends, F.lit(False)) if ends is not None else F.lit(False)})
    sums = count_sums(marked, at_bat, order, outcome, carried.drop("_last", "_done") if carried is not None else None).persist()
    try:
        late = F.lit(False)
        rows = sums
        if carried is not None:
            rows = attach(sums, carried.select(*at_bat, F.col("_last").alias("_before")), at_bat, "left")
            late = F.coalesce(F.col(order[0]) < F.col("_before"), F.lit(False))
        rows = rows.withColumn("out_of_order", late).drop("_before")
        seen = Observation()
        counted = finish_count(rows).drop(*COUNT_SUMS, "_last", "_done")
        counted = counted.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("out_of_order").alias("out_of_order"))
        counted.write.mode("overwrite").parquet(f"{output}/batch={number}")
        fresh = _latest(sums, at_bat)
        if carried is not None and number % generation == 0:
            untouched = attach(_open(carried, horizon), fresh.select(*at_bat).distinct(), at_bat, "left_anti")
            fresh = fresh.unionByName(untouched)
        fresh.write.mode("overwrite").parquet(f"{state}/generation={current}/batch={number}")
        return {"carried": before, **observed(seen, "rows", "out_of_order")}
    finally:
        sums.unpersist()
        if carried is not None:
            carried.unpersist()


def start_counts(
    stream: DataFrame,
    output: str,
    state: str,
    checkpoint: str,
    at_bat: Sequence[str],
    order: Sequence[str],
    outcome: str,
    *,
    generation: int = GENERATION,
    ends: Column | None = None,
    horizon: str | None = None,
    report: Callable[[int, dict[str, int]], None] | None = None,
) -> StreamingQuery:
    """Count everything that has arrived and stop.

    Pitches of an at-bat have to arrive in order across batches; inside a batch
    they are sorted. ``report`` gets the number and the counts of every batch,
    with the rows that came out of order.
    """

    def count(batch: DataFrame, number: int) -> None:
        counts = count_batch(batch, number, output, state, at_bat, order, outcome, generation, ends=ends, horizon=horizon)
        if report:
            report(number, counts)

    return (
        stream.writeStream.foreachBatch(count)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
