"""Replayable uniform numbers and weighted draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.operators.ordered import Ordered, written


def hashed_uniform(*columns: Column | str, seed: int = 0) -> Column:
    """A uniform number in [0, 1) that depends on the row's values and the seed only.

    ``rand`` depends on how rows are partitioned, so a recomputed task could
    draw anew; this cannot.
    """
    mixed = F.xxhash64(F.xxhash64(*columns), F.lit(seed))
    return F.shiftrightunsigned(mixed, 11).cast("double") / F.lit(float(2**53))


def cumulative(dist: DataFrame, given: Sequence[str], order: Sequence[str], weight: str, *, bounded: bool = False) -> DataFrame:
    """Adds the half-open probability interval ``[low, high)`` of each outcome of a condition.

    ``bounded`` states that a condition has few outcomes; otherwise conditions
    are counted, and one with very many is split.
    """
    weights = F.col(weight).cast("double")
    if given:
        dist = dist.withColumn("_sum", F.sum(weights).over(Window.partitionBy(*given)))
    else:
        dist = dist.withColumn("_sum", dist.agg(F.sum(weights)).scalar())
    run = Ordered(dist, given, order, bounded=bounded).running_sum("_upto", weights).build()
    slack = F.col("_sum") * 1e-12
    upper = F.when(F.col("_upto") >= F.col("_sum") - slack, F.lit(1.0)).otherwise(F.col("_upto") / F.col("_sum"))
    lower = (F.col("_upto") - F.col(weight)) / F.col("_sum")
    return run.withColumns({"low": lower, "high": upper}).drop("_upto", "_sum")


def draw(
    df: DataFrame,
    dist: DataFrame,
    given: Sequence[str],
    outcome: Sequence[str],
    weight: str,
    u: str,
    *,
    how: str = "left",
    bounded: bool = False,
) -> DataFrame:
    """One outcome per row, chosen by ``u`` from the distribution of the row's condition.

    The intervals are written once. Their size on disk is then known when the
    join on the condition is planned: a small table is broadcast and the rows
    stay where they are, a large one is shuffled. The residual test keeps exactly
    one interval, so only one row per draw leaves the join.
    """
    table = written(cumulative(dist, given, outcome, weight, bounded=bounded), "intervals").select(
        *[F.col(g).alias(f"_given_{g}") for g in given], *outcome, "low", "high"
    )
    condition = (F.col(u) >= F.col("low")) & (F.col(u) < F.col("high"))
    for g in given:
        condition = condition & F.col(g).eqNullSafe(F.col(f"_given_{g}"))
    return df.join(table, condition, how).drop("low", "high", *[f"_given_{g}" for g in given])


def pick_class(probabilities: Column, classes: Sequence[str], u: Column) -> Column:
    """The class drawn by ``u`` from a per-row probability array."""
    running = F.lit(0.0)
    out = F.lit(classes[-1])
    steps = []
    for i, name in enumerate(classes[:-1]):
        running = running + F.element_at(probabilities, i + 1)
        steps.append((u < running, name))
    for test, name in reversed(steps):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def mean_drawn_counts(df: DataFrame, drawn: Column, repeats: int, draw_id: str = "draw") -> DataFrame:
    """Mean number of rows per drawn class over repeated draws.

    ``drawn`` may use the column ``draw`` (1 to ``repeats``). The repeats are
    reduced map-side to one row per class and draw. A draw that misses a class
    does not enter that class's mean.
    """
    numbered = df.withColumn(draw_id, F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    counts = numbered.groupBy(draw_id, drawn.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("class").agg(F.avg("n").alias("mean_count"))
