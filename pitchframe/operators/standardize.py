"""z-scores, scaling and pseudo-observations without one-task windows.

Group statistics are aggregated with map-side partials and joined back, so a
category that holds a third of the rows is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.operators import ordered
from pitchframe.operators.aggregate import attach
from pitchframe.operators.ordered import Ordered, written

HOT_TIES = 50_000  # cells of one value that a task may have to join


def z_scores(
    df: DataFrame,
    column: str,
    within: Sequence[str],
    *,
    ddof: int,
    out: str = "z",
    constant: float | None = None,
) -> DataFrame:
    """Standard score of a column within groups.

    ``ddof=0`` divides by the population deviation, ``ddof=1`` by the sample
    deviation. Rows with a NULL value score NULL and do not enter the
    statistics; a group without spread scores ``constant``.
    """
    spread = {0: F.stddev_pop, 1: F.stddev_samp}[ddof]
    stats = df.groupBy(*within).agg(F.avg(column).alias("_mean"), spread(column).alias("_std"))
    joined = df.join(stats, list(within), "left")
    score = F.try_divide(F.col(column) - F.col("_mean"), F.nullif(F.col("_std"), F.lit(0.0)))
    if constant is not None:
        score = F.when(F.col(column).isNotNull(), F.coalesce(score, F.lit(constant)))
    return joined.withColumn(out, score).drop("_mean", "_std")


def standard_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Zero mean and unit population deviation over the whole table.

    The statistics of all columns come from one aggregation, read as a scalar
    subquery; no row is shuffled. A constant column becomes 0.
    """
    fields = [f for c in columns for f in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))]
    return _scale(df, df.agg(*fields), columns, suffix, "_m", "_s")


def min_max_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """The whole table mapped to [0, 1] per column; a constant column becomes 0."""
    fields = [f for c in columns for f in (F.min(c).alias(f"{c}_m"), (F.max(c) - F.min(c)).alias(f"{c}_s"))]
    return _scale(df, df.agg(*fields), columns, suffix, "_m", "_s")


def _scale(df, stats, columns, suffix, low, spread):
    one = stats.select(F.struct(*stats.columns)).scalar()
    df = df.withColumn("_stats", one)
    out = {}
    for c in columns:
        centred = (F.col(c) - F.col(f"_stats.{c}{low}")).cast("double")
        scaled = F.try_divide(centred, F.nullif(F.col(f"_stats.{c}{spread}").cast("double"), F.lit(0.0)))
        out[f"{c}{suffix}"] = F.when(F.col(c).isNotNull(), F.coalesce(scaled, F.lit(0.0)))
    return df.withColumns(out).drop("_stats")


def fill_with_mean(df: DataFrame, column: str, within: Sequence[str] = ()) -> DataFrame:
    """Replace NULL by the mean over the rows of ``df`` or of the group, so weighted by row."""
    if not within:
        return df.withColumn(column, F.coalesce(F.col(column), df.agg(F.avg(column)).scalar()))
    means = df.groupBy(*within).agg(F.avg(column).alias("_mean"))
    filled = attach(df, means, within, "left")
    return filled.withColumn(column, F.coalesce(F.col(column), F.col("_mean"))).drop("_mean")


def value_ranks(df: DataFrame, column: str, within: Sequence[str] = (), *, bounded: bool = False) -> DataFrame:
    """One row per (group, distinct value) with its count, average rank and group size.

    Works on distinct values only: ties collapse before anything is ordered.
    ``bounded`` states that no group has more rows than a task should.
    """
    present = df.select(*within, column).where(F.col(column).isNotNull())
    counts = present.groupBy(*within, column).agg(F.count(F.lit(1)).alias("ties"))
    ranked = Ordered(counts, within, [column], measure=present, bounded=bounded).running_sum("_upto", "ties").build()
    sizes = counts.groupBy(*within).agg(F.sum("ties").alias("size"))
    if within:
        ranked = ranked.join(sizes, list(within))
    else:
        ranked = ranked.withColumn("size", sizes.scalar())
    rank = F.col("_upto") - (F.col("ties") - 1) / F.lit(2.0)
    return ranked.withColumn("rank", rank).drop("_upto")


def pseudo_observations(
    df: DataFrame, columns: Sequence[str], within: Sequence[str] = (), suffix: str = "_u"
) -> DataFrame:
    """Average rank divided by group size plus one, per column.

    Rows are written once with a number of their own. Only (number, group,
    column, value) moves: distinct values of all columns are counted and ranked
    together, every cell finds its rank by its value, and the ranks of a row come
    back as one row, so the wide rows are shuffled once whatever the number of
    columns. A value that more than ``HOT_TIES`` cells share would be one large
    key of that join: there are few of those, so their ranks go to the cells.
    """
    rows = written(df.select("*", F.monotonically_increasing_id().alias("_row")), "rows")
    cells = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    long = rows.select("_row", *within, F.inline(cells)).where(F.col("_v").isNotNull()).withColumn("_v", F.col("_v") + F.lit(0.0))
    ranks = value_ranks(long, "_v", [*within, "_c"], bounded=rows.count() <= ordered.ROWS_PER_TASK)
    score = F.col("rank") / (F.col("size") + 1.0)
    keys = [*within, "_c", "_v"]
    ranks = written(ranks.select(*keys, "ties", score.alias("_u")), "ranks")
    hot = F.col("ties") > HOT_TIES
    met = attach(long, F.broadcast(ranks.where(hot).drop("ties")), keys, "left")
    rest = attach(met.where("_u IS NULL").drop("_u"), ranks.where(~hot).drop("ties"), keys)
    found = met.where("_u IS NOT NULL").select("_row", "_c", "_u").unionByName(rest.select("_row", "_c", "_u"))
    by_row = found.groupBy("_row").agg(*[F.max(F.when(F.col("_c") == i, F.col("_u"))).alias(f"{c}{suffix}") for i, c in enumerate(columns)])
    return rows.join(by_row, "_row", "left").select(*df.columns, *[f"{c}{suffix}" for c in columns])
