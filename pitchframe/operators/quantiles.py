"""Exact quantiles, histograms and summaries from distinct-value counts.

The built-in exact percentile keeps all distinct values of a group in one
buffer. Here values are counted first and a running count (which splits hot
groups) gives every position, so no task holds a whole column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.operators import ordered
from pitchframe.operators.ordered import Ordered


def long_values(df: DataFrame, columns: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """(group, column, value) rows of several numeric columns, NULL values left out."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return df.select(*within, F.inline(cells)).where(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct value of each column: (group, column, value, ties)."""
    cells = long_values(df, columns, within).withColumn("value", F.col("value") + F.lit(0.0))
    return cells.groupBy(*within, "column", "value").agg(F.count(F.lit(1)).alias("ties"))


def positions(df: DataFrame, columns: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their first and last zero-based position in the sorted column.

    No column of a group has more distinct values than the table has rows, so
    the groups are counted only if the table exceeds one task's rows.
    """
    keys = [*within, "column"]
    few = df.count() <= ordered.ROWS_PER_TASK
    measure = None if few else long_values(df, columns, within)
    order = Ordered(value_counts(df, columns, within), keys, ["value"], measure=measure, bounded=few).running_sum("_upto", "ties").build()
    return order.select(
        *keys, "value", "ties", (F.col("_upto") - F.col("ties")).alias("first"), (F.col("_upto") - 1).alias("last")
    )


def per_column(table: DataFrame, value: str) -> Column:
    """The value that a table with one row per listed column holds for ``column``.

    Read as one scalar map, so a frame over a single column needs no join.
    """
    entries = F.collect_list(F.struct("column", value))
    return F.try_element_at(table.agg(F.map_from_entries(entries)).scalar(), F.col("column"))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], within: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolation quantiles as rows (group, column, p, quantile)."""
    keys = [*within, "column"]
    placed = positions(df, columns, within)
    sizes = placed.groupBy(*keys).agg(F.sum("ties").alias("_n"))
    wanted = sizes.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    place = F.col("p") * (F.col("_n") - 1)
    wanted = wanted.withColumns({"_low": F.floor(place), "_high": F.ceil(place), "_part": place - F.floor(place)})
    # One struct per group, as long as the probability list, instead of one join row per value and p.
    plan = wanted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("p", "_low", "_high", "_part"))).alias("_plan"))
    hit = F.filter(
        "_plan",
        lambda w: ((w["_low"] >= F.col("first")) & (w["_low"] <= F.col("last")))
        | ((w["_high"] >= F.col("first")) & (w["_high"] <= F.col("last"))),
    )
    rows = (
        (placed.join(plan, keys) if within else placed.withColumn("_plan", per_column(plan, "_plan")))
        .withColumn("_hit", hit)
        .where(F.size("_hit") > 0)
        .select(*keys, "value", "first", "last", F.inline("_hit"))
    )
    inside = lambda c: (F.col(c) >= F.col("first")) & (F.col(c) <= F.col("last"))
    ends = rows.groupBy(*keys, "p", "_part").agg(
        F.max(F.when(inside("_low"), F.col("value"))).alias("_a"),
        F.max(F.when(inside("_high"), F.col("value"))).alias("_b"),
    )
    return ends.select(*keys, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("quantile"))


def summarize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum, one row per column.

    Everything follows from the distinct values and their ties: one scan counts
    them, and size and mean of a column are read as scalars.
    """
    counts = value_counts(df, columns)
    weighed = F.sum(F.col("value") * F.col("ties")) / F.sum("ties")
    whole = per_column(counts.groupBy("column").agg(F.struct(F.sum("ties").alias("n"), weighed.alias("mean")).alias("_all")), "_all")
    placed = positions(df, columns).withColumn("_all", whole).select("*", "_all.n", "_all.mean")
    squares = F.sum(F.col("ties") * F.pow(F.col("value") - F.col("mean"), 2))
    parts = {"count": F.max("n"), "mean": F.max("mean"), "_squares": squares, "min": F.min("value"), "max": F.max("value")}
    for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        place = F.col("n").cast("double") * p - p
        for end, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            parts[f"{name}_{end}"] = F.max(F.when(at.between(F.col("first"), F.col("last")), F.col("value")))
        parts[f"{name}_part"] = F.max(place - F.floor(place))
    wide = placed.groupBy("column").agg(*[v.alias(k) for k, v in parts.items()])
    quarter = lambda q: (F.col(f"{q}_low") + (F.col(f"{q}_high") - F.col(f"{q}_low")) * F.col(f"{q}_part")).alias(q)
    std = F.sqrt(F.try_divide(F.col("_squares"), F.nullif(F.col("count") - 1, F.lit(0)))).alias("std")
    return wide.select("column", "count", "mean", std, "min", quarter("q25"), quarter("q50"), quarter("q75"), "max")


def quantiles_at(df: DataFrame, columns: Sequence[str], draws: DataFrame, u: str = "u") -> DataFrame:
    """Empirical quantile for a row-varying ``u``.

    ``draws`` has the columns ``column`` and ``u``. A draw needs the values at
    two neighbouring positions of the sorted column. Distinct values, each with
    the next larger one, and draws are put in one order by position, and the
    last value before a draw is carried forward to it: one row per distinct
    value and one per draw, however often a value repeats. Draws at one position
    are told apart by their hash, so a long run of them can be split. The value
    is NULL where ``u`` is NULL or outside of [0, 1]; draws for a column without
    values are left out.
    """
    placed = positions(df, columns)
    few = df.count() <= ordered.ROWS_PER_TASK
    measure = None if few else long_values(df, columns)
    nexts = Ordered(placed, ["column"], ["first"], measure=measure, bounded=few).lead("next", "value").build()
    size = per_column(value_counts(df, columns).groupBy("column").agg(F.sum("ties").alias("_n")), "_n")
    here = F.struct("value", "last", "next").alias("_here")
    values = nexts.select("column", F.col("first").alias("_at"), F.lit(0).cast("long").alias("_salt"), here)
    place = F.col(u) * (F.col("_n") - 1)
    known = draws.withColumn("_n", size).where(F.col("_n").isNotNull())
    asked = known.select(
        *draws.columns, F.floor(place).alias("_at"), F.coalesce(F.nullif(F.abs(F.xxhash64(*draws.columns) % 2**40), F.lit(0)), F.lit(1)).alias("_salt"),
        F.lit(None).cast(values.schema["_here"].dataType).alias("_here"), (place - F.floor(place)).alias("_part"), F.lit(True).alias("_asked"),
    )
    both = asked.unionByName(values, allowMissingColumns=True)
    sizes = (measure if measure is not None else values).select("column").unionByName(draws.select("column"))
    carried = Ordered(both, ["column"], ["_at", "_salt"], measure=sizes).running_max("_found", "_here").build()
    low = F.col("_found.value")
    high = F.when(F.col("_at") < F.col("_found.last"), low).otherwise(F.coalesce("_found.next", low))
    value = F.when(F.col(u).between(0, 1), low + (high - low) * F.col("_part"))
    return carried.where("_asked").select(*draws.columns, value.alias("value"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width histogram: bin edges, count, density and cumulative probability.

    The bounds are a scalar subquery and the rest runs on at most ``bins`` rows.
    """
    bounds = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    one = bounds.select(F.struct("lo", "hi")).scalar()
    placed = df.where(F.col(column).isNotNull()).withColumn("_b", one)
    width = (F.col("_b.hi") - F.col("_b.lo")) / F.lit(float(bins))
    at = F.least(F.floor(F.try_divide(F.col(column) - F.col("_b.lo"), width)), F.lit(bins - 1))
    counts = (
        placed.withColumns({"_w": width, "_lo": F.col("_b.lo"), "bin": F.coalesce(at, F.lit(0)).cast("long")})
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.max("_w").alias("_w"), F.max("_lo").alias("_lo"))
    )
    total = counts.agg(F.sum("n")).scalar()
    run = Ordered(counts, [], ["bin"]).running_sum("_upto", "n").build()
    return run.select(
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"),
        "n",
        F.try_divide(F.col("n") / total, F.col("_w")).alias("density"),
        ((F.col("_upto") - F.col("n")) / total).alias("cdf_before"),
        (F.col("_upto") / total).alias("cdf"),
    )


def histogram_quantile(hist: DataFrame, draws: DataFrame, u: str = "u", *, cells: int = 1024) -> DataFrame:
    """For each draw the low edge of the first bin whose cumulative probability exceeds ``u``.

    The unit interval is cut into cells and every bin is listed under the cells
    it touches, so a draw finds its bin by an equi-join on its cell. The listed
    side has at most ``bins + cells`` rows and is broadcast.
    """
    touched = F.sequence(F.floor(F.col("cdf_before") * cells), F.floor(F.col("cdf") * cells))
    listed = hist.select("cdf_before", "cdf", F.col("low").alias("value"), F.explode(touched).alias("_cell"))
    cell = F.floor(F.col(u) * cells)
    inside = (F.col(u) >= F.col("cdf_before")) & (F.col(u) < F.col("cdf"))
    return draws.join(F.broadcast(listed), (cell == F.col("_cell")) & inside, "left").drop("_cell", "cdf_before", "cdf")
