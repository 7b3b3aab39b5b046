"""Grouped statistics. Every aggregate here has a map-side partial form."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach(left: DataFrame, grouped: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group columns back on keys where NULL is a group of its own."""
    side = grouped.withColumnsRenamed({k: f"_group_{k}" for k in keys})
    condition = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_group_{k}"))
        condition = test if condition is None else condition & test
    return left.join(side, condition, how).drop(*[f"_group_{k}" for k in keys])


def group_means(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], *, digits: int | None = None, complete: bool = True
) -> DataFrame:
    """Mean of the columns per group; ``complete`` uses only rows where all of them are present."""
    if complete:
        df = df.dropna(how="any", subset=list(columns))
    means = {c: F.avg(F.col(c).cast("double")) for c in columns}
    if digits is not None:
        means = {c: F.round(m, digits) for c, m in means.items()}
    return df.groupBy(*keys).agg(*[m.alias(c) for c, m in means.items()])


def keep_large_groups(df: DataFrame, keys: Sequence[str], minimum: int, when: Column | None = None) -> DataFrame:
    """Rows of groups with at least ``minimum`` rows (or rows that meet ``when``)."""
    count = F.count(F.lit(1)) if when is None else F.count_if(when)
    large = df.groupBy(*keys).agg(count.alias("_n")).where(F.col("_n") >= minimum)
    return df.join(large.select(*keys), list(keys), "left_semi")


def rate_percent(test: Column) -> Column:
    """Share of rows that meet the test, in percent; an unknown test counts as not met."""
    return F.avg(F.when(test, 100.0).otherwise(0.0))


def probability(test: Column) -> Column:
    return F.avg(F.when(test, 1.0).otherwise(0.0))


def pivot_values(
    df: DataFrame, index: Sequence[str], column: str, value: str, values: Sequence[str], prefix: str = "", fill: float = 0.0
) -> DataFrame:
    """Long to wide for a given value list: one aggregation, no extra job to find the values."""
    cells = [
        F.coalesce(F.max(F.when(F.col(column) == v, F.col(value))), F.lit(fill)).alias(f"{prefix}{v}") for v in values
    ]
    return df.groupBy(*index).agg(*cells)


def frequencies(df: DataFrame, keys: Sequence[str], *, share: str = "share", count: str = "n") -> DataFrame:
    """Row count per value and its share of all rows; the total is a scalar subquery."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(share, F.try_divide(F.col(count).cast("double"), total))


def conditional_distribution(
    df: DataFrame, given: Sequence[str], outcome: Sequence[str], *, count: str = "n", share: str = "p"
) -> DataFrame:
    """Count and probability of each outcome within each condition.

    Rows are reduced to one per (condition, outcome) before a window takes the
    totals, so a hot condition costs one row per distinct outcome. NULL is a
    value of its own on both sides.
    """
    counts = df.groupBy(*given, *outcome).agg(F.count(F.lit(1)).alias(count))
    total = F.sum(count).over(Window.partitionBy(*given))
    return counts.withColumn(share, F.col(count).cast("double") / total).select(*given, *outcome, count, share)


def distribution_map(df: DataFrame, given: Sequence[str], outcome: str, share: str, out: str = "distribution") -> DataFrame:
    """One row per condition with a map outcome -> probability.

    For distributions over a small outcome domain; the long form is the stored one.
    """
    entry = F.struct(F.col(outcome), F.col(share))
    return df.groupBy(*given).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(out))


def describe_moments(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation per group as ``<column>_mean`` and ``<column>_std``."""
    out = []
    for c in columns:
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(*keys).agg(*out)


def pair_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation and sample covariance of every column pair, from one scan."""
    pairs = list(combinations(columns, 2)) + [(c, c) for c in columns]
    aggregates = []
    for i, (a, b) in enumerate(pairs):
        aggregates += [F.corr(a, b).alias(f"r{i}"), F.covar_samp(a, b).alias(f"c{i}")]
    rows = [
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("correlation"), F.col(f"c{i}").alias("covariance")
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def all_null_share(df: DataFrame, columns: Sequence[str], out: str = "share") -> DataFrame:
    """Share of rows where all listed columns are NULL."""
    test = None
    for c in columns:
        test = F.col(c).isNull() if test is None else test & F.col(c).isNull()
    return df.agg(probability(test).alias(out))


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, non-NULL count and NULL count, from one scan."""
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    rows = []
    for i, field in enumerate(df.schema.fields):
        aggregates.append(F.count(F.col(f"`{field.name}`")).alias(f"n{i}"))
        rows.append(
            F.struct(
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.col(f"n{i}").alias("present"),
                (F.col("_rows") - F.col(f"n{i}")).alias("missing"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))
