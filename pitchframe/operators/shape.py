"""Filters, projections, set operations and row selection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchframe.operators import ordered
from pitchframe.operators.ordered import Ordered, sort_columns, top_rows


# -- filters ----------------------------------------------------------------


def require_all(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where every listed column is present."""
    return df.dropna(how="any", subset=list(columns))


def exclude(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """Rows whose value is present and not listed."""
    source = F.col(column)
    return df.where(source.isNotNull() & ~source.isin(*values))


def as_of(
    df: DataFrame,
    *,
    date: str | None = None,
    until: str | None = None,
    year: str | None = None,
    before_year: int | None = None,
    after_year: int | None = None,
) -> DataFrame:
    """Back-test cut-off: dates up to and including ``until``, years strictly between the bounds.

    The tests are plain comparisons with literals, so they prune partitions and
    reach the Parquet scan.
    """
    if until is not None:
        kind = df.schema[date].dataType
        df = df.where(F.col(date) <= F.lit(until).cast(kind))
    if before_year is not None:
        df = df.where(F.col(year) < before_year)
    if after_year is not None:
        df = df.where(F.col(year) > after_year)
    return df


def in_ranges(
    df: DataFrame, ranges: Mapping[str, tuple[float, float]], equals: Mapping[str, object] | None = None
) -> DataFrame:
    """Rows inside every closed range and equal to every given value."""
    for column, (low, high) in ranges.items():
        df = df.where(F.col(column).between(low, high))
    for column, value in (equals or {}).items():
        df = df.where(F.col(column) == value)
    return df


def distinct_on_day(df: DataFrame, timestamp: str, day: str, columns: Sequence[str]) -> DataFrame:
    """Distinct values of the columns on one calendar day.

    The day is a half-open range over the raw column, which can be pushed to
    the scan; ``to_date(column)`` could not.
    """
    kind = df.schema[timestamp].dataType
    start = F.lit(day).cast(kind)
    end = F.date_add(F.lit(day).cast("date"), 1).cast(kind)
    return df.where((F.col(timestamp) >= start) & (F.col(timestamp) < end)).select(*columns).distinct()


def members(df: DataFrame, column: str, values: Iterable[object]) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def drop_sentinel(df: DataFrame, column: str, sentinel: str = "None") -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != sentinel))


# -- projections ------------------------------------------------------------


def reshape(
    df: DataFrame,
    *,
    drop: Sequence[str] = (),
    rename: Mapping[str, str] | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Drop, rename and order columns; names that do not exist are ignored."""
    df = df.drop(*drop).withColumnsRenamed(dict(rename or {}))
    if keep is not None:
        df = df.select(*[c for c in keep if c in df.columns])
    return df


def add_suffix(df: DataFrame, suffix: str, *, except_for: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c not in except_for})


def columns_by_type(df: DataFrame) -> dict[str, list[str]]:
    """Column names split into ``numeric``, ``text`` and ``other``."""
    out: dict[str, list[str]] = {"numeric": [], "text": [], "other": []}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.NumericType):
            out["numeric"].append(field.name)
        elif isinstance(field.dataType, T.StringType):
            out["text"].append(field.name)
        else:
            out["other"].append(field.name)
    return out


def columns_from(df: DataFrame, text: str, count: int = 3) -> list[str]:
    """The first column whose name holds ``text`` and the columns after it, ``count`` in all."""
    for i, name in enumerate(df.columns):
        if text in name:
            return df.columns[i : i + count]
    return []


def same_everywhere(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per pair: are the two columns equal in every row (NULL equals NULL)?

    All pairs are tested in one scan and unpivoted from the single result row.
    """
    tests = [F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"t{i}") for i, (a, b) in enumerate(pairs)]
    rows = [
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"t{i}").alias("same"))
        for i, (a, b) in enumerate(pairs)
    ]
    return df.agg(*tests).select(F.inline(F.array(*rows)))


# -- sort and limit ---------------------------------------------------------


def sort_by(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Total sort; a leading ``-`` sorts that column descending."""
    return df.orderBy(*sort_columns(order))


def latest_distinct(
    df: DataFrame, entity: Sequence[str], columns: Sequence[str], order: Sequence[str], n: int = 1000
) -> DataFrame:
    """Distinct values among the first ``n`` rows of each entity in the given order."""
    needed = list(dict.fromkeys([*entity, *columns, *[o.lstrip("-") for o in order]]))
    return top_rows(df.select(*needed), entity, order, n).select(*entity, *columns).distinct()


def bounded_cohort(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in a total order.

    A table beyond one task's rows is cut first: its rows are counted by the
    first order column, and only rows up to the value that completes ``n`` are
    sorted. So about ``n`` rows meet in the last task, not ``n`` from every task.
    """
    if df.count() <= ordered.ROWS_PER_TASK:
        return df.orderBy(*sort_columns(order)).limit(n)
    name, descending = order[0].lstrip("-"), order[0].startswith("-")
    counts = df.groupBy(F.col(name).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    along = ["-_value"] if descending else ["_value"]
    running = Ordered(counts, [], along).running_sum("_upto", "_n").build().where(F.col("_upto") - F.col("_n") < n)
    last = F.min("_value") if descending else F.max("_value")
    cut = running.agg(F.struct(last.alias("last"), F.max(F.col("_value").isNull()).alias("nulls"))).scalar()
    near = df.withColumn("_cut", cut)
    inside = F.col(name) >= F.col("_cut.last") if descending else F.col(name) <= F.col("_cut.last")
    near = near.where(F.when(F.col(name).isNull(), F.col("_cut.nulls")).otherwise(inside)).drop("_cut")
    return near.orderBy(*sort_columns(order)).limit(n)


def closest_row(df: DataFrame, keys: Sequence[str], value: Column, target: float, position: Column) -> DataFrame:
    """Per key the row whose value is closest to the target, the lowest position on ties."""
    ranked = df.withColumn("_key", F.struct(F.abs(value - F.lit(target)).alias("d"), position.alias("p"))).where(
        value.isNotNull()
    )
    rest = [c for c in df.columns if c not in keys]
    picked = ranked.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("_key")).alias("_row"))
    return picked.select(*keys, "_row.*")


# -- set operations ---------------------------------------------------------


def stack_rows(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def side_by_side(left: DataFrame, right: DataFrame, row_id: Sequence[str]) -> DataFrame:
    """Columns of two frames that carry the same row id."""
    return left.join(right, list(row_id), "inner")


def label_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Labels present on one side only, with the side that lacks them.

    Both label sets are reduced in one shuffle, instead of two anti joins.
    """
    tagged = left.select(column, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(column, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    sides = tagged.groupBy(column).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return sides.where(F.col("_l") != F.col("_r")).select(
        column, F.when(F.col("_l") == 1, "right").otherwise("left").alias("missing_in")
    )


def domain_product(spark, domains: Mapping[str, Sequence[object]]) -> DataFrame:
    """Every combination of small literal domains, by exploding literal arrays of one row."""
    df = spark.range(1)
    for name, values in domains.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df.drop("id")


def reindex_counts(
    counts: DataFrame, categories: DataFrame, keys: Sequence[str], value: str, fill: object = 0
) -> DataFrame:
    """The counts on exactly the given categories; a category without a count gets ``fill``."""
    return categories.select(*keys).join(counts.select(*keys, value), list(keys), "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(fill))
    )
