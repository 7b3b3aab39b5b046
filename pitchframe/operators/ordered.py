"""Ordered operators that stay parallel when one group is huge.

A plain window sends a whole group to one task. Here a *large* group, one of
more than ``rows_per_task`` rows, is cut into consecutive segments: its rows are
range-partitioned by the keys and **all** order columns, and each partition's
part of a group is a segment. Borders are quantiles of full order tuples that
Spark samples, so neither bunched values, common prefixes nor few distinct values
of the first column fill one task; only rows that agree in every order column
stay together. The partitioned rows are written once below the shared folder, so
every later step, and every recomputed task, sees the same segments.

The window runs per segment, and what crosses a segment border (row offsets,
running totals, neighbouring rows) comes from a summary with one row per segment,
joined on the segment. Groups within the limit take the plain window. One
counting pass over the keys runs when the operator is built; a caller that knows
its groups to be small says ``bounded=True`` and skips it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.session import shared_dir

ROWS_PER_TASK = 1_000_000


def sort_columns(order: Sequence[str], *, reverse: bool = False) -> list[Column]:
    """Sort expressions for names; a leading ``-`` means descending."""
    out = []
    for item in order:
        descending = item.startswith("-")
        column = F.col(item.lstrip("-"))
        out.append(column.desc_nulls_last() if descending != reverse else column.asc_nulls_first())
    return out


class Ordered:
    """Collects ordered expressions over one ``(keys, order)`` and builds them in one pass."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        *,
        rows_per_task: int | None = None,
        bounded: bool = False,
        measure: DataFrame | None = None,
    ):
        """``measure`` may name a cheaper frame to count groups in.

        It needs the keys and at least as many rows per group, such as the rows
        that ``df`` was grouped from. ``bounded`` states that no group exceeds
        the limit.
        """
        self.measure = measure
        self.df, self.keys, self.order = df, list(keys), list(order)
        self.rows_per_task = ROWS_PER_TASK if rows_per_task is None else rows_per_task
        self._known: tuple[DataFrame, int] | None | bool = None if bounded else False
        self._numbers: list[str] = []
        self._sizes: list[str] = []
        self._shifts: list[tuple[str, str, int, object]] = []
        self._running: list[tuple[str, str, str]] = []
        self._values: dict[str, Column] = {}

    def again(self, df: DataFrame) -> Ordered:
        """The same keys and order over the same rows with more columns, after :meth:`build`.

        The large groups are known by then and are not counted again.
        """
        other = Ordered(df, self.keys, self.order, rows_per_task=self.rows_per_task)
        other._known = self._known
        return other

    def _value(self, column: Column | str) -> str:
        name = f"__v{len(self._values)}"
        self._values[name] = F.col(column) if isinstance(column, str) else column
        return name

    def row_number(self, out: str) -> Ordered:
        self._numbers.append(out)
        return self

    def size(self, out: str) -> Ordered:
        """Rows of the whole group."""
        self._sizes.append(out)
        return self

    def lag(self, out: str, column: Column | str, offset: int = 1, default: object = None) -> Ordered:
        self._shifts.append((out, self._value(column), offset, default))
        return self

    def lead(self, out: str, column: Column | str, offset: int = 1, default: object = None) -> Ordered:
        self._shifts.append((out, self._value(column), -offset, default))
        return self

    def running_sum(self, out: str, column: Column | str) -> Ordered:
        self._running.append((out, self._value(column), "sum"))
        return self

    def running_max(self, out: str, column: Column | str) -> Ordered:
        self._running.append((out, self._value(column), "max"))
        return self

    # -- large groups -------------------------------------------------------

    def _large(self) -> tuple[DataFrame, int] | None:
        """The keys of the groups above the limit, as a written table, and the number of segments for their rows."""
        source = self.df if self.measure is None else self.measure
        counts = source.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > self.rows_per_task)
        if self.keys:
            counts = written(counts, "large-groups")
        total = counts.agg(F.sum("__n")).first()[0]
        if not total:
            return None
        return counts.select(*self.keys), math.ceil(total / self.rows_per_task) + 1

    def _segments(self, rows: DataFrame, parts: int) -> DataFrame:
        """``rows`` with the number of the range they fall into, written once."""
        along = [F.col(k).asc_nulls_first() for k in self.keys] + sort_columns(self.order)
        dealt = rows.repartitionByRange(parts, *along)
        return written(dealt.withColumn("__seg", F.spark_partition_id()), "segments")

    def _summary(self, rows: DataFrame, depth: int, ahead: int) -> DataFrame:
        """One row per segment with everything that crosses its border."""
        place = [*self.keys, "__seg"]
        hot = rows
        aggregates = [F.count(F.lit(1)).alias("__rows")]
        for i, (_, value, kind) in enumerate(self._running):
            aggregates.append(getattr(F, kind)(value).alias(f"__r{i}"))
        summary = hot.groupBy(*place).agg(*aggregates)
        for side, count, reverse in (("__tail", depth, True), ("__head", ahead, False)):
            if count:
                edge = Window.partitionBy(*place).orderBy(*sort_columns(self.order, reverse=reverse))
                number = -F.col("__e") if reverse else F.col("__e")
                ends = (
                    hot.withColumn("__e", F.row_number().over(edge))
                    .where(F.col("__e") <= count)
                    .groupBy(*place)
                    .agg(
                        F.transform(
                            F.sort_array(F.collect_list(F.struct(number.alias("__o"), F.struct(*self._values).alias("__s")))),
                            lambda e: e["__s"],
                        ).alias(side)
                    )
                )
                summary = _left_join(summary, ends, place)
        along = Window.partitionBy(*self.keys).orderBy("__seg")
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        columns = {
            "__before": F.coalesce(F.sum("__rows").over(before), F.lit(0)),
            "__all": F.sum("__rows").over(Window.partitionBy(*self.keys)),
        }
        for i, (_, _, kind) in enumerate(self._running):
            columns[f"__c{i}"] = getattr(F, kind)(f"__r{i}").over(before)
        if depth:
            parts = [
                F.coalesce(F.lag("__tail", k).over(along), F.slice("__tail", 1, 0)) for k in range(depth, 0, -1)
            ]
            columns["__past"] = F.concat(*parts)
        if ahead:
            parts = [
                F.coalesce(F.lead("__head", k).over(along), F.slice("__head", 1, 0)) for k in range(1, ahead + 1)
            ]
            columns["__future"] = F.concat(*parts)
        return summary.withColumns(columns).select(*place, *columns, "__rows")

    def build(self) -> DataFrame:
        rows = self.df.withColumns(self._values) if self._values else self.df
        if self._known is False:
            self._known = self._large()
        if self._known is None:
            return self._build_plain(rows)
        large, parts = self._known
        if not self.keys:
            return self._build_split(self._segments(rows, parts))
        marked = _left_join(rows, large.withColumn("__large", F.lit(True)), self.keys)
        split = self._build_split(self._segments(marked.where("__large").drop("__large"), parts))
        return split.unionByName(self._build_plain(marked.where("__large IS NULL").drop("__large")))

    def _build_plain(self, rows: DataFrame) -> DataFrame:
        inner = Window.partitionBy(*self.keys).orderBy(*sort_columns(self.order))
        so_far = inner.rowsBetween(Window.unboundedPreceding, 0)
        out = {name: F.row_number().over(inner).cast("long") for name in self._numbers}
        for name in self._sizes:
            out[name] = F.count(F.lit(1)).over(Window.partitionBy(*self.keys))
        for name, value, offset, default in self._shifts:
            shifted = F.lag(value, offset, default) if offset > 0 else F.lead(value, -offset, default)
            out[name] = shifted.over(inner)
        for name, value, kind in self._running:
            out[name] = getattr(F, kind)(value).over(so_far)
        return rows.withColumns(out).select(*self.df.columns, *out)

    def _build_split(self, rows: DataFrame) -> DataFrame:
        depth = max([o for _, _, o, _ in self._shifts if o > 0], default=0)
        ahead = max([-o for _, _, o, _ in self._shifts if o < 0], default=0)
        place = [*self.keys, "__seg"]
        carried = _left_join(rows, self._summary(rows, depth, ahead), place)

        inner = Window.partitionBy(*place).orderBy(*sort_columns(self.order))
        so_far = inner.rowsBetween(Window.unboundedPreceding, 0)
        part = Window.partitionBy(*place)
        windows: dict[str, Column] = {"__rn": F.row_number().over(inner)}
        for i, (_, value, offset, _) in enumerate(self._shifts):
            shifted = F.lag(value, offset) if offset > 0 else F.lead(value, -offset)
            windows[f"__s{i}"] = shifted.over(inner)
        for i, (_, value, kind) in enumerate(self._running):
            windows[f"__w{i}"] = getattr(F, kind)(value).over(so_far)
        if self._sizes or ahead:
            windows["__size"] = F.count(F.lit(1)).over(part)
        out = carried.withColumns(windows)

        final: dict[str, Column] = {}
        for name in self._numbers:
            final[name] = (F.col("__rn") + F.coalesce(F.col("__before"), F.lit(0))).cast("long")
        for name in self._sizes:
            final[name] = F.coalesce(F.col("__all"), F.col("__size"))
        for i, (name, value, offset, default) in enumerate(self._shifts):
            if offset > 0:
                outside = F.col("__rn") <= offset
                index = F.col("__rn") - offset - 1
                edge = F.try_element_at("__past", index.cast("int"))
            else:
                outside = F.col("__rn") - offset > F.col("__size")
                index = F.col("__rn") - offset - F.col("__size")
                edge = F.try_element_at("__future", index.cast("int"))
            crossing = F.when(edge.isNull(), F.lit(default)).otherwise(edge[value])
            final[name] = F.when(outside, crossing).otherwise(F.col(f"__s{i}"))
        for i, (name, _, kind) in enumerate(self._running):
            here, carry = F.col(f"__w{i}"), F.col(f"__c{i}")
            both = here + carry if kind == "sum" else F.greatest(here, carry)
            final[name] = F.coalesce(both, here, carry)
        return out.withColumns(final).select(*self.df.columns, *final)


def _left_join(rows: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that keeps NULL keys."""
    renamed = side.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    condition = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"__key_{k}"))
        condition = test if condition is None else condition & test
    return rows.join(renamed, condition, "left").drop(*[f"__key_{k}" for k in keys])


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written below the shared folder and read back."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key.

    The rank filter is pushed below the shuffle as a group limit (for ``n`` up
    to 1000), so a task sends at most ``n`` rows per key.
    """
    window = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    return df.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= n).drop("__rank")
