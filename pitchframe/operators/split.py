"""Ordered train and test splits and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.operators.ordered import Ordered


def ordered_split(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], test_size: float, out: str = "is_train"
) -> DataFrame:
    """Marks the earlier rows of each group (or of the whole table) as training rows.

    The test part has ``ceil(rows * test_size)`` rows. ``order`` should be a
    total order.
    """
    placed = Ordered(df, keys, order).row_number("_rn").size("_n").build()
    test_rows = F.ceil(F.col("_n") * F.lit(float(test_size)))
    return placed.withColumn(out, F.col("_rn") <= F.col("_n") - test_rows).drop("_rn", "_n")


def contiguous_folds(df: DataFrame, order: Sequence[str], folds: int, out: str = "fold") -> DataFrame:
    """Consecutive folds over the whole table; the first ones take the remainder."""
    placed = Ordered(df, [], order).row_number("_rn").size("_n").build()
    base, extra = F.floor(F.col("_n") / folds), F.col("_n") % folds
    at = F.col("_rn") - 1
    early = F.floor(F.try_divide(at, base + 1))
    late = extra + F.floor(F.try_divide(at - extra * (base + 1), base))
    fold = F.when(at < extra * (base + 1), early).otherwise(late)
    return placed.withColumn(out, fold.cast("int")).drop("_rn", "_n")
