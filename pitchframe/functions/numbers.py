"""Geometry, odds, safe logarithms, casts and row-wise means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def spray_angle(x: Column | str, y: Column | str) -> Column:
    """Whole degrees between the first-base line of sight and a hit at ``(x, y)``.

    130 and 213 are the picture coordinates of home plate; half degrees round
    away from zero.
    """
    angle = F.atan2(_column(x).cast("double") - 130.0, F.lit(213.0) - _column(y).cast("double"))
    return F.round(-F.degrees(angle) + 90.0, 0)


def implied_probability(odds: Column | str) -> Column:
    """American odds text such as ``+150`` or ``-150`` as a probability with 4 decimals.

    Text that is not a number gives NULL.
    """
    number = F.replace(_column(odds), F.lit("+"), F.lit("")).try_cast("double")
    positive = F.try_divide(F.lit(1.0), number / 100.0 + 1.0)
    negative = F.lit(1.0) - F.try_divide(F.lit(1.0), -number / 100.0 + 1.0)
    return F.bround(F.when(number > 0, positive).otherwise(negative), 4)


def american_odds(probability: Column | str) -> Column:
    """American odds of a probability, halves to even; NULL outside the open interval (0, 1)."""
    p = _column(probability)
    favourite = -F.try_divide(p, F.lit(1.0) - p) * 100.0
    underdog = F.try_divide(F.lit(100.0), p) - 100.0
    value = F.when(p > 0.5, favourite).otherwise(underdog)
    return F.when((p > 0) & (p < 1), F.bround(value, 0).cast("long"))


def is_priceable(probability: Column | str) -> Column:
    p = _column(probability)
    return F.coalesce((p > 0) & (p < 1), F.lit(False))


def safe_log(probability: Column | str, epsilon: float = 1e-10) -> Column:
    return F.log(_column(probability) + F.lit(epsilon))


def to_number(column: Column | str, kind: str = "double") -> Column:
    """Text as a number; NULL where it is not one."""
    return _column(column).try_cast(kind)


def row_mean(columns: Sequence[str], default: float = 0.0) -> Column:
    """Mean over the columns of one row, skipping NULL; ``default`` when all are NULL."""
    values = [F.col(c).cast("double") for c in columns]
    total, present = F.lit(0.0), F.lit(0)
    for value in values:
        total = total + F.coalesce(value, F.lit(0.0))
        present = present + value.isNotNull().cast("int")
    return F.coalesce(F.try_divide(total, present), F.lit(default))


def settled(column: Column, digits: int) -> Column:
    """Rounded after a nudge of 1e-9, so exact halves do not depend on summation order."""
    return F.round(column + F.lit(1e-9), digits)


def plain(column: Column, digits: int = 6) -> Column:
    """Rounded, with negative zero turned into zero."""
    return F.round(column, digits) + F.lit(0.0)
