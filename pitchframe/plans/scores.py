"""Standardised per-entity rates within categories, and the batter tables built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.operators.aggregate import group_means, pivot_values, rate_percent
from pitchframe.operators.shape import as_of, exclude
from pitchframe.operators.standardize import z_scores


def standardized_rates(
    df: DataFrame, entity: str, category: str, measure: Column, minimum: int, *, ddof: int = 0
) -> DataFrame:
    """Long table (entity, category, z) of an aggregate measure for groups with enough rows.

    One shuffle reduces the rows to (entity, category); scoring runs on those.
    Groups without a measure are left out before scoring; a category without
    spread scores 0.
    """
    rates = (
        df.groupBy(entity, category)
        .agg(F.count(F.lit(1)).alias("_n"), measure.alias("_rate"))
        .where((F.col("_n") >= minimum) & F.col("_rate").isNotNull())
    )
    return z_scores(rates, "_rate", [category], ddof=ddof, constant=0.0).select(entity, category, "z")


def wide_scores(
    scores: DataFrame, entity: str, category: str, values: Sequence[str], prefix: str = ""
) -> DataFrame:
    return pivot_values(scores, [entity], category, "z", values, prefix)


def strike_scores(pitches: DataFrame, *, minimum: int = 50, before_year: int | None = None) -> DataFrame:
    """How often each batter takes a strike per pitch type, standardised across batters."""
    rows = exclude(pitches, "pitch_type", ["PO"]).where(F.col("type").isNotNull())
    rows = as_of(rows, year="game_year", before_year=before_year)
    return standardized_rates(rows, "batter", "pitch_type", rate_percent(F.col("type") == "S"), minimum)


def contact_scores(pitches: DataFrame, *, minimum: int = 15, before_year: int | None = None) -> DataFrame:
    """Mean batting value per pitch type of balls in play, standardised across batters."""
    rows = exclude(pitches, "pitch_type", ["PO"]).where(F.col("type") == "X")
    rows = as_of(rows, year="game_year", before_year=before_year)
    return standardized_rates(
        rows, "batter", "pitch_type", F.avg(F.col("woba_value").cast("double")), minimum
    )


def strike_zones(pitches: DataFrame, *, digits: int | None = 3) -> DataFrame:
    """Mean strike-zone edges per batter."""
    return group_means(pitches, ["batter"], ["sz_top", "sz_bot"], digits=digits)


def fielding_scores(table: DataFrame, within: Sequence[str] = ("year",)) -> DataFrame:
    """Team fielding against right- and left-handed batters with sample z-scores per year."""
    renamed = table.withColumnsRenamed(
        {"outs_above_average_rhh": "oaa_rhh", "outs_above_average_lhh": "oaa_lhh"}
    )
    for side in ("oaa_rhh", "oaa_lhh"):
        renamed = z_scores(renamed, side, within, ddof=1, out=f"{side}_standardized")
    return renamed
