"""Scores to probabilities and prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.functions.numbers import american_odds
from pitchframe.operators.aggregate import probability
from pitchframe.operators.shape import closest_row


def game_totals(scores: DataFrame, game: Sequence[str], side: str, runs: str) -> DataFrame:
    """Long scores (game, side ``home``/``away``, inning, runs) as one row per game."""
    of = lambda s: F.sum(F.when(F.col(side) == s, F.col(runs)).otherwise(0)).cast("long")
    return with_flags(scores.groupBy(*game).agg(of("home").alias("home"), of("away").alias("away")))


def with_flags(games: DataFrame) -> DataFrame:
    """Total, strict wins and covers (ties count) of both sides."""
    return games.withColumns(
        {
            "total": F.col("home") + F.col("away"),
            "home_wins": F.col("home") > F.col("away"),
            "away_wins": F.col("away") > F.col("home"),
            "home_covers": F.col("home") >= F.col("away"),
            "away_covers": F.col("away") >= F.col("home"),
        }
    )


def totals_ladder(games: DataFrame, lines: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Over and under probability and price for each line.

    All lines are counted in one aggregation and unpivoted afterwards; the game
    rows are not multiplied by the lines.
    """
    aggregates, rows = [], []
    for i, line in enumerate(lines):
        aggregates += [
            probability(F.col("total") > line).alias(f"o{i}"),
            probability(F.col("total") < line).alias(f"u{i}"),
        ]
        rows.append(F.struct(F.lit(float(line)).alias("line"), F.col(f"o{i}").alias("p_over"), F.col(f"u{i}").alias("p_under")))
    ladder = games.groupBy(*by).agg(*aggregates).select(*by, F.inline(F.array(*rows)))
    return ladder.withColumns({"odds_over": american_odds("p_over"), "odds_under": american_odds("p_under")})


def spread_market(games: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Minus and plus half-run lines of both sides with prices."""
    wide = games.groupBy(*by).agg(
        *[probability(F.col(c)).alias(c) for c in ("home_wins", "away_wins", "home_covers", "away_covers")]
    )
    rows = [
        F.struct(F.lit(0).alias("position"), F.lit("-0.5").alias("market"), F.col("home_wins").alias("home_p"), F.col("away_wins").alias("away_p")),
        F.struct(F.lit(1).alias("position"), F.lit("+0.5").alias("market"), F.col("home_covers").alias("home_p"), F.col("away_covers").alias("away_p")),
    ]
    market = wide.select(*by, F.inline(F.array(*rows)))
    return market.withColumns({"home_odds": american_odds("home_p"), "away_odds": american_odds("away_p")})


def fair_total(ladder: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The line whose over probability is closest to one half, the lower line on ties."""
    return closest_row(ladder, by, F.col("p_over"), 0.5, F.col("line"))


def fair_spread(market: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The row closest to even for each side; one row when both sides agree."""
    home = closest_row(market, by, F.col("home_p"), 0.5, F.col("position"))
    away = closest_row(market, by, F.col("away_p"), 0.5, F.col("position"))
    return home.unionByName(away).dropDuplicates([*by, "position"])
