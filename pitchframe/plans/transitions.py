"""Transition table of the pitch data, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.functions.categories import OUTCOME_CLASSES, collapse
from pitchframe.operators.shape import as_of
from pitchframe.operators.state import fit_transitions
from pitchframe.plans.features import FIRST_SEASON_AFTER

LAST_INNING = 9
HALF_INNING = ["game_pk", "inning", "inning_topbot"]


def transition_table(pitches: DataFrame) -> DataFrame:
    """Distribution of base/out states after each outcome class, extra and ninth innings left out.

    Columns outcome, stand, outs, on_1b to on_3b, after_outs, after_1b to
    after_3b, runs_scored, n and p.
    """
    rows = as_of(pitches, year="game_year", after_year=FIRST_SEASON_AFTER).where(F.col("inning") < LAST_INNING)
    rows = rows.select(
        *HALF_INNING,
        "game_date",
        "at_bat_number",
        "pitch_number",
        "outs_when_up",
        (F.col("post_bat_score") - F.col("bat_score")).alias("runs_scored"),
        "stand",
        collapse("events", OUTCOME_CLASSES).alias("simplified_outcome"),
        "batter",
        "on_1b",
        "on_2b",
        "on_3b",
    )
    return fit_transitions(rows, HALF_INNING, ["game_date", "at_bat_number", "pitch_number"])
