"""Category collapse, flags and row-dependent column choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# At-bat event -> outcome class.
OUTCOME_CLASSES = {
    "single": ["single"],
    "double": ["double"],
    "triple": ["triple"],
    "home_run": ["home_run"],
    "field_out": ["field_out"],
    "ground_out": ["ground_out", "force_out"],
    "fly_out": ["fly_out", "sac_fly"],
    "double_play": ["double_play", "grounded_into_double_play", "sac_fly_double_play"],
    "triple_play": ["triple_play"],
    "fielding_error": ["field_error"],
    "fielders_choice": ["fielders_choice"],
}

# Pitch description -> pitch outcome class.
PITCH_CLASSES = {
    "strike": ["swinging_strike", "swinging_strike_blocked", "called_strike", "foul_tip", "swinging_pitchout"],
    "foul": ["foul", "foul_pitchout"],
    "ball": ["ball", "blocked_ball", "pitchout"],
    "hit_by_pitch": ["hit_by_pitch"],
    "hit_into_play": ["hit_into_play"],
}


def collapse(column: Column | str, classes: Mapping[str, Sequence[str]]) -> Column:
    """The class that lists the value; NULL for a value no class lists."""
    source = F.col(column) if isinstance(column, str) else column
    out = F.lit(None).cast("string")
    for name, members in reversed(classes.items()):
        out = F.when(source.isin(*members), F.lit(name)).otherwise(out)
    return out


def has_class(column: Column | str, classes: Mapping[str, Sequence[str]]) -> Column:
    """Whether some class lists the value; a plain IN list, which reaches the scan."""
    source = F.col(column) if isinstance(column, str) else column
    return source.isin(*[m for members in classes.values() for m in members])


def presence(column: Column | str) -> Column:
    """1 when the value is there, else 0."""
    source = F.col(column) if isinstance(column, str) else column
    return source.isNotNull().cast("int")


def sign_bucket(column: Column) -> Column:
    """1, 0 or -1. NULL counts as -1, like a CASE with an ELSE branch."""
    return F.when(column > 0, 1).when(column == 0, 0).otherwise(-1)


def choose(test: Column, yes: Column | str, no: Column | str) -> Column:
    """``yes`` where the test holds; a NULL test takes ``no``."""
    first = F.col(yes) if isinstance(yes, str) else yes
    second = F.col(no) if isinstance(no, str) else no
    return F.when(test, first).otherwise(second)


def null_if_text(column: Column | str, sentinel: str = "None") -> Column:
    source = F.col(column) if isinstance(column, str) else column
    return F.when(source != sentinel, source)


def override(column: Column, key: Column, patches: Mapping[str, object]) -> Column:
    """Replace the value for the listed keys only."""
    out = column
    for name, value in patches.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out
