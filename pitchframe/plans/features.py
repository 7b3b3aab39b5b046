"""Training sets for all batters, pitchers or venues in one pass.

Every builder takes the pitch table with its usual column names and keeps the
entity and time key next to the features, so one result serves all entities:
filter or split it by the entity column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.functions.categories import OUTCOME_CLASSES, PITCH_CLASSES, choose, collapse, has_class, presence
from pitchframe.functions.numbers import spray_angle
from pitchframe.operators.joins import lookup
from pitchframe.operators.ordered import Ordered, written
from pitchframe.operators.shape import as_of, bounded_cohort, exclude, in_ranges, latest_distinct, require_all
from pitchframe.operators.standardize import fill_with_mean
from pitchframe.plans.scores import wide_scores
from pitchframe.schemas import PITCH_KEY

# Model features and the default cohort.
PITCH_FEATURES = ["release_speed", "release_spin_rate", "plate_x", "plate_z"]
OUTCOME_FEATURES = [*PITCH_FEATURES, "p_throws", "strikes", "balls"]
COHORT_STAND = "R"
COHORT_RANGES = {"sz_top": (3.3, 3.5), "sz_bot": (1.5, 1.7)}
ARSENAL_PITCHES = 1000
COHORT_PITCHES = 25_000
COHORT_HITS = 2_500
FIRST_SEASON_AFTER = 2020


def default_cohort(pitches: DataFrame, limit: int, order: Sequence[str] = PITCH_KEY) -> DataFrame:
    """Pitches to an average right-handed batter, for batters without data."""
    rows = in_ranges(pitches, COHORT_RANGES, {"stand": COHORT_STAND})
    return bounded_cohort(rows, order, limit)


def pitch_outcome_set(pitches: DataFrame, *, until: str | None = None, keep_null_target: bool = False) -> DataFrame:
    """Seven features and the outcome class of every pitch with complete features.

    A description outside the class list has no target; such rows are left out
    unless ``keep_null_target``.
    """
    rows = as_of(require_all(pitches, OUTCOME_FEATURES), date="game_date", until=until)
    if not keep_null_target:
        rows = rows.where(has_class("description", PITCH_CLASSES))
    rows = rows.withColumn("pitch_outcome", collapse("description", PITCH_CLASSES))
    return rows.select("batter", *PITCH_KEY, *OUTCOME_FEATURES, "pitch_outcome")


def training_sets(
    wanted: DataFrame, rows: DataFrame, entity: str, cohort: DataFrame, *, default: object = -1
) -> tuple[DataFrame, DataFrame]:
    """Which rows each wanted entity trains on, and those rows.

    Returns ``(entity, training_set)``, the entity itself or ``default`` where it
    has no rows, and all rows under their ``training_set``: the cohort is there
    once, however many entities fall back to it.
    """
    known = rows.select(F.col(entity).alias("_known")).distinct()
    kind = rows.schema[entity].dataType
    sets = wanted.select(entity).distinct().join(known, F.col(entity) == F.col("_known"), "left")
    sets = sets.select(entity, F.coalesce("_known", F.lit(default).cast(kind)).alias("training_set"))
    own = rows.join(wanted.select(entity).distinct(), entity, "left_semi").withColumn("training_set", F.col(entity))
    return sets, own.unionByName(cohort.withColumn("training_set", F.lit(default).cast(kind)))


def pitch_outcome_training(pitches: DataFrame, batters: DataFrame, *, until: str | None = None, limit: int = COHORT_PITCHES) -> tuple[DataFrame, DataFrame]:
    """Outcome training sets of the given batters; one without pitches takes the default cohort's."""
    complete = as_of(require_all(pitches, OUTCOME_FEATURES), date="game_date", until=until)
    cohort = pitch_outcome_set(default_cohort(complete, limit))
    return training_sets(batters, pitch_outcome_set(pitches, until=until), "batter", cohort)


def hit_characteristic_training(pitches: DataFrame, batters: DataFrame, *, until: str | None = None, limit: int = COHORT_HITS) -> tuple[DataFrame, DataFrame]:
    """Ball-in-play training sets of the given batters; one without any takes the default cohort's."""
    hits = as_of(pitches, date="game_date", until=until).where(F.col("description") == "hit_into_play")
    cohort = hit_characteristic_set(default_cohort(require_all(hits, ["launch_speed", "launch_angle", "hc_x", "hc_y"]), limit))
    return training_sets(batters, hit_characteristic_set(pitches, until=until), "batter", cohort)


def arsenals(pitches: DataFrame, n: int = ARSENAL_PITCHES) -> DataFrame:
    """Pitch types among each pitcher's latest ``n`` pitches outside exhibition games."""
    rows = exclude(exclude(pitches, "pitch_type", ["PO"]), "game_type", ["E", "S"])
    order = ["-game_date", "-game_pk", "-at_bat_number", "-pitch_number"]
    return latest_distinct(rows, ["pitcher"], ["pitch_type"], order, n)


def pitch_sequence_set(
    pitches: DataFrame,
    strikes: DataFrame,
    contact: DataFrame,
    pitch_types: Sequence[str],
    *,
    until: str | None = None,
    arsenal: DataFrame | None = None,
) -> DataFrame:
    """Pitch choice with the previous pitch, the running pitch number and batter scores.

    The arsenal and cut-off filters come first, so the previous pitch and the
    running number skip pitches they remove.
    """
    arsenal = arsenals(pitches) if arsenal is None else arsenal
    rows = as_of(pitches, date="game_date", until=until)
    rows = rows.join(arsenal, ["pitcher", "pitch_type"], "left_semi")
    base = [
        "pitcher", "batter", *PITCH_KEY, "game_year", "pitch_type", "strikes", "balls", "outs_when_up", "stand",
        "on_1b", "on_2b", "on_3b",
    ]
    rows = rows.select(*base).withColumns({b: presence(b) for b in ("on_1b", "on_2b", "on_3b")})
    # At-bats follow each other in a pitcher's game, so one order serves both columns. A pitcher's game is a few hundred rows.
    rows = (
        Ordered(rows, ["game_pk", "pitcher"], ["at_bat_number", "pitch_number"], bounded=True)
        .lag("_pitch", "pitch_type")
        .lag("_at_bat", "at_bat_number")
        .row_number("cumulative_pitch_number")
        .build()
    )
    same_at_bat = F.col("_at_bat") == F.col("at_bat_number")
    rows = rows.withColumn("prev_pitch", F.when(same_at_bat, F.col("_pitch"))).drop("_pitch", "_at_bat")
    for scores, suffix in ((strikes, "_strike"), (contact, "_woba")):
        wide = wide_scores(scores, "batter", "pitch_type", pitch_types)
        rows = lookup(rows, wide, {"batter": "batter"}, {t: f"{t}{suffix}" for t in pitch_types})
    return rows


def hit_class_set(
    pitches: DataFrame,
    venues: DataFrame,
    speeds: DataFrame,
    fielding: DataFrame,
    teams: DataFrame,
    *,
    venue_id: object = None,
    until: str | None = None,
) -> DataFrame:
    """Balls in play with spray angle, runner speed and fielding strength, per venue.

    ``venues`` has game_pk and venue_id, ``speeds`` player_id and speed,
    ``fielding`` year, entity_id and the two standardised columns, ``teams``
    team_id and team_code. A missing speed takes the mean over the joined rows
    of the same venue.
    """
    if venue_id is not None:
        venues = venues.where(F.col("venue_id") == venue_id)
    rows = as_of(pitches, date="game_date", until=until, year="game_year", after_year=FIRST_SEASON_AFTER)
    rows = rows.where((F.col("type") == "X") & has_class("events", OUTCOME_CLASSES)).withColumns(
        {
            "simplified_outcome": collapse("events", OUTCOME_CLASSES),
            "fielding_team": choose(F.col("inning_topbot") == "Top", "home_team", "away_team"),
            "spray_angle": spray_angle("hc_x", "hc_y"),
        }
    )
    rows = require_all(
        rows,
        ["outs_when_up", "of_fielding_alignment", "launch_speed", "launch_angle", "spray_angle"],
    )
    rows = rows.withColumns({b: presence(b) for b in ("on_1b", "on_2b", "on_3b")})
    rows = rows.join(venues.select("game_pk", "venue_id").distinct(), "game_pk")
    rows = lookup(rows, speeds.withColumn("speed", F.col("speed").try_cast("double")), {"batter": "player_id"}, ["speed"])
    strength = lookup(fielding, teams, {"entity_id": "team_id"}, {"team_code": "team"})
    strength = strength.withColumn("year", F.col("year").cast("int"))
    rows = lookup(
        rows,
        strength,
        {"game_year": "year", "fielding_team": "team"},
        ["oaa_rhh_standardized", "oaa_lhh_standardized"],
    )
    # The joined rows are used twice, for the means and for themselves.
    rows = fill_with_mean(written(rows, "balls-in-play"), "speed", ["venue_id"])
    rows = rows.withColumn("oaa", choose(F.col("stand") == "R", "oaa_rhh_standardized", "oaa_lhh_standardized"))
    return rows.select(
        "venue_id", *PITCH_KEY, "simplified_outcome", "game_year", "outs_when_up", "stand", "on_1b", "on_2b", "on_3b",
        "launch_speed", "launch_angle", "spray_angle", "speed", "oaa",
    )


def hit_characteristic_set(pitches: DataFrame, *, until: str | None = None) -> DataFrame:
    """Launch speed, launch angle and spray angle of every ball in play."""
    rows = as_of(pitches, date="game_date", until=until).where(F.col("description") == "hit_into_play")
    rows = rows.withColumn("spray_angle", spray_angle("hc_x", "hc_y"))
    rows = require_all(rows, ["launch_speed", "launch_angle", "spray_angle"])
    return rows.select("batter", *PITCH_KEY, "launch_speed", "launch_angle", "spray_angle")
