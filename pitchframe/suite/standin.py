"""The events table in the shape of the pitch table, for Spark and as a SQL text.

Both derive every pitch column from the whole events table by the same
arithmetic, so all builders of the pitch domain can be checked on it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.schemas import FLOAT_COLUMNS, PITCH_COLUMNS, TEXT_COLUMNS
from pitchframe.sources.tables import read_table

# One text for both engines; only the JSON access and the day number differ.
_COLUMNS = """
    ts AS game_date,
    CAST(year(ts) AS INT) AS game_year,
    CASE WHEN k % 23 = 0 THEN 'S' WHEN k % 29 = 0 THEN NULL ELSE 'R' END AS game_type,
    CAST({day} AS BIGINT) AS game_pk,
    CAST(k % 11 + 1 AS BIGINT) AS inning,
    CASE WHEN user_id % 2 = 0 THEN 'Top' ELSE 'Bot' END AS inning_topbot,
    CAST(floor(event_id / 4) AS BIGINT) AS at_bat_number,
    CAST(event_id % 4 + 1 AS BIGINT) AS pitch_number,
    CAST(user_id AS BIGINT) AS pitcher,
    CAST(k AS BIGINT) AS batter,
    CASE WHEN k % 3 = 0 THEN 'L' ELSE 'R' END AS stand,
    CASE WHEN user_id % 4 = 0 THEN 'L' ELSE 'R' END AS p_throws,
    concat('T', CAST(user_id % 25 AS {text})) AS home_team,
    concat('T', CAST(k % 25 AS {text})) AS away_team,
    CASE event_type WHEN 'click' THEN 'FF' WHEN 'view' THEN 'SL' WHEN 'purchase' THEN 'CH'
        WHEN 'signup' THEN 'CU' ELSE CASE WHEN k % 2 = 0 THEN 'PO' END END AS pitch_type,
    CASE WHEN event_id % 7 < 3 THEN 'S' WHEN event_id % 7 < 5 THEN 'B' ELSE 'X' END AS type,
    CASE WHEN event_id % 7 = 0 THEN 'called_strike' WHEN event_id % 7 = 1 THEN 'foul' WHEN event_id % 7 = 2 THEN 'foul_tip'
        WHEN event_id % 7 = 3 THEN 'ball' WHEN event_id % 7 = 4 THEN CASE WHEN k < 20 THEN 'hit_by_pitch' ELSE 'blocked_ball' END
        WHEN k % 19 = 0 THEN 'missed_bunt' ELSE 'hit_into_play' END AS description,
    CASE k % 13 WHEN 0 THEN 'single' WHEN 1 THEN 'double' WHEN 2 THEN 'triple' WHEN 3 THEN 'home_run'
        WHEN 4 THEN 'field_out' WHEN 5 THEN 'force_out' WHEN 6 THEN 'sac_fly' WHEN 7 THEN 'grounded_into_double_play'
        WHEN 8 THEN 'field_error' WHEN 9 THEN 'fielders_choice' WHEN 10 THEN 'ground_out' WHEN 11 THEN 'walk' END AS events,
    CAST(k % 4 AS BIGINT) AS balls,
    CAST(user_id % 3 AS BIGINT) AS strikes,
    CAST(k % 3 AS BIGINT) AS outs_when_up,
    CASE WHEN k % 4 < 2 THEN CAST(user_id % 6 AS BIGINT) END AS on_1b,
    CASE WHEN k % 5 < 2 THEN CAST(user_id % 9 AS BIGINT) END AS on_2b,
    CASE WHEN k % 7 < 2 THEN CAST(user_id % 5 AS BIGINT) END AS on_3b,
    CASE WHEN k <> 3 THEN 70.0E0 + k / 4.0E0 + 3.0E0 * (event_id % 7) END AS release_speed,
    CASE WHEN k <> 5 THEN CAST(2000 + user_id AS BIGINT) END AS release_spin_rate,
    (k - 50) / 25.0E0 AS plate_x,
    value / 20.0E0 AS plate_z,
    3.0E0 + (k % 10) / 10.0E0 AS sz_top,
    1.2E0 + (k % 8) / 10.0E0 AS sz_bot,
    value * 2.0E0 AS hc_x,
    k * 2.0E0 AS hc_y,
    CASE WHEN k <> 8 THEN value END AS launch_speed,
    CASE WHEN k <> 9 THEN CAST(k - 40 AS BIGINT) END AS launch_angle,
    CASE WHEN k <> 10 THEN value / 50.0E0 END AS woba_value,
    CAST(k % 5 AS BIGINT) AS bat_score,
    CAST(user_id % 5 AS BIGINT) AS fld_score,
    CAST(k % 5 + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS post_bat_score,
    CASE WHEN k <> 12 THEN 'Standard' END AS of_fielding_alignment,
    event_id
"""

PITCH_SQL = f"""
pitches AS (
  SELECT {_COLUMNS.format(text="VARCHAR", day="date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))")}
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e
)"""


def pitches(spark: SparkSession, folder: str) -> DataFrame:
    return as_pitches(read_table(spark, folder, "events"))


def as_pitches(events: DataFrame) -> DataFrame:
    """Pitch columns of a batch or streaming events frame.

    ``k`` is parsed in a one-element explode: as a plain projection the parse
    would be copied into every filter on a column made from it.
    """
    text = f"""
      SELECT {_COLUMNS.format(text="STRING", day="datediff(CAST(ts AS DATE), DATE '1970-01-01')")}
      FROM {{events}} LATERAL VIEW explode(array(CAST(get_json_object(props, '$.k') AS BIGINT))) parsed AS k"""
    return events.sparkSession.sql(text, events=events)


# The stand-in has some of the feed's columns; the others are filled by rule.
_HAVE = set(re.findall(r"AS (\w+),?$", _COLUMNS, re.MULTILINE))


def _filled(name: str, at: int, text: str) -> str:
    if name in _HAVE:
        return name
    if name in TEXT_COLUMNS:
        return f"concat('t', CAST(event_id % {at + 2} AS {text}))"
    return f"(event_id % {at + 5}) / 4.0E0" if name in FLOAT_COLUMNS else f"CAST(event_id % {at + 3} AS BIGINT)"


def _plain(name: str, at: int) -> str:
    value = _filled(name, at, "VARCHAR")
    return f"CAST(CAST({value} AS FLOAT) AS DOUBLE) AS {name}" if name in FLOAT_COLUMNS else f"{value} AS {name}"


FEED_SQL = ", ".join(_plain(name, at) for at, name in enumerate(PITCH_COLUMNS))
# What the feed below spoils: column, rows, the value written there and what is wrong with it.
SPOILT = [
    ("launch_angle", "event_id % 97 = 5", "12.7", "not a bigint"),
    ("release_speed", "event_id % 89 = 7", "fast", "not a float"),
    ("pitch_number", "event_id % 101 = 3", None, "missing"),
]


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """The stand-in as an export has it: all columns as text, half of the whole numbers with a point, some values spoilt."""
    return as_feed(read_table(spark, folder, "events"))


def as_feed(events: DataFrame) -> DataFrame:
    """:func:`feed` of an events frame."""
    rows = as_pitches(events)
    columns = [F.col("event_id").alias("row_id"), F.lit("1").alias("pitcher.1")]
    bad = {name: (test, value) for name, test, value, _ in SPOILT}
    for at, name in enumerate(PITCH_COLUMNS):
        value = F.expr(_filled(name, at, "STRING")).cast("string")
        if name not in TEXT_COLUMNS and name not in FLOAT_COLUMNS and name != "game_date":
            value = F.when(F.col("event_id") % 2 == 0, F.concat(value, F.lit(".0"))).otherwise(value)
        if name in bad:
            value = F.when(F.expr(bad[name][0]), F.lit(bad[name][1])).otherwise(value)
        columns.append(value.alias(name))
    return rows.select(*columns)
