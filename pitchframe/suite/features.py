"""Batter tables and training sets on the pitch stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchframe.functions.numbers import plain, settled
from pitchframe.plans import features as feat
from pitchframe.plans import scores
from pitchframe.sources.tables import read_table
from pitchframe.suite import register
from pitchframe.suite.standin import PITCH_SQL, pitches

_TYPES = ["CH", "CU", "FF", "SL"]

_STRIKE_SQL = """
strike_rates AS (SELECT batter, pitch_type, avg(CASE WHEN type = 'S' THEN 1.0E0 ELSE 0.0E0 END) * 100 AS r FROM pitches
  WHERE pitch_type <> 'PO' AND type IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 15),
strike_scores AS (SELECT batter, pitch_type, coalesce((r - avg(r) OVER w) / nullif(stddev_pop(r) OVER w, 0), 0) AS z
  FROM strike_rates WINDOW w AS (PARTITION BY pitch_type)),
contact_rates AS (SELECT batter, pitch_type, avg(woba_value) AS r FROM pitches
  WHERE pitch_type <> 'PO' AND type = 'X' GROUP BY 1, 2 HAVING count(*) >= 3),
contact_scores AS (SELECT batter, pitch_type, coalesce((r - avg(r) OVER w) / nullif(stddev_pop(r) OVER w, 0), 0) AS z
  FROM contact_rates WHERE r IS NOT NULL WINDOW w AS (PARTITION BY pitch_type))"""


def _wide_sql(table: str, suffix: str) -> str:
    cells = ", ".join(f"coalesce(max(z) FILTER (pitch_type = '{t}'), 0) AS {t}_{suffix}" for t in _TYPES)
    return f"SELECT batter, {cells} FROM {table} GROUP BY 1"


def _tables(spark, folder):
    rows = pitches(spark, folder)
    return rows, scores.strike_scores(rows, minimum=15), scores.contact_scores(rows, minimum=3)


@register(
    "A2 A3 W5 A5 P8 P11",
    f"""WITH {PITCH_SQL}, {_STRIKE_SQL}, wide AS ({_wide_sql("strike_scores", "strike")})
    SELECT batter, {", ".join(f"round({t}_strike, 6) + 0.0 AS {t}_strike" for t in _TYPES)} FROM wide""",
)
def strike_score_table(spark, folder):
    _, strikes, _ = _tables(spark, folder)
    wide = scores.wide_scores(strikes, "batter", "pitch_type", _TYPES)
    return wide.select("batter", *[plain(F.col(t)).alias(f"{t}_strike") for t in _TYPES])


@register(
    "A2 A4 W5 A5",
    f"""WITH {PITCH_SQL}, {_STRIKE_SQL} SELECT batter, pitch_type, round(z, 6) + 0.0 AS z FROM contact_scores""",
)
def contact_score_table(spark, folder):
    _, _, contact = _tables(spark, folder)
    return contact.withColumn("z", plain(F.col("z")))


@register(
    "M7 P2 P7 P8",
    f"""WITH {PITCH_SQL}, t AS (
      SELECT *, CASE WHEN description IN ('swinging_strike', 'swinging_strike_blocked', 'called_strike', 'foul_tip', 'swinging_pitchout') THEN 'strike'
           WHEN description IN ('foul', 'foul_pitchout') THEN 'foul' WHEN description IN ('ball', 'blocked_ball', 'pitchout') THEN 'ball'
           WHEN description IN ('hit_by_pitch', 'hit_into_play') THEN description END AS pitch_outcome FROM pitches)
    SELECT batter, game_pk, at_bat_number, pitch_number, release_speed, release_spin_rate, plate_x, plate_z, p_throws, strikes, balls, pitch_outcome
    FROM t WHERE release_speed IS NOT NULL AND release_spin_rate IS NOT NULL AND game_date <= TIMESTAMP '2024-01-20' AND pitch_outcome IS NOT NULL""",
)
def pitch_outcome_features(spark, folder):
    return feat.pitch_outcome_set(pitches(spark, folder), until="2024-01-20").drop("game_date")


@register(
    "M7",
    f"""WITH {PITCH_SQL}, t AS (
      SELECT *, CASE WHEN description IN ('called_strike', 'foul_tip') THEN 'strike' WHEN description = 'foul' THEN 'foul'
           WHEN description IN ('ball', 'blocked_ball') THEN 'ball' WHEN description IN ('hit_by_pitch', 'hit_into_play') THEN description END AS pitch_outcome FROM pitches)
    SELECT pitch_outcome, count(*) AS n FROM t WHERE release_speed IS NOT NULL AND release_spin_rate IS NOT NULL GROUP BY 1""",
)
def pitch_outcome_targets(spark, folder):
    """Targets with the unmapped descriptions kept as a class of their own."""
    rows = feat.pitch_outcome_set(pitches(spark, folder), keep_null_target=True)
    return rows.groupBy("pitch_outcome").agg(F.count(F.lit(1)).alias("n"))


_ARSENAL_SQL = """
arsenal AS (SELECT DISTINCT pitcher, pitch_type FROM (
  SELECT pitcher, pitch_type, row_number() OVER (PARTITION BY pitcher ORDER BY game_date DESC, game_pk DESC, at_bat_number DESC, pitch_number DESC) AS rn
  FROM pitches WHERE pitch_type <> 'PO' AND pitch_type IS NOT NULL AND game_type IS NOT NULL AND game_type NOT IN ('E', 'S')) WHERE rn <= 5)"""


@register(
    "M8 T2 J3 J8 W1 W2 P3 A5",
    f"""WITH {PITCH_SQL}, {_STRIKE_SQL}, {_ARSENAL_SQL},
    seq AS (SELECT p.*, lag(pitch_type) OVER (PARTITION BY game_pk, pitcher, at_bat_number ORDER BY pitch_number) AS prev_pitch,
              row_number() OVER (PARTITION BY game_pk, pitcher ORDER BY at_bat_number, pitch_number) AS cumulative_pitch_number
            FROM pitches p SEMI JOIN arsenal USING (pitcher, pitch_type)),
    s AS ({_wide_sql("strike_scores", "strike")}), w AS ({_wide_sql("contact_scores", "woba")})
    SELECT pitcher, batter, game_pk, at_bat_number, pitch_number, game_year, pitch_type, strikes, balls, outs_when_up, stand,
      CASE WHEN on_1b IS NULL THEN 0 ELSE 1 END AS on_1b, CASE WHEN on_2b IS NULL THEN 0 ELSE 1 END AS on_2b, CASE WHEN on_3b IS NULL THEN 0 ELSE 1 END AS on_3b,
      prev_pitch, cumulative_pitch_number,
      {", ".join(f"round({t}_strike, 6) + 0.0 AS {t}_strike, round({t}_woba, 6) + 0.0 AS {t}_woba" for t in _TYPES)}
    FROM seq LEFT JOIN s USING (batter) LEFT JOIN w USING (batter)""",
)
def pitch_sequence_features(spark, folder):
    built = pitch_sequence_rows(*_tables(spark, folder)).drop("game_date")
    rounded = [f"{t}_{s}" for t in _TYPES for s in ("strike", "woba")]
    return built.withColumns({c: plain(F.col(c)) for c in rounded})


def pitch_sequence_rows(rows, strikes, contact):
    return feat.pitch_sequence_set(rows, strikes, contact, _TYPES, arsenal=feat.arsenals(rows, 5))


@register(
    "M9 J3 J5 J6 J7 P1 P3 P6 F1",
    f"""WITH {PITCH_SQL},
    venues AS (SELECT DISTINCT game_pk, CAST(game_pk % 10 AS BIGINT) AS venue_id FROM pitches),
    speeds AS (SELECT c_custkey AS player_id, c_acctbal AS speed FROM customer WHERE c_mktsegment <> 'BUILDING'),
    oaa AS (SELECT 2024 AS y, n_nationkey AS id, n_nationkey / 4.0E0 AS rhh, n_regionkey / 2.0E0 AS lhh FROM nation),
    teams AS (SELECT n_nationkey AS id, 'T' || CAST(n_nationkey AS VARCHAR) AS team FROM nation WHERE n_nationkey <> 7),
    h AS (SELECT *, CASE WHEN events IN ('single', 'double', 'triple', 'home_run', 'field_out', 'triple_play', 'fielders_choice') THEN events
           WHEN events IN ('ground_out', 'force_out') THEN 'ground_out' WHEN events IN ('fly_out', 'sac_fly') THEN 'fly_out'
           WHEN events = 'grounded_into_double_play' THEN 'double_play' WHEN events = 'field_error' THEN 'fielding_error' END AS simplified_outcome,
           CASE WHEN inning_topbot = 'Top' THEN home_team ELSE away_team END AS fielding_team,
           round(-(180 / pi()) * atan2(hc_x - 130, 213 - hc_y) + 90) + 0.0 AS spray_angle FROM pitches WHERE type = 'X' AND game_year > 2020),
    j AS (SELECT h.*, venue_id, speed, rhh, lhh FROM h JOIN venues USING (game_pk) LEFT JOIN speeds ON batter = player_id
          LEFT JOIN (SELECT y, team, rhh, lhh FROM oaa JOIN teams USING (id)) o ON game_year = y AND fielding_team = team
          WHERE simplified_outcome IS NOT NULL AND of_fielding_alignment IS NOT NULL AND launch_speed IS NOT NULL AND launch_angle IS NOT NULL)
    SELECT venue_id, game_pk, at_bat_number, pitch_number, simplified_outcome, game_year, outs_when_up, stand,
      CASE WHEN on_1b IS NULL THEN 0 ELSE 1 END AS on_1b, CASE WHEN on_2b IS NULL THEN 0 ELSE 1 END AS on_2b, CASE WHEN on_3b IS NULL THEN 0 ELSE 1 END AS on_3b,
      launch_speed, launch_angle, spray_angle, round(coalesce(speed, avg(speed) OVER (PARTITION BY venue_id)) + 1e-9, 4) AS speed,
      CASE WHEN stand = 'R' THEN rhh ELSE lhh END AS oaa FROM j""",
)
def hit_class_features(spark, folder):
    built = hit_class_rows(spark, folder).drop("game_date")
    return built.withColumns({"speed": settled(F.col("speed"), 4), "spray_angle": plain(F.col("spray_angle"), 0)})


def hit_class_rows(spark, folder):
    rows = pitches(spark, folder)
    nation, customer = read_table(spark, folder, "nation"), read_table(spark, folder, "customer")
    venues = rows.select("game_pk", (F.col("game_pk") % 10).alias("venue_id"))
    speeds = customer.where("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("player_id"), F.col("c_acctbal").cast("string").alias("speed")
    )
    fielding = nation.select(
        F.lit("2024").alias("year"),
        F.col("n_nationkey").alias("entity_id"),
        (F.col("n_nationkey") / 4.0).alias("oaa_rhh_standardized"),
        (F.col("n_regionkey") / 2.0).alias("oaa_lhh_standardized"),
    )
    teams = nation.where("n_nationkey <> 7").select(
        F.col("n_nationkey").alias("team_id"), F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("team_code")
    )
    return feat.hit_class_set(rows, venues, speeds, fielding, teams)


@register(
    "M10 F1 P7 P8",
    f"""WITH {PITCH_SQL}
    SELECT batter, game_pk, at_bat_number, pitch_number, launch_speed, launch_angle,
      round(-(180 / pi()) * atan2(hc_x - 130, 213 - hc_y) + 90) + 0.0 AS spray_angle
    FROM pitches WHERE description = 'hit_into_play' AND launch_speed IS NOT NULL AND launch_angle IS NOT NULL AND game_date <= TIMESTAMP '2024-01-25'""",
)
def hit_characteristics(spark, folder):
    built = feat.hit_characteristic_set(pitches(spark, folder), until="2024-01-25").drop("game_date")
    return built.withColumn("spray_angle", plain(F.col("spray_angle"), 0))


@register(
    "M7 T3 P9",
    f"""WITH {PITCH_SQL},
    w AS (SELECT c_custkey AS batter FROM customer WHERE c_custkey % 5 = 0),
    t AS (SELECT *, CASE WHEN description IN ('called_strike', 'foul_tip', 'foul', 'ball', 'blocked_ball', 'hit_by_pitch', 'hit_into_play') THEN 1 END AS target FROM pitches
          WHERE release_speed IS NOT NULL AND release_spin_rate IS NOT NULL),
    c AS (SELECT count(target) AS n FROM (SELECT * FROM t WHERE stand = 'R' AND sz_top BETWEEN 3.3E0 AND 3.5E0 AND sz_bot BETWEEN 1.5E0 AND 1.7E0
          ORDER BY game_date, game_pk, at_bat_number, pitch_number LIMIT 60)),
    o AS (SELECT batter, count(*) AS n FROM t WHERE target = 1 GROUP BY 1)
    SELECT w.batter, CASE WHEN o.batter IS NULL THEN -1 ELSE w.batter END AS training_set, coalesce(o.n, (SELECT n FROM c)) AS n FROM w LEFT JOIN o ON w.batter = o.batter""",
)
def outcome_training_sets(spark, folder):
    """What batters train on: their own pitches, or the default cohort where they have none."""
    batters = read_table(spark, folder, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("batter"))
    sets, rows = feat.pitch_outcome_training(pitches(spark, folder), batters, limit=60)
    sizes = rows.groupBy("training_set").agg(F.count(F.lit(1)).alias("n"))
    return sets.join(sizes, "training_set").select("batter", "training_set", "n")


@register(
    "M10 T3 P9",
    f"""WITH {PITCH_SQL},
    w AS (SELECT c_custkey AS batter FROM customer WHERE c_custkey % 5 = 0),
    t AS (SELECT * FROM pitches WHERE description = 'hit_into_play' AND launch_speed IS NOT NULL AND launch_angle IS NOT NULL),
    c AS (SELECT avg(launch_speed) AS m FROM (SELECT * FROM t WHERE stand = 'R' AND sz_top BETWEEN 3.3E0 AND 3.5E0 AND sz_bot BETWEEN 1.5E0 AND 1.7E0
          ORDER BY game_date, game_pk, at_bat_number, pitch_number LIMIT 25)),
    o AS (SELECT batter, avg(launch_speed) AS m FROM t GROUP BY 1)
    SELECT w.batter, round(coalesce(o.m, (SELECT m FROM c)), 6) AS launch_speed FROM w LEFT JOIN o ON w.batter = o.batter""",
)
def hit_training_sets(spark, folder):
    """Mean launch speed of what batters train on."""
    batters = read_table(spark, folder, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("batter"))
    sets, rows = feat.hit_characteristic_training(pitches(spark, folder), batters, limit=25)
    means = rows.groupBy("training_set").agg(F.round(F.avg("launch_speed"), 6).alias("launch_speed"))
    return sets.join(means, "training_set", "left").select("batter", "launch_speed")
