"""Transition tables and prices."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from pitchframe.functions.categories import OUTCOME_CLASSES, collapse
from pitchframe.operators import markets, state
from pitchframe.plans.classifiers import stored_transitions
from pitchframe.plans.transitions import transition_table
from pitchframe.session import shared_dir
from pitchframe.sources.registry import TABLE_DAYS
from pitchframe.sources.store import Store
from pitchframe.sources.tables import read_table
from pitchframe.suite import SQL, register
from pitchframe.suite.standin import PITCH_SQL, pitches

_OUTCOME = """CASE WHEN events IN ('single', 'double', 'triple', 'home_run', 'field_out', 'triple_play', 'fielders_choice') THEN events
           WHEN events IN ('ground_out', 'force_out') THEN 'ground_out' WHEN events IN ('fly_out', 'sac_fly') THEN 'fly_out'
           WHEN events = 'grounded_into_double_play' THEN 'double_play' WHEN events = 'field_error' THEN 'fielding_error' END"""

_TABLE_SQL = f"""
n AS (SELECT *, post_bat_score - bat_score AS runs_scored, {_OUTCOME} AS outcome, lead(outs_when_up, 1, 3) OVER w AS after_outs,
        lead(on_1b) OVER w AS a1, lead(on_2b) OVER w AS a2, lead(on_3b) OVER w AS a3
      FROM pitches WHERE inning < 9 AND game_year > 2020
      WINDOW w AS (PARTITION BY game_pk, inning, inning_topbot ORDER BY game_date, at_bat_number, pitch_number)),
h AS (SELECT outcome, stand, outs_when_up AS outs, on_1b IS NOT NULL AS on_1b, on_2b IS NOT NULL AS on_2b, on_3b IS NOT NULL AS on_3b, after_outs,
        CASE a1 WHEN on_3b THEN '3b' WHEN on_2b THEN '2b' WHEN on_1b THEN '1b' WHEN batter THEN 'batter' END AS after_1b,
        CASE a2 WHEN on_3b THEN '3b' WHEN on_2b THEN '2b' WHEN on_1b THEN '1b' WHEN batter THEN 'batter' END AS after_2b,
        CASE a3 WHEN on_3b THEN '3b' WHEN on_2b THEN '2b' WHEN on_1b THEN '1b' WHEN batter THEN 'batter' END AS after_3b, runs_scored
      FROM n WHERE outcome IS NOT NULL),
t AS (SELECT *, count(*) AS n FROM h GROUP BY ALL)"""


@register(
    "G1 A10 W3 W4 W11 P1 P3 P5",
    f"""WITH {PITCH_SQL}, {_TABLE_SQL}
    SELECT *, round(n / sum(n) OVER (PARTITION BY outcome, stand, outs, on_1b, on_2b, on_3b), 6) AS p FROM t""",
)
def transition_probabilities(spark, folder):
    return transition_table(pitches(spark, folder)).withColumn("p", F.round("p", 6))


@register("G1 S11 S12", SQL[transition_probabilities.__name__])
def stored_transition_probabilities(spark, folder):
    """The table as a second caller gets it: fitted and stored by the first, read back while it is valid."""
    store, rows, today = Store(spark, shared_dir(spark, "store")), pitches(spark, folder), datetime.date(2024, 5, 1)
    stored_transitions(store, today, rows)
    again = stored_transitions(store, today + datetime.timedelta(days=TABLE_DAYS), rows.limit(0))
    return again.withColumn("p", F.round("p", 6))


@register(
    "A10 G1",
    """WITH t AS (SELECT event_type AS before, lead(event_type, 1, 'END') OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS after FROM events),
         c AS (SELECT before, after, count(*) AS n FROM t GROUP BY ALL)
    SELECT *, round(n / sum(n) OVER (PARTITION BY before), 6) AS p FROM c""",
)
def event_transitions(spark, folder):
    from pitchframe.operators.aggregate import conditional_distribution
    from pitchframe.operators.ordered import Ordered

    events = read_table(spark, folder, "events").select(
        "user_id", F.col("ts").cast("date").alias("day"), "ts", "event_id", F.col("event_type").alias("before")
    )
    rows = Ordered(events, ["user_id", "day"], ["ts", "event_id"]).lead("after", "before", 1, "END").build()
    return conditional_distribution(rows, ["before"], ["after"]).withColumn("p", F.round("p", 6))


@register(
    "G2 U4",
    f"""WITH {PITCH_SQL},
    s AS (SELECT DISTINCT outs_when_up AS outs, on_1b IS NOT NULL AS a, on_2b IS NOT NULL AS b, on_3b IS NOT NULL AS c FROM pitches)
    SELECT e.outcome, CAST(outs AS INTEGER) AS outs, a AS on_1b, b AS on_2b, c AS on_3b,
      CAST(CASE WHEN e.outcome = 'K' THEN outs + 1 ELSE outs END AS INTEGER) AS after_outs,
      CASE WHEN e.outcome = 'walk' THEN 'batter' WHEN a THEN '1b' END AS after_1b,
      CASE WHEN e.outcome = 'walk' AND a THEN '1b' WHEN b THEN '2b' END AS after_2b,
      CASE WHEN e.outcome = 'walk' AND a AND b THEN '2b' WHEN c THEN '3b' END AS after_3b,
      CASE WHEN e.outcome = 'walk' AND a AND b AND c THEN 1 ELSE 0 END AS runs_scored
    FROM s, (VALUES ('K'), ('walk')) e(outcome)""",
)
def forced_transitions_seen(spark, folder):
    """The certain transitions of every base/out state that occurs."""
    seen = pitches(spark, folder).select(
        F.col("outs_when_up").cast("int").alias("outs"), *[F.col(b).isNotNull().alias(b) for b in state.BASES]
    ).distinct()
    return seen.join(state.forced_table(spark), ["outs", *state.BASES])


@register(
    "G3 G2 J13 M16",
    f"""WITH {PITCH_SQL}, {_TABLE_SQL},
    c AS (SELECT *, sum(n) OVER w AS upto, sum(n) OVER (PARTITION BY outcome, stand, outs, on_1b, on_2b, on_3b) AS total FROM t
          WINDOW w AS (PARTITION BY outcome, stand, outs, on_1b, on_2b, on_3b
            ORDER BY after_outs NULLS FIRST, after_1b NULLS FIRST, after_2b NULLS FIRST, after_3b NULLS FIRST, runs_scored NULLS FIRST)),
    s AS (SELECT event_id, CASE WHEN description = 'called_strike' THEN 'K' WHEN events = 'walk' THEN 'walk' ELSE {_OUTCOME} END AS outcome, stand,
            outs_when_up AS outs, on_1b IS NOT NULL AS on_1b, on_2b IS NOT NULL AS on_2b, on_3b IS NOT NULL AS on_3b, ((event_id * 7919) % 10007) / 10007.0E0 AS u FROM pitches)
    SELECT s.event_id, s.outcome,
      CASE s.outcome WHEN 'K' THEN s.outs + 1 WHEN 'walk' THEN s.outs ELSE c.after_outs END AS after_outs,
      CASE s.outcome WHEN 'K' THEN CASE WHEN s.on_1b THEN '1b' END WHEN 'walk' THEN 'batter' ELSE c.after_1b END AS after_1b,
      CASE s.outcome WHEN 'K' THEN CASE WHEN s.on_2b THEN '2b' END WHEN 'walk' THEN CASE WHEN s.on_1b THEN '1b' WHEN s.on_2b THEN '2b' END ELSE c.after_2b END AS after_2b,
      CASE s.outcome WHEN 'K' THEN CASE WHEN s.on_3b THEN '3b' END WHEN 'walk' THEN CASE WHEN s.on_1b AND s.on_2b THEN '2b' WHEN s.on_3b THEN '3b' END ELSE c.after_3b END AS after_3b,
      CASE s.outcome WHEN 'K' THEN 0 WHEN 'walk' THEN CASE WHEN s.on_1b AND s.on_2b AND s.on_3b THEN 1 ELSE 0 END ELSE c.runs_scored END AS runs_scored
    FROM s LEFT JOIN c ON s.outcome = c.outcome AND s.stand = c.stand AND s.outs = c.outs AND s.on_1b = c.on_1b AND s.on_2b = c.on_2b AND s.on_3b = c.on_3b
      AND u >= (upto - n) / total AND u < upto / total""",
)
def applied_transitions(spark, folder):
    rows = pitches(spark, folder)
    outcome = (
        F.when(F.col("description") == "called_strike", "K")
        .when(F.col("events") == "walk", "walk")
        .otherwise(collapse("events", OUTCOME_CLASSES))
    )
    states = rows.select(
        "event_id", outcome.alias("outcome"), "stand", F.col("outs_when_up").alias("outs"),
        *[F.col(b).isNotNull().alias(b) for b in state.BASES],
        ((F.col("event_id") * 7919 % 10007) / 10007.0).alias("u"),
    )
    applied = state.apply_transitions(states, transition_table(rows), "u")
    return applied.select("event_id", "outcome", *state.AFTER)


_GAMES = """g AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS home, count(*) FILTER (o_orderstatus = 'F') AS away FROM orders GROUP BY 1)"""


def _games(spark, folder):
    """Each customer is a game; an open order is a home run, a finished one an away run."""
    side = F.when(F.col("o_orderstatus") == "O", "home").when(F.col("o_orderstatus") == "F", "away")
    scores = read_table(spark, folder, "orders").select("o_custkey", side.alias("side"), F.lit(1).alias("runs"))
    return markets.game_totals(scores, ["o_custkey"], "side", "runs")


@register(
    "O1 A12",
    f"""WITH {_GAMES} SELECT *, home + away AS total, home > away AS home_wins, away > home AS away_wins, home >= away AS home_covers, away >= home AS away_covers FROM g""",
)
def game_results(spark, folder):
    return _games(spark, folder)


_PRICE = "CASE WHEN {p} > 0 AND {p} < 1 THEN CAST(round_even(CASE WHEN {p} > 0.5 THEN -({p} / (1 - {p})) * 100 ELSE 100 / {p} - 100 END, 0) AS BIGINT) END"
_LINES = [i + 0.5 for i in range(10)]
_LADDER = f"""{_GAMES},
    l AS (SELECT line, avg(CASE WHEN home + away > line THEN 1.0E0 ELSE 0.0E0 END) AS p_over, avg(CASE WHEN home + away < line THEN 1.0E0 ELSE 0.0E0 END) AS p_under
          FROM g, (SELECT unnest([{", ".join(f"{x}E0" for x in _LINES)}]) AS line) GROUP BY 1)"""


@register(
    "O2 A13 F7",
    f"""WITH {_LADDER} SELECT line, round(p_over, 6) AS p_over, round(p_under, 6) AS p_under,
      {_PRICE.format(p="p_over")} AS odds_over, {_PRICE.format(p="p_under")} AS odds_under FROM l""",
)
def totals_market(spark, folder):
    ladder = markets.totals_ladder(_games(spark, folder), _LINES)
    return ladder.withColumns({c: F.round(c, 6) for c in ("p_over", "p_under")})


_SPREAD = f"""{_GAMES},
    w AS (SELECT avg(CASE WHEN home > away THEN 1.0E0 ELSE 0.0E0 END) AS hw, avg(CASE WHEN away > home THEN 1.0E0 ELSE 0.0E0 END) AS aw,
            avg(CASE WHEN home >= away THEN 1.0E0 ELSE 0.0E0 END) AS hc, avg(CASE WHEN away >= home THEN 1.0E0 ELSE 0.0E0 END) AS ac FROM g),
    m AS (SELECT 0 AS position, '-0.5' AS market, hw AS home_p, aw AS away_p FROM w UNION ALL SELECT 1, '+0.5', hc, ac FROM w)"""


@register(
    "O3 A13 F7",
    f"""WITH {_SPREAD} SELECT position, market, round(home_p, 6) AS home_p, round(away_p, 6) AS away_p,
      {_PRICE.format(p="home_p")} AS home_odds, {_PRICE.format(p="away_p")} AS away_odds FROM m""",
)
def spread_market(spark, folder):
    market = markets.spread_market(_games(spark, folder))
    return market.withColumns({c: F.round(c, 6) for c in ("home_p", "away_p")})


@register(
    "O4 T5",
    f"""WITH {_LADDER} SELECT line, round(p_over, 6) AS p_over FROM l ORDER BY abs(p_over - 0.5), line LIMIT 1""",
)
def fair_total_line(spark, folder):
    ladder = markets.totals_ladder(_games(spark, folder), _LINES)
    return markets.fair_total(ladder).select("line", F.round("p_over", 6).alias("p_over"))


@register(
    "O4 O3",
    f"""WITH {_SPREAD}, r AS (SELECT *, row_number() OVER (ORDER BY abs(home_p - 0.5), position) AS h, row_number() OVER (ORDER BY abs(away_p - 0.5), position) AS a FROM m)
    SELECT market, round(home_p, 6) AS home_p, round(away_p, 6) AS away_p FROM r WHERE h = 1 OR a = 1""",
)
def fair_spread_rows(spark, folder):
    fair = markets.fair_spread(markets.spread_market(_games(spark, folder)))
    return fair.select("market", *[F.round(c, 6).alias(c) for c in ("home_p", "away_p")])


@register(
    "O2 O4",
    """WITH g AS (SELECT c_mktsegment, o_custkey, count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'F') GROUP BY ALL),
        l AS (SELECT c_mktsegment, line, avg(CASE WHEN total > line THEN 1.0E0 ELSE 0.0E0 END) AS p_over FROM g, (SELECT unnest(range(20)) + 0.5E0 AS line) GROUP BY ALL)
    SELECT c_mktsegment, line, round(p_over, 6) AS p_over FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(p_over - 0.5), line) AS rn FROM l) WHERE rn = 1""",
)
def fair_total_per_segment(spark, folder):
    orders, customer = read_table(spark, folder, "orders"), read_table(spark, folder, "customer")
    played = orders.where("o_orderstatus IN ('O', 'F')").join(customer, orders.o_custkey == customer.c_custkey)
    games = played.groupBy("c_mktsegment", "o_custkey").agg(F.count(F.lit(1)).alias("total"))
    ladder = markets.totals_ladder(games, [i + 0.5 for i in range(20)], ["c_mktsegment"])
    return markets.fair_total(ladder, ["c_mktsegment"]).select("c_mktsegment", "line", F.round("p_over", 6).alias("p_over"))
