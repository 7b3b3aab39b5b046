"""Ordered operators: lags, running positions, scores, ranks, splits, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchframe.functions.categories import PITCH_CLASSES, collapse
from pitchframe.functions.numbers import plain
from pitchframe.operators import state
from pitchframe.operators.ordered import Ordered
from pitchframe.operators.quantiles import histogram, histogram_quantile, quantiles_at
from pitchframe.operators.split import ordered_split
from pitchframe.operators.standardize import pseudo_observations, z_scores
from pitchframe.sources.tables import read_table
from pitchframe.suite import register
from pitchframe.suite.standin import PITCH_SQL, pitches


@register(
    "W1 W2 W3 W4",
    """SELECT event_id, lag(event_type) OVER w AS previous, row_number() OVER w AS position,
         lead(event_type, 1, 'END') OVER w AS following, lead(value) OVER w AS next_value, lead(props) OVER w AS next_props
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def event_sequences(spark, folder):
    events = read_table(spark, folder, "events")
    return (
        Ordered(events, ["user_id"], ["ts", "event_id"])
        .lag("previous", "event_type")
        .row_number("position")
        .lead("following", "event_type", 1, "END")
        .lead("next_value", "value")
        .lead("next_props", "props")
        .build()
        .select("event_id", "previous", "position", "following", "next_value", "next_props")
    )


_SCORES = """WITH c AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL)
   SELECT user_id, event_type, round((v - avg(v) OVER w) / nullif({std}(v) OVER w, 0), 6) + 0.0 AS z FROM c WINDOW w AS (PARTITION BY event_type)"""


def _mean_values(spark, folder):
    return read_table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))


@register("W5", _SCORES.format(std="stddev_pop"))
def population_scores(spark, folder):
    return z_scores(_mean_values(spark, folder), "v", ["event_type"], ddof=0).select("user_id", "event_type", plain(F.col("z")).alias("z"))


@register("W6", _SCORES.format(std="stddev_samp"))
def sample_scores(spark, folder):
    return z_scores(_mean_values(spark, folder), "v", ["event_type"], ddof=1).select("user_id", "event_type", plain(F.col("z")).alias("z"))


@register(
    "W7",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity,
         round((rank() OVER w + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0E0) / (count(*) OVER (PARTITION BY l_suppkey) + 1), 6) AS l_quantity_u
       FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity)""",
)
def quantity_ranks_per_supplier(spark, folder):
    lines = read_table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return pseudo_observations(lines, ["l_quantity"], ["l_suppkey"]).withColumn("l_quantity_u", F.round("l_quantity_u", 6))


@register(
    "W7",
    """SELECT l_orderkey, l_linenumber, l_partkey,
         round((rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0E0) / (count(*) OVER () + 1), 6) AS l_extendedprice_u,
         round((rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2.0E0) / (count(*) OVER () + 1), 6) AS l_tax_u
       FROM lineitem""",
)
def global_pseudo_observations(spark, folder):
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_tax")
    ranked = pseudo_observations(lines, ["l_extendedprice", "l_tax"])
    return ranked.select(
        "l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 6).alias(c) for c in ("l_extendedprice_u", "l_tax_u")]
    )


@register(
    "W8",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= n - ceil(n * 0.2::DOUBLE) AS is_train
       FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events)""",
)
def split_per_user(spark, folder):
    return ordered_split(read_table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], 0.2).select("event_id", "is_train")


@register(
    "W8",
    """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) <= n - ceil(n * 0.1::DOUBLE) AS is_train
       FROM (SELECT *, count(*) OVER () AS n FROM events)""",
)
def split_whole_table(spark, folder):
    return ordered_split(read_table(spark, folder, "events"), [], ["ts", "event_id"], 0.1).select("event_id", "is_train")


@register(
    "W9",
    """SELECT event_id, round(sum(value) OVER w, 2) AS running, value AS open, lead(value) OVER w AS close,
         greatest(value, lead(value) OVER w) AS high, least(value, lead(value) OVER w) AS low
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def running_values(spark, folder):
    rows = (
        Ordered(read_table(spark, folder, "events"), ["user_id"], ["ts", "event_id"])
        .running_sum("running", "value")
        .lead("close", "value")
        .build()
    )
    return rows.select(
        "event_id",
        F.round("running", 2).alias("running"),
        F.col("value").alias("open"),
        "close",
        F.greatest("value", "close").alias("high"),
        F.least("value", "close").alias("low"),
    )


_HISTOGRAM = """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    h AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 40.0E0)), 39) AS BIGINT) AS bin, lo, (hi - lo) / 40.0E0 AS w, count(*) AS n FROM lineitem, b GROUP BY ALL),
    f AS (SELECT bin, lo + bin * w AS low, lo + (bin + 1) * w AS high, n, n / sum(n) OVER () / w AS density,
            sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS cdf FROM h)"""


@register(
    "M28 W9",
    _HISTOGRAM
    + " SELECT bin, round(low, 4) AS low, round(high, 4) AS high, n, round(density, 10) AS density, round(cdf, 6) AS cdf FROM f",
)
def price_histogram(spark, folder):
    hist = histogram(read_table(spark, folder, "lineitem"), "l_extendedprice", 40)
    return hist.select(
        "bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n",
        F.round("density", 10).alias("density"), F.round("cdf", 6).alias("cdf"),
    )


@register(
    "M28",
    _HISTOGRAM
    + """ SELECT event_id, round((SELECT min(low) FROM f WHERE f.cdf > u), 4) AS value
         FROM (SELECT event_id, ((event_id * 7919) % 10007) / 10007.0E0 AS u FROM events)""",
)
def price_histogram_inverse(spark, folder):
    hist = histogram(read_table(spark, folder, "lineitem"), "l_extendedprice", 40)
    draws = read_table(spark, folder, "events").select("event_id", ((F.col("event_id") * 7919 % 10007) / 10007.0).alias("u"))
    return histogram_quantile(hist, draws).select("event_id", F.round("value", 4).alias("value"))


@register(
    "M27",
    """WITH v AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS at FROM lineitem),
            d AS (SELECT event_id, ((event_id * 7919) % 10007) / 10007.0E0 * ((SELECT count(*) FROM lineitem) - 1) AS place FROM events)
       SELECT event_id, round(a.x + (b.x - a.x) * (place - floor(place)), 4) AS value FROM d
       JOIN v a ON a.at = CAST(floor(place) AS BIGINT) JOIN v b ON b.at = CAST(ceil(place) AS BIGINT)""",
)
def price_quantile_per_event(spark, folder):
    draws = read_table(spark, folder, "events").select(
        "event_id", F.lit("l_extendedprice").alias("column"), ((F.col("event_id") * 7919 % 10007) / 10007.0).alias("u")
    )
    values = quantiles_at(read_table(spark, folder, "lineitem"), ["l_extendedprice"], draws)
    return values.select("event_id", F.round("value", 4).alias("value"))


@register(
    "W3 W4 W11 G4",
    f"""WITH {PITCH_SQL},
    n AS (SELECT *, lead(outs_when_up, 1, 3) OVER w AS after_outs, lead(on_1b) OVER w AS a1, lead(on_2b) OVER w AS a2, lead(on_3b) OVER w AS a3
          FROM pitches WINDOW w AS (PARTITION BY game_pk, inning, inning_topbot ORDER BY game_date, event_id)),
    h AS (SELECT *, CASE a1 WHEN on_3b THEN '3b' WHEN on_2b THEN '2b' WHEN on_1b THEN '1b' WHEN batter THEN 'batter' END AS after_1b,
            CASE a2 WHEN on_3b THEN '3b' WHEN on_2b THEN '2b' WHEN on_1b THEN '1b' WHEN batter THEN 'batter' END AS after_2b,
            CASE a3 WHEN on_3b THEN '3b' WHEN on_2b THEN '2b' WHEN on_1b THEN '1b' WHEN batter THEN 'batter' END AS after_3b FROM n)
    SELECT event_id, after_outs, after_1b, after_2b, after_3b,
      CASE after_1b WHEN 'batter' THEN batter WHEN '1b' THEN on_1b WHEN '2b' THEN on_2b WHEN '3b' THEN on_3b END AS new_1b,
      CASE after_2b WHEN 'batter' THEN batter WHEN '1b' THEN on_1b WHEN '2b' THEN on_2b WHEN '3b' THEN on_3b END AS new_2b,
      CASE after_3b WHEN 'batter' THEN batter WHEN '1b' THEN on_1b WHEN '2b' THEN on_2b WHEN '3b' THEN on_3b END AS new_3b
    FROM h""",
)
def tracked_runners(spark, folder):
    rows = state.next_state(pitches(spark, folder), ["game_pk", "inning", "inning_topbot"], ["game_date", "event_id"])
    rows = state.move_occupants(state.track_runners(rows))
    return rows.select(
        "event_id", "after_outs", "after_1b", "after_2b", "after_3b",
        *[F.col(f"on_{b}_new").alias(f"new_{b}") for b in ("1b", "2b", "3b")],
    )


@register(
    "W12",
    f"""WITH RECURSIVE {PITCH_SQL},
    p AS (SELECT event_id, pitcher, game_pk, row_number() OVER (PARTITION BY pitcher, game_pk ORDER BY game_date, event_id) AS i,
            CASE WHEN description IN ('called_strike', 'foul_tip') THEN 'strike' WHEN description = 'foul' THEN 'foul'
                 WHEN description IN ('ball', 'blocked_ball') THEN 'ball' WHEN description IN ('hit_by_pitch', 'hit_into_play') THEN description END AS o FROM pitches),
    f AS (SELECT event_id, pitcher, game_pk, i, CASE o WHEN 'ball' THEN 1 WHEN 'hit_by_pitch' THEN 4 ELSE 0 END AS b,
            CASE WHEN o IN ('strike', 'foul') THEN 1 ELSE 0 END AS s FROM p WHERE i = 1
          UNION ALL
          SELECT p.event_id, p.pitcher, p.game_pk, p.i, CASE p.o WHEN 'ball' THEN b + 1 WHEN 'hit_by_pitch' THEN 4 ELSE b END,
            CASE WHEN p.o = 'strike' OR (p.o = 'foul' AND s < 2) THEN s + 1 ELSE s END
          FROM f JOIN p ON p.pitcher = f.pitcher AND p.game_pk = f.game_pk AND p.i = f.i + 1)
    SELECT event_id, CAST(b AS BIGINT) AS balls_after, CAST(s AS BIGINT) AS strikes_after,
      CASE WHEN b > 3 THEN 'walk' WHEN s > 2 THEN 'K' END AS event FROM f""",
)
def running_counts(spark, folder):
    """Ball/strike count per pitcher and day."""
    rows = pitches(spark, folder).withColumn("outcome", collapse("description", PITCH_CLASSES))
    counted = state.running_count(rows, ["pitcher", "game_pk"], ["game_date", "event_id"], "outcome")
    return counted.select("event_id", "balls_after", "strikes_after", "event")
