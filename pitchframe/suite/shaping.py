"""Filters, projections, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchframe.functions import categories as cat
from pitchframe.functions import numbers as num
from pitchframe.functions import text as txt
from pitchframe.functions.normal import add_normal_cdf, add_normal_quantile
from pitchframe.operators import shape
from pitchframe.plans.features import COHORT_RANGES, COHORT_STAND
from pitchframe.sources.tables import query, read_table
from pitchframe.suite import register
from pitchframe.suite.standin import PITCH_SQL, pitches

# Fixed value: class map for the event types of the test table.
EVENT_CLASSES = {"browse": ["click", "view"], "convert": ["purchase", "signup"]}
PRIORITY_CLASSES = {"high": ["1-URGENT", "2-HIGH"], "medium": ["3-MEDIUM"], "low": ["4-NOT SPECIFIED", "5-LOW"]}


@register(
    "P1 A7",
    """SELECT CASE WHEN event_type IN ('click', 'view') THEN 'browse'
                   WHEN event_type IN ('purchase', 'signup') THEN 'convert' END AS event_class,
              event_type, count(*) AS n
       FROM events GROUP BY ALL""",
)
def event_classes(spark, folder):
    events = read_table(spark, folder, "events")
    return events.groupBy(cat.collapse("event_type", EVENT_CLASSES).alias("event_class"), "event_type").agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "P1 P2 P3 P5",
    f"""WITH {PITCH_SQL}
    SELECT event_id,
      CASE WHEN events IN ('single', 'double', 'triple', 'home_run', 'field_out', 'triple_play', 'fielders_choice') THEN events
           WHEN events IN ('ground_out', 'force_out') THEN 'ground_out'
           WHEN events IN ('fly_out', 'sac_fly') THEN 'fly_out'
           WHEN events IN ('double_play', 'grounded_into_double_play', 'sac_fly_double_play') THEN 'double_play'
           WHEN events = 'field_error' THEN 'fielding_error' END AS outcome,
      CASE WHEN description IN ('swinging_strike', 'swinging_strike_blocked', 'called_strike', 'foul_tip', 'swinging_pitchout') THEN 'strike'
           WHEN description IN ('foul', 'foul_pitchout') THEN 'foul'
           WHEN description IN ('ball', 'blocked_ball', 'pitchout') THEN 'ball'
           WHEN description IN ('hit_by_pitch', 'hit_into_play') THEN description END AS pitch_outcome,
      CASE WHEN on_1b IS NOT NULL THEN 1 ELSE 0 END AS has_1b,
      CASE WHEN on_2b IS NOT NULL THEN 1 ELSE 0 END AS has_2b,
      CASE WHEN on_3b IS NOT NULL THEN 1 ELSE 0 END AS has_3b,
      post_bat_score - bat_score AS runs_scored
    FROM pitches""",
)
def pitch_classes(spark, folder):
    return pitches(spark, folder).select(
        "event_id",
        cat.collapse("events", cat.OUTCOME_CLASSES).alias("outcome"),
        cat.collapse("description", cat.PITCH_CLASSES).alias("pitch_outcome"),
        *[cat.presence(f"on_{b}").alias(f"has_{b}") for b in ("1b", "2b", "3b")],
        (F.col("post_bat_score") - F.col("bat_score")).alias("runs_scored"),
    )


@register(
    "P2",
    """SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium'
                   WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'low' END AS priority_class,
              count(*) AS n, count(DISTINCT o_custkey) AS customers
       FROM orders GROUP BY 1""",
)
def priority_classes(spark, folder):
    orders = read_table(spark, folder, "orders")
    return orders.groupBy(cat.collapse("o_orderpriority", PRIORITY_CLASSES).alias("priority_class")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers")
    )


@register(
    "P4",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1 WHEN c_acctbal = 0 THEN 0 ELSE -1 END AS balance_sign FROM customer""",
)
def balance_sign(spark, folder):
    return read_table(spark, folder, "customer").select(
        "c_custkey", cat.sign_bucket(F.col("c_acctbal")).alias("balance_sign")
    )


@register(
    "P6",
    f"""WITH {PITCH_SQL}
    SELECT event_id, CASE WHEN inning_topbot = 'Top' THEN home_team ELSE away_team END AS fielding_team,
      CASE WHEN stand = 'R' THEN plate_x ELSE plate_z END AS side_value FROM pitches""",
)
def fielding_side(spark, folder):
    return pitches(spark, folder).select(
        "event_id",
        cat.choose(F.col("inning_topbot") == "Top", "home_team", "away_team").alias("fielding_team"),
        cat.choose(F.col("stand") == "R", "plate_x", "plate_z").alias("side_value"),
    )


@register(
    "P7",
    f"""WITH {PITCH_SQL}
    SELECT event_id, release_speed, release_spin_rate, launch_speed, launch_angle FROM pitches
    WHERE release_speed IS NOT NULL AND release_spin_rate IS NOT NULL AND launch_speed IS NOT NULL AND launch_angle IS NOT NULL""",
)
def complete_pitches(spark, folder):
    columns = ["release_speed", "release_spin_rate", "launch_speed", "launch_angle"]
    return shape.require_all(pitches(spark, folder), columns).select("event_id", *columns)


@register(
    "P8 F2",
    """SELECT o_orderstatus, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders
       WHERE o_orderdate <= TIMESTAMP '1998-06-30' AND year(o_orderdate) < 1998 AND year(o_orderdate) > 1995 GROUP BY 1""",
)
def orders_until(spark, folder):
    orders = read_table(spark, folder, "orders").withColumn("o_year", F.year("o_orderdate"))
    kept = shape.as_of(orders, date="o_orderdate", until="1998-06-30", year="o_year", before_year=1998, after_year=1995)
    return kept.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day")
    )


@register(
    "P9",
    f"""WITH {PITCH_SQL}
    SELECT event_id, sz_top, sz_bot FROM pitches
    WHERE stand = 'R' AND sz_top >= 3.3E0 AND sz_top <= 3.5E0 AND sz_bot <= 1.7E0 AND sz_bot >= 1.5E0""",
)
def cohort_pitches(spark, folder):
    return shape.in_ranges(pitches(spark, folder), COHORT_RANGES, {"stand": COHORT_STAND}).select(
        "event_id", "sz_top", "sz_bot"
    )


@register(
    "P10 A9",
    "SELECT DISTINCT user_id, event_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'",
)
def users_on_day(spark, folder):
    return shape.distinct_on_day(
        read_table(spark, folder, "events"), "ts", "2024-01-05", ["user_id", "event_type"]
    )


@register(
    "P11",
    f"""WITH {PITCH_SQL}
    SELECT game_type, pitch_type, count(*) AS n FROM pitches
    WHERE pitch_type <> 'PO' AND pitch_type IS NOT NULL AND game_type NOT IN ('E', 'S') GROUP BY ALL""",
)
def regular_pitches(spark, folder):
    rows = shape.exclude(shape.exclude(pitches(spark, folder), "pitch_type", ["PO"]), "game_type", ["E", "S"])
    return rows.groupBy("game_type", "pitch_type").agg(F.count(F.lit(1)).alias("n"))


@register(
    "P12",
    """SELECT s_suppkey AS supplier, s_name AS supplier_name, s_acctbal AS balance_main FROM supplier""",
)
def supplier_columns(spark, folder):
    supplier = read_table(spark, folder, "supplier")
    slim = shape.reshape(
        supplier,
        drop=["s_nationkey", "no_such_column"],
        rename={"s_suppkey": "supplier", "s_name": "supplier_name", "s_acctbal": "balance", "absent": "x"},
        keep=["supplier", "supplier_name", "balance", "absent"],
    )
    return shape.add_suffix(slim.select("supplier", "supplier_name", "balance"), "_main", except_for=["supplier", "supplier_name"])


@register(
    "P13",
    """SELECT p_type, count(*) AS n FROM part WHERE nullif(p_type, 'ECONOMY') IS NOT NULL GROUP BY 1""",
)
def parts_without_sentinel(spark, folder):
    part = shape.drop_sentinel(read_table(spark, folder, "part"), "p_type", "ECONOMY")
    return part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@register(
    "P14",
    """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
       WHERE l_returnflag IN ('A', 'R') GROUP BY 1""",
)
def listed_flags(spark, folder):
    rows = shape.members(read_table(spark, folder, "lineitem"), "l_returnflag", ["A", "R"])
    return rows.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@register(
    "P15 P16 A11",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         round((coalesce(l_extendedprice, 0) + coalesce(nullif(l_discount, 0), 0) + coalesce(nullif(l_tax, 0), 0))
           / (1 + CASE WHEN nullif(l_discount, 0) IS NULL THEN 0 ELSE 1 END + CASE WHEN nullif(l_tax, 0) IS NULL THEN 0 ELSE 1 END), 4) + 0.0 AS price_mean
       FROM lineitem""",
)
def mean_from_column_pattern(spark, folder):
    """Mean over the first column whose name holds ``price`` and the next two, zeros as NULL."""
    lineitem = read_table(spark, folder, "lineitem")
    lineitem = lineitem.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in ("l_discount", "l_tax")})
    columns = shape.columns_from(lineitem, "price", 3)
    columns = [c for c in columns if c in shape.columns_by_type(lineitem)["numeric"]]
    return lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", num.plain(num.row_mean(columns), 4).alias("price_mean")
    )


@register(
    "P17",
    """SELECT n_nationkey, n_name, CASE WHEN n_name = 'NATION_3' THEN 109 ELSE r_regionkey END AS region_code
       FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def patched_region_codes(spark, folder):
    nation, region = read_table(spark, folder, "nation"), read_table(spark, folder, "region")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
    return joined.select(
        "n_nationkey", "n_name", cat.override(F.col("r_regionkey"), F.col("n_name"), {"NATION_3": 109}).alias("region_code")
    )


@register(
    "P18",
    """SELECT 'l_quantity' AS "left", 'copy' AS "right", bool_and(l_quantity IS NOT DISTINCT FROM l_quantity + 0) AS same FROM lineitem
       UNION ALL SELECT 'l_discount', 'l_tax', bool_and(l_discount IS NOT DISTINCT FROM l_tax) FROM lineitem""",
)
def equal_columns(spark, folder):
    rows = read_table(spark, folder, "lineitem").withColumn("copy", F.col("l_quantity") + 0.0)
    return shape.same_everywhere(rows, [("l_quantity", "copy"), ("l_discount", "l_tax")])


@register(
    "T1",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey""",
)
def orders_sorted(spark, folder):
    rows = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return shape.sort_by(rows, ["o_custkey", "-o_totalprice", "o_orderkey"])


@register(
    "T2 W10 A9",
    """SELECT DISTINCT user_id, event_type FROM (
         SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
       WHERE rn <= 20""",
)
def latest_event_types(spark, folder):
    events = read_table(spark, folder, "events")
    return shape.latest_distinct(events, ["user_id"], ["event_type"], ["-ts", "-event_id"], 20)


@register(
    "T3 P9",
    f"""WITH {PITCH_SQL}
    SELECT event_id, launch_speed, launch_angle FROM pitches
    WHERE stand = 'R' AND sz_top BETWEEN 3.3E0 AND 3.5E0 AND sz_bot BETWEEN 1.5E0 AND 1.7E0
    ORDER BY game_date, event_id LIMIT 2500""",
)
def bounded_default_cohort(spark, folder):
    rows = shape.in_ranges(pitches(spark, folder), COHORT_RANGES, {"stand": COHORT_STAND})
    return shape.bounded_cohort(rows, ["game_date", "event_id"], 2500).select("event_id", "launch_speed", "launch_angle")


@register(
    "T4",
    """SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey""",
)
def parts_by_price(spark, folder):
    rows = read_table(spark, folder, "part")
    return shape.reshape(shape.sort_by(rows, ["-p_retailprice", "p_partkey"]), keep=["p_partkey", "p_name", "p_retailprice"])


@register(
    "T5",
    """SELECT c_mktsegment, c_custkey, c_acctbal FROM (
         SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(c_acctbal - 5000.0E0), c_custkey) AS rn FROM customer)
       WHERE rn = 1""",
)
def closest_balance(spark, folder):
    rows = read_table(spark, folder, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return shape.closest_row(rows, ["c_mktsegment"], F.col("c_acctbal"), 5000.0, F.col("c_custkey"))


@register(
    "U1",
    """SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer
       UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier""",
)
def stacked_accounts(spark, folder):
    customer = read_table(spark, folder, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")
    )
    supplier = read_table(spark, folder, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")
    )
    return shape.stack_rows(customer, supplier)


@register(
    "U2",
    """SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders""",
)
def aligned_order_columns(spark, folder):
    orders = read_table(spark, folder, "orders")
    return shape.side_by_side(
        orders.select("o_orderkey", "o_totalprice"),
        orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"),
        ["o_orderkey"],
    )


@register(
    "U3",
    """SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'right' ELSE 'left' END AS missing_in
       FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') a
       FULL OUTER JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') b ON a.o_custkey = b.o_custkey
       WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL""",
)
def customers_of_one_status(spark, folder):
    orders = read_table(spark, folder, "orders")
    return shape.label_difference(
        orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"), "o_custkey"
    )


@register(
    "U4 U5 A6",
    """WITH d AS (SELECT * FROM (VALUES ('click'), ('view'), ('purchase'), ('refund')) a(event_type), (VALUES (0), (1)) b(large))
       SELECT d.event_type, d.large, coalesce(c.n, 0) AS n
       FROM d LEFT JOIN (SELECT event_type, CASE WHEN value > 50 THEN 1 ELSE 0 END AS large, count(*) AS n FROM events GROUP BY ALL) c
         ON d.event_type = c.event_type AND d.large = c.large""",
)
def counts_on_domain(spark, folder):
    events = read_table(spark, folder, "events")
    counts = events.groupBy("event_type", (F.col("value") > 50).cast("int").alias("large")).agg(F.count(F.lit(1)).alias("n"))
    domain = shape.domain_product(spark, {"event_type": ["click", "view", "purchase", "refund"], "large": [0, 1]})
    return shape.reindex_counts(counts, domain, ["event_type", "large"], "n")


@register(
    "F1",
    f"""WITH {PITCH_SQL}
    SELECT event_id, round(-(180 / pi()) * atan2(hc_x - 130, 213 - hc_y) + 90) + 0.0 AS spray_angle FROM pitches""",
)
def spray_angles(spark, folder):
    return pitches(spark, folder).select("event_id", num.plain(num.spray_angle("hc_x", "hc_y"), 0).alias("spray_angle"))


@register(
    "F2 F3 F10",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_year, strftime(o_orderdate, '%m/%d/%Y') AS us_day,
         strftime(CAST(o_orderdate AS DATE) - 2, '%Y-%m-%d') AS two_days_prior,
         strftime(CAST(o_orderdate AS DATE) + INTERVAL 19 HOUR + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M') AS start_time,
         TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority_number
       FROM orders""",
)
def order_date_parts(spark, folder):
    orders = read_table(spark, folder, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.select(
        "o_orderkey",
        F.year(txt.parse_day(text)).alias("o_year"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_day"),
        F.date_format(txt.days_before("o_orderdate", 2), "yyyy-MM-dd").alias("two_days_prior"),
        F.date_format(txt.clock_to_timestamp("o_orderdate", F.lit("7:05 PM ET")), "yyyy-MM-dd HH:mm").alias("start_time"),
        num.to_number(F.substring("o_orderpriority", 1, 1), "int").alias("priority_number"),
    )


@register(
    "F4 F5",
    """SELECT p_partkey,
         CASE WHEN length(split_part(name, ' ', 1)) = 2 THEN split_part(name, ' ', 1) || substr(split_part(name, ' ', 2), 1, 1)
              ELSE split_part(name, ' ', 1) END AS code,
         regexp_replace(name || ': ' || p_type, ':.+', '') AS bare,
         regexp_extract(p_brand, '#([0-9]+)', 1) AS brand_number
       FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN substr(p_name, 1, 2) || ' ' || p_type ELSE p_name END AS name FROM part)""",
)
def part_codes(spark, folder):
    part = read_table(spark, folder, "part").withColumn(
        "name",
        F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", F.substring("p_name", 1, 2), "p_type")).otherwise(F.col("p_name")),
    )
    return part.select(
        "p_partkey",
        txt.team_code("name").alias("code"),
        txt.strip_tail(F.concat_ws(": ", "name", "p_type")).alias("bare"),
        F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("brand_number"),
    )


@register(
    "F6 F7 F10",
    """SELECT o_orderkey,
         round_even(CASE WHEN q > 0 THEN 1 / (q / 100 + 1) ELSE 1 - 1 / (-q / 100 + 1) END, 4) AS implied,
         CASE WHEN p > 0 AND p < 1 THEN CAST(round_even(CASE WHEN p > 0.5E0 THEN -(p / (1 - p)) * 100 ELSE 100 / p - 100 END, 0) AS BIGINT) END AS price,
         p > 0 AND p < 1 AS valid
       FROM (SELECT o_orderkey, CAST(CAST(o_orderkey % 900 AS BIGINT) + 101 AS DOUBLE) * CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS q,
               (o_custkey % 101) / 100.0E0 AS p FROM orders)""",
)
def odds_and_probabilities(spark, folder):
    orders = read_table(spark, folder, "orders")
    number = (F.col("o_orderkey") % 900 + 101).cast("string")
    quoted = F.concat(F.when(F.col("o_orderstatus") == "F", "-").otherwise("+"), number)
    p = F.col("o_custkey") % 101 / 100.0
    return orders.select(
        "o_orderkey",
        num.implied_probability(quoted).alias("implied"),
        num.american_odds(p).alias("price"),
        num.is_priceable(p).alias("valid"),
    )


@register(
    "F8",
    """SELECT l_suppkey, round(sum(ln(l_discount + 1e-10)), 4) + 0.0 AS log_sum FROM lineitem GROUP BY 1""",
)
def safe_log_sums(spark, folder):
    return read_table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        num.plain(F.sum(num.safe_log("l_discount")), 4).alias("log_sum")
    )


@register(
    "F9",
    """SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - 0.5E0) / 50.0E0, 6) AS p, 0.0E0 AS gap,
         CASE WHEN l_quantity = 25.5 THEN 0 WHEN l_quantity < 25.5 THEN -1 ELSE 1 END AS score_sign FROM lineitem""",
)
def normal_round_trip(spark, folder):
    """Normal score of the quantity share and the way back."""
    rows = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", ((F.col("l_quantity") - 0.5) / 50.0).alias("p")
    )
    rows = add_normal_cdf(add_normal_quantile(rows, "p", "score"), "score", "back")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round("p", 6).alias("p"),
        num.plain(F.col("back") - F.col("p"), 9).alias("gap"),
        F.signum("score").cast("int").alias("score_sign"),
    )


@register(
    "S2",
    """SELECT n_name, count(*) AS customers, round(avg(c_acctbal) + 1e-9, 4) AS mean_balance FROM customer
       JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 100 AND c_mktsegment <> 'MACHINERY' GROUP BY 1""",
)
def bound_sql_text(spark, folder):
    return query(
        spark,
        """SELECT n_name, count(*) AS customers, round(avg(c_acctbal) + 1e-9, 4) AS mean_balance
           FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
           WHERE c_acctbal > :least AND c_mktsegment <> :segment GROUP BY n_name""",
        {"customer": read_table(spark, folder, "customer"), "nation": read_table(spark, folder, "nation")},
        least=100,
        segment="MACHINERY",
    )
