"""Grouped statistics and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchframe.functions.numbers import plain, settled
from pitchframe.operators import aggregate as agg
from pitchframe.operators.quantiles import exact_quantiles, summarize
from pitchframe.operators.sampling import mean_drawn_counts
from pitchframe.operators.shape import as_of
from pitchframe.plans import scores
from pitchframe.sources.tables import read_table
from pitchframe.suite import register
from pitchframe.suite.standin import PITCH_SQL, pitches


@register(
    "A2 A3 A5 W5 P8 P11",
    """WITH c AS (SELECT l_suppkey, l_returnflag, avg(CASE WHEN l_linestatus = 'F' THEN 1.0E0 ELSE 0.0E0 END) * 100 AS rate
                  FROM lineitem WHERE l_returnflag IS NOT NULL AND l_shipdate <= TIMESTAMP '2002-01-01' GROUP BY 1, 2 HAVING count(*) >= 200),
            z AS (SELECT l_suppkey, l_returnflag, coalesce((rate - avg(rate) OVER w) / nullif(stddev_pop(rate) OVER w, 0), 0) AS z
                  FROM c WINDOW w AS (PARTITION BY l_returnflag))
       SELECT l_suppkey, round(coalesce(max(z) FILTER (l_returnflag = 'A'), 0), 6) + 0.0 AS z_A,
         round(coalesce(max(z) FILTER (l_returnflag = 'N'), 0), 6) + 0.0 AS z_N,
         round(coalesce(max(z) FILTER (l_returnflag = 'R'), 0), 6) + 0.0 AS z_R FROM z GROUP BY 1""",
)
def standardized_rates_wide(spark, folder):
    """Flagship: share of finished lines per supplier and flag, standardised per flag, wide."""
    lines = as_of(read_table(spark, folder, "lineitem"), date="l_shipdate", until="2002-01-01")
    lines = lines.where(F.col("l_returnflag").isNotNull())
    z = scores.standardized_rates(lines, "l_suppkey", "l_returnflag", agg.rate_percent(F.col("l_linestatus") == "F"), 200)
    wide = scores.wide_scores(z, "l_suppkey", "l_returnflag", ["A", "N", "R"], "z_")
    return wide.select("l_suppkey", *[plain(F.col(c)).alias(c) for c in ("z_A", "z_N", "z_R")])


@register(
    "A1",
    f"""WITH {PITCH_SQL}
    SELECT batter, round(avg(sz_top), 3) AS sz_top, round(avg(sz_bot), 3) AS sz_bot FROM pitches
    WHERE sz_top IS NOT NULL AND sz_bot IS NOT NULL GROUP BY 1""",
)
def strike_zone_lookup(spark, folder):
    return scores.strike_zones(pitches(spark, folder))


@register(
    "A1 A4",
    """SELECT user_id, round(avg(value) + 1e-9, 6) AS value FROM events WHERE value IS NOT NULL GROUP BY 1""",
)
def mean_value_per_user(spark, folder):
    means = agg.group_means(read_table(spark, folder, "events"), ["user_id"], ["value"])
    return means.withColumn("value", settled(F.col("value"), 6))


@register(
    "A2 A3",
    """SELECT user_id, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 100.0E0 ELSE 0.0E0 END) + 1e-9, 6) AS error_rate
       FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 60 AND count(*) FILTER (event_type = 'error') >= 15)
       GROUP BY 1""",
)
def large_user_groups(spark, folder):
    events = read_table(spark, folder, "events")
    kept = agg.keep_large_groups(events, ["user_id"], 60)
    kept = agg.keep_large_groups(kept, ["user_id"], 15, F.col("event_type") == "error")
    return kept.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), settled(agg.rate_percent(F.col("event_type") == "error"), 6).alias("error_rate")
    )


@register(
    "A5",
    """SELECT user_id, count(*) FILTER (event_type = 'click') + 0.0E0 AS click, count(*) FILTER (event_type = 'view') + 0.0E0 AS "view" FROM events GROUP BY 1""",
)
def event_pivot(spark, folder):
    counts = read_table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return agg.pivot_values(counts, ["user_id"], "event_type", "n", ["click", "view"])


@register(
    "A6",
    """SELECT o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1""",
)
def priority_shares(spark, folder):
    shares = agg.frequencies(read_table(spark, folder, "orders"), ["o_orderpriority"])
    return shares.withColumn("share", F.round("share", 6))


@register(
    "A7",
    "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL",
)
def line_group_sizes(spark, folder):
    return read_table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "A8 F2",
    """SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
         strftime(CAST(max(ts) AS DATE) - 2, '%Y-%m-%d') AS look_back FROM events""",
)
def high_water_mark(spark, folder):
    shown = "yyyy-MM-dd HH:mm:ss"
    return read_table(spark, folder, "events").agg(
        F.date_format(F.min("ts"), shown).alias("first_ts"),
        F.date_format(F.max("ts"), shown).alias("last_ts"),
        F.date_format(F.date_sub(F.max("ts").cast("date"), 2), "yyyy-MM-dd").alias("look_back"),
    )


@register("A9", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_supplier_flags(spark, folder):
    return read_table(spark, folder, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@register(
    "A10",
    """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
       SELECT o_orderstatus, o_orderpriority, n, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS p FROM c""",
)
def priority_given_status(spark, folder):
    dist = agg.conditional_distribution(read_table(spark, folder, "orders"), ["o_orderstatus"], ["o_orderpriority"])
    return dist.withColumn("p", F.round("p", 6))


@register(
    "A10",
    """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
       SELECT o_orderstatus, count(*) AS outcomes, round(sum(n) FILTER (o_orderpriority = '1-URGENT') / sum(n), 6) AS p_urgent FROM c GROUP BY 1""",
)
def distribution_maps(spark, folder):
    dist = agg.conditional_distribution(read_table(spark, folder, "orders"), ["o_orderstatus"], ["o_orderpriority"])
    maps = agg.distribution_map(dist, ["o_orderstatus"], "o_orderpriority", "p")
    return maps.select(
        "o_orderstatus",
        F.size("distribution").cast("long").alias("outcomes"),
        F.round(F.try_element_at("distribution", F.lit("1-URGENT")), 6).alias("p_urgent"),
    )


@register(
    "A13",
    """SELECT l_shipdate_year, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0E0 ELSE 0.0E0 END), 6) AS p_discounted
       FROM (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS l_shipdate_year FROM lineitem) GROUP BY 1""",
)
def discount_probability(spark, folder):
    lines = read_table(spark, folder, "lineitem").withColumn("l_shipdate_year", F.year("l_shipdate"))
    return lines.groupBy("l_shipdate_year").agg(F.round(agg.probability(F.col("l_discount") > 0.05), 6).alias("p_discounted"))


_SUMMARY = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}) + 1e-9, 4) AS mean, round(stddev_samp({c}) + 1e-9, 4) AS std, min({c}) AS "min",
        round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS "max" FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)


@register("A14 M27", _SUMMARY)
def line_summary(spark, folder):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rounded = {c: settled(F.col(c), 4) for c in ("mean", "std")} | {c: F.round(c, 6) for c in ("q25", "q50", "q75")}
    return summarize(read_table(spark, folder, "lineitem"), columns).withColumns(rounded)


@register(
    "M27 A14",
    " UNION ALL ".join(
        f"""SELECT l_returnflag, 'l_extendedprice' AS "column", {p}E0 AS p, round(quantile_cont(l_extendedprice, {p}), 4) AS quantile FROM lineitem GROUP BY 1"""
        for p in (0.05, 0.5, 0.95)
    ),
)
def price_quantiles_by_flag(spark, folder):
    q = exact_quantiles(read_table(spark, folder, "lineitem"), ["l_extendedprice"], [0.05, 0.5, 0.95], ["l_returnflag"])
    return q.withColumn("quantile", F.round("quantile", 4))


_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS correlation, round(covar_samp({a}, {b}), 4) + 0.0 AS covariance FROM lineitem"
    for a, b in [
        ("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"),
        ("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice"), ("l_discount", "l_discount"),
    ]
)


@register("A15", _PAIRS)
def line_correlations(spark, folder):
    matrix = agg.pair_matrix(read_table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return matrix.withColumns(
        {"correlation": plain(F.col("correlation")), "covariance": plain(F.col("covariance"), 4)}
    )


@register(
    "A16",
    f"""WITH {PITCH_SQL}
    SELECT round(avg(CASE WHEN on_1b IS NULL AND on_2b IS NULL AND on_3b IS NULL THEN 1.0E0 ELSE 0.0E0 END), 6) AS share FROM pitches""",
)
def empty_bases_share(spark, folder):
    share = agg.all_null_share(pitches(spark, folder), ["on_1b", "on_2b", "on_3b"])
    return share.withColumn("share", F.round("share", 6))


@register(
    "A17",
    """SELECT l_linestatus, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std,
         round(avg(l_tax), 6) AS l_tax_mean, round(stddev_samp(l_tax), 6) AS l_tax_std FROM lineitem GROUP BY 1""",
)
def line_moments(spark, folder):
    moments = agg.describe_moments(read_table(spark, folder, "lineitem"), ["l_linestatus"], ["l_quantity", "l_tax"])
    return moments.select("l_linestatus", *[F.round(c, 6).alias(c) for c in moments.columns[1:]])


@register(
    "A18",
    f"""WITH {PITCH_SQL}
    SELECT 'pitch_type' AS "column", 'string' AS type, count(pitch_type) AS present, count(*) - count(pitch_type) AS missing FROM pitches
    UNION ALL SELECT 'on_1b', 'bigint', count(on_1b), count(*) - count(on_1b) FROM pitches
    UNION ALL SELECT 'launch_speed', 'double', count(launch_speed), count(*) - count(launch_speed) FROM pitches""",
)
def pitch_column_profile(spark, folder):
    return agg.column_profile(pitches(spark, folder).select("pitch_type", "on_1b", "launch_speed"))


@register(
    "A19 M16",
    """WITH d AS (SELECT unnest(range(1, 21)) AS draw),
       x AS (SELECT draw, ((event_id * 7919 + draw * 104729) % 10007) / 10007.0E0 AS u, event_type FROM events, d),
       c AS (SELECT draw, CASE WHEN u < 0.2E0 THEN 'low' WHEN u < CASE WHEN event_type = 'error' THEN 0.5E0 ELSE 0.9E0 END THEN 'middle' ELSE 'high' END AS class, count(*) AS n FROM x GROUP BY ALL)
       SELECT class, round(avg(n), 4) AS mean_count FROM c GROUP BY 1""",
)
def mean_counts_over_draws(spark, folder):
    u = ((F.col("event_id") * 7919 + F.col("draw") * 104729) % 10007) / 10007.0
    edge = F.when(F.col("event_type") == "error", 0.5).otherwise(0.9)
    drawn = F.when(u < 0.2, "low").when(u < edge, "middle").otherwise("high")
    counts = mean_drawn_counts(read_table(spark, folder, "events"), drawn, 20)
    return counts.withColumn("mean_count", F.round("mean_count", 4))


@register(
    "A17 W6",
    """WITH t AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS "year", c_nationkey AS entity_id, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS oaa_rhh, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS oaa_lhh
                  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
       SELECT "year", entity_id, round(oaa_rhh + 1e-9, 2) AS oaa_rhh, round(oaa_lhh + 1e-9, 2) AS oaa_lhh,
         round((oaa_rhh - avg(oaa_rhh) OVER w) / nullif(stddev_samp(oaa_rhh) OVER w, 0), 6) + 0.0 AS oaa_rhh_standardized,
         round((oaa_lhh - avg(oaa_lhh) OVER w) / nullif(stddev_samp(oaa_lhh) OVER w, 0), 6) + 0.0 AS oaa_lhh_standardized
       FROM t WINDOW w AS (PARTITION BY "year")""",
)
def standardized_sides(spark, folder):
    orders, customer = read_table(spark, folder, "orders"), read_table(spark, folder, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    of = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    table = joined.groupBy(F.year("o_orderdate").cast("string").alias("year"), F.col("c_nationkey").alias("entity_id")).agg(
        of("F").alias("outs_above_average_rhh"), of("O").alias("outs_above_average_lhh")
    )
    scored = scores.fielding_scores(table)
    return scored.select(
        "year",
        "entity_id",
        *[settled(F.col(c), 2).alias(c) for c in ("oaa_rhh", "oaa_lhh")],
        *[plain(F.col(c)).alias(c) for c in ("oaa_rhh_standardized", "oaa_lhh_standardized")],
    )
