"""Encodings, draws, likelihoods, chi-square tests, reports and synthetic rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchframe.functions.numbers import plain
from pitchframe.operators import encode, metrics, sampling, synth
from pitchframe.operators.aggregate import conditional_distribution, frequencies
from pitchframe.operators.standardize import min_max_scale, standard_scale
from pitchframe.sources.tables import read_table
from pitchframe.suite import register

_CUT = "2024-01-16 00:00:00"


def _before_cut():
    return F.col("ts") < F.lit(_CUT).cast("timestamp_ntz")


@register(
    "M1",
    """SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) - 1 AS name_code, p_name AS decoded FROM part""",
)
def part_name_codes(spark, folder):
    part = read_table(spark, folder, "part")
    codes = encode.label_codes(part, "p_name")
    coded = encode.encode_labels(part, "p_name", codes, "name_code")
    return encode.decode_labels(coded, "name_code", codes, "decoded", label="p_name").select("p_partkey", "name_code", "decoded")


@register(
    "M2",
    """WITH c AS (SELECT p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part WHERE p_size <= 1))
       SELECT p_partkey, coalesce(code, -1) AS name_code FROM part LEFT JOIN c USING (p_name)""",
)
def part_name_ordinals(spark, folder):
    part = read_table(spark, folder, "part")
    codes = encode.label_codes(part.where("p_size <= 1"), "p_name")
    return encode.ordinal_encode(part, "p_name", codes, "name_code").select("p_partkey", "name_code")


@register(
    "M3 M4",
    """SELECT l_orderkey, l_linenumber, l_partkey,
         round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS q_unit,
         round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) + 0.0 AS price_score FROM lineitem""",
)
def scaled_lines(spark, folder):
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    scaled = standard_scale(min_max_scale(lines, ["l_quantity"], "_unit"), ["l_extendedprice"], "_score")
    return scaled.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round("l_quantity_unit", 6).alias("q_unit"), plain(F.col("l_extendedprice_score")).alias("price_score"),
    )


@register(
    "M5",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_click, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS is_view,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_error FROM events""",
)
def event_one_hot(spark, folder):
    hot = encode.one_hot(read_table(spark, folder, "events"), "event_type", ["click", "view", "error"])
    return hot.select("event_id", "is_click", "is_view", "is_error")


@register(
    "M14 U3 W10",
    """WITH tr AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), te AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
       SELECT 'train' AS part, * FROM tr UNION ALL SELECT 'test', * FROM te
       UNION ALL SELECT 'train', min(o_orderkey), o_custkey FROM te WHERE o_custkey NOT IN (SELECT o_custkey FROM tr) GROUP BY o_custkey
       UNION ALL SELECT 'test', min(o_orderkey), o_custkey FROM tr WHERE o_custkey NOT IN (SELECT o_custkey FROM te) GROUP BY o_custkey""",
)
def balanced_split(spark, folder):
    orders = read_table(spark, folder, "orders")
    edge = F.lit("1998-01-01").cast("timestamp_ntz")
    columns = ["o_orderkey", "o_custkey"]
    train, test = encode.balance_classes(
        orders.where(F.col("o_orderdate") < edge).select(*columns),
        orders.where(F.col("o_orderdate") >= edge).select(*columns),
        "o_custkey",
        ["o_orderkey"],
    )
    return train.select(F.lit("train").alias("part"), *columns).unionByName(test.select(F.lit("test").alias("part"), *columns))


@register(
    "M16 J13",
    """WITH d AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL),
            c AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY p) AS upto, sum(n) OVER (PARTITION BY s) AS total FROM d)
       SELECT o_orderkey, c.p AS drawn FROM orders JOIN c ON o_orderstatus = s
         AND ((o_orderkey * 7919) % 10007) / 10007.0E0 >= (upto - n) / total AND ((o_orderkey * 7919) % 10007) / 10007.0E0 < upto / total""",
)
def drawn_priorities(spark, folder):
    orders = read_table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", ((F.col("o_orderkey") * 7919 % 10007) / 10007.0).alias("u")
    )
    dist = orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    dist = dist.withColumnRenamed("o_orderpriority", "drawn")
    drawn = sampling.draw(orders.drop("o_orderpriority"), dist, ["o_orderstatus"], ["drawn"], "n", "u")
    return drawn.select("o_orderkey", "drawn")


_RULE = "CASE WHEN n_chars > 600 THEN 1 ELSE 0 END"


def _labelled(spark, folder):
    documents = read_table(spark, folder, "documents").select("doc_id", "n_chars")
    rows = read_table(spark, folder, "labels").join(documents, "doc_id")
    return rows.withColumn("predicted", F.when(F.col("n_chars") > 600, 1).otherwise(0))


@register(
    "M17 F8",
    f"""SELECT round(avg(-ln(CASE WHEN quality = {_RULE} THEN 0.7E0 ELSE 0.3E0 END)), 6) AS log_loss,
         round(sum(ln(CASE WHEN quality = {_RULE} THEN 0.7E0 ELSE 0.3E0 END)), 4) AS log_likelihood
       FROM labels JOIN documents USING (doc_id)""",
)
def rule_log_loss(spark, folder):
    rows = _labelled(spark, folder)
    p = F.when(F.col("quality") == F.col("predicted"), 0.7).otherwise(0.3)
    loss = metrics.log_loss(rows, p).withColumn("log_loss", F.round("log_loss", 6))
    likelihood = metrics.log_likelihood(rows, p).select(F.round("log_likelihood", 4)).scalar()
    return loss.withColumn("log_likelihood", likelihood)


@register(
    "M18 A6 J5",
    f"""WITH tr AS (SELECT * FROM events WHERE ts < TIMESTAMP '{_CUT}'), s AS (SELECT event_type, count(*) / (SELECT count(*) FROM tr) AS p FROM tr GROUP BY 1)
       SELECT round(sum(ln(p)), 4) AS log_likelihood, count(*) AS n FROM events JOIN s USING (event_type) WHERE ts >= TIMESTAMP '{_CUT}'""",
)
def baseline_log_likelihood(spark, folder):
    events = read_table(spark, folder, "events")
    scored = metrics.with_baseline_probability(events.where(_before_cut()), events.where(~_before_cut()), "event_type")
    return scored.agg(
        F.round(F.sum(F.log("p_baseline")), 4).alias("log_likelihood"), F.count("p_baseline").alias("n")
    )


@register(
    "M19 U5",
    f"""WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '{_CUT}' GROUP BY ALL),
            o AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{_CUT}' GROUP BY ALL)
       SELECT o.user_id, CASE WHEN count(*) FILTER (coalesce(e.n, 0) = 0) = 0 THEN round(sum((o.n - e.n) ** 2 / e.n), 6) END AS statistic, count(*) - 1 AS dof
       FROM o LEFT JOIN e ON o.user_id = e.user_id AND o.event_type = e.event_type GROUP BY 1""",
)
def goodness_of_fit_per_user(spark, folder):
    counts = lambda rows: rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    events = read_table(spark, folder, "events")
    tests = metrics.goodness_of_fit(
        counts(events.where(~_before_cut())), counts(events.where(_before_cut())), ["event_type"], "n", ["user_id"]
    )
    return tests.select("user_id", F.round("statistic", 6).alias("statistic"), "dof")


@register(
    "M19",
    f"""WITH e AS (SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '{_CUT}' GROUP BY 1),
            o AS (SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{_CUT}' GROUP BY 1),
            s AS (SELECT sum((o.n - e.n) ** 2 / e.n) AS x, count(*) - 1 AS dof FROM o JOIN e USING (event_type))
       SELECT round(x, 6) AS statistic, dof, round(exp(-x / 2) * (1 + x / 2), 9) AS p_value FROM s""",
)
def goodness_of_fit_p_values(spark, folder):
    """One test over all rows; with its four degrees of freedom the tail has a short closed form."""
    events = read_table(spark, folder, "events")
    first = frequencies(events.where(_before_cut()), ["event_type"])
    second = frequencies(events.where(~_before_cut()), ["event_type"])
    test = metrics.goodness_of_fit(second, first, ["event_type"], "n")
    return test.select(F.round("statistic", 6).alias("statistic"), "dof", F.round("p_value", 9).alias("p_value"))


def _chain_sql(classes: int) -> str:
    """Counts drawn class by class: the first count whose cumulative binomial probability reaches the draw's number."""
    steps = []
    for j in range(1, classes):
        steps.append(
            f"""t{j} AS (SELECT DISTINCT d.g, d.left_n, c.p / c.rest AS share FROM d{j - 1} d JOIN cells c ON c.g = d.g AND c.j = {j}),
            q{j} AS (SELECT g, left_n, k, sum(exp(lgamma(left_n + 1) - lgamma(k + 1) - lgamma(left_n - k + 1) + k * ln(share) + (left_n - k) * ln(1 - share)))
                OVER (PARTITION BY g, left_n ORDER BY k) AS upto FROM (SELECT *, unnest(range(left_n + 1)) AS k FROM t{j})),
            d{j} AS (SELECT d.*  EXCLUDE (left_n), q.k AS k{j}, d.left_n - q.k AS left_n FROM d{j - 1} d ASOF JOIN q{j} q
                ON d.g = q.g AND d.left_n = q.left_n AND {_draw_number("draw", j)} <= q.upto)"""
        )
    return ",\n".join(steps)


def _draw_number(draw, position):
    """An arithmetic number in (0, 1) for both engines."""
    return f"((({draw}) * 104729 + ({position}) * 1299709) % 1000003 + 0.5E0) / 1000003"


_TYPES_SQL = "SELECT user_id % 3 AS g, event_type, count(*) AS n FROM events WHERE ts {sign} TIMESTAMP '" + _CUT + "' GROUP BY ALL"


@register(
    "M19",
    f"""WITH e AS ({_TYPES_SQL.format(sign="<")}), o AS ({_TYPES_SQL.format(sign=">=")}),
    cells AS (SELECT e.g, e.event_type, row_number() OVER w AS j, e.n / sum(e.n) OVER (PARTITION BY e.g) AS p, coalesce(o.n, 0) AS o,
        sum(e.n) OVER (PARTITION BY e.g ORDER BY e.event_type ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / sum(e.n) OVER (PARTITION BY e.g) AS rest
      FROM e LEFT JOIN o ON e.g = o.g AND e.event_type = o.event_type WINDOW w AS (PARTITION BY e.g ORDER BY e.event_type)),
    d0 AS (SELECT g, draw, left_n FROM (SELECT g, CAST(sum(o) AS BIGINT) AS left_n FROM cells GROUP BY g), (SELECT unnest(range(1, 1001)) AS draw)),
    {_chain_sql(5)},
    long AS (SELECT g, draw, unnest([k1, k2, k3, k4, left_n]) AS d, unnest([1, 2, 3, 4, 5]) AS j FROM d4),
    x AS (SELECT l.g, draw, sum((o - d) ** 2 / d) AS x, count(*) FILTER (d = 0) AS none FROM long l JOIN cells c ON l.g = c.g AND l.j = c.j WHERE o > 0 GROUP BY ALL)
    SELECT g, count(*) AS draws, count(*) FILTER (none > 0 OR exp(-x / 2) * (1 + x / 2) < 0.05) AS different,
      count(*) FILTER (none > 0 OR exp(-x / 2) * (1 + x / 2) < 0.05) / count(*) AS share_different FROM x GROUP BY g""",
)
def repeated_goodness_of_fit(spark, folder):
    """How many of 1000 drawn samples of the later events differ from the observed ones, with arithmetic uniform numbers."""
    events = read_table(spark, folder, "events").withColumn("g", F.col("user_id") % 3)
    count = lambda rows: rows.groupBy("g", "event_type").agg(F.count(F.lit(1)).alias("n"))
    shares = conditional_distribution(events.where(_before_cut()), ["g"], ["event_type"])
    number = lambda draw, position: ((draw * 104729 + position * 1299709) % 1000003 + 0.5) / 1000003.0
    return metrics.repeated_goodness_of_fit(count(events.where(~_before_cut())), shares, ["g"], "event_type", u=number)


@register(
    "M20",
    f"""WITH c AS (SELECT ts < TIMESTAMP '{_CUT}' AS early, event_type, count(*) AS o FROM events GROUP BY ALL),
            e AS (SELECT *, sum(o) OVER (PARTITION BY early) * sum(o) OVER (PARTITION BY event_type) / sum(o) OVER () AS e FROM c)
       SELECT round(sum((o - e) ** 2 / e), 6) AS statistic, CAST((count(DISTINCT early) - 1) * (count(DISTINCT event_type) - 1) AS BIGINT) AS dof FROM e""",
)
def contingency_of_halves(spark, folder):
    events = read_table(spark, folder, "events").withColumn("early", _before_cut())
    test = metrics.contingency(events, "early", "event_type")
    return test.select(F.round("statistic", 6).alias("statistic"), "dof")


@register(
    "M21",
    f"""WITH r AS (SELECT quality, {_RULE} AS predicted FROM labels JOIN documents USING (doc_id)), k AS (SELECT unnest([0, 1]) AS class)
       SELECT class, round(coalesce(count(*) FILTER (quality = class AND predicted = class) / nullif(count(*) FILTER (predicted = class), 0), 0), 6) AS "precision",
         round(coalesce(count(*) FILTER (quality = class AND predicted = class) / nullif(count(*) FILTER (quality = class), 0), 0), 6) AS recall,
         round(coalesce(2.0E0 * count(*) FILTER (quality = class AND predicted = class) / nullif(count(*) FILTER (predicted = class) + count(*) FILTER (quality = class), 0), 0), 6) AS f1,
         count(*) FILTER (quality = class) AS support FROM r, k GROUP BY 1""",
)
def quality_report(spark, folder):
    report = metrics.class_report(_labelled(spark, folder), "quality", "predicted")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@register(
    "M21",
    f"""WITH r AS (SELECT quality, {_RULE} AS predicted FROM labels JOIN documents USING (doc_id)) SELECT quality, predicted, count(*) AS n FROM r GROUP BY ALL""",
)
def quality_confusion(spark, folder):
    return metrics.confusion(_labelled(spark, folder), "quality", "predicted")


@register(
    "M21",
    f"""WITH r AS (SELECT quality, {_RULE} AS predicted FROM labels JOIN documents USING (doc_id)) SELECT round(avg(CASE WHEN quality = predicted THEN 1.0E0 ELSE 0.0E0 END), 6) AS accuracy FROM r""",
)
def quality_accuracy(spark, folder):
    report = metrics.class_report(_labelled(spark, folder), "quality", "predicted")
    return metrics.report_averages(report).select(F.round("accuracy", 6).alias("accuracy"))


@register("M24")
def kernel_resampled_lines(spark, folder):
    """Top-hat kernel draws per return flag and line status."""
    lines = read_table(spark, folder, "lineitem")
    return synth.ball_samples(lines, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount", "l_tax"], 500, seed=3)


_POINTS = [{"l_quantity": 5.0 * i, "l_discount": 0.02 * j} for i in range(1, 10) for j in range(5)]


@register(
    "M25",
    f"""WITH g AS (SELECT * FROM (VALUES {", ".join(f"({i}, {p['l_quantity']}E0, {p['l_discount']}E0)" for i, p in enumerate(_POINTS))}) v(point, x, y))
       SELECT CAST(point AS INTEGER) AS point, round(ln(sum(exp(-((l_quantity - x) ** 2 + (l_discount - y) ** 2) / (2.0E0 * 0.5E0 ** 2))) / (count(*) * 2 * pi() * 0.5E0 ** 2)), 6) AS log_density
       FROM lineitem, g GROUP BY 1""",
)
def line_log_density(spark, folder):
    dens = synth.log_density(read_table(spark, folder, "lineitem"), ["l_quantity", "l_discount"], _POINTS, bandwidth=0.5)
    return dens.withColumn("log_density", F.round("log_density", 6))


@register(
    "M25",
    """SELECT l_returnflag, CAST(point AS INTEGER) AS point, CASE WHEN c > 0 THEN round(ln(c / (n * 4.0E0)), 6) END AS log_density FROM (
         SELECT l_returnflag, point, count(*) FILTER (abs(l_quantity - 10 * point) <= 2) AS c, count(*) AS n
         FROM lineitem, (SELECT unnest(range(7)) AS point) GROUP BY ALL)""",
)
def tophat_log_density_by_flag(spark, folder):
    points = [{"l_quantity": 10.0 * i} for i in range(7)]
    dens = synth.log_density(
        read_table(spark, folder, "lineitem"), ["l_quantity"], points, bandwidth=2.0, kernel="tophat", keys=["l_returnflag"]
    )
    return dens.withColumn("log_density", F.round("log_density", 6))


@register(
    "M25",
    """WITH f AS (SELECT CASE WHEN event_id = 0 THEN 1e6 ELSE value END AS x, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) * 5.0E0 / count(*) OVER ()) AS INTEGER) AS fold FROM events),
    c AS (SELECT fold, x, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT unnest([0.5E0, 1.0E0, 2.0E0, 5.0E0, 10.0E0]) AS bandwidth),
    s AS (SELECT fold, sum(n) AS held FROM c GROUP BY fold),
    d AS (SELECT bandwidth, a.fold, a.x, any_value(a.n) AS n, sum(b.n * exp(-((a.x - b.x) ** 2) / (2 * bandwidth ** 2)) / (bandwidth * sqrt(2 * pi()))) AS d
          FROM t, c a JOIN c b ON a.fold <> b.fold GROUP BY ALL)
    SELECT bandwidth, round(sum(n * ln(greatest(d / ((SELECT sum(n) FROM c) - held), 1e-300))) / sum(n), 2) AS mean_log_likelihood FROM d JOIN s USING (fold) GROUP BY bandwidth""",
)
def bandwidth_choice(spark, folder):
    """Held-out log likelihood of the event value, one of them far off, for several kernel widths."""
    events = read_table(spark, folder, "events")
    events = events.withColumn("value", F.when(F.col("event_id") == 0, 1e6).otherwise(F.col("value")))
    scores = synth.bandwidth_scores(events, "value", [0.5, 1.0, 2.0, 5.0, 10.0], ["ts", "event_id"])
    return scores.withColumn("mean_log_likelihood", F.round("mean_log_likelihood", 2))


@register(
    "M25",
    """SELECT p_partkey, round(ln(sum(exp(-((value - p_size) ** 2 + (k - p_partkey % 90) ** 2) / (2.0E0 * 2.0E0 ** 2))) / (count(*) * 2 * pi() * 2.0E0 ** 2)), 5) AS log_density
       FROM part, (SELECT value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) e GROUP BY p_partkey""",
)
def event_density_at_parts(spark, folder):
    """Density of the events at points that are rows of another table."""
    events = read_table(spark, folder, "events").select("value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    points = read_table(spark, folder, "part").select("p_partkey", F.col("p_size").alias("value"), (F.col("p_partkey") % 90).alias("k"))
    dens = synth.log_density_at(events, ["value", "k"], points, ["p_partkey"], bandwidth=2.0)
    return dens.withColumn("log_density", F.round("log_density", 5))


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


@register(
    "M24",
    """WITH r AS (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS at, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
    d AS (SELECT sample, ((sample * 7919) % 10007 + 0.5E0) / 10007 AS a, ((sample * 104729) % 10007 + 0.5E0) / 10007 AS b, ((sample * 1299709) % 10007 + 0.5E0) / 10007 AS c
          FROM (SELECT unnest(range(1, 501)) AS sample)),
    n AS (SELECT DISTINCT l_returnflag, n FROM r)
    SELECT n.l_returnflag, CAST(sample AS BIGINT) AS sample, round(l_quantity + CASE WHEN c >= 0.5 THEN b ELSE -b END * 0.4E0, 6) AS l_quantity
    FROM d, n JOIN r ON r.l_returnflag = n.l_returnflag AND r.at = CAST(floor(a * n.n) AS BIGINT) + 1""",
)
def resampled_quantities(spark, folder):
    """500 draws per flag from a top-hat kernel, from arithmetic uniform numbers."""
    factor = {"row": 7919, "radius": 104729, "l_quantity": 1299709}
    number = lambda name: ((F.col("sample") * factor[name]) % 10007 + 0.5) / 10007.0
    drawn = synth.ball_samples(read_table(spark, folder, "lineitem"), ["l_returnflag"], ["l_quantity"], 500, bandwidth=0.4, uniform=number)
    return drawn.withColumn("l_quantity", F.round("l_quantity", 6))


@register("M26 W7 F9 A15 M27")
def copula_lines(spark, folder):
    return synth.copula_samples(read_table(spark, folder, "lineitem"), _COLUMNS, 5000, seed=11)


@register("M26 M28")
def copula_lines_by_histogram(spark, folder):
    return synth.copula_samples(read_table(spark, folder, "lineitem"), _COLUMNS, 5000, seed=11, margins="histogram")


_KS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(max(abs(a - b)), 6) AS ks_distance FROM (
          SELECT sum(x) OVER (ORDER BY v) / sum(x) OVER () AS a, sum(y) OVER (ORDER BY v) / sum(y) OVER () AS b FROM (
            SELECT {c} AS v, count(*) FILTER (l_returnflag = 'A') AS x, count(*) FILTER (l_returnflag = 'N') AS y FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1))"""
    for c in _COLUMNS
)


@register("M29", _KS)
def flag_distances(spark, folder):
    lines = read_table(spark, folder, "lineitem")
    ks = synth.compare_columns(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'N'"), _COLUMNS)
    return ks.withColumn("ks_distance", F.round("ks_distance", 6))


@register(
    "M29 A15",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}) FILTER (l_returnflag = 'A'), 6) + 0.0 AS real, round(corr({a}, {b}) FILTER (l_returnflag = 'N'), 6) + 0.0 AS generated,
              round(abs(corr({a}, {b}) FILTER (l_returnflag = 'A') - corr({a}, {b}) FILTER (l_returnflag = 'N')), 6) + 0.0 AS difference FROM lineitem"""
        for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))
    ),
)
def flag_correlation_gaps(spark, folder):
    lines = read_table(spark, folder, "lineitem")
    pairs = synth.compare_pairs(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'N'"), _COLUMNS)
    return pairs.withColumns({c: plain(F.col(c)) for c in ("real", "generated", "difference")})


@register("M29 M26")
def copula_quality(spark, folder):
    """Distance between the lines and their copula sample, per column."""
    lines = read_table(spark, folder, "lineitem")
    return synth.compare_columns(lines, synth.copula_samples(lines, _COLUMNS, 5000, seed=11), _COLUMNS)
