"""Typed scans, sinks, landed payloads and the parameter registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchframe.schemas import FLOAT_COLUMNS, PITCH_COLUMNS
from pitchframe.session import shared_dir
from pitchframe.sources import checked, payloads, registry, tables
from pitchframe.sources.tables import read_table
from pitchframe.suite import register
from pitchframe.suite.standin import FEED_SQL, PITCH_SQL, SPOILT, as_feed


_GOOD = " AND ".join(f"NOT ({test})" for _, test, _, _ in SPOILT)


# Rows of a file of the export: some 40 MB of text.
EXPORT_ROWS = 100_000


def _export(spark, folder, rows=EXPORT_ROWS):
    """The stand-in feed as CSV files of about ``rows`` rows, however the events are stored: one large row group is one task otherwise."""
    events = read_table(spark, folder, "events")
    target = shared_dir(spark, "feed")
    tables.write_csv(as_feed(events.repartition(events.count() // rows + 1)), target)
    return target


def _loaded(spark, folder):
    """The stand-in feed as a CSV export, checked and loaded into a table by year; its folder and what was counted."""
    export, target = _export(spark, folder), shared_dir(spark, "pitches")
    source = tables.check_pitches(spark, export, "csv", keep=["row_id"])
    return target, source, checked.load(source, target, ["game_year"])


@register("S1", f"WITH {PITCH_SQL} SELECT {FEED_SQL} FROM pitches WHERE {_GOOD}")
def typed_pitch_scan(spark, folder):
    """All declared columns: text from CSV is typed and stored as Parquet, which is read in its own types."""
    target, source, _ = _loaded(spark, folder)
    stored = tables.read_pitches(spark, f"{target}/state=accepted")
    floats = {c: F.col(c).cast("double") for c in FLOAT_COLUMNS}
    return stored.withColumns(floats | {"game_date": F.col("game_date").cast("timestamp_ntz")}).select(*PITCH_COLUMNS)


@register(
    "S1",
    f"WITH {PITCH_SQL} "
    + " UNION ALL ".join(
        f"""SELECT CAST(event_id AS VARCHAR) AS row_id, game_pk, '{name}' AS "column", {'CAST(NULL AS VARCHAR)' if value is None else f"'{value}'"} AS value,
          '{reason}' AS reason FROM pitches WHERE {test}"""
        for name, test, value, reason in SPOILT
    ),
)
def pitch_rejects(spark, folder):
    """Every value that does not fit, with its row and the reason, as the load stored it."""
    target, source, _ = _loaded(spark, folder)
    stored = spark.read.schema(source.frame.schema).parquet(f"{target}/state=rejected")
    return stored.select("row_id", "game_pk", F.inline("problems"))


@register(
    "S1",
    f"""WITH {PITCH_SQL} SELECT * FROM (
        SELECT 'read' AS counted, count(*) AS n FROM pitches UNION ALL SELECT 'rejected', count(*) FROM pitches WHERE NOT ({_GOOD}) UNION ALL """
    + " UNION ALL ".join(f"SELECT 'rejected_{name}', count(*) FROM pitches WHERE {test}" for name, test, _, _ in SPOILT)
    + ") WHERE n > 0",
)
def pitch_load_counts(spark, folder):
    """What one pass of the load counted."""
    _, _, counts = _loaded(spark, folder)
    return spark.createDataFrame([(k, n) for k, n in counts.items() if n], "counted string, n long")


@register(
    "S1 P9",
    f"""WITH {PITCH_SQL} SELECT pitch_type, count(*) AS n FROM pitches
        WHERE {_GOOD} AND game_date >= TIMESTAMP '2024-01-10' AND game_date < TIMESTAMP '2024-01-13' AND game_pk > 19733 GROUP BY 1""",
)
def pitches_of_days(spark, folder):
    """A stored table read through the declared schema; the date and the game prune its files."""
    return days_of_pitches(tables.read_pitches(spark, f"{_loaded(spark, folder)[0]}/state=accepted"))


def days_of_pitches(stored):
    days = (F.col("game_date") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("game_date") < F.lit("2024-01-13").cast("timestamp"))
    return stored.where(days & (F.col("game_pk") > 19733)).groupBy("pitch_type").agg(F.count(F.lit(1)).alias("n"))


@register("S3 S13", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_round_trip(spark, folder):
    target = shared_dir(spark, "csv")
    tables.write_csv(read_table(spark, folder, "supplier"), target)
    return tables.read_dimension(
        spark, target, ["s_suppkey", "s_name", "s_acctbal"], "s_suppkey long, s_name string, s_acctbal double"
    )


@register(
    "S4",
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, count(*) AS n, count(DISTINCT o_orderkey) AS order_keys FROM orders GROUP BY 1",
)
def appended_orders(spark, folder):
    """Two appends into a folder partitioned by year."""
    target = shared_dir(spark, "append")
    orders = read_table(spark, folder, "orders").withColumn("o_year", F.year("o_orderdate"))
    for part in (F.col("o_orderstatus") == "F", F.col("o_orderstatus") != "F"):
        tables.append_rows(orders.where(part), target, ["o_year"])
    stored = spark.read.parquet(target)
    return stored.groupBy("o_year").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("order_keys"))


@register("S5 S6", "SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1")
def replaced_totals(spark, folder):
    """A derived table is written, replaced and read back under a name."""
    target = shared_dir(spark, "replace")
    totals = read_table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    tables.replace_folder(totals.where("customers < 0"), target)
    tables.replace_folder(totals, target)
    stored = spark.read.parquet(target)
    stored.createOrReplaceTempView("customer_totals")
    if not tables.has_table(spark, "customer_totals"):
        raise LookupError("customer_totals")
    return tables.query(spark, "SELECT c_nationkey, customers FROM customer_totals WHERE customers > :least", least=0)


@register(
    "S7",
    """SELECT event_id, user_id AS runner_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 4 AS speed FROM events""",
)
def embedded_arrays(spark, folder):
    events = read_table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    row = F.to_json(F.array(F.struct(F.col("user_id").alias("runner_id"), (k / 4).alias("r_sprint_speed_top50percent"), F.lit(1).alias("rank"))))
    page = events.select("event_id", F.concat(F.lit("<html>\n<script>\nvar data = "), row, F.lit(";\nvar x = 1;\n</script></html>")).alias("body"))
    rows = payloads.embedded_rows(page, "body", "runner_id long, r_sprint_speed_top50percent double", keep=["event_id"])
    return rows.withColumnRenamed("r_sprint_speed_top50percent", "speed")


@register(
    "S7",
    """SELECT event_id, CASE WHEN event_id % 50 = 3 THEN 'rank' ELSE 'page' END AS "column",
         CASE event_id % 50 WHEN 1 THEN '' WHEN 2 THEN '[{"rank":' ELSE '1.5' END AS value,
         CASE event_id % 50 WHEN 1 THEN 'no array' WHEN 2 THEN 'not a JSON array' ELSE 'not a bigint' END AS reason
       FROM events WHERE event_id % 50 IN (1, 2, 3)""",
)
def embedded_page_rejects(spark, folder):
    """Pages without the array, with broken JSON or with a value that does not fit."""
    at = F.col("event_id") % 50
    text = F.when(at == 2, F.lit('[{"rank":')).when(at == 3, F.lit('[{"rank":1.5},{"rank":4.0}]')).otherwise(F.lit('[{"rank":1}]'))
    body = F.when(at == 1, F.lit("<p>nothing</p>")).otherwise(F.concat(F.lit("var data = "), text, F.lit(";")))
    pages = read_table(spark, folder, "events").select("event_id", body.alias("body"))
    return payloads.embedded(pages, "body", "rank long", keep=["event_id"]).rejects()


@register(
    "S10",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '{"eventGroup":' ELSE '{"message":"closed"}' END AS value,
         CASE WHEN o_orderkey % 3 = 0 THEN 'not a JSON object' ELSE 'no events' END AS reason FROM orders WHERE o_orderkey % 3 < 2""",
)
def unread_offers(spark, folder):
    """Odds responses that are cut off or hold no event group."""
    at = F.col("o_orderkey") % 3
    good = F.lit('{"eventGroup":{"events":[]}}')
    body = F.when(at == 0, F.lit('{"eventGroup":')).when(at == 1, F.lit('{"message":"closed"}')).otherwise(good)
    responses = read_table(spark, folder, "orders").select("o_orderkey", body.alias("body"))
    return payloads.unread_responses(responses, "body", ["o_orderkey"])


@register(
    "S8",
    """SELECT o_orderkey AS game_pk, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS venue_name,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS venue_id FROM orders""",
)
def schedule_venues(spark, folder):
    """Schedule responses made from orders; partial orders have no game."""
    venue = F.struct(F.struct(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"), F.lit("x").alias("link")).alias("venue"))
    full = F.to_json(F.struct(F.array(F.struct(F.array(venue).alias("games"))).alias("dates")))
    body = F.when(F.col("o_orderstatus") == "P", F.lit('{"dates": []}')).otherwise(full)
    responses = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("game_pk"), body.alias("body"))
    return payloads.venues(responses, "body")


@register(
    "S9",
    """SELECT page_id, CAST(i AS INTEGER) AS position, split_part(item, '/', -1) AS item FROM (
         SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]+)"', 1)) AS item,
           unnest(range(1, len(regexp_extract_all(html, '<li><a href="([^"]+)"', 1)) + 1)) AS i FROM pages)""",
)
def page_list_items(spark, folder):
    return payloads.list_items(read_table(spark, folder, "pages"), "html", r'<li><a href="([^"]+)"', ["page_id"], "/")


@register("S9", """SELECT o_orderkey, CAST(0 AS INTEGER) AS game, s.side, CASE WHEN s.side = 'home' THEN 'H' ELSE 'V' END || CAST(o_custkey AS VARCHAR) AS team,
      o_orderstatus = 'F' AND s.side = 'home' AS confirmed, CAST(o_custkey AS VARCHAR) AS pitcher, CAST(p.slot AS INTEGER) AS slot, CAST(o_orderkey + p.slot AS VARCHAR) AS player
    FROM orders, (VALUES ('visit'), ('home')) s(side), (VALUES (1), (2)) p(slot)""")
def order_lineups(spark, folder):
    """Line-up pages made from orders, two slots per side."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey").cast("string")

    def side(name: str, letter: str, confirmed):
        status = F.when(confirmed, F.lit('<li class="lineup__status is-confirmed">ok</li>')).otherwise(F.lit('<li class="lineup__status">?</li>'))
        players = [
            F.concat(F.lit('<li class="lineup__player">\n<a href="/p/name-'), (key + slot).cast("string"), F.lit('">x</a></li>'))
            for slot in (1, 2)
        ]
        return F.concat(
            F.lit(f'<ul class="lineup__list is-{name}">'),
            F.lit('<li class="lineup__player-highlight"><a href="/p/star-'), customer, F.lit('">s</a></li>'),
            status, *players, F.lit("</ul>"),
        )

    def head(name: str, letter: str):
        return F.concat(F.lit(f'<div class="lineup__team is-{name}"><div class="lineup__abbr">{letter}'), customer, F.lit("</div></div>"))

    never = F.lit(False)
    html = F.concat(
        F.lit('<div class="lineup__box">'), head("visit", "V"), head("home", "H"),
        side("visit", "V", never), side("home", "H", F.col("o_orderstatus") == "F"), F.lit("</div>"),
    )
    pages = read_table(spark, folder, "orders").select("o_orderkey", html.alias("html"))
    return payloads.lineups(pages, "html", ["o_orderkey"])


@register(
    "S10 F4 F5",
    """SELECT f.fetched, CAST(o_orderkey AS VARCHAR) AS event, '2024-04-0' || f.fetched AS start, 'A' || o_orderkey || CASE WHEN o_orderkey < 10 THEN 'R' ELSE '' END AS away, 'H' || o_orderkey || CASE WHEN o_orderkey < 10 THEN 'B' ELSE '' END AS home, 'Game' AS period, m.market, m.side, m.line,
         CASE WHEN m.n = 1 THEN 1.9E0 ELSE o_custkey / 100.0E0 + f.fetched END AS odds
       FROM orders, (VALUES (CAST(1 AS INTEGER)), (2)) f(fetched), (VALUES (1, 'total', 'over', 8.5E0), (2, 'total', 'under', 8.5E0)) m(n, market, side, line) WHERE o_orderstatus <> 'F'""",
)
def order_offers(spark, folder):
    """Odds responses of two days made from orders; finished orders have started already."""
    key = F.col("o_orderkey").cast("string")
    event = F.struct(
        key.alias("providerEventId"), F.concat(F.lit("A"), key, F.lit(" Reds")).alias("teamName1"),
        F.concat(F.lit("H"), key, F.lit(" Blues")).alias("teamName2"), F.concat(F.lit("2024-04-0"), F.col("fetched")).alias("startDate"),
        F.struct(F.when(F.col("o_orderstatus") == "F", "STARTED").otherwise("NOT_STARTED").alias("state")).alias("eventStatus"),
    )
    outcome = lambda label, odds: F.struct(F.lit(label).alias("label"), F.lit(8.5).alias("line"), odds.alias("oddsDecimal"))
    offer = lambda label: F.struct(
        key.alias("providerEventId"), F.lit(label).alias("label"),
        F.array(outcome("Over", F.lit(1.9)), outcome("Under", F.col("o_custkey") / 100.0 + F.col("fetched"))).alias("outcomes"),
    )
    offers = F.array(F.array(offer("Total Runs"), offer("2nd Half Total")))
    body = F.to_json(
        F.struct(
            F.struct(
                F.array(event).alias("events"),
                F.array(F.struct(F.array(F.struct(F.struct(offers.alias("offers")).alias("offerSubcategory"))).alias("offerSubcategoryDescriptors"))).alias("offerCategories"),
            ).alias("eventGroup")
        )
    )
    orders = read_table(spark, folder, "orders").withColumn("fetched", F.explode(F.array(F.lit(1), F.lit(2))))
    responses = orders.select("fetched", F.lit("Game").alias("category"), body.alias("body"))
    return payloads.offers(responses, "body", "category", ["fetched"])


@register(
    "S11 S12",
    """WITH e AS (SELECT o_orderpriority AS model, o_orderstatus AS id, CAST(max(o_orderdate) AS DATE) AS created, CAST(count(*) % 7 AS INTEGER) AS classifier__max_depth
                  FROM orders GROUP BY 1, 2, year(o_orderdate)),
            l AS (SELECT *, row_number() OVER (PARTITION BY model, id ORDER BY created DESC) AS rn FROM e)
       SELECT model, id, strftime(created, '%Y%m%d') AS created, classifier__max_depth FROM l
       WHERE rn = 1 AND date_diff('day', created, (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) + 85) <= 90""",
)
def valid_parameters(spark, folder):
    """Entries per priority and status, one per year; the newest one counts if it is at most 90 days old."""
    orders = read_table(spark, folder, "orders")
    entries = orders.groupBy(
        F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("id"), F.year("o_orderdate").alias("_year")
    ).agg(
        F.max("o_orderdate").cast("date").alias("created"), (F.count(F.lit(1)) % 7).cast("int").alias("classifier__max_depth")
    )
    target = shared_dir(spark, "registry")
    registry.write_registry(entries.drop("_year"), target)
    stored = registry.read_written(spark, target)
    today = orders.agg(F.date_add(F.max("o_orderdate").cast("date"), 85)).scalar()
    valid = registry.latest_valid(stored, ["model", "id"], today, registry.PARAMETER_DAYS)
    return valid.select("model", "id", F.date_format("created", "yyyyMMdd").alias("created"), "classifier__max_depth")
