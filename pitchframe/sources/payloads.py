"""Parsers of landed JSON and HTML payloads, one row per page or response."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchframe.functions.text import last_token, strip_tail, team_code
from pitchframe.operators.ordered import top_rows
from pitchframe.schemas import OFFER_SCHEMA, VENUE_SCHEMA
from pitchframe.sources.checked import PROBLEM, Checked, checked

EMBEDDED_ARRAY = r"data = (.*);"
LINEUP_BOX = r'<div[^>]*class="(?:[^"]*\s)?lineup__box(?:\s[^"]*)?"'
LINEUP_PLAYER = r'(?s)<li[^>]*class="(?:[^"]*\s)?lineup__player(?:\s[^"]*)?"[^>]*>.*?<a[^>]*href="([^"]+)"'


def embedded(pages: DataFrame, text: str, schema: str, pattern: str = EMBEDDED_ARRAY, keep: Sequence[str] = ()) -> Checked:
    """Items of a JSON array that a page assigns to a script variable, in the columns of ``schema``.

    A page without the array, or whose array is not JSON, has one problem; so
    has an item with a value that does not fit. An empty array has no rows.
    """
    fields = T.StructType.fromDDL(schema)
    raw = F.regexp_extract(text, pattern, 1)
    texts = T.ArrayType(T.StructType([T.StructField(f.name, T.StringType()) for f in fields]))
    pages = pages.select(*keep, raw.alias("_raw")).withColumn("_items", F.from_json("_raw", texts))
    why = F.when(F.col("_raw") == "", "no array").when(F.json_array_length("_raw").isNull(), "not a JSON array")
    broken = F.when(why.isNotNull(), F.array(F.struct(F.lit("page").alias("column"), F.col("_raw").alias("value"), why.alias("reason"))))
    pages = pages.withColumn("_broken", F.coalesce(broken, F.array().cast(PROBLEM)))
    items = F.when(F.size("_broken") > 0, F.array(F.lit(None).cast(texts.elementType))).otherwise(F.col("_items"))
    rows = pages.select(*keep, "_broken", F.explode(items).alias("_item")).select(*keep, "_broken", "_item.*")
    return checked(rows, fields, keep=keep, already="_broken")


def embedded_rows(pages: DataFrame, text: str, schema: str, pattern: str = EMBEDDED_ARRAY, keep: Sequence[str] = ()) -> DataFrame:
    """The items of :func:`embedded` without problems."""
    return embedded(pages, text, schema, pattern, keep).rows()


def venues(responses: DataFrame, body: str, game: str = "game_pk") -> DataFrame:
    """(game, venue_name, venue_id) from schedule responses; NULL where a response has no game."""
    parsed = responses.withColumn("_j", F.from_json(body, VENUE_SCHEMA))
    first_game = F.get(F.get(F.col("_j.dates"), F.lit(0))["games"], F.lit(0))
    return parsed.withColumn("_venue", first_game["venue"]).select(
        game, F.col("_venue.name").alias("venue_name"), F.col("_venue.id").alias("venue_id")
    )


def list_items(pages: DataFrame, html: str, pattern: str, keep: Sequence[str], separator: str = "-") -> DataFrame:
    """One row per pattern match: page columns, position from 1 and the last token of the captured text."""
    found = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    return pages.select(*keep, F.posexplode(found).alias("_at", "_text")).select(
        *keep, (F.col("_at") + 1).alias("position"), last_token("_text", separator).alias("item")
    )


def lineups(pages: DataFrame, html: str, keep: Sequence[str], skip_last: int = 0) -> DataFrame:
    """Line-up slots per game box and side.

    A page holds several boxes, each with a visiting and a home list; the last
    ``skip_last`` boxes are not games. A list is confirmed when it carries the
    confirmed status.
    """
    boxes = F.split(F.col(html), LINEUP_BOX)
    games = F.slice(boxes, F.lit(2), F.greatest(F.size(boxes) - 1 - skip_last, F.lit(0)))
    rows = pages.select(*keep, F.posexplode(games).alias("game", "_box"))
    sides = []
    for side in ("visit", "home"):
        name = F.regexp_extract(
            "_box", rf'(?s)lineup__team is-{side}.*?lineup__abbr[^>]*>\s*([^<]*?)\s*<', 1
        )
        listing = F.regexp_extract("_box", rf'(?s)<ul[^>]*lineup__list is-{side}.*?</ul>', 0)
        sides.append(F.struct(F.lit(side).alias("side"), name.alias("team"), listing.alias("_list")))
    rows = rows.select(*keep, "game", F.inline(F.array(*sides)))
    rows = rows.withColumns(
        {
            "confirmed": F.contains(F.col("_list"), F.lit("lineup__status is-confirmed")),
            "pitcher": last_token(
                F.regexp_extract("_list", r'(?s)lineup__player-highlight.*?<a[^>]*href="([^"]+)"', 1)
            ),
            "_ids": F.regexp_extract_all("_list", F.lit(LINEUP_PLAYER), F.lit(1)),
        }
    )
    return rows.select(
        *keep, "game", "side", "team", "confirmed", "pitcher", F.posexplode("_ids").alias("_at", "_href")
    ).select(
        *keep, "game", "side", "team", "confirmed", "pitcher", (F.col("_at") + 1).alias("slot"), last_token("_href").alias("player")
    )


def unread_responses(responses: DataFrame, body: str, keep: Sequence[str] = ()) -> DataFrame:
    """The reject side of :func:`offers`: responses that are no JSON or hold no event group, with the reason."""
    parsed = responses.withColumn("_j", F.from_json(body, OFFER_SCHEMA))
    why = F.when(F.json_object_keys(body).isNull(), "not a JSON object").when(F.col("_j.eventGroup.events").isNull(), "no events")
    return parsed.select(*keep, F.col(body).alias("value"), why.alias("reason")).where(F.col("reason").isNotNull())


def offers(responses: DataFrame, body: str, category: str, keep: Sequence[str] = ()) -> DataFrame:
    """Odds responses as rows (keep, event, start, away, home, period, market, side, line, odds).

    ``keep`` names columns that tell one collection of responses from another,
    such as the time they were fetched; quotations of different collections,
    events or start times stay apart.

    Only games that have not started count, and of several events with the same
    teams the first. Offers without a label and second-half markets are left
    out. The market family goes by the words in the label; of repeated
    quotations the last one stays.
    """
    numbered = responses.select(
        *keep, F.col(category).alias("period"), F.from_json(body, OFFER_SCHEMA).alias("_j"), F.xxhash64(*keep, category, body).alias("_response")
    )
    events = (
        numbered.select("_response", F.posexplode("_j.eventGroup.events").alias("_at", "e"))
        .where(F.col("e.eventStatus.state") == "NOT_STARTED")
        .select(
            "_response",
            "_at",
            F.col("e.providerEventId").alias("event"),
            F.col("e.startDate").alias("start"),
            F.col("e.teamName1").alias("away_name"),
            F.col("e.teamName2").alias("home_name"),
        )
    )
    events = top_rows(events, ["_response", "away_name", "home_name"], ["_at"], 1).select(
        "_response", "event", "start", team_code("away_name").alias("away"), team_code("home_name").alias("home")
    )
    quotes = (
        numbered.select("_response", *keep, "period", F.posexplode("_j.eventGroup.offerCategories").alias("_a", "_x"))
        .select("_response", *keep, "period", "_a", F.posexplode("_x.offerSubcategoryDescriptors").alias("_b", "_x"))
        .select("_response", *keep, "period", "_a", "_b", F.posexplode("_x.offerSubcategory.offers").alias("_c", "_x"))
        .select("_response", *keep, "period", "_a", "_b", "_c", F.posexplode("_x").alias("_d", "_o"))
        .where(F.col("_o.label").isNotNull() & ~F.contains(F.col("_o.label"), F.lit("2nd Half")))
        .select(
            "_response",
            *keep,
            "period",
            F.col("_o.providerEventId").alias("event"),
            F.col("_o.label").alias("_label"),
            "_a",
            "_b",
            "_c",
            "_d",
            F.posexplode("_o.outcomes").alias("_e", "_s"),
        )
    )
    has = lambda text: F.contains(F.col("_label"), F.lit(text))
    family = (
        F.when(has("Spread") | has("Run Line"), "spread")
        .when(has("Team Total"), "team total")
        .when(has("Total"), "total")
        .when(has("Moneyline"), "moneyline")
    )
    label = F.col("_s.label")
    by_team = F.col("market").isin("spread", "moneyline")
    direction = F.when(label.isin("Over", "Under"), F.lower(label))
    team = F.when(by_team, team_code(label)).when(
        F.col("market") == "team total", team_code(F.trim(F.regexp_replace(strip_tail("_label"), r"Team Total.*$", "")))
    )
    rows = (
        quotes.join(events, ["_response", "event"])
        .withColumn("market", family)
        .withColumns({"team": team, "direction": F.when(~by_team, direction)})
        .where(
            F.when(by_team, F.col("team").isin(F.col("away"), F.col("home")))
            .when(F.col("market") == "team total", F.col("team").isin(F.col("away"), F.col("home")) & F.col("direction").isNotNull() & ~has("Touchdowns"))
            .when(F.col("market") == "total", F.col("direction").isNotNull())
        )
        .select(
            *keep,
            "event",
            "start",
            "away",
            "home",
            F.when((F.col("market") == "team total") & (F.col("period") == "TT"), "Game").otherwise(F.col("period")).alias("period"),
            "market",
            F.concat_ws(" ", "team", "direction").alias("side"),
            F.when(F.col("market") != "moneyline", F.col("_s.line")).alias("line"),
            F.col("_s.oddsDecimal").alias("odds"),
            F.struct("_a", "_b", "_c", "_d", "_e").alias("_place"),
        )
    )
    key = [*keep, "event", "start", "away", "home", "period", "market", "side", "line"]
    return rows.groupBy(*key).agg(F.max_by("odds", "_place").alias("odds"))
