"""Hand-written rows for the rules that are easy to get wrong."""

import datetime
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchframe import schemas
from pitchframe.functions import categories, numbers, text
from pitchframe.operators import encode, joins, markets, metrics, shape, standardize, state
from pitchframe.operators.aggregate import conditional_distribution, distribution_map, pivot_values
from pitchframe.plans import scores
from pitchframe.plans.features import arsenals, pitch_outcome_set
from pitchframe.sources import checked, payloads, registry, tables
from pitchframe.suite import landing, standin
from pitchframe.suite.landing import days_of_pitches
from pitchframe.suite.standin import pitches

DATA = "/root/testdata/sf0.001"


def values(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


# -- states -----------------------------------------------------------------


def test_forced_transitions_of_all_states(spark):
    table = {
        (r["outcome"], r["outs"], r["on_1b"], r["on_2b"], r["on_3b"]): tuple(r)[5:] for r in state.forced_table(spark).collect()
    }
    assert len(table) == 48
    T, N = True, False
    walks = {
        (N, N, N): ("batter", None, None, 0),
        (T, N, N): ("batter", "1b", None, 0),
        (N, T, N): ("batter", "2b", None, 0),
        (N, N, T): ("batter", None, "3b", 0),
        (T, T, N): ("batter", "1b", "2b", 0),
        (T, N, T): ("batter", "1b", "3b", 0),
        (N, T, T): ("batter", "2b", "3b", 0),
        (T, T, T): ("batter", "1b", "2b", 1),
    }
    for outs in range(3):
        for bases, after in walks.items():
            assert table[("walk", outs, *bases)] == (outs, *after)
            stay = tuple(label if on else None for on, label in zip(bases, ("1b", "2b", "3b")))
            assert table[("K", outs, *bases)] == (outs + 1, *stay, 0)


@pytest.mark.parametrize(
    "pitches, balls, strikes, event",
    [
        (["foul", "foul", "foul"], 0, 2, None),
        (["strike", "foul", "strike"], 0, 3, "K"),
        (["ball"] * 4, 4, 0, "walk"),
        (["hit_by_pitch"], 4, 0, "walk"),
        (["ball", "ball", "hit_by_pitch"], 4, 0, "walk"),
        (["foul", "foul", "strike"], 0, 3, "K"),
        (["hit_into_play", None], 0, 0, None),
    ],
)
def test_count_fold(spark, pitches, balls, strikes, event):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(pitches)], "ab int, i int, outcome string")
    last = state.running_count(df, ["ab"], ["i"], "outcome").orderBy(F.desc("i")).first()
    assert (last["balls_after"], last["strikes_after"], last["event"]) == (balls, strikes, event)


def test_half_inning_ends_with_three_outs_and_empty_bases(spark):
    df = spark.createDataFrame(
        [("g", 1, 0, 5, None), ("g", 2, 1, 6, 5), ("h", 1, 2, 7, None)],
        "half string, i int, outs_when_up int, batter int, on_1b int",
    ).withColumns({"on_2b": F.lit(None).cast("int"), "on_3b": F.lit(None).cast("int")})
    rows = values(state.next_state(df, ["half"], ["i"]).orderBy("half", "i"), "after_outs", "on_1b_after")
    assert rows == [(1, 5), (3, None), (3, None)]


def test_runner_tracking(spark):
    columns = "batter int, on_1b int, on_2b int, on_3b int, on_1b_after int, on_2b_after int, on_3b_after int"
    df = spark.createDataFrame(
        [
            (10, None, None, None, 10, None, None),  # single
            (10, 11, 12, None, 99, 10, 12),  # an unseen pinch runner
            (10, 10, None, 10, 10, None, None),  # a repeated id: the later base wins
        ],
        columns,
    )
    rows = values(state.track_runners(df), "after_1b", "after_2b", "after_3b")
    assert rows == [("batter", None, None), (None, "batter", "2b"), ("3b", None, None)]


def test_transition_probabilities_and_draw(spark):
    schema = "half string, i int, simplified_outcome string, stand string, batter int, outs_when_up int, on_1b int, on_2b int, on_3b int, runs_scored int"
    rows = []
    for game in range(4):
        rows.append((f"g{game}", 1, "single", "R", 10, 0, None, None, None, 0))
        rows.append((f"g{game}", 2, None, "R", 11, 0, 10 if game < 3 else None, None if game < 3 else 10, None, 0))
    table = state.fit_transitions(spark.createDataFrame(rows, schema), ["half"], ["i"])
    assert sorted(values(table, "after_1b", "after_2b", "n", "p"), key=str) == [("batter", None, 3, 0.75), (None, "batter", 1, 0.25)]
    states = spark.createDataFrame(
        [("single", "R", 0, False, False, False, u) for u in (0.0, 0.2, 0.25, 0.99)]
        + [("walk", "R", 1, True, True, True, 0.5), ("triple", "R", 0, False, False, False, 0.5)],
        "outcome string, stand string, outs int, on_1b boolean, on_2b boolean, on_3b boolean, u double",
    )
    after = state.apply_transitions(states, table, "u")
    got = {(r["outcome"], r["u"]): tuple(r[c] for c in state.AFTER) for r in after.collect()}
    assert got[("single", 0.2)] == (0, None, "batter", None, 0)
    assert got[("single", 0.25)] == got[("single", 0.99)] == (0, "batter", None, None, 0)
    assert got[("walk", 0.5)] == (1, "batter", "1b", "2b", 1)
    assert got[("triple", 0.5)] == (None,) * 5


def test_distribution_keeps_null_conditions(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (None, "b"), ("x", "a")], "g string, o string")
    dist = conditional_distribution(df, ["g"], ["o"])
    assert {(r["g"], r["o"]): (r["n"], round(r["p"], 6)) for r in dist.collect()} == {
        (None, "a"): (1, 0.333333),
        (None, "b"): (2, 0.666667),
        ("x", "a"): (1, 1.0),
    }
    assert distribution_map(dist, ["g"], "o", "p").where("g = 'x'").first()["distribution"] == {"a": 1.0}


# -- scalars ----------------------------------------------------------------


def test_odds(spark):
    df = spark.createDataFrame([(0.5,), (0.75,), (0.25,), (0.0,), (1.0,), (None,)], "p double")
    rows = values(df, numbers.american_odds("p"), numbers.is_priceable("p"))
    assert rows == [(100, True), (-300, True), (300, True), (None, False), (None, False), (None, False)]
    # Halves go to the even neighbour: 100 / 0.4 - 100 = 150; p = 100/202.5 gives 102.5.
    assert spark.createDataFrame([(100 / 202.5,)], "p double").select(numbers.american_odds("p")).first()[0] == 102
    quotes = spark.createDataFrame([("+150",), ("-150",), ("EVEN",)], "q string")
    assert values(quotes, numbers.implied_probability("q")) == [0.4, 0.6, None]


def test_spray_angle(spark):
    df = spark.createDataFrame([(130.0, 10.0), (130.0, 200.0), (230.0, 113.0)], "x double, y double")
    assert values(df, numbers.spray_angle("x", "y")) == [90.0, 90.0, 45.0]


def test_team_codes_and_clock(spark):
    names = ["WAS Nationals", "CHI White Sox", "LA Dodgers", "NY Mets", "BOS Red Sox", "KC", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert values(df, text.team_code("n"))[:5] == ["WSN", "CHW", "LAD", "NYM", "BOS"]
    clock = spark.createDataFrame([("2024-07-04", "7:05 PM ET"), ("2024-07-04", "noon")], "d string, c string")
    times = values(clock, F.date_format(text.clock_to_timestamp(F.to_date("d"), "c"), "yyyy-MM-dd HH:mm"))
    assert times == ["2024-07-04 19:05", None]


def test_class_maps_and_null_rules(spark):
    df = spark.createDataFrame([("sac_fly",), ("strikeout",), (None,)], "e string")
    assert values(df, categories.collapse("e", categories.OUTCOME_CLASSES)) == ["fly_out", None, None]
    marks = spark.createDataFrame([("None",), ("x",), (None,)], "s string")
    assert values(marks, categories.null_if_text("s")) == [None, "x", None]
    assert values(shape.drop_sentinel(marks, "s"), "s") == ["x"]
    assert numbers is not None and values(
        spark.createDataFrame([(1.0, None), (None, None)], "a double, b double"), numbers.row_mean(["a", "b"])
    ) == [1.0, 0.0]


# -- scores -----------------------------------------------------------------


def test_z_scores(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", 5.0), ("b", 5.0), ("c", None)], "g string, x double")
    population = standardize.z_scores(df, "x", ["g"], ddof=0, constant=0.0).orderBy("g", "x").collect()
    assert [None if r["z"] is None else round(r["z"], 6) for r in population] == [-1.341641, -0.447214, 0.447214, 1.341641, 0.0, 0.0, None]
    sample = standardize.z_scores(df.where("g = 'a'"), "x", ["g"], ddof=1).orderBy("x").first()["z"]
    assert round(sample, 6) == -1.161895


def test_slice_drops_small_groups_and_fills(spark):
    rows = [(1, "FF", "S")] * 3 + [(2, "FF", "S")] * 2 + [(2, "FF", "B")] + [(1, "SL", "S")] * 2
    df = spark.createDataFrame([(*r, 1.0, 2020) for r in rows], "batter int, pitch_type string, type string, woba_value float, game_year int")
    wide = scores.wide_scores(scores.strike_scores(df, minimum=3), "batter", "pitch_type", ["FF", "SL"])
    got = [(b, round(ff, 9), sl) for b, ff, sl in sorted(values(wide, "batter", "FF", "SL"))]
    assert got == [(1, 1.0, 0.0), (2, -1.0, 0.0)]
    assert scores.strike_scores(df, minimum=1, before_year=2020).count() == 0
    missing = df.withColumns({"type": F.lit("X"), "woba_value": F.lit(None).cast("float")})
    assert scores.contact_scores(missing, minimum=1).count() == 0  # a missing mean poisons nothing


def test_speed_fill_is_weighted_by_row(spark):
    df = spark.createDataFrame([("v", 10.0), ("v", 10.0), ("v", 40.0), ("v", None), ("w", None), ("w", 7.0)], "g string, s double")
    assert sorted(values(standardize.fill_with_mean(df, "s", ["g"]), "s")) == [7.0, 7.0, 10.0, 10.0, 20.0, 40.0]
    assert round(standardize.fill_with_mean(df, "s").where("g = 'w'").agg(F.max("s")).first()[0], 4) == 16.75


# -- joins and shaping ------------------------------------------------------


def test_only_new_rows_once(spark):
    stored = spark.createDataFrame([(1, "a")], "k int, v string")
    incoming = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    assert values(joins.only_new(incoming, stored, ["k"]), "k", "v") == [(2, "y")]


def test_look_back_is_strict(spark):
    day = lambda d: datetime.date(2024, 5, d)
    stored = spark.createDataFrame([(1, day(8)), (2, day(9))], "k int, d date")
    incoming = spark.createDataFrame([(1, day(8)), (2, day(9)), (3, day(10))], "k int, d date")
    fresh = joins.only_new(incoming, stored, ["k"], date="d", high_water=day(10))
    assert sorted(values(fresh, "k")) == [1, 3]  # the eighth itself is not compared


def test_cut_off_is_inclusive_for_dates_and_strict_for_years(spark):
    df = spark.createDataFrame([(datetime.date(2021, 1, i), 2021) for i in (1, 2, 3)], "d date, y int")
    assert shape.as_of(df, date="d", until="2021-01-02").count() == 2
    assert shape.as_of(df, year="y", before_year=2021).count() == 0
    assert shape.as_of(df, year="y", after_year=2021).count() == 0


def test_exclusion_drops_null_and_listed(spark):
    df = spark.createDataFrame([("R",), ("E",), ("S",), (None,)], "t string")
    assert values(shape.exclude(df, "t", ["E", "S"]), "t") == ["R"]


def test_first_id_entry_wins(spark):
    id_map = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1)], "a int, b int, line int")
    df = spark.createDataFrame([(1, None), (None, 20), (None, 11), (5, None)], "a int, b int")
    assert sorted(values(joins.resolve_ids(df, id_map, "a", "b", ["line"]), "a", "b"), key=str) == [(1, 10), (1, 11), (2, 20), (5, None)]


def test_columns_and_pivot(spark):
    df = spark.createDataFrame([(1, "n", 2.0, 3.0)], "id int, name string, factor_2022 double, factor_2021 double")
    assert shape.columns_from(df, "2022", 3) == ["factor_2022", "factor_2021"]
    assert shape.columns_by_type(df) == {"numeric": ["id", "factor_2022", "factor_2021"], "text": ["name"], "other": []}
    long = spark.createDataFrame([(1, "a", 5.0)], "k int, c string, v double")
    assert pivot_values(long, ["k"], "c", "v", ["a", "b"]).first().asDict() == {"k": 1, "a": 5.0, "b": 0.0}
    same = shape.same_everywhere(spark.createDataFrame([(1, 1, None), (None, None, 2)], "a int, b int, c int"), [("a", "b"), ("a", "c")])
    assert sorted(values(same, "right", "same")) == [("b", True), ("c", False)]


def test_arsenal_is_recent(spark):
    rows = [(1, "FF", "R", i) for i in range(5)] + [(1, "SL", "R", 9), (1, "PO", "R", 10), (1, "CH", "S", 11), (1, "CU", None, 12)]
    df = spark.createDataFrame(rows, "pitcher int, pitch_type string, game_type string, game_date int").withColumns(
        {"game_pk": F.lit(1), "at_bat_number": F.lit(1), "pitch_number": F.lit(1)}
    )
    assert values(arsenals(df, 1), "pitch_type") == ["SL"]
    assert sorted(values(arsenals(df), "pitch_type")) == ["FF", "SL"]


def test_unmapped_targets_are_optional(spark):
    base = {"batter": 1, "game_date": datetime.datetime(2024, 1, 1), "game_pk": 1, "at_bat_number": 1, "p_throws": "R", "strikes": 0, "balls": 0,
            "release_speed": 90.0, "release_spin_rate": 2000, "plate_x": 0.0, "plate_z": 2.0}
    rows = [{**base, "pitch_number": 1, "description": "ball"}, {**base, "pitch_number": 2, "description": "other"},
            {**base, "pitch_number": 3, "description": "ball", "plate_x": None}]
    df = spark.createDataFrame(rows, "batter int, game_date timestamp, game_pk int, at_bat_number int, p_throws string, strikes int, balls int, release_speed double, release_spin_rate int, plate_x double, plate_z double, pitch_number int, description string")
    assert values(pitch_outcome_set(df), "pitch_outcome") == ["ball"]
    assert sorted(values(pitch_outcome_set(df, keep_null_target=True), "pitch_outcome"), key=str) == [None, "ball"]


def test_balance_copies_the_first_row(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b")], "i int, c string")
    test = spark.createDataFrame([(3, "c"), (4, "c"), (5, "a")], "i int, c string")
    more_train, more_test = encode.balance_classes(train, test, "c", ["i"])
    assert sorted(values(more_train, "i")) == [1, 2, 3]
    assert sorted(values(more_test, "i")) == [2, 3, 4, 5]


# -- statistics -------------------------------------------------------------


def test_chi_square_tail(spark):
    rows = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (7.814727903251179, 3, 0.05), (0.0, 3, 1.0), (5000.0, 9, 0.0)]
    df = spark.createDataFrame(rows, "statistic double, dof int, expected double")
    for r in metrics.add_chi_square_tail(df, "statistic", "dof").collect():
        assert r["p_value"] == pytest.approx(r["expected"], abs=1e-12)


def test_contingency_with_correction(spark):
    rows = [("x", "a")] * 10 + [("x", "b")] * 20 + [("y", "a")] * 30 + [("y", "b")] * 5
    two = metrics.contingency(spark.createDataFrame(rows, "s string, c string"), "s", "c").first()
    n, r, c = 65, (30, 35), (40, 25)
    gap = abs(10 - 30 * 40 / 65) - 0.5
    expected = sum(gap**2 / (a * b / n) for a in r for b in c)
    assert two["statistic"] == pytest.approx(expected) and two["dof"] == 1
    wide = metrics.contingency(spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c"), ("y", "c")], "s string, c string"), "s", "c").first()
    assert wide["statistic"] == pytest.approx(4.0) and wide["dof"] == 2


def test_market_rules(spark):
    games = markets.with_flags(spark.createDataFrame([(1, 2, 2), (2, 3, 0), (3, 0, 1)], "g int, home int, away int"))
    first = games.where("g = 1").first()
    assert (first["home_wins"], first["away_wins"], first["home_covers"], first["away_covers"], first["total"]) == (False, False, True, True, 4)
    ladder = markets.totals_ladder(games, [0.5, 1.5, 3.5]).orderBy("line").collect()
    assert [r["p_over"] for r in ladder] == pytest.approx([1.0, 2 / 3, 1 / 3])
    assert ladder[0]["odds_over"] is None and ladder[1]["odds_over"] == -200
    assert markets.fair_total(markets.totals_ladder(games, [1.5, 3.5])).first()["line"] == 1.5  # tie: first line
    fair = markets.fair_spread(markets.spread_market(games))
    assert 1 <= fair.count() <= 2


# -- payloads and registry --------------------------------------------------


def test_embedded_array(spark):
    page = 'x\n var data = [{"runner_id":1,"r_sprint_speed_top50percent":27.1,"other":3},{"runner_id":2}];\n var y = 1;'
    df = spark.createDataFrame([(page,), ("nothing",)], "body string")
    assert values(payloads.embedded_rows(df, "body", schemas.SPEED_SCHEMA), "runner_id", "r_sprint_speed_top50percent") == [(1, 27.1), (2, None)]


def test_schedule_venue(spark):
    df = spark.createDataFrame([(7, '{"dates":[{"games":[{"venue":{"id":1,"name":"X"}}]}]}'), (8, '{"dates":[]}'), (9, "oops")], "game_pk int, body string")
    assert values(payloads.venues(df, "body"), "game_pk", "venue_name", "venue_id") == [(7, "X", 1), (8, None, None), (9, None, None)]


def test_lineups(spark):
    def side(name, status, ids):
        items = "".join(f'<li class="lineup__player"><div>1B</div><a title="n" href="/p/some-name-{i}">n</a></li>' for i in ids)
        return f'<ul class="lineup__list is-{name}"><li class="lineup__player-highlight"><a href="/p/arm-{name}9">a</a></li><li class="lineup__status {status}">s</li>{items}</ul>'

    box = (
        '<div class="lineup__box"><div class="lineup__team is-visit"><img src="l"><div class="lineup__abbr"> BOS </div></div>'
        '<div class="lineup__team is-home"><div class="lineup__abbr">NYY</div></div>'
        + side("visit", "is-expected", [11, 12]) + side("home", "is-confirmed", [12345]) + "</div>"
    )
    df = spark.createDataFrame([(1, "<html>" + box + '<div class="lineup__box is-tools">x</div>')], "page int, html string")
    rows = payloads.lineups(df, "html", ["page"], skip_last=1).orderBy(F.desc("side"), "slot")
    assert values(rows, "side", "team", "confirmed", "pitcher", "slot", "player") == [
        ("visit", "BOS", False, "visit9", 1, "11"),
        ("visit", "BOS", False, "visit9", 2, "12"),
        ("home", "NYY", True, "home9", 1, "12345"),
    ]


def test_offers(spark):
    event = lambda i, a, h, s: f'{{"providerEventId":"{i}","teamName1":"{a}","teamName2":"{h}","eventStatus":{{"state":"{s}"}}}}'
    quote = lambda i, label, outs: f'{{"providerEventId":"{i}",{label}"outcomes":[{outs}]}}'
    out = lambda label, line, odds: f'{{"label":"{label}","line":{line},"oddsDecimal":{odds}}}'
    offers = ",".join(
        [
            quote("1", '"label":"Run Line",', out("NY Mets", -1.5, 2.1) + "," + out("BOS Red Sox", 1.5, 1.7)),
            quote("1", '"label":"Total",', out("Over", 8.5, 1.9) + "," + out("Under", 8.5, 1.8) + "," + out("Over", 8.5, 1.95)),
            quote("1", '"label":"NY Mets: Team Total Runs",', out("Over", 3.5, 1.6)),
            quote("1", '"label":"Moneyline",', out("NY Mets", 0, 1.5)),
            quote("1", '"label":"2nd Half Total",', out("Over", 4.5, 9.9)),
            quote("1", "", out("Over", 4.5, 9.9)),
            quote("2", '"label":"Total",', out("Over", 7.5, 3.3)),
            quote("3", '"label":"Total",', out("Over", 6.5, 3.3)),
        ]
    )
    events = ",".join([event("1", "NY Mets", "BOS Red Sox", "NOT_STARTED"), event("2", "NY Mets", "BOS Red Sox", "NOT_STARTED"), event("3", "CHI Cubs", "LA Angels", "STARTED")])
    body = f'{{"eventGroup":{{"events":[{events}],"offerCategories":[{{"offerSubcategoryDescriptors":[{{"offerSubcategory":{{"offers":[[{offers}]]}}}}]}}]}}}}'
    responses = spark.createDataFrame([("TT", body)], "category string, body string")
    rows = payloads.offers(responses, "body", "category")
    twice = payloads.offers(responses.withColumn("day", F.explode(F.array(F.lit(1), F.lit(2)))), "body", "category", ["day"])
    assert twice.count() == 2 * rows.count() and payloads.unread_responses(responses, "body").count() == 0
    assert sorted(values(rows, "away", "home", "period", "market", "side", "line", "odds"), key=str) == sorted(
        [
            ("NYM", "BOS", "TT", "spread", "NYM", -1.5, 2.1),
            ("NYM", "BOS", "TT", "spread", "BOS", 1.5, 1.7),
            ("NYM", "BOS", "TT", "total", "over", 8.5, 1.95),
            ("NYM", "BOS", "TT", "total", "under", 8.5, 1.8),
            ("NYM", "BOS", "Game", "team total", "NYM over", 3.5, 1.6),
            ("NYM", "BOS", "TT", "moneyline", "NYM", None, 1.5),
        ],
        key=str,
    )


def test_registry_takes_the_latest_entry(spark, tmp_path):
    folder = tmp_path / "params" / "pitch_outcome"
    folder.mkdir(parents=True)
    for name, depth in (("10-20240101", 2), ("10-20240701", 5), ("11-20230101", 3)):
        (folder / f"{name}.json").write_text(f'{{"classifier__max_depth": {depth}, "classifier__eval_metric": "mlogloss"}}')
    entries = registry.read_registry(spark, str(tmp_path / "params"))
    today = F.lit("2024-08-01").cast("date")
    valid = registry.latest_valid(entries, ["model", "id"], today, registry.PARAMETER_DAYS)
    assert values(valid, "model", "id", "classifier__max_depth") == [("pitch_outcome", "10", 5)]
    wanted = spark.createDataFrame([("pitch_outcome", "10"), ("pitch_outcome", "11"), ("pitch_outcome", "12")], "model string, id string")
    assert sorted(values(registry.needs_refit(wanted, entries, ["model", "id"], today, 90), "id")) == ["11", "12"]


# -- tables -----------------------------------------------------------------


def test_schema_has_all_columns():
    assert len(schemas.PITCH_SCHEMA) == 92
    assert [f.name for f in schemas.PITCH_SCHEMA if not f.nullable] == ["game_date", "game_pk", "at_bat_number", "pitch_number"]


def test_typed_scan_of_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("game_date,game_pk,at_bat_number,pitch_number,launch_angle,release_speed,pitcher.1\n2024-04-01,1,2,3,12.7,95.5,9\n")
    row = tables.read_pitches(spark, str(tmp_path / "p.csv"), "csv").first()
    assert (row["game_pk"], row["release_speed"], row["umpire"], row["game_date"]) == (1, 95.5, None, datetime.datetime(2024, 4, 1))
    (tmp_path / "q.csv").write_text("game_date,game_pk,at_bat_number\n2024-04-01,1,2\n")
    with pytest.raises(Exception, match="pitch_number is missing"):
        tables.read_pitches(spark, str(tmp_path / "q.csv"), "csv").collect()


def test_values_that_do_not_fit_are_rejected(spark, tmp_path):
    lines = ["game_date,game_pk,at_bat_number,pitch_number,launch_angle,release_speed"]
    lines += ["2024-04-01,543257.0,2,3,12.7,95.5", "2024-04-02,5.43257E5,2,4,12,NaN", "2024-04-03,,2,5,,x", "someday,1,2,6,9223372036854775808,1", "2024-04-04,1,2,7,nan,1"]
    (tmp_path / "p.csv").write_text("\n".join(lines) + "\n")
    source = tables.check_pitches(spark, str(tmp_path / "p.csv"), "csv")
    assert sorted(values(source.rows(), "game_pk", "pitch_number", "launch_angle", "release_speed"), key=str) == [(1, 7, None, 1.0), (543257, 4, 12, None)]
    rejects = sorted(values(source.rejects(), "pitch_number", "column", "value", "reason"), key=str)
    assert rejects == [
        (3, "launch_angle", "12.7", "not a bigint"),
        (5, "game_pk", None, "missing"),
        (5, "release_speed", "x", "not a float"),
        (6, "game_date", "someday", "not a timestamp"),
        (6, "launch_angle", "9223372036854775808", "not a bigint"),
    ]
    counts = checked.load(source, str(tmp_path / "out"), ["game_year"])
    assert counts == {"read": 5, "rejected": 3, "rejected_game_date": 1, "rejected_game_pk": 1, "rejected_launch_angle": 2, "rejected_release_speed": 1}
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("state").count().orderBy("state").collect() == [("accepted", 2), ("rejected", 3)]
    # Values in numeric files: whole numbers stored as doubles.
    df = spark.createDataFrame([(1, 5.0), (2, 5.5), (3, float("nan")), (4, None), (5, 1e30)], "k int, x double")
    schema = "k long not null, x long"
    found = checked.checked(df, T.StructType.fromDDL(schema))
    assert sorted(values(found.rows(), "k", "x"), key=str) == [(1, 5), (3, None), (4, None)]
    assert [r["value"] for r in found.rejects().orderBy("k").collect()] == ["5.5", "1.0E30"]


def test_each_value_is_typed_once(spark, tmp_path):
    """One conversion of a text feeds its column, the test for a problem and both counts; texts with a point raise nothing on the way."""
    (tmp_path / "p.csv").write_text("k,x,typed_x\n1,7.0,a\n2,7.5,b\n3, 8 ,c\n4,1e2,d\n5,9.,e\n6,.0,f\n7,no,g\n8,-0.0,h\n")
    df = spark.read.csv(str(tmp_path / "p.csv"), header=True)
    source = checked.checked(df, T.StructType.fromDDL("k long not null, x long"), keep=["typed_x"])
    assert sorted(values(source.rows(), "typed_x", "k", "x")) == [("a", 1, 7), ("c", 3, 8), ("d", 4, 100), ("e", 5, 9), ("f", 6, 0), ("h", 8, 0)]
    assert sorted(values(source.rejects(), "k", "column", "value", "reason")) == [(2, "x", "7.5", "not a bigint"), (7, "x", "no", "not a bigint")]
    plan = source.frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("as decimal(38,9)") <= 6  # at most three per column: before, the problems converted again


def test_export_is_dealt_out(spark, tmp_path):
    """A single row group of events becomes several files of the export, with the same rows."""
    target = landing._export(spark, DATA, rows=300)
    made = spark.read.csv(target, header=True)
    assert made.rdd.getNumPartitions() > 0 and len([f for f in os.listdir(target) if f.endswith(".csv")]) > 1
    want = standin.feed(spark, DATA).select(*[F.col(f"`{c}`").cast("string").alias(c.replace(".", "_")) for c in made.columns])
    got = made.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in made.columns]).drop("game_date")
    assert got.exceptAll(want.drop("game_date")).isEmpty() and got.count() == want.count()
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") != "8000"


def test_declared_types_prune_the_scan(spark, tmp_path):
    rows = checked.checked(pitches(spark, DATA), schemas.PITCH_SCHEMA).rows()
    rows.write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for df in (tables.read_pitches(spark, str(tmp_path / "t")), tables.check_pitches(spark, str(tmp_path / "t")).rows()):
        plan = days_of_pitches(df)._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters:")[1].split("]")[0]
        assert "GreaterThanOrEqual(game_date" in pushed and "LessThan(game_date" in pushed and "GreaterThan(game_pk,19733)" in pushed
        assert len(plan.split("ReadSchema: ")[1].split("\n")[0].split(",")) <= 5
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_dimension_without_index_column(spark, tmp_path):
    (tmp_path / "d.csv").write_text(",venue_id,venue_name\n0,5,Park\n")
    df = tables.read_dimension(spark, str(tmp_path / "d.csv"), ["venue_id", "venue_name"], "venue_id long, venue_name string")
    assert df.collect()[0].asDict() == {"venue_id": 5, "venue_name": "Park"}


def test_replaced_table(spark):
    assert not tables.has_table(spark, "team_oaa")
    tables.replace_table(spark.range(3), "team_oaa")
    tables.replace_table(spark.range(2), "team_oaa")
    assert tables.has_table(spark, "team_oaa") and spark.table("team_oaa").count() == 2
    assert tables.query(spark, "SELECT count(*) AS n FROM team_oaa WHERE id >= :low", low=1).first()["n"] == 1


def test_filters_reach_the_scan(spark):
    events = tables.read_table(spark, "/root/testdata/sf0.001", "events")
    for df in (shape.as_of(events, date="ts", until="2024-01-10"), shape.distinct_on_day(events, "ts", "2024-01-05", ["user_id"])):
        plan = df.select("user_id")._jdf.queryExecution().executedPlan().toString()
        assert "LessThan" in plan.split("PushedFilters:")[1].split("]")[0]
        assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan
