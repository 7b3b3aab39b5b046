"""Invariants of fitted models, draws and synthetic rows."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pitchframe.functions.normal import add_normal_cdf, add_normal_quantile
from pitchframe.operators import metrics, models, sampling, synth
from pitchframe.operators.quantiles import exact_quantiles, quantiles_at
from pitchframe.operators.split import ordered_split
from pitchframe.plans.features import pitch_outcome_set
from pitchframe.sources.tables import read_table
from pitchframe.suite.standin import pitches

DATA = "/root/testdata/sf0.01"
NUMERIC = ["release_speed", "release_spin_rate", "plate_x", "plate_z", "strikes", "balls"]


@pytest.fixture(scope="module")
def split(spark):
    order = ["game_date", "game_pk", "at_bat_number", "pitch_number"]
    rows = ordered_split(pitch_outcome_set(pitches(spark, DATA)), [], order, 0.2)
    return rows.where("is_train").cache(), rows.where("NOT is_train").cache()


def test_classifier_beats_the_training_frequencies(spark, split):
    train, test = split
    fitted = models.fit_classifier(train, "pitch_outcome", NUMERIC, ["p_throws"])
    assert fitted.classes == ["ball", "foul", "hit_by_pitch", "hit_into_play", "strike"]
    scored = metrics.with_baseline_probability(train, fitted.with_true_probability(test), "pitch_outcome")
    row = scored.agg(F.sum(F.log(F.greatest("p_true", F.lit(1e-15)))).alias("model"), F.sum(F.log("p_baseline")).alias("base")).first()
    assert row["model"] > row["base"]
    long = fitted.long_probabilities(test, ["game_pk", "at_bat_number", "pitch_number"])
    assert long.count() == 5 * test.count()
    sums = fitted.probabilities(test).select(F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    ranked = fitted.importances(spark).collect()
    assert len(ranked) == 7 and ranked[0]["importance"] >= ranked[-1]["importance"]


def test_greedy_search_carries_the_best_setting(split):
    train, test = split
    groups = [{"maxDepth": [1, 4]}, {"numTrees": [2, 2]}]
    best, trials = models.greedy_search(train, test, "pitch_outcome", NUMERIC, (), groups)
    first = {t[1]["maxDepth"]: t[2] for t in trials if t[0] == 0}
    assert best["maxDepth"] == min(first, key=first.get)
    assert all(t[1]["maxDepth"] == best["maxDepth"] for t in trials if t[0] == 1)
    assert len(trials) == 4


def test_unseen_text_and_class_still_score(spark):
    train = spark.createDataFrame([(float(i), "L" if i % 2 else "R", "ab"[i % 2]) for i in range(40)], "x double, s string, y string")
    test = spark.createDataFrame([(1.0, "Z", "a"), (2.0, "L", "c")], "x double, s string, y string")
    fitted = models.fit_classifier(train, "y", ["x"], ["s"], models.forest(numTrees=3, maxDepth=2))
    rows = fitted.with_true_probability(test).orderBy("x").collect()
    assert len(rows) == 2 and rows[1]["p_true"] == 0.0 and {r["predicted"] for r in rows} <= {"a", "b"}


def test_scores_after_an_observed_query(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    train = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(40)], "x double, y string")
    fitted = models.fit_classifier(train, "y", ["x"], [], models.forest(numTrees=3, maxDepth=2))
    assert len(fitted.with_true_probability(train.limit(2)).collect()) == 2


def test_entity_rates_shrink_to_the_overall_shares(spark):
    train = spark.createDataFrame([(1, "a")] * 30 + [(2, "b")] * 10, "e int, y string")
    test = spark.createDataFrame([(1,), (2,), (3,)], "e int")
    rows = {r["e"]: r["rate_a"] for r in models.entity_rates(train, test, "e", "y", ["a", "b"], prior=10).collect()}
    assert rows[3] == pytest.approx(0.75) and rows[1] == pytest.approx(37.5 / 40) and rows[2] == pytest.approx(7.5 / 20)


def test_mixed_types_are_refused(spark):
    df = spark.createDataFrame([(1, "a", None)], "x int, s string, d date")
    assert models.feature_columns(df, ["d"]) == (["x"], ["s"])
    with pytest.raises(TypeError):
        models.feature_columns(df, [])


def test_clusters_separate(spark):
    df = spark.createDataFrame([(i, float(i % 2) * 10 + i * 0.01, 1.0) for i in range(40)], "b int, t double, z double")
    found = models.cluster(df, ["t", "z"], 2, seed=1)
    assert found.groupBy((F.col("b") % 2).alias("p"), "cluster").count().count() == 2


def test_regressors(spark):
    df = spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(100)], "x double, y double")
    for kind, least in (("tree", 0.95), ("ridge", 0.99)):
        scored = models.residuals(df, models.fit_regressors(df, ["y"], ["x"], kind), ["x"])
        assert models.regression_report(scored, ["y"]).first()["r2"] > least


def test_normal_curves(spark):
    exact = NormalDist()
    points = [1e-12, 1e-6, 0.01, 0.07, 0.3, 0.5, 0.6, 0.93, 0.999, 1 - 1e-9]
    df = add_normal_quantile(spark.createDataFrame([(p,) for p in [*points, 0.0, 1.0]], "p double"), "p", "z")
    for r in add_normal_cdf(df, "z", "back").collect():
        if 0 < r["p"] < 1:
            assert r["z"] == pytest.approx(exact.inv_cdf(r["p"]), rel=1e-12, abs=1e-14)
            assert r["back"] == pytest.approx(r["p"], rel=1e-6)
        else:
            assert r["z"] == 0.0


def test_draws_follow_their_weights_and_repeat(spark):
    dist = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 3.0)], "g string, o string, w double")
    rows = spark.range(20_000).select("id", F.lit("g").alias("g")).withColumn("u", sampling.hashed_uniform("id", seed=4))
    drawn = sampling.draw(rows, dist, ["g"], ["o"], "w", "u")
    share = drawn.agg(F.avg((F.col("o") == "b").cast("double"))).first()[0]
    assert drawn.count() == 20_000 and share == pytest.approx(0.75, abs=0.01)
    again = sampling.draw(rows.repartition(5), dist, ["g"], ["o"], "w", "u")
    assert sorted(drawn.select("id", "o").collect()) == sorted(again.select("id", "o").collect())
    picked = rows.select(sampling.pick_class(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)), ["x", "y", "z"], F.col("u")).alias("c"))
    counts = {r["c"]: r["count"] / 20_000 for r in picked.groupBy("c").count().collect()}
    assert counts["x"] == pytest.approx(0.2, abs=0.02) and counts["y"] == pytest.approx(0.5, abs=0.02)


def test_ball_samples_stay_near_rows(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 10.0), ("b", 5.0, 5.0), ("b", None, 1.0)], "g string, x double, y double")
    rows = synth.ball_samples(df, ["g"], ["x", "y"], 400, bandwidth=0.5, seed=2).collect()
    assert len(rows) == 800
    centres = {"a": [(0, 0), (10, 10)], "b": [(5, 5)]}
    gaps = [min(math.dist((r["x"], r["y"]), c) for c in centres[r["g"]]) for r in rows]
    assert max(gaps) <= 0.5 + 1e-9
    assert np.mean(np.array(gaps) < 0.25) == pytest.approx(0.25, abs=0.06)  # even in area


def test_log_density_by_hand(spark):
    xs = [0.0, 1.0, 4.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r["point"]: r["log_density"] for r in synth.log_density(df, ["x"], [{"x": 0.5}, {"x": 50.0}], bandwidth=1.0).collect()}
    want = np.log(np.mean([math.exp(-((0.5 - x) ** 2) / 2) / math.sqrt(2 * math.pi) for x in xs]))
    assert got[0] == pytest.approx(want)
    flat = synth.log_density(df, ["x"], [{"x": 0.5}], bandwidth=0.6, kernel="tophat").first()["log_density"]
    assert flat == pytest.approx(math.log(2 / 3 / 1.2))


def test_bandwidth_scores_against_brute_force(spark):
    rng = np.random.default_rng(5)
    xs = rng.normal(size=300)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double")
    got = {r["bandwidth"]: r["mean_log_likelihood"] for r in synth.bandwidth_scores(df, "x", [0.1, 0.4, 3.0], ["i"], folds=3, bins=2048).collect()}
    for h, score in got.items():
        total = 0.0
        for fold in range(3):
            test, train = xs[fold * 100 : fold * 100 + 100], np.delete(xs, slice(fold * 100, fold * 100 + 100))
            kernel = np.exp(-((test[:, None] - train[None, :]) ** 2) / (2 * h * h)) / (h * math.sqrt(2 * math.pi))
            total += np.log(np.maximum(kernel.mean(axis=1), 1e-300)).sum()
        assert score == pytest.approx(total / 300, abs=0.02)
    assert max(got, key=got.get) == 0.4


def test_copula_keeps_margins_and_dependence(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=3000)
    y = np.exp(0.8 * x + 0.6 * rng.normal(size=3000))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    for margins in ("empirical", "histogram"):
        made = synth.copula_samples(df, ["x", "y"], 4000, seed=3, margins=margins, bins=500)
        rows = np.array([(r["x"], r["y"]) for r in made.collect()])
        assert rows.shape == (4000, 2)
        rank = lambda v: np.argsort(np.argsort(v))
        assert np.corrcoef(rank(rows[:, 0]), rank(rows[:, 1]))[0, 1] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1], abs=0.05)
        assert rows[:, 0].min() >= x.min() - 1e-9 and rows[:, 1].max() <= y.max() + 1e-9
        distance = {r["column"]: r["ks_distance"] for r in synth.compare_columns(df, made, ["x", "y"]).collect()}
        assert max(distance.values()) < 0.06


def test_quantiles_with_one_dominant_value(spark):
    values = [5.0] * 4000 + [float(i) for i in range(2000)] + [None] * 10
    df = spark.createDataFrame([(v,) for v in values], "x double")
    data = np.array([v for v in values if v is not None])
    us = [0.0, 0.001, 0.3, 0.6657, 0.66678, 0.9, 1.0]
    fixed = {r["p"]: r["quantile"] for r in exact_quantiles(df, ["x"], us).collect()}
    draws = spark.createDataFrame([("x", u) for u in us], "column string, u double")
    varying = {r["u"]: r["value"] for r in quantiles_at(df, ["x"], draws).collect()}
    for u in us:
        assert fixed[u] == pytest.approx(np.quantile(data, u))
        assert varying[u] == pytest.approx(np.quantile(data, u))


def test_a_split_is_ordered_once_and_read_by_all_fits(spark):
    from pitchframe.suite import learning

    rows = spark.range(50).selectExpr("id AS game_date", "id AS game_pk", "id AS at_bat_number", "id AS pitch_number", "id % 3 AS x")
    train, test = learning._later(rows, learning._ORDER)
    assert {r["game_pk"] for r in train.collect()} == set(range(40)) and {r["game_pk"] for r in test.collect()} == set(range(40, 50))
    assert all("split-" in f for f in train.inputFiles()) and train.inputFiles()
