"""Boosted trees: splits by definition, missing values, replayable sums, many models in one pass."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchframe.operators import boosting, models
from pitchframe.operators.boosting import Setting


def frame(spark, rows, schema="x double, z double, s string, y string"):
    return spark.createDataFrame(rows, schema)


def made(seed, n=400):
    """The class depends on x, on whether z is missing and on s."""
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        x, z, s = round(draw.uniform(0, 4), 2), None if draw.random() < 0.3 else draw.uniform(0, 1), draw.choice("abc")
        y = "miss" if z is None else "high" if x > 2.5 else "low" if s != "c" else "odd"
        rows.append((x, z, None if draw.random() < 0.1 else s, y))
    return rows


def same_trees(a, b):
    pairs = [(s, t) for r, q in zip(a.rounds, b.rounds, strict=True) for s, t in zip(r, q, strict=True)]
    return all((s.feature == t.feature).all() and (s.cut == t.cut).all() and (s.value == t.value).all() for s, t in pairs)


def test_missing_values_are_used(spark):
    train, test = frame(spark, made(1, 1500)), frame(spark, made(2, 400))
    fitted = boosting.fit_boosted(train, "y", ["x", "z"], ["s"], Setting(n_estimators=12))
    scored = fitted.with_true_probability(test).collect()
    assert sum(r["predicted"] == r["y"] for r in scored if r["s"]) >= 0.97 * sum(r["s"] is not None for r in scored)
    assert all(math.isclose(sum(r["probabilities"]), 1) for r in scored)
    assert fitted.classes == ["high", "low", "miss", "odd"]
    ranked = [r["feature"] for r in fitted.importances(spark).collect()]
    assert sorted(ranked) == ["s", "x", "z"]
    assert fitted.long_probabilities(test, ["x"]).count() == 4 * 400


def test_first_split_by_definition(spark):
    rows = made(3, 200)
    setting = Setting(max_depth=1, n_estimators=1, min_child_weight=2.0)
    fitted = boosting.fit_boosted(frame(spark, rows), "y", ["x", "z"], (), setting, bins=8)
    prior = np.exp(fitted.first) / np.exp(fitted.first).sum()
    for k, name in enumerate(fitted.classes):
        g = [prior[k] - (r[3] == name) for r in rows]
        h = [prior[k] * (1 - prior[k])] * len(rows)
        best = (0.0, None)
        score = lambda at: sum(g[i] for i in at) ** 2 / (sum(h[i] for i in at) + 1)  # noqa: B023, E731
        for column in (0, 1):
            for cut in [*fitted.binning.cuts["xz"[column]], math.inf]:
                for missing_left in (True, False):
                    left = [i for i, r in enumerate(rows) if (missing_left if r[column] is None else r[column] <= cut)]
                    right = sorted(set(range(len(rows))) - set(left))
                    if min(sum(h[i] for i in left), sum(h[i] for i in right)) >= 2:
                        gain = score(left) + score(right) - score(range(len(rows)))
                        if gain > best[0] + 1e-6:
                            best = (gain, left)
        tree = fitted.rounds[0][k]
        if best[1] is None:
            assert tree.feature[0] == -1
            continue
        f = tree.feature[0]
        cuts = fitted.binning.cuts["xz"[f]]
        bins = [boosting.MISSING if r[f] is None else int(np.searchsorted(cuts, r[f], "left")) for r in rows]
        left = [i for i, b in enumerate(bins) if (tree.missing_left[0] if b == boosting.MISSING else b <= tree.cut[0])]
        right = sorted(set(range(len(rows))) - set(left))
        assert score(left) + score(right) - score(range(len(rows))) == pytest.approx(best[0], abs=1e-3)
        assert tree.value[1] == pytest.approx(-sum(g[i] for i in left) / (sum(h[i] for i in left) + 1) * 0.3, abs=1e-4)


def test_trees_do_not_depend_on_partitions(spark):
    df = frame(spark, made(4))
    binning = boosting.fit_binning(df, ["x", "z"], ["s"])
    classes = boosting.class_names(df, "y")
    settings = [Setting(n_estimators=12, subsample=0.7, colsample_bytree=0.6), Setting(max_depth=2, n_estimators=3)]
    fits = [boosting.fit_many(boosting._binned(df.repartition(n), binning, classes, "y"), "y", classes, binning, settings) for n in (1, 5)]
    assert same_trees(fits[0][0], fits[1][0]) and same_trees(fits[0][1], fits[1][1])
    alone = boosting.fit_many(boosting._binned(df, binning, classes, "y"), "y", classes, binning, settings[1:])
    assert same_trees(alone[0], fits[0][1]) and [len(m.rounds) for m in fits[0]] == [12, 3]


def test_odd_training_rows(spark):
    df = frame(spark, made(5, 60))
    nothing = boosting.fit_boosted(df.limit(0), "y", ["x"], ["s"], Setting(n_estimators=2))
    assert nothing.rounds == [] and nothing.classes == []
    one = boosting.fit_boosted(df.withColumn("y", F.lit("only")), "y", ["x"], ["s"], Setting(n_estimators=2))
    assert {r["predicted"] for r in one.probabilities(df).collect()} == {"only"}
    empty = boosting.fit_boosted(df.withColumns({"x": F.lit(None).cast("double"), "s": F.lit(None).cast("string")}), "y", ["x"], ["s"], Setting(n_estimators=2))
    assert all((t.feature == -1).all() for r in empty.rounds for t in r)
    unseen = frame(spark, [(float("nan"), None, "new", "other"), (1e9, 1.0, None, None)])
    fitted = boosting.fit_boosted(df, "y", ["x", "z"], ["s"], Setting(n_estimators=2))
    rows = fitted.with_true_probability(unseen.withColumn("probability", F.lit(1))).collect()
    assert [r["p_true"] for r in rows][0] == 0.0 and all(r["predicted"] in fitted.classes for r in rows)


def test_search_carries_the_best_setting(spark):
    train, test = frame(spark, made(6)), frame(spark, made(7, 200) + [(1.0, 1.0, "a", "never seen")])
    groups = [{"max_depth": [1, 3]}, {"learning_rate": [0.1, 0.5], "n_estimators": [1, 4]}]
    best, trials = boosting.greedy_search(train, test, "y", ["x", "z"], ["s"], groups, Setting(n_estimators=4))
    assert [g for g, _, _ in trials] == [0, 0, 1, 1, 1, 1]
    depth = min(trials[:2], key=lambda t: t[2])[1].max_depth
    assert depth == 3 and all(s.max_depth == 3 for _, s, _ in trials[2:])
    assert best == min(trials[2:], key=lambda t: t[2])[1]
    fitted = boosting.fit_boosted(train, "y", ["x", "z"], ["s"], best)
    rows = fitted.with_true_probability(test).collect()
    want = sum(-math.log(min(max(r["p_true"], 2.220446049250313e-16), 1 - 2.220446049250313e-16)) for r in rows) / len(rows)
    assert min(t[2] for t in trials[2:]) == pytest.approx(want, rel=1e-6)


def test_rates_leave_out_the_own_fold(spark):
    rows = [(e, y, f) for e, y, f in [(1, "a", 0)] * 3 + [(1, "b", 1)] * 2 + [(2, "a", 0)] + [(None, "b", 1)] + [(2, "a", None)]]
    df = spark.createDataFrame(rows, "e int, y string, f int")
    got = {(r["e"], r["f"]): r["rate_a"] for r in models.out_of_fold_rates(df, "e", "y", ["a", "b"], F.col("f"), prior=2.0).collect()}
    for (e, f), rate in got.items():
        others = [r for r in rows if r[2] != f]
        overall = sum(r[1] == "a" for r in others) / len(others)
        own = [r for r in others if r[0] == e]
        assert rate == pytest.approx((sum(r[1] == "a" for r in own) + 2 * overall) / (len(own) + 2))
    assert len(got) == 5


def test_models_with_the_same_trees_share_their_sums(spark):
    df = frame(spark, made(12))
    binning, classes = boosting.fit_binning(df, ["x", "z"], ["s"]), boosting.class_names(df, "y")
    binned = boosting._binned(df, binning, classes, "y")
    assert len(binned.inputFiles()) > 1
    settings = [Setting(max_depth=1, n_estimators=2), Setting(max_depth=2, n_estimators=2), Setting(max_depth=1, subsample=0.5, n_estimators=2), Setting(max_depth=1, n_estimators=1)]
    grown = boosting.fit_many(binned, "y", classes, binning, settings)
    for model, setting in zip(grown, settings, strict=True):
        assert same_trees(model, boosting.fit_many(binned, "y", classes, binning, [setting])[0])
    growing = {m: [boosting.Tree.empty(s.max_depth) for _ in classes] for m, s in enumerate(settings)}
    empty = [boosting.Boosted("y", classes, binning, grown[0].first, s, gains=np.zeros(3)) for s in settings]
    tables = boosting._histograms(binned, empty, growing, 0, 0, 0)
    assert np.shares_memory(tables[0, 1], tables[1, 1]) and np.shares_memory(tables[0, 1], tables[3, 1])
    assert not np.shares_memory(tables[0, 1], tables[2, 1]) and tables[2, 1][..., 1].sum() < tables[0, 1][..., 1].sum()
