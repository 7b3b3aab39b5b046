"""Counts drawn from quantiles, densities at rows, and operators that cut before they sort."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchframe.functions import binomial
from pitchframe.operators import metrics, ordered, shape, synth
from pitchframe.operators.quantiles import quantiles_at
from pitchframe.plans.features import training_sets


def plain_quantile(u, n, p):
    total = 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total >= u:
            return k
    return n


def test_binomial_quantiles_by_definition():
    draw = random.Random(1)
    cases = [(draw.random(), draw.choice([0, 1, 2, 7, 40, 300, 900]), draw.choice([0.0, 1.0, 1e-6, 0.3, 0.5, draw.random()])) for _ in range(500)]
    u, n, p = (np.array(x) for x in zip(*cases, strict=True))
    assert binomial.binomial_quantile(u, n, p).tolist() == [plain_quantile(*c) for c in cases]
    # Where the expansion takes over, both give the same counts.
    u, n, p = np.linspace(0.001, 0.999, 60), np.full(60, 50_000), np.full(60, 0.4)
    assert binomial._expanded(u, n, p).tolist() == binomial._searched(u, n, p).tolist()
    wide = binomial.binomial_quantile(np.array([0.5, 1e-9, 1 - 1e-9]), np.full(3, 10**12), np.full(3, 0.25))
    assert abs(int(wide[0]) - 25 * 10**10) <= 1 and wide[1] < wide[0] < wide[2]


def test_drawn_counts_add_up():
    draw = np.random.default_rng(4)
    p = np.tile([0.2, 0.0, 0.5, 0.3], (2000, 1))
    counts = binomial.multinomial_counts(draw.random((2000, 4)), np.full(2000, 50), p)
    assert (counts.sum(axis=1) == 50).all() and (counts[:, 1] == 0).all() and (counts >= 0).all()
    assert counts.mean(axis=0) == pytest.approx([10, 0, 25, 15], abs=0.3)
    assert binomial.multinomial_counts(np.zeros((2, 1)), np.array([3, 0]), np.ones((2, 1))).tolist() == [[3], [0]]


def test_repeated_tests_find_the_different_group(spark):
    shares = spark.createDataFrame([(g, c, p) for g in ("same", "other", "none") for c, p in (("a", 0.5), ("b", 0.3), ("c", 0.2))], "g string, c string, p double")
    seen = [("same", "a", 5000), ("same", "b", 3000), ("same", "c", 2000), ("other", "a", 3000), ("other", "b", 5000), ("other", "c", 2000), ("new", "a", 5), ("none", "z", 4)]
    rows = metrics.repeated_goodness_of_fit(spark.createDataFrame(seen, "g string, c string, n long"), shares, ["g"], "c", draws=400).collect()
    got = {r["g"]: r["share_different"] for r in rows}
    assert set(got) == {"same", "other", "none"} and all(r["draws"] == 400 for r in rows)
    # Observed counts at the expectation differ from a draw rarely, others nearly always; a class that is never drawn always.
    assert got["same"] < 0.3 and got["other"] == 1.0 and got["none"] == 1.0


def test_density_at_rows_with_split_cells(spark):
    draw = random.Random(6)
    data = [(draw.gauss(0, 1), draw.gauss(0, 2)) for _ in range(300)] + [(0.5, 0.5)] * 50 + [(None, 1.0), (900.0, -900.0)]
    points = [(i, draw.gauss(0, 2), draw.gauss(0, 2)) for i in range(40)] + [(98, 500.0, 0.0), (99, None, 0.0)]
    df, at = spark.createDataFrame(data, "x double, y double"), spark.createDataFrame(points, "id int, x double, y double")
    whole = [d for d in data if d[0] is not None]
    for kernel, h in (("gaussian", 0.7), ("tophat", 0.9)):
        for limit in (10_000, 7):
            got = {r["id"]: r["log_density"] for r in synth.log_density_at(df, ["x", "y"], at, ["id"], bandwidth=h, kernel=kernel, rows_per_cell=limit).collect()}
            assert set(got) == {p[0] for p in points if p[1] is not None} and got[98] is None
            for i, x, y in points[:40]:
                far = [(x - a) ** 2 + (y - b) ** 2 for a, b in whole]
                total = sum(math.exp(-d / (2 * h * h)) / (2 * math.pi * h * h) if kernel == "gaussian" else (d <= h * h) / (math.pi * h * h) for d in far)
                assert got[i] == (pytest.approx(math.log(total / len(whole)), abs=1e-6) if total > 0 else None)


def test_density_asks_equal_points_once_and_sums_by_column(spark):
    """Sixty thousand points at six places over forty thousand rows of one cell: the pairs of all would take minutes."""
    df = spark.range(40_000).selectExpr("id / 40000 AS x", "CAST(id % 4 AS DOUBLE) AS y")
    at = spark.range(60_000).selectExpr("id", "CAST(id % 3 AS DOUBLE) AS x", "CAST(id % 2 AS DOUBLE) AS y")
    start = time.monotonic()
    got = {r["id"]: r["log_density"] for r in synth.log_density_at(df, ["x", "y"], at, ["id"], bandwidth=1.0, rows_per_cell=100_000).collect()}
    assert time.monotonic() - start < 40 and len(got) == 60_000
    k = np.arange(40_000)
    for i in range(6):
        want = np.mean(np.exp(-((k / 40000 - i % 3) ** 2 + (k % 4 - i % 2) ** 2) / 2)) / (2 * math.pi)
        assert {round(got[j], 6) for j in range(i, 60_000, 6)} == {round(math.log(want), 6)}


def test_density_of_repeated_and_missing_keys(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0)], "x double, y double")
    at = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 0.0), (None, -0.0, 0.0)], "id int, x double, y double")
    got = {r["id"]: r["log_density"] for r in synth.log_density_at(df, ["x", "y"], at, ["id"], bandwidth=1.0).collect()}
    one = (1 + math.exp(-0.5)) / (4 * math.pi)
    assert got == {1: pytest.approx(math.log(2 * one)), None: pytest.approx(math.log(one))}


def test_first_rows_after_a_counted_cut(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 20)
    draw = random.Random(8)
    rows = [(draw.choice([None, *range(9)]), k) for k in range(200)]
    df = spark.createDataFrame(rows, "a int, k int").repartition(6)
    for order in (["a", "k"], ["-a", "k"], ["k"]):
        for n in (0, 1, 25, 150, 195, 500):
            want = [tuple(r) for r in df.orderBy(*ordered.sort_columns(order)).limit(n).collect()]
            cohort = shape.bounded_cohort(df, order, n)
            assert [tuple(r) for r in cohort.collect()] == want
    assert shape.bounded_cohort(df.limit(0), ["a"], 5).count() == 0


def test_quantiles_at_odd_positions(spark, monkeypatch):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (2.0, None), (7.0, 6.0), (None, None)], "x double, y double")
    us = [0.0, 0.1, 0.5, 0.9, 1.0, None, -0.1, 1.5]
    draws = spark.createDataFrame([(c, u, i) for c in ("x", "y", "z") for i, u in enumerate(us + [0.5] * 40)], "column string, u double, id int")
    want = {"x": [1.0, 1.3, 2.0, 5.5, 7.0], "y": [5.0, 5.1, 5.5, 5.9, 6.0]}
    for limit in (10**6, 5):
        monkeypatch.setattr(ordered, "ROWS_PER_TASK", limit)
        rows = quantiles_at(df, ["x", "y"], draws).collect()
        assert len(rows) == 2 * len(us) + 80 and {r["column"] for r in rows} == {"x", "y"}
        for r in rows:
            if r["id"] < 5:
                assert r["value"] == pytest.approx(want[r["column"]][r["id"]])
            elif r["id"] < 8:
                assert r["value"] is None
            else:
                assert r["value"] == pytest.approx(want[r["column"]][2])


def test_entities_without_rows_share_one_cohort(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 0.7), (2, 0.1), (4, 9.0)], "batter long, x double")
    cohort = spark.createDataFrame([(8, 3.0), (9, 4.0)], "batter long, x double")
    wanted = spark.createDataFrame([(1,), (3,), (3,), (5,), (2,)], "batter long")
    sets, kept = training_sets(wanted, rows, "batter", cohort)
    assert sorted(map(tuple, sets.collect())) == [(1, 1), (2, 2), (3, -1), (5, -1)]
    assert sorted(map(tuple, kept.groupBy("training_set").agg(F.count("*")).collect())) == [(-1, 2), (1, 2), (2, 1)]
