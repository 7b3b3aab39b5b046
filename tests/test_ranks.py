"""Ranks of values that many cells share."""

import random

import pytest

from pitchframe.operators import standardize


def test_ranks_of_values_that_many_cells_share(spark, monkeypatch):
    """Values of more than three cells find their rank without a shuffle of their cells, others by a join; the ranks are the same."""
    monkeypatch.setattr(standardize, "HOT_TIES", 3)
    draw = random.Random(5)
    rows = [(draw.choice("ab"), draw.choice([0.0, -0.0, 1.0, None, draw.random()]), float(draw.randint(0, 40))) for _ in range(200)]
    out = standardize.pseudo_observations(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, g string, x double, y double"), ["x", "y"], ["g"])
    got = {r["id"]: (r["x_u"], r["y_u"]) for r in out.collect()}
    assert len(got) == 200
    for i, (g, *values) in enumerate(rows):
        for at, v in enumerate(values):
            held = [r[at + 1] for r in rows if r[0] == g and r[at + 1] is not None]
            rank = None if v is None else sum(h < v for h in held) + (sum(h == v for h in held) + 1) / 2
            assert got[i][at] == (None if v is None else pytest.approx(rank / (len(held) + 1)))
