"""Stored versions: valid ones are used, half-written ones don't count, a second run fits nothing."""

import datetime

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler

from pitchframe.operators import boosting
from pitchframe.operators.boosting import Setting
from pitchframe.plans.classifiers import stored_classifier, stored_transitions
from pitchframe.sources.store import Store
from pitchframe.suite.standin import pitches

from test_boosting import frame, made

DAY = datetime.date(2024, 5, 1)


def later(days):
    return DAY + datetime.timedelta(days=days)


def test_versions_and_their_time_limit(spark, tmp_path):
    store, built = Store(spark, str(tmp_path)), []

    def build(n):
        return lambda: (built.append(n), spark.range(n))[1]

    read = lambda n, day, key="a": store.table("t", key, day, 10, build(n)).count()
    assert [read(3, DAY), read(4, later(10)), read(5, later(11)), read(6, later(11)), read(7, DAY, "b")] == [3, 3, 5, 5, 7]
    assert built == [3, 5, 7]
    assert store.latest("t", "a", later(-1), 10) is None  # nothing that is newer than the day asked for

    def fails(path):
        spark.range(2).write.parquet(path)
        raise OSError("writer died")

    with pytest.raises(OSError, match="writer died"):
        store.put("t", "a", later(12), fails)
    assert read(8, later(12)) == 5


def test_a_second_run_fits_nothing(spark, tmp_path, monkeypatch):
    rows = frame(spark, made(11, 300)).selectExpr("*", "xxhash64(x, z, s) AS at")
    groups = [{"max_depth": [1, 2]}, {"learning_rate": [0.3, 0.5]}]
    run = lambda day: stored_classifier(Store(spark, str(tmp_path)), "y", "all", day, rows, "y", ["at"], groups=groups, start=Setting(n_estimators=3))
    first = run(DAY)
    calls = []
    real = boosting.fit_many
    monkeypatch.setattr(boosting, "fit_many", lambda *a: calls.append(1) or real(*a))
    second = run(later(90))
    assert calls == [] and second.document() == first.document()
    score = lambda m: sorted(map(str, m.probabilities(rows).select("x", "predicted", "probabilities").collect()))
    assert score(first) == score(second)
    run(later(91))
    assert len(calls) == 3  # two groups and the fit with the best setting


def test_pipelines_and_tables_are_stored(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    fit = lambda: Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v")]).fit(df)
    for _ in range(2):
        assert store.pipeline("p", "x", DAY, 5, fit).transform(df).first()["v"].toArray().tolist() == [1.0, 2.0]
    rows = pitches(spark, "/root/testdata/sf0.001")
    first = sorted(map(str, stored_transitions(store, DAY, rows).collect()))
    assert first == sorted(map(str, stored_transitions(store, later(180), rows.limit(0)).collect())) and first
    assert store.entries().count() == 2
