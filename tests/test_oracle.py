"""Every registered query against its SQL on DuckDB, and the rules all plans keep."""

import duckdb
import pytest

import __spark_entry__ as entry
from pitchframe import suite
from pitchframe.operators import ordered

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# Forms of the operators that split hot groups, checked again with splitting forced.
SPLIT = """event_sequences split_per_user split_whole_table running_values tracked_runners running_counts
    quantity_ranks_per_supplier global_pseudo_observations price_histogram price_quantile_per_event line_summary
    price_quantiles_by_flag part_name_codes drawn_priorities applied_transitions pitch_sequence_features
    transition_probabilities flag_distances event_transitions streamed_counts""".split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def rows_of(names, rows):
    key = lambda row: tuple((v is None, str(v)) for v in row)
    place = [names.index(n) for n in sorted(names)]
    return sorted((tuple(row[i] for i in place) for row in rows), key=key)


def compare(spark, database, name):
    df = suite.QUERIES[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    result = database.execute(suite.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    want = rows_of(names, result.fetchall())
    assert len(got) == len(want)
    assert got == want
    assert [[type(v) for v in r] for r in got] == [[type(v) for v in r] for r in want]


@pytest.mark.parametrize("name", sorted(suite.SQL))
def test_same_rows_as_sql(spark, database, name):
    compare(spark, database, name)


@pytest.mark.parametrize("name", SPLIT)
def test_same_rows_when_hot_groups_are_split(spark, database, name, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 40)
    compare(spark, database, name)


def test_inventory_is_covered():
    ids = {i for covered in suite.IDS.values() for i in covered}
    counts = {"S": 13, "P": 18, "J": 13, "A": 19, "W": 12, "T": 5, "U": 5, "F": 10, "M": 29, "G": 4, "O": 4, "X": 2}
    assert ids == {f"{letter}{i}" for letter, n in counts.items() for i in range(1, n + 1)}


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(suite.QUERIES) & set(suite.SQL)))
def test_plan_has_no_nested_loops_and_no_python(spark, name):
    plan = suite.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    for word in ("BroadcastNestedLoopJoin", "CartesianProduct", "Python", "Pandas"):
        assert word not in plan
