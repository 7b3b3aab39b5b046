import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchframe.operators.ordered import Ordered, sort_columns, top_rows
from pitchframe.operators.split import contiguous_folds, ordered_split


def skewed(spark):
    """One key with half of the rows, NULL keys, NULL order values, one far outlier."""
    df = spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 31 == 0, None).otherwise(F.col("id") % 50).alias("k"),
        F.when(F.col("id") % 97 == 0, None).when(F.col("id") == 500, 1e12).otherwise(F.col("id") * 7919 % 1009 / 10.0).alias("x"),
        F.when(F.col("id") % 5 != 0, F.col("id")).alias("v"),
        "id",
    )
    return df.repartition(8)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("order", [["x", "id"], ["-x", "id"], ["id"], ["-id"]])
def test_split_equals_plain_window(spark, keys, order):
    df = skewed(spark)
    built = (
        Ordered(df, keys, order, rows_per_task=60)
        .row_number("rn")
        .size("n")
        .lag("l1", "v")
        .lag("l3", "id", 3, -1)
        .lead("f1", "v", 1, -2)
        .lead("f2", "id", 2)
        .running_sum("s", "v")
        .running_max("m", "v")
        .build()
    )
    w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumns(
        {
            "rn": F.row_number().over(w).cast("long"),
            "n": F.count("*").over(Window.partitionBy(*keys)),
            "l1": F.lag("v").over(w),
            "l3": F.lag("id", 3, -1).over(w),
            "f1": F.lead("v", 1, -2).over(w),
            "f2": F.lead("id", 2).over(w),
            "s": F.sum("v").over(upto),
            "m": F.max("v").over(upto),
        }
    )
    assert sorted(built.collect(), key=lambda r: r["id"]) == sorted(plain.collect(), key=lambda r: r["id"])


@pytest.mark.parametrize(
    "columns, order",
    [
        ({"x": "concat('Customer#', lpad(id, 12, '0'))"}, ["x"]),  # a long common prefix
        ({"x": "exp(id / 100.0)"}, ["x"]),  # even on a logarithmic scale
        ({"x": "id % 3"}, ["x", "-id"]),  # three values lead the order
        ({"x": "if(id = 0, 1e15D, cast(id as double))"}, ["x"]),  # one far value
        ({"x": "if(id % 2 = 0, double('NaN'), if(id % 5 = 0, null, id))"}, ["x", "id"]),
        ({"x": "date_add(date'2020-01-01', cast(id % 7 as int))"}, ["-x", "id"]),
    ],
)
@pytest.mark.parametrize("keys", [["k"], []])
def test_no_task_gets_a_large_group(spark, columns, order, keys):
    df = spark.range(20_000).selectExpr("id", "1 AS k", *[f"{text} AS {name}" for name, text in columns.items()])
    ordered = Ordered(df.repartition(8), keys, order, rows_per_task=1000).row_number("rn")
    _, parts = ordered._large()
    largest = ordered._segments(df, parts).groupBy("__seg").count().agg(F.max("count")).first()[0]
    assert largest <= 2500
    want = [r["id"] for r in df.orderBy(*sort_columns(order)).collect()]
    assert [r["id"] for r in sorted(ordered.build().collect(), key=lambda r: r["rn"])] == want



def test_hot_groups_may_be_measured_on_the_rows_before_grouping(spark):
    rows = spark.range(5000).select((F.col("id") % 700 * 1.0).alias("x"))
    counts = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    built = Ordered(counts, [], ["x"], rows_per_task=10, measure=rows).running_sum("upto", "n").size("values").build()
    last = built.orderBy(F.desc("x")).first()
    assert (last["upto"], last["values"]) == (5000, 700)


def test_no_hot_group_is_a_plain_window(spark):
    plan = Ordered(spark.range(100), [], ["id"]).row_number("rn").build()._jdf.queryExecution().toString()
    assert "__seg" not in plan


def test_text_order_is_split_by_its_first_bytes(spark):
    df = spark.range(500).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("name"), "id")
    built = Ordered(df, [], ["name"], rows_per_task=5).row_number("rn").build()
    assert all(r["rn"] == r["id"] + 1 for r in built.collect())


def test_top_rows_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    top = top_rows(df, ["k"], ["-id"], 2)
    assert sorted(r["id"] for r in top.collect()) == [94, 95, 96, 97, 98, 99]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 2, Partial" in plan


def test_ordered_split_sizes(spark):
    df = spark.range(11).withColumn("k", F.lit("a"))
    kept = ordered_split(df, ["k"], ["id"], 0.2)
    assert [r["id"] for r in kept.where("is_train").orderBy("id").collect()] == list(range(8))
    folds = contiguous_folds(spark.range(11), ["id"], 3).orderBy("id").collect()
    assert [r["fold"] for r in folds] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2]
