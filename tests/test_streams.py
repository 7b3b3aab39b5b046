"""Streams against the batch operators they mirror."""

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchframe.functions.categories import PITCH_CLASSES, collapse
from pitchframe.operators.joins import only_new
from pitchframe.operators.state import running_count
from pitchframe.sources.tables import read_table
from pitchframe.streaming import counts, ingest
from pitchframe.suite.standin import pitches

DATA = "/root/testdata/sf0.001"


def day_files(df, order, folder, parts):
    """Write consecutive parts as files that arrive one after the other."""
    rows = df.withColumn("_part", F.ntile(parts).over(Window.orderBy(*order))).persist()
    for i in range(1, parts + 1):
        rows.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(folder)
    return folder


def arriving(spark, folder, schema):
    return ingest.pitch_stream(spark, folder, schema, maxFilesPerTrigger=1)


def test_ingest_keeps_every_row_once(spark, tmp_path):
    events = read_table(spark, DATA, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "game_year": F.year("ts")})
    source, target, check = (str(tmp_path / n) for n in ("source", "target", "check"))
    day_files(events, ["ts"], source, 4)
    events.limit(150).write.mode("append").parquet(source)  # late repeats
    query = ingest.start_ingest(arriving(spark, source, events.schema), target, check, ["event_id"], "ts")
    query.awaitTermination()
    stored = spark.read.parquet(target)
    assert stored.count() == stored.select("event_id").distinct().count() == events.count()
    # Only new files are read when the stream is started again.
    events.limit(1).withColumn("event_id", F.lit(-1).cast("long")).write.mode("append").parquet(source)
    ingest.start_ingest(arriving(spark, source, events.schema), target, check, ["event_id"], "ts").awaitTermination()
    assert spark.read.parquet(target).count() == events.count() + 1


def test_watermark_counts_what_it_drops(spark, tmp_path):
    events = read_table(spark, DATA, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "game_year": F.year("ts")})
    source, target, check = (str(tmp_path / n) for n in ("source", "target", "check"))
    day_files(events, ["ts"], source, 3)
    early = events.orderBy("ts").limit(20)
    early.coalesce(1).write.mode("append").parquet(source)
    query = ingest.start_ingest(arriving(spark, source, events.schema), target, check, ["event_id"], "ts", watermark="2 days")
    query.awaitTermination()
    assert spark.read.parquet(target).count() == events.count()
    assert ingest.dropped_as_late(query) == 20


def test_repeated_batch_appends_nothing(spark, tmp_path):
    events = read_table(spark, DATA, "events").withColumn("game_year", F.year("ts"))
    target = str(tmp_path / "target")
    for _ in range(2):
        ingest.append_batch(events, target, ["event_id"], "ts", ["game_year"])
    assert spark.read.parquet(target).count() == events.count()


def test_incremental_rules(spark):
    day = lambda y, d: datetime.date(y, 5, d)
    stored = spark.createDataFrame([(1, day(2020, 3)), (2, day(2020, 9)), (3, day(2020, 10))], "k int, d date")
    incoming = spark.createDataFrame(
        [(1, day(2020, 3)), (9, day(2020, 3)), (3, day(2020, 10)), (4, day(2020, 10)), (4, day(2020, 10)), (5, day(2022, 1))], "k int, d date"
    )
    run = lambda base, today: sorted(r["k"] for r in ingest.incremental_rows(incoming, base, ["k"], "d", today).collect())
    assert run(None, day(2020, 11)) == [1, 3, 4, 5, 9]
    assert run(stored, day(2020, 11)) == [4, 5]  # from the stored maximum on
    assert run(stored, day(2022, 11)) == [4, 5, 9]  # a gap over a year: the whole year is compared


def test_streamed_counts_equal_batch(spark, tmp_path):
    rows = pitches(spark, DATA).withColumn("outcome", collapse("description", PITCH_CLASSES))
    keys, order = ["pitcher"], ["game_date", "event_id"]
    source = day_files(rows, order, str(tmp_path / "source"), 7)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = arriving(spark, source, rows.schema)
    counts.start_counts(stream, out, state, str(tmp_path / "check"), keys, order, "outcome", generation=2).awaitTermination()
    columns = ["event_id", "balls_after", "strikes_after", "event"]
    batch = running_count(rows, keys, order, "outcome").select(*columns)
    live = spark.read.parquet(out)
    assert live.select("batch").distinct().count() == 7
    assert sorted(batch.collect()) == sorted(live.select(*columns).collect())
    # Repeating a batch gives the same output again.
    last = live.where("batch = 6").select(*rows.columns)
    counts.count_batch(last.persist(), 6, out, state, keys, order, "outcome", 2)
    assert sorted(spark.read.parquet(out).select(*columns).collect()) == sorted(batch.collect())


def test_late_and_repeated_rows_are_counted(spark, tmp_path):
    events = read_table(spark, DATA, "events").withColumn("game_month", F.date_format("ts", "yyyy-MM-dd"))
    target = str(tmp_path / "target")
    late = events.where("ts < '2024-01-05'")
    first = events.where("ts >= '2024-01-05'")
    n = first.count()
    assert ingest.append_batch(first.unionByName(first), target, ["event_id"], "ts", ["game_month"]) == {"arrived": 2 * n, "late": 0, "without_date": 0, "appended": n}
    assert ingest.append_batch(late.unionByName(first.limit(5)), target, ["event_id"], "ts", ["game_month"]) | {"late": 0} == {
        "arrived": late.count() + 5, "late": 0, "without_date": 0, "appended": late.count()
    }
    stored = spark.read.schema(events.schema).parquet(target)
    assert stored.count() == events.count()
    # Stored keys are read for the batch's own partitions and dates.
    spans = late.groupBy("game_month").agg(F.min("ts").alias("low"), F.max("ts").alias("high")).collect()
    plan = ingest.near_keys(stored, spans, "ts", ["game_month"]).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "game_month" in plan.split("PartitionFilters: [")[1].split("]")[0] and "ts" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert ingest.high_water_mark(stored, "ts", ["game_month"]) == events.agg(F.max("ts")).first()[0]
    nothing = ingest.append_batch(late.limit(0), target, ["event_id"], "ts", ["game_month"])
    assert nothing == {"arrived": 0, "late": 0, "without_date": 0, "appended": 0}


def test_a_repeated_key_keeps_its_smallest_row(spark):
    rows = spark.createDataFrame([(1, "b", 2.0), (1, "a", 9.0), (1, "a", 3.0), (2, None, 1.0), (2, "z", 0.0)], "k int, s string, x double")
    stored = rows.where("k = 9").select("k")
    for parts in (1, 4):
        assert sorted(tuple(r) for r in only_new(rows.repartition(parts), stored, ["k"]).collect()) == [(1, "a", 3.0), (2, None, 1.0)]


def test_at_bats_leave_the_state(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    start = datetime.datetime(2024, 4, 1)
    carried, late = [], 0
    for number in range(14):
        # Three at-bats a batch: one ends, one never does, one goes on in the next batch.
        rows = [(f"end{number}", start + datetime.timedelta(hours=number), 1, "ball", True), (f"stay{number}", start + datetime.timedelta(hours=number), 2, "strike", False)]
        rows += [("long", start + datetime.timedelta(hours=number if number != 9 else 1), 3, "ball" if number % 2 else "foul", False)]
        batch = spark.createDataFrame(rows, "at_bat string, ts timestamp, n int, outcome string, last boolean").coalesce(1)
        seen = counts.count_batch(batch, number, out, state, ["at_bat"], ["ts", "n"], "outcome", 2, ends=F.col("last"), horizon="3 HOURS")
        carried.append(seen["carried"])
        late += seen["out_of_order"]
    assert max(carried[6:]) <= 12 and carried[-1] <= carried[7] and late == 1
    rows = spark.read.parquet(out).where("at_bat = 'long'").orderBy("batch").collect()
    assert [r["out_of_order"] for r in rows] == [b == 9 for b in range(14)]
