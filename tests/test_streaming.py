"""Replay in several batches equals the batch operators."""
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import detectors
from tidepanel.schema import DetectorSettings
from tidepanel.streaming import ops


@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    """Daily signal of five ids with gaps, written as three files in day order."""
    rows = [(i, d, float(((d * 7 + i * 3) % 11) / 10 - 0.4 + (0.9 if d > 14 else 0.0))) for i in range(5) for d in range(30) if (d + i) % 9]
    df = spark.createDataFrame(rows, "id long, d int, z double")
    path = str(tmp_path_factory.mktemp("days"))
    for low in (0, 10, 20):
        df.filter(F.col("d").between(low, low + 9)).coalesce(1).write.mode("append").parquet(path)
    return df, path


def stream(spark, days):
    return ops.read_events(spark, days[1], days[0].schema, files_per_trigger=1)


def test_scores_and_episodes(spark, days):
    got = {(r["id"], r["d"]): r for r in ops.run_to_table(ops.stream_detect(stream(spark, days)), "d").collect()}
    batch = detectors.scores(days[0].withColumnRenamed("d", "m"), ["id"]).filter("z is not null")
    rows = batch.collect()
    assert len(rows) == len(got)
    for r in rows:
        for name in detectors.METHODS:
            assert got[r["id"], r["m"]][name] == pytest.approx(r[name], abs=1e-12)
    active = detectors.alarm_episodes(batch.withColumn("active", F.col("ewma") > 0.5), ["id"]).filter("episode")
    assert {(r["id"], r["m"]) for r in active.collect()} == {k for k, r in got.items() if r["episode"]}


def test_bocpd(spark, days):
    got = {(r["id"], r["d"]): r["score"] for r in ops.run_to_table(ops.stream_bocpd(stream(spark, days), 0.3), "b").collect()}
    batch = detectors.score_bocpd(days[0].withColumnRenamed("d", "m"), ["id"], spark.createDataFrame([(0.3,)], "sigma double"), DetectorSettings()).filter("z is not null")
    for r in batch.collect():
        assert (got[r["id"], r["m"]] is None) == (r["score"] is None)
        if r["score"] is not None:
            assert got[r["id"], r["m"]] == pytest.approx(r["score"], rel=1e-9)


def test_confirmation(spark, days):
    dense = days[0].filter("id = 4 and d < 3 or id = 4 and d > 5 and d < 13").select("id", "d", "z")
    got = ops.run_to_table(ops.stream_confirm(stream(spark, days), 0.5), "c")
    # An unbroken stretch must agree with the batch machine started at its first day.
    stretch = days[0].filter("id = 0 and d between 10 and 17").withColumnRenamed("z", "x").withColumnRenamed("d", "m")
    batch = detectors.confirm_shift(stretch, ["id"], spark.createDataFrame([(0, 0.5)], "id long, threshold double"), 11)
    want = {(r["m"], r["event"]) for r in batch.collect()}
    assert (17, "pending") in want
    assert want == {(r["d"], r["event"]) for r in got.filter("id = 0 and d between 10 and 17").collect()} and dense.count() > 0


def test_open_candidates_are_told_by_a_timer_and_survive_a_restart(spark, tmp_path):
    """Id 1 falls silent behind a jump; only the days of id 2 move the watermark past it. Two starts of one query share a checkpoint."""
    rows = [(1, d, 0.0 if d < 4 else 1.0) for d in range(6)] + [(2, d, 0.0) for d in range(12)] + [(3, d, 0.0 if d < 11 else 1.0) for d in range(12)]
    df = spark.createDataFrame(rows, "id long, d int, z double")
    source, out, kept = (str(tmp_path / name) for name in ("in", "out", "kept"))

    def replay(low, high):
        df.filter(F.col("d").between(low, high)).coalesce(1).write.mode("append").parquet(source)
        events = ops.stream_confirm(ops.read_events(spark, source, df.schema, 1), 0.5)
        events.writeStream.format("parquet").option("checkpointLocation", kept).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
        return {(r["id"], r["d"], r["event"]) for r in spark.read.parquet(out).collect()}

    assert replay(0, 5) == {(1, 4, "trigger")}
    assert replay(6, 6) == {(1, 4, "trigger")}  # day 6 of id 1 may still come
    assert replay(7, 11) == {(1, 4, "trigger"), (1, 5, "pending"), (3, 11, "trigger")}  # id 3 is open, and may go on


def test_a_long_run_keeps_its_whole_posterior(spark, tmp_path):
    rows = [(1, d, float(((d * 13) % 17) / 20 - 0.4 + (0.8 if d > 700 else 0.0))) for d in range(1000)]
    df = spark.createDataFrame(rows, "id long, d int, z double")
    for low in (0, 350, 800):
        df.filter(F.col("d").between(low, {0: 349, 350: 799, 800: 999}[low])).coalesce(1).write.mode("append").parquet(str(tmp_path))
    got = {r["d"]: r["score"] for r in ops.run_to_table(ops.stream_bocpd(ops.read_events(spark, str(tmp_path), df.schema, 1), 0.3), "long").collect()}
    batch = detectors.score_bocpd(df.withColumnRenamed("d", "m"), ["id"], spark.createDataFrame([(0.3,)], "sigma double"), DetectorSettings())
    want = {r["m"]: r["score"] for r in batch.collect()}
    assert len(got) == 1000 and all(got[d] == pytest.approx(want[d], rel=1e-9) for d in range(1, 1000))


def test_late_rows_are_counted_exactly_after_restarts(spark, tmp_path):
    """The watermark follows release times; a batch that is repeated replaces itself."""
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    deliveries = [[("a", "2024-01-05"), ("b", "2024-01-10")], [("c", "2024-01-04"), ("d", "2024-01-09"), ("e", "2024-01-20"), ("f", None)], [("g", "2024-01-11"), ("h", "2024-01-19")]]
    schema = None
    for rows in deliveries:
        df = spark.createDataFrame(rows, "key string, day string").select("key", F.to_timestamp("day").alias("ts"))
        schema = df.schema
        df.coalesce(1).write.mode("append").parquet(source)
        kept, late, counts = ops.stream_available(ops.read_events(spark, source, schema), "3 days", folder)
    keys = lambda df: {(r["batch"], r["key"]) for r in df.collect()}
    assert keys(kept) == {(0, "a"), (0, "b"), (1, "d"), (1, "e"), (2, "h")} and keys(late) == {(1, "c"), (1, "f"), (2, "g")}
    assert {(r["batch"], r["kept_rows"], r["late_rows"]) for r in counts.collect()} == {(0, 2, 0), (1, 2, 2), (2, 1, 1)}
