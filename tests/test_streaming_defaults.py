"""Streams in a session that keeps Spark's default state store."""
from tidepanel.streaming import ops

DEFAULT = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def test_per_id_state_needs_no_setting_of_the_session(spark, tmp_path):
    path = str(tmp_path / "days")
    spark.createDataFrame([(i, d, 0.0 if d < 4 else 1.0) for i in range(3) for d in range(8)], "id long, d int, z double").coalesce(1).write.parquet(path)
    days = lambda: ops.read_events(spark, path, "id long, d int, z double")
    before = spark.conf.get(ops.PROVIDER)
    spark.conf.set(ops.PROVIDER, DEFAULT)
    try:
        assert ops.run_to_table(ops.stream_detect(days()), "detect").count() == 24
        assert ops.run_to_table(ops.stream_confirm(days(), 0.5), "confirm").filter("event = 'confirm'").count() == 3
        assert ops.run_to_table(ops.stream_bocpd(days(), 0.3), "bocpd").count() == 24
        assert spark.conf.get(ops.PROVIDER) == DEFAULT
    finally:
        spark.conf.set(ops.PROVIDER, before)
