"""Order statistics send groups to the rows, never the rows to every task."""
from pyspark.sql import functions as F

from tidepanel.operators.quantiles import grouped_median, weighted_median


def test_repeated_values_are_not_broadcast(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 5).cast("double").alias("v"), F.lit(1.0).alias("w"))
    df = df.withColumn("k", F.when(F.col("k") < 2, F.col("k")))  # rows without a key belong to no group
    for out in (grouped_median(df, ["k"], "v"), weighted_median(df, ["k"], "v", "w", "median")):
        assert "BuildLeft" not in out._jdf.queryExecution().sparkPlan().toString()
        assert {(r["k"], r["median"]) for r in out.collect()} == {(0, 2.0), (1, 2.0)}
