"""A large region is not the work of one task."""
from pyspark.sql import functions as F

from tidepanel.operators import events


def test_claims_without_list_meet_their_region_in_many_tasks(spark):
    claims = spark.createDataFrame([(i, 1 if i < 200 else i % 3 + 7, "[]" if i % 5 else "[3]") for i in range(206)] + [(900, None, "[]")], "claim_id long, region long, ids string")
    lookup = spark.createDataFrame([(i, 1) for i in range(400)] + [(1000, 8)], "id long, region long")
    out = events.expand_claims(claims, lookup).withColumn("task", F.spark_partition_id())
    got = {(r["claim_id"], r["id"], r["regional_exposure"]) for r in out.collect()}
    want = {(i, j, True) for i in range(200) if i % 5 for j in range(400)} | {(i, 3, False) for i in range(0, 206, 5)} | {(900, None, True)}
    want |= {(i, 1000 if i % 3 + 7 == 8 else None, True) for i in range(201, 206) if i % 5}
    assert got == want and out.count() == len(want)
    assert out.groupBy("task").count().agg(F.max("count")).first()[0] < 0.25 * len(want)
