"""Adapters from the star-schema tables to the panel model.

Each adapter reads only the columns it needs and reduces the fact table with one map-side combined
aggregation, so a hot id costs one partial row per task and month, never its raw rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.functions import months, scalars

TOTAL = "ALL"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, m, value): monthly revenue per supplier, all categories together."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_suppkey").alias("id"), months.month_index("l_shipdate").alias("m"), "l_extendedprice")
        .groupBy("id", "m").agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    )


def supplier_category_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, category, m, value): per return flag, plus the total of all flags."""
    fine = (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("category"),
                months.month_index("l_shipdate").alias("m"), "l_extendedprice")
        .groupBy("id", "category", "m").agg(F.sum("l_extendedprice").alias("value"))
    )
    whole = fine.groupBy("id", "m").agg(F.sum("value").alias("value")).withColumn("category", F.lit(TOTAL))
    return fine.unionByName(whole).withColumn("value", F.round("value", 2))


def part_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, m, value): monthly revenue per part; most months are missing."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_partkey").alias("id"), months.month_index("l_shipdate").alias("m"), "l_extendedprice")
        .groupBy("id", "m").agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    )


def supplier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, region, nation, region_name, nation_name)."""
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("nation"))
    n = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("nation"), F.col("n_name").alias("nation_name"),
        F.col("n_regionkey").cast("long").alias("region"))
    r = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("long").alias("region"), F.col("r_name").alias("region_name"))
    return s.join(n, "nation", "left").join(r, "region", "left").select(
        "id", "region", "nation", "region_name", "nation_name")


def part_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, region): brand number as the parent of a part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long").alias("region"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, d, value, n): daily value per user, d = day number of the calendar."""
    return (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").alias("id"), F.datediff(F.col("ts").cast("date"), F.lit("2023-12-31").cast("date")).alias("d"), "value")
        .groupBy("id", "d").agg(F.round(F.sum("value"), 2).alias("value"), F.count("*").alias("n"))
    )


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_x, id_y, distance, type): one edge per line item between its supplier and part number.

    Numbers are read as one id space; operators keep the edges whose two ends are panel ids.
    """
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("id_x"), F.col("l_partkey").alias("id_y"),
        (F.col("l_extendedprice") / 1000).alias("distance"), F.col("l_returnflag").alias("type"))


def error_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated external events: one claim per error, listed for its user, public the day after."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    day = F.col("ts").cast("date")
    return e.select(
        F.col("event_id").alias("claim_id"),
        F.concat(F.lit("ep"), F.get_json_object("props", "$.k")).alias("episode_id"),
        F.pmod(F.col("user_id"), F.lit(5)).cast("long").alias("region"),
        F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit("]")).alias("ids"),
        day.alias("published_date"), F.date_add(day, 1).alias("available_from"), day.alias("event_start"),
        F.concat(F.lit("https://src"), F.pmod(F.col("event_id"), F.lit(4)).cast("string"), F.lit(".example.org/"),
                 F.col("event_id").cast("string")).alias("source_url"),
    )
