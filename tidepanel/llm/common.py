"""What the operators share: table access, stored intermediate results, ranks without large groups, crc32."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidepanel.session import cut_lineage as store, scratch_path  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def dense_ranks(df: DataFrame, group: list[str], order: list[str], out: str, salt: int = 1024) -> DataFrame:
    """``out``: a gapless number from 0 within each group.

    A group may hold most rows, so each is dealt to ``salt`` parts by a hash of ``order``; rows are numbered in their part and
    moved by the parts before it. The table of parts has at most ``salt`` rows a group, and is joined, not collected.
    """
    part = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(salt)).cast("int"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = part.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n")).select(
        *group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return part.withColumn("_in", F.row_number().over(inside) - 1).join(moved, [*group, "_part"]).withColumn(
        out, (F.col("_before") + F.col("_in")).cast("long")).drop("_part", "_in", "_before")
