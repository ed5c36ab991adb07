"""Reading panels, lookups and edges: pruned columns, pushed filters, declared schemas."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel import schema
from tidepanel.functions import months


def read_table(spark: SparkSession, path: str, struct=None) -> DataFrame:
    """Parquet or CSV by suffix. CSV needs a declared schema so that nothing is inferred by a scan."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        reader = spark.read if struct is None else spark.read.schema(struct)
        return reader.parquet(path)
    if suffix == "csv":
        if struct is None:
            raise ValueError("CSV input needs a schema")
        return spark.read.schema(struct).option("header", True).option("mode", "FAILFAST").csv(path)
    raise ValueError("tables must be CSV or Parquet")


def read_panel(spark: SparkSession, path: str, struct=None) -> DataFrame:
    return read_table(spark, path, struct or schema.OBSERVATION)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_category_cutoff(spark: SparkSession, path: str, category: str, until: str) -> DataFrame:
    """One category up to a month end; both predicates reach the Parquet scan."""
    return read_panel(spark, path).filter((F.col("category") == category) & (F.col("month") <= F.lit(until).cast("date")))


def read_edges(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return read_table(spark, path, schema.EDGES).filter(F.col("type") == kind).select("id_x", "id_y", "distance")


def with_month_index(df: DataFrame, column: str = "month") -> DataFrame:
    return df.withColumn("m", months.month_index(F.col(column)))
