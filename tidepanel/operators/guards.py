"""Checks that reject bad input. Each is one aggregate that returns the number of offending rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assert_empty(df: DataFrame, message: str) -> None:
    if df.limit(1).count():
        raise ValueError(message)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    assert_empty(duplicates(df, keys), f"duplicate {keys}")
    return df


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df`` unchanged; a row for which ``condition`` is not true stops the job that reads it. Nothing runs before that."""
    return df.filter(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def require_unique(df: DataFrame, keys: list[str], message: str | None = None) -> DataFrame:
    """``df`` unchanged, with a check inside its plan: rows are counted per key where a join by these keys has to bring them together anyway."""
    counted = df.withColumn("_times", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    return require(counted, F.col("_times") == 1, message or f"duplicate {keys}").drop("_times")


def bad_ids(df: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is missing, negative or not integral."""
    x = F.col(column).cast("double")
    return df.filter(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))) | (x < 0) | (x != F.floor(x)))


def validate_ids(df: DataFrame, column: str = "id") -> DataFrame:
    assert_empty(bad_ids(df, column), f"{column}: nonnegative integers required")
    return df.withColumn(column, F.col(column).cast("long"))


def not_unique_pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    """Codes that break a one-to-one mapping, on either side."""
    pairs = df.select(left, right).distinct()
    a = pairs.groupBy(F.col(left).cast("string").alias("code")).agg(F.count("*").alias("n")).withColumn("side", F.lit(left))
    b = pairs.groupBy(F.col(right).cast("string").alias("code")).agg(F.count("*").alias("n")).withColumn("side", F.lit(right))
    return a.unionByName(b).filter("n > 1")
