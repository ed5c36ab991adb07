"""Writers: forecasts, frozen issues, resumable units, nested export, fingerprints."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.session import cut_lineage


def write_forecasts(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy("origin").parquet(path)


def write_csv(df: DataFrame, path: str, digits: int = 12) -> None:
    """Doubles with a fixed number of significant digits."""
    kinds = dict(df.dtypes)
    out = df.select(*[
        F.format_string(f"%.{digits}g", F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns
    ])
    out.write.mode("errorifexists").option("header", True).csv(path)


def write_frozen(df: DataFrame, path: str) -> None:
    """An issued forecast is never overwritten."""
    df.write.mode("errorifexists").parquet(path)


def _existing(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_resumable(df: DataFrame, path: str, unit: list[str], token: str, compute: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Store the units of ``df`` that a commit log beside ``path`` does not name yet, each in its own folder.

    The log holds names of finished units and the token of their inputs and settings; another token is refused. Only unit columns are read
    to find what is missing, and ``compute`` (source rows → stored rows, unit columns kept) sees missing units only. A unit is named after
    its rows are written, so one that a failure left behind is written again over what there is. Returns how many were written.
    """
    spark, log = df.sparkSession, f"{path.rstrip('/')}-commits"
    done = _existing(spark, log, df.select(*unit).withColumn("_token", F.lit(token)).schema)
    if done.filter(F.col("_token") != token).limit(1).count():
        raise ValueError("stored units come from other inputs or settings")
    pending = cut_lineage(df.select(*unit).distinct().join(done.select(*unit), unit, "left_anti"), "pending")
    n = pending.count()
    if n:
        rows = df.join(pending, unit, "left_semi")
        rows = compute(rows) if compute else rows
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*unit).parquet(path)
        pending.withColumn("_token", F.lit(token)).write.mode("append").parquet(log)
    return n


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free change detector: row count, sum and xor of row hashes."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.select(h.alias("h")).agg(
        F.count("*").alias("n"),
        F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum_hash"),
        F.bit_xor("h").alias("xor_hash"),
    )


def export_nested(forecasts: DataFrame) -> DataFrame:
    """One JSON document per id: {category: {horizon: [[target, predicted], …]}}.

    The month axis bounds what is nested under one id.
    """
    per_h = forecasts.groupBy("id", "category", "horizon").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("target", "predicted"))),
            lambda s: F.array(s["target"].cast("string"), s["predicted"].cast("string")),
        ).alias("points"))
    per_c = per_h.groupBy("id", "category").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("horizon").cast("string"), "points")))).alias("h"))
    return per_c.groupBy("id").agg(
        F.to_json(F.map_from_entries(F.array_sort(
            F.collect_list(F.struct("category", "h")),
            lambda a, b: F.when(a["category"] < b["category"], -1).otherwise(1)))).alias("document"))
