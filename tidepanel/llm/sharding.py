"""Sharding of records by weighted rendezvous hashing.

Each record scores every shard by its stable key and goes to the best one: a record leaves its shard only for a new shard
that scores higher, so one more shard takes about rows / shards rows, all of them into itself.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.llm.common import dense_ranks, table

SHARDS = 8


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard that wins ``key``: the largest ``-weight / ln(u)``, u a hash of key and shard in (0, 1); ties go to the larger number.

    A null key is a key of its own. Weights are positive; a shard of twice the weight wins twice the keys.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("at least one shard, and positive weights only")
    text = F.coalesce(key.cast("string"), F.lit("\0null"))

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 11)
        return F.struct((F.lit(-weight) / F.log((bits + 0.5) / F.lit(2.0**53))).alias("score"), F.lit(shard).alias("shard"))

    each = [score(s, w) for s, w in sorted(weights.items())]
    return (F.greatest(*each) if len(each) > 1 else each[0])["shard"]


def shard_documents(docs: DataFrame, shards: int = SHARDS, weights: dict[int, float] | None = None) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with its size, checksum, shard, place in the shard and shard after one more is added.

    Repeated rows stay and get places of their own; a null text has size 1 and the checksum of no bytes; no rows give no rows.
    Other columns are ignored. Places are in no order that a reader may rely on; only that they are gapless from 0.
    """
    weights = weights or {s: 1.0 for s in range(shards)}
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    one = docs.select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"), rendezvous(F.col("doc_id"), weights | {max(weights) + 1: 1.0}).alias("grown_shard"))
    return dense_ranks(one, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
