"""Benchmark decontamination with SimHash windows, on DataFrame operations only.

Texts are lower-cased and split at white space; n words have n - 4 shingles of five words. A document holds an item if a window of
as many shingles as the item has (all of the document, if it has fewer) and the item reach SIMILAR / 100 of weighted similarity:
the sum over shingles of the smaller number of times, by the sum of the larger.

1. Positions whose shingle belongs to an item of n shingles are found by an equi-join on hashes. A similar window holds at least
   ``ceil(4 (n + m) / 9)`` of them, m its own shingles, so all windows without are left out. No rows are lost by this.
2. Each window of n shingles that is left gets a 64-bit SimHash of its shingles, each occurrence counted; equal windows are done once.
3. Multi-index: a fingerprint has eight blocks of eight bits. Two fingerprints within RADIUS bits have a block within RADIUS // 8 bits, so
   items are indexed under all values that near for each block, and a window looks up its eight. This finds every fingerprint of that
   size within RADIUS.
4. The weighted similarity of each window and item found is counted on the shingles themselves.

At SIMILAR = 80 two fingerprints differ in about 10 bits of 64, with a deviation of 3; RADIUS = 23 leaves more than four deviations.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.llm.common import store, table

SIMILAR, RADIUS = 80, 23
#: Items and windows that are broadcast at most; with more, the joins shuffle both sides.
BROADCAST_ITEMS, BROADCAST_WINDOWS = 2_000, 500_000

_SPACES = " \t\n\u000b\f\r"


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.lower(text), F.lit(_SPACES))
    return F.when(trimmed != "", F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1))


def _hashes(words: str) -> Column:
    """Hashes of the shingles of an array of words; null with fewer than five.

    The array is bound to a lambda's variable: else the optimizer may put the expression for it into the inner lambda.
    """
    return F.expr(f"""transform(array({words}), w -> CASE WHEN size(w) >= 5 THEN transform(sequence(0, size(w) - 5),
        i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])) END)[0]""")


def _shingles(words: str) -> Column:
    return F.expr(f"transform(array({words}), w -> transform(sequence(1, size(w) - 4), i -> array_join(slice(w, i, 5), ' ')))[0]")


def _simhash(hashes: str) -> Column:
    """Eight blocks of eight bits, as numbers: a bit is set if more than half of the hashes have it."""
    bits = f"transform(sequence(0, 63), b -> int(2 * aggregate({hashes}, 0L, (s, h) -> s + (shiftright(h, b) & 1L)) > size({hashes})))"
    blocks = "transform(sequence(0, 7), j -> aggregate(sequence(0, 7), 0, (s, i) -> s + shiftleft(bits[8 * j + i], i)))"
    return F.expr(f"transform(array({bits}), bits -> {blocks})[0]")


def _distance(a: str, b: str) -> Column:
    return F.expr(" + ".join(f"bit_count({a}[{j}] ^ {b}[{j}])" for j in range(8)))


def _common(a: str, b: str) -> Column:
    """Sum over shingles of the smaller number of times; without repeats the size of the intersection."""
    return F.expr(f"""CASE WHEN size(array_distinct({a})) = size({a}) AND size(array_distinct({b})) = size({b}) THEN size(array_intersect({a}, {b}))
        ELSE aggregate(array_distinct({a}), 0, (s, x) -> s + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x)))) END""")


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds two hashes of doc_id and text, which tell rows apart if ids repeat or are null."""
    return docs.withColumns({"_k1": F.xxhash64("doc_id", "text"), "_k2": F.xxhash64("text", F.lit(7), "doc_id")})


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(_k1, _k2, doc_id, item_id, similarity, start): each row of ``docs`` (doc_id, text) and item of ``items`` (item_id, text) that it holds.

    similarity is that of the best window and start its first word, the earliest of equal ones. Items of fewer than five words
    and null texts have no shingles and are in no document; a repeated item_id counts once for each text of its own, and rows of ``docs``
    that are equal in doc_id and text count once. Other columns are ignored.
    """
    items = items.select("item_id", _words(F.col("text")).alias("w")).where("size(w) >= 5").distinct()
    items = items.select("item_id", _shingles("w").alias("ish"), _hashes("w").alias("ih")).withColumns({"n": F.size("ih"), "iblocks": _simhash("ih")})
    items = store(items, "items")
    few = items.count() <= BROADCAST_ITEMS
    small = F.broadcast if few else (lambda df: df)
    docs = _keyed(docs.select("doc_id", "text"))
    known = items.select(F.explode(F.array_distinct("ih")).alias("h"), "n").distinct()
    placed = docs.select("_k1", "_k2", _words(F.col("text")).alias("w")).select("_k1", "_k2", _hashes("w").alias("hs")).select(
        "_k1", "_k2", F.size("hs").alias("total"), F.posexplode_outer("hs").alias("pos", "h"))
    hits = placed.join(small(known), "h").groupBy("_k1", "_k2", "n", "total").agg(F.array_sort(F.collect_set("pos")).alias("p"))  # of one document
    hits = hits.withColumn("m", F.least("n", "total")).withColumn("need", F.expr("int((4 * (n + m) + 8) div 9)")).where("size(p) >= need")
    ranges = F.expr("filter(transform(sequence(0, size(p) - need), i -> struct(greatest(0, p[i + need - 1] - m + 1) AS a, least(p[i], total - m) AS z)), r -> r.a <= r.z)")
    starts = F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["a"], r["z"]))))
    spots = hits.select("_k1", "_k2", "n", F.col("m"), F.explode_outer(starts).alias("start")).where("start is not null").groupBy("_k1", "_k2").agg(F.collect_list(F.struct("n", "m", "start")).alias("spots"))
    spots = store(spots, "spots")
    size = spots.agg(F.sum(F.size("spots"))).first()[0] or 0  # one number
    windows = docs.join(F.broadcast(spots) if size <= BROADCAST_WINDOWS else spots, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]).select(
        "_k1", "_k2", "doc_id", _words(F.col("text")).alias("w"), F.explode("spots").alias("x")).select(
        "_k1", "_k2", "doc_id", "x.n", "x.start", F.expr("slice(w, x.start + 1, x.m + 4)").alias("v"))
    windows = store(windows, "windows")
    different = windows.select("n", "v").distinct().withColumn("vh", _hashes("v")).select("n", "v", _simhash("vh").alias("blocks"))
    index = items.select("n", "item_id", "iblocks", F.posexplode("iblocks").alias("j", "own")).select(
        "n", "item_id", "iblocks", "j", F.explode(F.expr(f"filter(sequence(0, 255), x -> bit_count(x ^ own) <= {RADIUS // 8})")).alias("value"))
    found = different.select("n", "v", "blocks", F.posexplode("blocks").alias("j", "value")).join(small(index), ["n", "j", "value"]).where(
        _distance("blocks", "iblocks") <= RADIUS).select("n", "v", "item_id").distinct()
    both = found.join(small(items.select("n", "item_id", "ish")), ["n", "item_id"]).withColumn("sh", _shingles("v"))
    both = both.withColumn("c", _common("sh", "ish")).withColumn("u", F.size("sh") + F.size("ish") - F.col("c")).where(f"100 * c >= {SIMILAR} * u")
    best = both.groupBy("n", "v", "item_id").agg(F.max(F.col("c") / F.col("u")).alias("similarity"))
    return windows.join(best, ["n", "v"]).groupBy("_k1", "_k2", "doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("b")).select(
        "_k1", "_k2", "doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.s")).cast("long").alias("start"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    leaks = store(find_leaks(docs, items).select("_k1", "_k2").distinct(), "leaks")
    few = leaks.count() <= BROADCAST_WINDOWS
    return _keyed(docs).join(F.broadcast(leaks) if few else leaks, ["_k1", "_k2"], "left_anti").select(*docs.columns)


_SPLIT = "regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')"
ORACLE = {"op1_decontamination": f"""WITH i AS (SELECT item_id, w, len(w) - 4 AS n FROM (SELECT item_id, {_SPLIT} AS w FROM benchmark) WHERE len(w) >= 5),
d AS (SELECT doc_id, w, len(w) - 4 AS total FROM (SELECT doc_id, {_SPLIT} AS w FROM documents) WHERE len(w) >= 5),
ish AS (SELECT item_id, n, s, count(*) AS k FROM (SELECT item_id, n, array_to_string(w[j:j+4], ' ') AS s FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM i)) GROUP BY ALL),
dsh AS (SELECT doc_id, total, j - 1 AS pos, array_to_string(w[j:j+4], ' ') AS s FROM (SELECT *, unnest(range(1, total + 1)) AS j FROM d)),
hit AS (SELECT doc_id, item_id, n, k, s, pos, total, least(n, total) AS m FROM dsh JOIN ish USING (s)),
win AS (SELECT doc_id, item_id, n, m, s, k, unnest(range(greatest(0, pos - m + 1), least(pos, total - m) + 1)) AS start FROM hit),
c AS (SELECT doc_id, item_id, n, m, start, sum(c) AS c FROM (SELECT doc_id, item_id, n, m, start, s, least(any_value(k), count(*)) AS c FROM win GROUP BY ALL) GROUP BY ALL),
ok AS (SELECT doc_id, item_id, start, c / (n + m - c) AS similarity FROM c WHERE 100 * c >= {SIMILAR} * (n + m - c))
SELECT doc_id, item_id, max(similarity)::DOUBLE AS similarity, arg_min(start, (-similarity, start))::BIGINT AS start FROM ok GROUP BY ALL"""}


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")).drop("_k1", "_k2")


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
