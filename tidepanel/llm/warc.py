r"""Writing web pages as WARC archives, and reading archives back by verified boundaries.

An archive is text of records ``WARC/1.0 CRLF headers CRLF CRLF block CRLF CRLF``; Spark's text sink and source write and split it on any
file system. Reading cuts at every ``WARC/1.0 CRLF``, in payloads too, so what follows each one is only a candidate:

1. Every task parses the candidates of its splits and emits record offset -> successor offset, as Content-Length has it. Offsets are
   sums of the lengths before: of the pieces in a split, and of the splits of a file.
2. Candidates whose successor is the very next candidate form stretches. At the end of a stretch the chain ends or jumps.
3. Pointer jumping over those ends, doubling each round, finds all that the chain from offset 0 of each file reaches. There
   are as many rounds as the logarithm of the jumps, and none if no payload holds the magic.
4. Candidates that are not on the chain are parts of a payload; they are put back into the record before them.

A window over the candidates of one file is as large as the writer lets a file become.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidepanel.llm.common import scratch_path, store, table
from tidepanel.session import delete_at_exit

MAGIC, BREAK = "WARC/1.0\r\n", "\r\n\r\n"
#: Records of a file that the writer allows, and digests of repeated payloads that are broadcast at most.
FILE_RECORDS, BROADCAST_DIGESTS = 50_000, 500_000
#: Payloads of at least so many bytes are written once.
REVISIT_LEAST = 0
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each five hex digits are four of base 32."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_LEAST) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html) into archives under ``path``.

    Of rows with equal payloads of at least ``least`` bytes that with the largest page_id is a response, the others are revisits of it
    without a block; rows that share that page_id are all responses. A null html is an empty payload, line ends in a url become spaces,
    a null url or page_id is left empty. The url stands in angle brackets, so no header line can end in the magic. Other columns are ignored.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " ").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"), F.octet_length(body).alias("size"), sha1_base32(body).alias("digest"))
    twice = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    twice = store(twice.select("digest", "size", "first"), "digests")
    few = twice.count() <= BROADCAST_DIGESTS
    rows = rows.join(F.broadcast(twice) if few else twice, ["digest", "size"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: "), name("first"))).otherwise(""),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: <"), "url", F.lit(">\r\nWARC-Payload-Digest: sha1:"), "digest",
        F.lit("\r\nX-Payload-Length: "), F.col("size").cast("string"), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.when(again, "0").otherwise((F.col("size") + len(_HTTP)).cast("string")), F.lit(BREAK), F.when(again, "").otherwise(F.concat(F.lit(_HTTP), "html")))
    rows.select(record.alias("value")).write.option("lineSep", BREAK).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between occurrences of the magic, with file and start of the split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value",
        F.octet_length("value").alias("bytes"), F.xxhash64("value").alias("hash"))


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each piece: its place, and what its headers say; next is null unless they give the length of the block."""
    header = F.substring_index("value", BREAK, 1)
    field = lambda pattern: F.nullif(F.regexp_extract(F.concat(F.lit("\r\n"), "header", F.lit("\r\n")), "\r\n" + pattern + "\r\n", 1), F.lit(""))
    read = _pieces(spark, path).withColumn("order", F.monotonically_increasing_id()).withColumns({
        "header": header, "head": F.octet_length(header), "both": F.octet_length(F.substring_index("value", BREAK, 2))})
    read = read.withColumn("length", field("Content-Length: ([0-9]{1,18})").cast("long"))
    begin = F.col("both") + len(BREAK)
    size = F.col("length") - (F.col("both") - F.col("head"))  # of the payload, after the header of the HTTP response
    rows = read.select(
        "file", "split", "order", "bytes", "hash", "head", "length", field("WARC-Type: ([a-z]+)").alias("type"),
        field("WARC-Record-ID: <urn:page:(-?[0-9]+)>").cast("long").alias("page_id"), field("WARC-Refers-To: <urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest: sha1:([A-Z2-7]+)").alias("told"), field("X-Payload-Length: ([0-9]+)").cast("long").alias("told_size"),
        size.alias("size"), begin.alias("begin"), (F.col("bytes") >= begin + size).alias("whole"),
        sha1_base32(F.expr(f"substring(cast(value as binary), int(both + {len(BREAK) + 1}), int(greatest(0, least(length - (both - head), bytes))))")).alias("digest"))
    rows = store(rows, "candidates")
    step = F.col("bytes") + len(MAGIC)
    within = Window.partitionBy("file", "split").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("file", "split").agg(F.sum(step).alias("total")).select("file", "split", F.coalesce(
        F.sum("total").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = rows.withColumn("within", F.coalesce(F.sum(step).over(within), F.lit(0))).join(totals, ["file", "split"])
    start = F.col("base") + F.col("within")
    return placed.withColumn("at", start - len(MAGIC)).withColumn("next", F.when(
        F.col("type").isNotNull(), start + F.col("head") + 2 * len(BREAK) + F.col("length"))).where("at >= 0").drop("base", "within", "order")


def _chain(rows: DataFrame) -> DataFrame:
    """Adds ``real``: whether the chain from the start of the file reaches the candidate."""
    ahead, behind = Window.partitionBy("file").orderBy("at"), Window.partitionBy("file").orderBy(F.desc("at"))
    rows = rows.withColumn("follows", F.lead("at").over(ahead)).withColumn(
        "end", F.last(F.when(~F.col("next").eqNullSafe(F.col("follows")) | F.col("next").isNull(), F.col("at")), True).over(behind))
    rows = store(rows, "stretches")
    jumps = rows.where("at = end and next is not null").select("file", F.col("end").alias("a"), F.col("next").alias("entry"))
    jumps = jumps.join(rows.select("file", F.col("at").alias("entry"), F.col("end").alias("b")), ["file", "entry"])
    found = rows.where("at = 0 and next is not null").select("file", "end")
    jumps, found = store(jumps, "jumps"), store(found, "found")
    there, n = jumps.select("file", "a", "b"), found.count()
    while there.limit(1).count():
        more = found.join(there, (found["file"] == there["file"]) & (found["end"] == there["a"])).select(found["file"], F.col("b").alias("end"))
        found = store(found.union(more).distinct(), "found")
        if (now := found.count()) == n:
            break
        n = now
        second = there.select("file", F.col("a").alias("b"), F.col("b").alias("c"))
        there = store(there.join(second, ["file", "b"]).select("file", "a", F.col("c").alias("b")), "jumps")
    entries = found.select("file", F.col("end").alias("a")).join(jumps, ["file", "a"]).select("file", F.col("b").alias("end"), "entry").union(
        rows.where("at = 0 and next is not null").select("file", "end", F.lit(0).cast("long")))
    return rows.join(entries, ["file", "end"], "left").withColumn("real", F.col("entry").isNotNull() & (F.col("at") >= F.col("entry")) & F.col("next").isNotNull())


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are those of the payload as read; a revisit has them in its headers. Records after a broken chain (a
    wrong or missing length) can't be told from payload and are left out, as no boundary leads to them. No files give no rows.
    """
    rows = store(_chain(_candidates(spark, path)), "records")
    own = Window.partitionBy("file").orderBy("at")
    real = rows.where("real")
    done = real.where("type <> 'response' or whole").select(
        "page_id", F.when(F.col("type") == "response", F.col("size")).otherwise(F.col("told_size")).alias("payload_bytes"),
        F.when(F.col("type") == "response", F.col("digest")).otherwise(F.col("told")).alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
    if not real.where("type = 'response' and not whole").limit(1).count():
        return done
    parts = rows.withColumn("owner", F.last(F.when(F.col("real"), F.struct("at", "page_id", "size", "begin", "type", "whole")), True).over(own)).where(
        "owner.type = 'response' and not owner.whole").select("file", "split", "at", "bytes", "hash", "owner")
    kinds = ["file", "split", "bytes", "hash"]
    texts = _pieces(spark, path).join(parts.select(*kinds).distinct(), kinds).dropDuplicates(kinds)
    whole = parts.join(texts, kinds).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("all"))  # of one record
    payload = F.expr(f"substring(cast(array_join(transform(all, x -> x.value), '{MAGIC}') as binary), int(owner.begin + 1), int(owner.size))")
    put = whole.withColumn("payload", payload).select(
        F.col("owner.page_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"),
        F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return done.union(put)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    delete_at_exit(spark, path)
    return read_archives(spark, path).select("page_id", F.col("payload_bytes").cast("long"), "payload_digest", "record_type", "refers_to")
