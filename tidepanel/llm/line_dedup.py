r"""Line dedup: runs of lines that occurred before, found by winnowing over line hashes.

A run is a number of consecutive ``\n``-split lines of a document with ``MIN_WORDS`` words or more in total, lines without a word left out.
A line is deleted if a run that holds it has occurred earlier: in a document of a smaller id, or in the same document before the run
begins, without overlap. A line without a word is deleted if it stands inside a window (below) that goes.

* Windows of winnowing are measured in words: from each line forward, and back from each line, the fewest lines with ``MIN_WORDS`` words.
  Each selects its smallest line hash (the last of equal ones) as fingerprint. A repeated run holds the same windows at each place, so
  they select the same fingerprints: no run is missed.
* Positions are joined by fingerprint, place of the fingerprint in the window and content hash of the window, which extends the match
  from the fingerprint to both ends of the window. All windows of a fingerprint that occurred earlier, forward and backward ones, together
  cover the longest repeated run around it: the backward window that ends at the run's last line lies in the run, and so does
  the forward window from any line before that window.

Only the first place of each window is kept by the join, found by an aggregation that is partly done before the shuffle; copies
are never paired with each other.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.llm.common import store, table
from tidepanel.llm.text import EXACT, EXACT_2, SPACE, U, lines, mix, powers, slices, span_hashes, words

#: Words of the shortest run that is deleted.
MIN_WORDS = 50


def windows(data: np.ndarray, at: np.ndarray, least: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """Row, first line, lines, fingerprint, its place and two content hashes of every window of a slice; equal windows of a row once."""
    a, z, row = lines(data, at)
    starts, _, _ = words(data, at)
    count = np.searchsorted(starts, z) - np.searchsorted(starts, a)
    number = np.arange(len(a)) - np.searchsorted(row, np.arange(len(at)))[row]  # of the line in its text
    filled = count > 0  # so no window has more than ``least`` lines
    a, z, row, count, number = a[filled], z[filled], row[filled], count[filled], number[filled]
    n = len(a)
    if not n:
        return {}
    upto = np.concatenate(([0], np.cumsum(count)))
    first = np.searchsorted(row, np.arange(len(at)))  # first line of each row, then the number of lines
    low, high = first[row], first[row + 1]
    i = np.arange(n)
    end = np.searchsorted(upto, upto[:-1] + least)  # lines i..end-1 have enough words
    forward = np.column_stack([i, end])[end <= high]
    begin = np.searchsorted(upto, upto[1:] - least, side="right") - 1  # lines begin..i have enough
    backward = np.column_stack([begin, i + 1])[(begin >= low) & (upto[1:] >= least)]
    span = np.unique(np.concatenate([forward, backward]), axis=0)
    if not len(span):
        return {}
    h = span_hashes(data, a, z, EXACT)
    # The smallest hash of each window, the last of equal ones: reduceat takes every other interval.
    edges = span.ravel()
    lowest = np.minimum.reduceat(np.concatenate([h, [U(0)]]), edges)[::2]
    size = span[:, 1] - span[:, 0]
    flat = np.repeat(span[:, 0], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    place = np.maximum.reduceat(np.where(h[flat] == np.repeat(lowest, size), flat, -1), np.cumsum(size) - size) - span[:, 0]
    out = {"row": row[span[:, 0]], "start": number[span[:, 0]], "size": number[span[:, 1] - 1] + 1 - number[span[:, 0]], "fingerprint": lowest.view(np.int64), "place": place}
    local = flat - np.repeat(span[:, 0], size)
    for name, values in (("key", h), ("key2", span_hashes(data, a, z, EXACT_2))):
        terms = values[flat] * powers(int(size.max()))[local]
        out[name] = mix(np.add.reduceat(terms, np.cumsum(size) - size) + size.astype(np.uint64)).view(np.int64)
    return out


def _windows(batches):
    for batch in batches:
        for rows, data, at in slices(batch):
            found = windows(data, at)
            if found:
                ids = rows.column(0).take(pa.array(found["row"]))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[k], pa.int32()) for k in ("start", "size", "place")),
                                                  *(pa.array(found[k]) for k in ("fingerprint", "key", "key2"))],
                                                 ["doc_id", "start", "size", "place", "fingerprint", "key", "key2"])


_KEY = ["fingerprint", "place", "key", "key2"]


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs): for each document with lines to delete, the windows that occurred earlier as an array of (start, size) in lines.

    size counts the lines without a word in between. A null doc_id comes before all others. A row given twice, or another text with the same doc_id, counts as the same place.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _windows, "doc_id long, start int, size int, place int, fingerprint long, key long, key2 long")
    rows = store(rows, "windows")
    first = rows.groupBy(*_KEY).agg(F.min(F.struct("doc_id", "start", "size")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    later = rows.join(first.select(*_KEY, "first"), _KEY).where(
        "not (first.doc_id <=> doc_id) or first.start + first.size <= start")
    return later.groupBy("doc_id").agg(F.collect_set(F.struct("start", "size")).alias("runs"))  # at most two for each line


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, the text without the deleted lines, and then n_lines and n_deleted.

    A null text stays null with 0 lines, an empty one has one line. Deleting all lines leaves an empty text. The number of
    characters and the like are not changed here.
    """
    runs = repeated_runs(docs).select(F.col("doc_id").alias("_doc"), "runs")
    joined = docs.join(runs, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")), "left")
    split = F.split("text", "\n", -1)
    kept = F.filter(split, lambda x, i: ~F.exists("runs", lambda r: (i >= r["start"]) & (i < r["start"] + r["size"])))
    parts = joined.withColumn("_kept", F.when(F.col("runs").isNotNull(), kept))
    n = F.coalesce(F.size(split), F.lit(0))
    return parts.select(
        *[F.coalesce(F.array_join("_kept", "\n"), "text").alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("_n_lines"),
        F.when(F.col("text").isNull() | F.col("_kept").isNull(), 0).otherwise(n - F.size("_kept")).cast("long").alias("_n_deleted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the deduplicated text, its lines before and the lines deleted."""
    return dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated runs; one of which no word is left, though lines were deleted, goes."""
    out = dedup_lines(docs).where("_n_deleted = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.select(*[F.length("text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


ORACLE = {"op2_line_dedup": f"""WITH l AS (SELECT doc_id, i - 1 AS i, t[i] AS line, len(regexp_extract_all(t[i], '[^\\x20\\x09-\\x0D]+')) AS n FROM
  (SELECT doc_id, string_split(text, chr(10)) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l WHERE n > 0),
span AS (SELECT a.doc_id, a.j AS a, min(b.j) AS z FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.upto - a.upto + a.n >= {MIN_WORDS} GROUP BY ALL
  UNION SELECT b.doc_id, max(a.j), b.j FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.upto - a.upto + a.n >= {MIN_WORDS} GROUP BY b.doc_id, b.j),
t AS (SELECT doc_id, list(line ORDER BY j) AS t, list(i ORDER BY j) AS nr FROM s GROUP BY 1),
k AS (SELECT doc_id, nr[a] AS a, nr[z] AS z, array_to_string(t[a:z], chr(10)) AS key FROM span JOIN t USING (doc_id)),
f AS (SELECT key, min({{'d': doc_id, 'a': a, 'z': z}}) AS f FROM k GROUP BY key),
gone AS (SELECT doc_id, a, z FROM k JOIN f USING (key) WHERE f.d < doc_id OR f.z < a),
dead AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN gone g ON l.doc_id = g.doc_id AND l.i BETWEEN g.a AND g.z)
SELECT d.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (x.i IS NULL), '') AS text, count(l.i)::BIGINT AS n_lines, count(x.i)::BIGINT AS n_deleted
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN dead x ON x.doc_id = l.doc_id AND x.i = l.i GROUP BY d.doc_id"""}
