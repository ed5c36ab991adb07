"""Quality rules: boosted trees over statistics of whole documents.

The statistics are counted on hashed words and lines of UTF-8 slices. The trees are trained here, on a bounded sample of labelled
documents, with second-order logistic boosting on quantile bins; features with a known direction keep it (a split that breaks the
direction is refused, and its halves are bounded by the middle). The trained trees are complete and flattened into node arrays, so
scoring a batch is ``depth`` gathers per tree.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.llm.common import table
from tidepanel.llm.text import SPACE, U, grams, lines, mix, slices, span_hashes, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Labelled documents that the trees are fitted on, at most; chosen by a hash of the id.
TRAIN_ROWS = 20_000
KEEP_AT = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_lines", "n_marks")
#: Direction of each feature of ``features``: -1 the score may only fall with it, 1 only rise, 0 free.
DIRECTIONS = np.array([1, 0, -1, -1, -1, -1, 0, 0, -1])

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_MARK = np.arange(256) == ord("!")
_POINT = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point


def _per_row(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The COUNTS of each row of a slice, as columns of whole numbers."""
    n = len(at) - 1
    starts, ends, rows = words(data, at)
    n_words = np.bincount(rows, minlength=n)
    values, first = grams(span_hashes(data, starts, ends), rows, 3)
    repeated = np.zeros(len(starts), bool)
    if len(values):
        keys = values ^ mix(rows[first].astype(np.uint64) + U(1))
        inorder = np.sort(keys)
        twice = inorder[1:][inorder[1:] == inorder[:-1]]
        if len(twice):
            hit = first[twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys]
            for k in range(3):
                repeated[hit + k] = True
    a, z, line_rows = lines(data, at)
    total = np.concatenate(([0], np.cumsum(~SPACE[data], dtype=np.int64)))
    filled = total[z] > total[a]
    hashes, line_rows_filled = span_hashes(data, a, z)[filled], line_rows[filled]
    order = np.lexsort((hashes, line_rows_filled))
    h, r = hashes[order], line_rows_filled[order]
    again = r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])]
    return np.column_stack([
        n_words, _per_row(_POINT[data] & ~SPACE[data], at), _per_row(_SYMBOL[data], at), np.bincount(again, minlength=n),
        np.bincount(rows[repeated], minlength=n), _per_row(_UPPER[data], at), _per_row(_DIGIT[data], at),
        np.bincount(line_rows_filled, minlength=n), _per_row(_MARK[data], at)]).astype(np.int64)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


def features(counts: np.ndarray) -> np.ndarray:
    """Shares of the counts, in the order of DIRECTIONS."""
    c = counts.astype(float)
    n, chars = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1)
    return np.column_stack([np.minimum(c[:, 0], 200), c[:, 1] / n, c[:, 2] / n, c[:, 3] / np.maximum(c[:, 7], 1), c[:, 4] / n, c[:, 5] / chars,
                            c[:, 6] / chars, c[:, 7] / n, c[:, 8] / n])


@dataclass
class Trees:
    """Complete trees of one depth: inner nodes in level order, then a value for each leaf."""
    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2^depth
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, row = np.full(len(x), self.bias), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[row, f[node]] > t[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, directions: np.ndarray = DIRECTIONS, rounds: int = 40, depth: int = 3, rate: float = 0.25,
              bins: int = 64, ridge: float = 1.0, least: float = 3.0) -> Trees:
    """Boosted trees for labels 0 and 1, monotone in each feature with a direction."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.column_stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T)])
    inner = 2**depth - 1
    feature, threshold, value = (np.zeros((rounds, k)) for k in (inner, inner, inner + 1))
    total = np.full(len(y), bias)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node, low, high = np.zeros(len(y), np.int64), np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        threshold[k] = np.inf  # a node without a split sends all rows left
        weight = lambda gs, hs, i: np.clip(-gs / (hs + ridge), low[i], high[i])
        gain = lambda gs, hs, w: -(gs * w + 0.5 * (hs + ridge) * w * w)
        for i in range(inner):
            at = np.flatnonzero(node == i)
            left, right = 2 * i + 1, 2 * i + 2
            low[left] = low[right] = low[i]
            high[left] = high[right] = high[i]
            best = (1e-6, None)
            if len(at) > 1:
                gs, hs = g[at].sum(), h[at].sum()
                alone = gain(gs, hs, weight(gs, hs, i))
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[at, j]
                    gl, hl = (np.cumsum(np.bincount(b, s[at], len(e) + 1))[:-1] for s in (g, h))
                    wl, wr = weight(gl, hl, i), weight(gs - gl, hs - hl, i)
                    found = gain(gl, hl, wl) + gain(gs - gl, hs - hl, wr) - alone
                    found[(hl < least * 0.25) | (hs - hl < least * 0.25) | ((wr - wl) * directions[j] < 0)] = -np.inf
                    c = int(np.argmax(found))
                    if found[c] > best[0]:
                        best = (found[c], (j, c, wl[c], wr[c]))
            if best[1]:
                j, c, wl, wr = best[1]
                feature[k, i], threshold[k, i] = j, edges[j][c]
                if directions[j]:
                    middle = (wl + wr) / 2
                    (high if directions[j] > 0 else low)[left] = middle
                    (low if directions[j] > 0 else high)[right] = middle
                node[at] = np.where(binned[at, j] <= c, left, right)
            else:
                node[at] = left
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value[k] = rate * np.clip(-gs / (hs + ridge), low[inner:], high[inner:])
        total += value[k][leaf]
    return Trees(feature.astype(np.int64), threshold, value, bias)


def _counted(batches):
    for batch in batches:
        for rows, data, at in slices(batch):
            counts = statistics(data, at)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c) for c in counts.T)], ["y", *COUNTS])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Trees | None:
    """Trees fitted on at most ``most`` rows of ``labels`` (doc_id, quality) by their documents; None without both classes.

    Labels that are null are left out; a label of a repeated document counts for each of its rows.
    """
    chosen = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("y")).orderBy(
        F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text")  # at most ``most`` rows
    found = rows.mapInArrow(_counted, "y double, " + ", ".join(f"{c} long" for c in COUNTS)).orderBy(
        F.xxhash64(*COUNTS), "y", *COUNTS).limit(2 * most).toPandas().sort_values(["y", *COUNTS])  # rows that repeat are cut without regard to labels
    if found.empty or found["y"].nunique() < 2:
        return None
    return fit_trees(features(found[list(COUNTS)].to_numpy()), found["y"].to_numpy())


def _verdict(counts: np.ndarray, trees: Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = base_failed(counts)
    score = trees.score(features(counts)) if trees else np.where(failed, 0.0, 1.0)
    return failed, ~failed & (score >= KEEP_AT), score


def judge(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """A row for each row of ``docs``: its counts, whether a base rule rejects it, the trees' score and the verdict.

    A null text has no words and fails; without trees (no labels of both classes) the base rules alone decide.
    """

    def run(batches):
        for batch in batches:
            for rows, data, at in slices(batch):
                counts = statistics(data, at)
                failed, kept, score = _verdict(counts, trees)
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c) for c in counts.T[:5]), pa.array(failed), pa.array(kept), pa.array(score)],
                                                 ["doc_id", *COUNTS[:5], "base_failed", "kept", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS[:5]) + ", base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""

    def run(batches):
        for batch in batches:
            for rows, data, at in slices(batch):
                kept = _verdict(statistics(data, at), trees)[1]
                if kept.any():
                    yield rows.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))
