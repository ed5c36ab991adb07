"""Toxicity by a noisy channel: disguised words are restored first, then the text is scored.

A token that may be disguised (letters with digits, signs or separators, a letter three or more times in a row, single letters set apart) is read
as a lattice: each character gives the letters that it may stand for, a separator may vanish, a letter three times or more may stand for
one or two. A Viterbi search takes the path of the largest probability under a letter trigram model, counted over the words of all documents,
and the channel's costs. In a run of single letters and signs each gap may end a word; the words of all paths nearly as likely as the best count.
Restored words are scored by evidence learned from labelled documents.
"""
from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.llm.common import crc_of_id, table
from tidepanel.llm.text import column, slices, words

FOLDS, HELD_OUT, TOXIC_AT = 4, 2, 0.3
#: The bounded sample of labelled documents (half for evidence, half to calibrate it), and the features kept of it.
TRAIN_ROWS, FEATURES, FEATURE_DOCS, FEATURE_RATIO = 16_000, 20_000, 4, 3.0
#: Tokens whose score a worker remembers; it starts anew beyond that.
REMEMBERED = 500_000

# Letters that a character of leetspeak may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = ".-_*~'`"
#: Costs of the channel, as natural logarithms.
SWAPPED, DROPPED, REPEATED = -1.0, -0.3, -0.2
#: Cost of a word that goes on over a wider gap, or ends at a narrow one in a run that has wider gaps.
UNLIKELY = -3.0
#: Places of a lattice that are read at once, and of them those read again by the next stretch.
STRETCH, OVERLAP = 256, 64
#: How far below the best a path may be to go on, and for its words to count.
BEAM, NEARLY = 12.0, 5.0

# Letter classes of the language model: a-z are 1 to 26, any other letter is 27, the edge of a word 0.
SIZE = 28
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27
_APART = (_CODE > 0) & (np.arange(256) < 128) | np.isin(np.arange(256), [ord(x) for x in (*STANDS_FOR, *SEPARATORS) if x.isascii()])
_EDGES = SEPARATORS + "".join(x for x in STANDS_FOR if not x.isdigit())
_OUTER_SEPARATORS = SEPARATORS + ",;:?\")]}[{<>/\\=&#%^"
_OUTER = _EDGES + _OUTER_SEPARATORS


def _trigrams(batches):
    total = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        for _, data, at in slices(batch):
            codes = _CODE[data]
            codes = np.insert(codes, at, 0)
            codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]  # one edge between words
            edge = np.flatnonzero(codes == 0)
            codes = np.insert(codes, edge, 0)  # two, for the model's history
            if len(codes) > 2:
                total += np.bincount(codes[:-2] * SIZE**2 + codes[1:-1] * SIZE + codes[2:], minlength=SIZE**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])


def letter_model(docs: DataFrame) -> np.ndarray:
    """Logarithms of the probability of a letter after two, counted over all texts; a table of SIZE^3 numbers whatever the input."""
    found = docs.select("text").mapInArrow(_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIZE**3)
    counts[found["code"].to_numpy(np.int64)] = found["n"]
    three = counts.reshape(SIZE, SIZE, SIZE)
    one = three.sum((0, 1)) + 1
    two = three.sum(0) + 5 * one / one.sum()
    two /= two.sum(1, keepdims=True)
    full = three + 5 * two[None]
    return np.log(full / full.sum(2, keepdims=True))


def _code(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27


def _lattice(token: str, exact: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of equal characters the strings it may stand for, with their costs; costs below those of others are left out. Two equal
    signs are two letters if ``exact``, one or two otherwise."""
    out = []
    for char, run in itertools.groupby(token):
        n = len(list(run))
        if char in SEPARATORS:
            out.append([("", DROPPED)])
        elif char.isalpha():
            out.append([(char * n, 0.0)] if n < 3 else [(char, REPEATED), (char * 2, REPEATED)])
        elif char in STANDS_FOR and exact and n == 2:
            out.append([(x + y, SWAPPED * 2) for x in STANDS_FOR[char] for y in STANDS_FOR[char]])
        elif char in STANDS_FOR:
            out.append([(x * k, SWAPPED * k + (REPEATED if k < n else 0.0)) for x in STANDS_FOR[char] for k in range(1, min(n, 2) + 1)])
        else:
            out.append([("", 2 * SWAPPED)])
    return out


def restore(token: str, model: np.ndarray, exact: bool = False) -> str:
    """The likeliest word behind a disguised token: Viterbi over the lattice with the last two letters as state."""
    paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for choices in _lattice(token, exact):
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (total, word) in paths.items():
            for letters, cost in choices:
                x, y, at = a, b, total + cost
                for letter in letters:
                    c = _code(letter)
                    at += model[x, y, c]
                    x, y = y, c
                if (x, y) not in new or at > new[x, y][0]:
                    new[x, y] = (at, word + letters)
        paths = new
    return max(((at + model[a, b, 0], word) for (a, b), (at, word) in paths.items()))[1]


def _stretch(places: list[tuple[list[tuple[str, float]], float, float]], model: np.ndarray, last: bool) -> tuple[set[str], int]:
    """Words of all paths that are nearly as likely as the best, and the place that the next stretch begins with."""
    n = len(places)
    until = np.full(n + 1, -np.inf)  # of the best path that ends a word before a place
    until[0] = 0.0
    open_: dict[tuple[int, int, int], tuple[float, str]] = {}
    spans: list[tuple[int, int, str, float]] = []
    for p in range(n + 1):
        end = places[p][2] if p < n else 0.0
        for (s, a, b), (total, word) in open_.items():
            total += (model[a, b, 0] if word else 0.0) + end
            spans.append((s, p, word, total - until[s]))
            until[p] = max(until[p], total)
        if p == n:
            break
        choices, on, _ = places[p]
        new: dict[tuple[int, int, int], tuple[float, str]] = {}
        for (s, a, b), (total, word), more in [*((*x, on) for x in open_.items()), ((p, 0, 0), (until[p], ""), 0.0)]:
            for letters, cost in choices:
                x, y, at = a, b, total + cost + more
                for letter in letters:
                    c = _code(letter)
                    at += model[x, y, c]
                    x, y = y, c
                if (s, x, y) not in new or at > new[s, x, y][0]:
                    new[s, x, y] = (at, word + letters)
        new = {k: v for k, v in new.items() if len(v[1]) <= LONGEST}
        least = max(at for at, _ in new.values()) - BEAM
        open_ = {k: v for k, v in new.items() if v[0] >= least}
    rest = np.full(n + 1, -np.inf)
    rest[n] = 0.0
    follows = {}
    for s, p, _, own in sorted(spans, key=lambda x: -x[0]):
        if own + rest[p] > rest[s]:
            rest[s], follows[s] = own + rest[p], p
    cut, p = n, 0
    if not last:  # what lies beyond may still change the last part
        cut = n - OVERLAP
        while (p := follows[p]) <= n - OVERLAP:
            cut = p
    return {w for s, p, w, own in spans if w and s < cut and (last or p < n) and until[s] + own + rest[p] >= rest[0] - NEARLY}, cut


def read_words(places: list[tuple[list[tuple[str, float]], float, float]], model: np.ndarray) -> set[str]:
    """Words of a lattice in which a word may end before any place: (choices, cost if a word goes on from the place before, cost if it ends
    there) of each place. Lattices of any length are read in overlapping stretches, each from an end of a word of the one before."""
    out, first = set(), 0
    while first < len(places):
        last = first + STRETCH >= len(places)
        found, n = _stretch(places[first:first + STRETCH], model, last)
        out |= found
        first += n
    return out


_PARTS = re.compile(r"[^\W\d_]+")
_PIECES = re.compile(r"[^\W_@$!|+(€]*(?:[@$!|+(€]+[^\W_@$!|+(€]*)*")
_SIGNS = "".join(x for x in STANDS_FOR if not x.isdigit())
_THRICE = re.compile(r"([^\W\d_])\1\1")
_TWICE = re.compile(r"([\d@$!|+(€])\1")
_MIXED = re.compile(f"[{re.escape(''.join(STANDS_FOR) + SEPARATORS)}]")
#: A longer stretch of characters is no single word.
LONGEST = 40


def clean_words(token: str, model: np.ndarray) -> set[str]:
    """Words that a lower-case token stands for: its letters' runs; and if letters are mixed with signs, digits or separators or stand three
    times in a row, the words restored of the whole token, of its pieces between separators, and of what a trigram model cuts it into."""
    if token.isalpha() and not _THRICE.search(token):
        return {token}
    parts = set(_PARTS.findall(token))
    if not parts or not (_MIXED.search(token) or _THRICE.search(token)):
        return parts
    whole = token.strip(_OUTER)
    if whole in parts and not _THRICE.search(whole):  # nothing but signs at its edges
        core = token.strip(_OUTER_SEPARATORS)
        return parts | ({restore(core, model), restore(core, model, True)} if 3 <= len(core) <= LONGEST and core != whole else set())
    texts = {whole, token.strip(_OUTER_SEPARATORS)}
    texts |= {y for x in texts for x in _PIECES.findall(x) for y in (x, x.strip(_SIGNS))}
    texts = {x for x in texts if 3 <= len(x) <= LONGEST and not x.isdigit() and (x not in parts or _THRICE.search(x))}
    parts |= {restore(x, model) for x in texts} | {restore(x, model, True) for x in texts if _TWICE.search(x)}
    if len(whole) > LONGEST or sum(not x.isalnum() for x in whole) > 2:
        parts |= read_words(_token_places(whole), model)
    parts.discard("")
    return parts


def _token_places(token: str) -> list[tuple[list[tuple[str, float]], float, float]]:
    """The lattice of a token in which words end at separators and other signs, less likely elsewhere."""
    places, apart = [], False
    for i, char in enumerate(token):
        if i > 2 and char == token[i - 1] == token[i - 2] == token[i - 3]:
            continue  # any number above two stands for one or two
        if char in SEPARATORS:
            choices = [("", DROPPED)]
        elif char.isalpha():
            choices = [(char, 0.0)]
        elif char in STANDS_FOR:
            choices = [(x, SWAPPED) for x in STANDS_FOR[char]] + ([] if char.isdigit() else [("", 2 * SWAPPED)])
        else:
            choices = [("", 2 * SWAPPED)]
        if i > 1 and char == token[i - 1] == token[i - 2] and char not in SEPARATORS:
            choices.append(("", REPEATED))
        places.append((choices, 0.0, 0.0 if apart else UNLIKELY))
        apart = not char.isalnum()
    return places


def word_features(word: str) -> list[str]:
    """The word and its beginnings."""
    return ["=" + word] + [word[:n] for n in (3, 4, 5, 6, 7) if len(word) > n]


def _spaced(data: np.ndarray, at: np.ndarray) -> dict[int, list[list[tuple[str, int]]]]:
    """By row, runs of three and more single letters and signs set apart by white space: each with the white space before it."""
    starts, ends, rows = words(data, at)
    out: dict[int, list[list[tuple[str, int]]]] = {}
    if not len(starts):
        return out
    lead, size = data[starts], ends - starts
    single = ((size == 1) & _APART[lead]) | ((lead >= 0xC0) & (size == np.where(lead >= 0xF0, 4, np.where(lead >= 0xE0, 3, 2))))
    follows = single & np.concatenate(([False], single[:-1] & (rows[1:] == rows[:-1])))
    for a in np.flatnonzero(single & ~follows & np.concatenate((follows[1:], [False]))):
        run: list[tuple[str, int]] = []
        for i in itertools.count(a):
            more = i < len(starts) and (i == a or follows[i])
            char = data[starts[i]:ends[i]].tobytes().decode("utf-8", "replace").lower() if more else ""
            if len(char) == 1 and (char.isalpha() or char in STANDS_FOR or char in SEPARATORS):
                run.append((char, int(starts[i] - ends[i - 1]) if run else 0))
                continue
            if sum(c not in SEPARATORS for c, _ in run) >= 3 and any(c.isalpha() for c, _ in run):
                out.setdefault(int(rows[a]), []).append(run)
            run = []
            if not more:
                break
    return out


def spaced_words(run: list[tuple[str, int]], model: np.ndarray) -> set[str]:
    """Words of a run of single characters, in which any gap may end a word, a wider one more likely; and what stands between wider gaps as
    one word."""
    gaps = [n for _, n in run[1:]]
    least = min(gaps)
    told = max(gaps) > least
    places, pieces = [], [""]
    for i, (char, gap) in enumerate(run):
        if i > 3 and gap == least and all(x == (char, least) for x in run[i - 3:i]):
            continue  # any number above two stands for one or two
        if char in SEPARATORS:
            choices = [("", DROPPED)]
        elif char.isalpha():
            choices = [(char, 0.0)]
        else:
            choices = [(x, SWAPPED) for x in STANDS_FOR[char]] + ([] if char.isdigit() else [("", 2 * SWAPPED)])
        if i > 1 and run[i - 1][0] == run[i - 2][0] == char and char not in SEPARATORS:
            choices.append(("", REPEATED))
        places.append((choices, UNLIKELY if gap > least else 0.0, UNLIKELY if told and gap == least else 0.0))
        if gap > least:
            pieces.append("")
        if len(pieces[-1]) <= LONGEST:  # longer ones are not read as one word
            pieces[-1] += char
    whole = (x.strip(_EDGES) for x in pieces)
    return read_words(places, model) | {restore(x, model) for x in whole if 3 <= len(x) <= LONGEST}


class Evidence(dict):
    """Token -> evidence of the best feature of its words; remembered."""

    def __init__(self, weights: dict[str, float], model: np.ndarray):
        self.weights, self.model = weights, model

    def __missing__(self, token: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        get = self.weights.get
        self[token] = out = max((get(f, 0.0) for w in clean_words(token, self.model) for f in word_features(w)), default=0.0)
        return out

    def of_word(self, word: str) -> float:
        return max(self.weights.get(f, 0.0) for f in word_features(word))


def _texts(batches, model):
    for batch in batches:
        for rows, data, at in slices(batch):
            spaced = _spaced(data, at)
            texts = column(rows, "text")
            yield rows, [(set((texts[i].as_py() or "").lower().split()), {w for run in spaced.get(i, []) for w in spaced_words(run, model)})
                         for i in range(rows.num_rows)]


def _summed(evidence: Evidence, tokens: set[str], joined: set[str]) -> tuple[float, float]:
    found = [e for e in map(evidence.__getitem__, tokens) if e]
    found += [e for e in (evidence.of_word(w) for w in joined) if e]
    return max(found, default=0.0), min(sum(found), 60.0)


def _feature_counts(model):
    def run(batches):
        own = model.value
        seen: dict[tuple[str, int], int] = {}
        for rows, texts in _texts(batches, own):
            for y, (tokens, joined) in zip(rows.column(0).to_pylist(), texts):
                clean = {w for t in tokens for w in clean_words(t, own)} | joined
                for f in {f for w in clean for f in word_features(w)}:
                    seen[f, y] = seen.get((f, y), 0) + 1
            if len(seen) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen]), pa.array([y for _, y in seen]), pa.array(list(seen.values()))], ["feature", "y", "n"])
                seen = {}
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen]), pa.array([y for _, y in seen]), pa.array(list(seen.values()))], ["feature", "y", "n"])

    return run


def _evidence_rows(weights, model):
    def run(batches):
        evidence = Evidence(weights.value, model.value)
        for rows, texts in _texts(batches, evidence.model):
            found = np.array([_summed(evidence, *x) for x in texts]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], ["y", "best", "total"])

    return run


def _inputs(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(best)), best, np.sqrt(total)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method; the weights of evidence are kept from below zero."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w[1:] = np.maximum(w[1:], 0)
    return w


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The letter model of all texts, evidence of features and calibration, from labels (doc_id, toxic) outside the held-out fold.

    Without labels of both classes every text gets the same score.
    """
    spark = docs.sparkSession
    chosen = labels.where("toxic is not null and doc_id is not null").where(crc_of_id(F.col("doc_id")) % FOLDS != HELD_OUT).select(
        "doc_id", F.col("toxic").cast("long").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)))  # equal texts together
    share = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    prior = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1)
    out = {"model": letter_model(docs), "weights": {}, "fit": np.array([math.log(prior / (1 - prior)), 0.0, 0.0])}
    if not share.get(0) or not share.get(1):
        return out
    model = spark.sparkContext.broadcast(out["model"])
    first, second = rows.where("half = 0").select("y", "text"), rows.where("half = 1").select("y", "text")
    sizes = {r["y"]: r["count"] for r in first.groupBy("y").count().collect()}
    counts = first.mapInArrow(_feature_counts(model), "feature string, y long, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    weight = F.log((F.col("t") + 0.5) / (sizes.get(1, 0) + 1.0)) - F.log((F.col("c") + 0.5) / (sizes.get(0, 0) + 1.0))
    best = counts.where(F.col("t") >= FEATURE_DOCS).withColumn("w", weight).where(F.col("w") >= math.log(FEATURE_RATIO)).orderBy(
        F.desc("w"), F.desc("t"), "feature").limit(FEATURES).toPandas()
    out["weights"] = dict(zip(best["feature"], best["w"]))
    weights = spark.sparkContext.broadcast(out["weights"])
    seen = second.mapInArrow(_evidence_rows(weights, model), "y long, best double, total double").orderBy(
        F.xxhash64("best", "total"), "y", "best", "total").limit(2 * TRAIN_ROWS).toPandas().sort_values(["y", "best", "total"])  # cut without regard to labels
    if len(seen) and seen["y"].nunique() == 2:
        out["fit"] = _logistic(_inputs(seen["best"].to_numpy(), seen["total"].to_numpy()), seen["y"].to_numpy(float))
    return out


def score(docs: DataFrame, trained: dict) -> DataFrame:
    """doc_id and score for each row of ``docs`` (doc_id, text): the probability that it is labelled toxic; a text without evidence, null and
    empty ones too, gets that of such texts."""
    held = docs.sparkSession.sparkContext.broadcast(trained)  # bounded by SIZE, FEATURES

    def run(batches):
        own = held.value
        evidence = Evidence(own["weights"], own["model"])
        for rows, texts in _texts(batches, evidence.model):
            found = np.array([_summed(evidence, *x) for x in texts]).reshape(-1, 2)
            p = 1 / (1 + np.exp(-_inputs(found[:, 0], found[:, 1]) @ own["fit"]))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = score(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return found.select("doc_id", F.coalesce(crc_of_id(F.col("doc_id")) % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))
