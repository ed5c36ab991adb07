"""Language identification by cross-parsing with suffix automata.

For each language, a suffix automaton of labelled text accepts exactly the strings that occur in it. A text is cut greedily into the
longest phrases that a language's automaton accepts; the language that needs the least bits for them, phrases times the logarithm of
its automaton's text length, wins. Texts are UTF-8 bytes folded to few classes. A text is parsed in stretches of ``STRETCH`` classes,
all stretches of a slice at once: each step is one gather in the automata's transition tables.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidepanel.llm.common import crc_of_id, table
from tidepanel.llm.text import column, slices

#: Bytes of labelled text for each language, for all together, and documents to choose from: the bounded sample the automata are built of.
TRAIN_BYTES, ALL_TRAIN_BYTES, TRAIN_DOCS = 32_768, 524_288, 200
STRETCH = 512
UNDETERMINED = "und"
FOLDS = 5

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True
_LETTER[128:] = True


def fold(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z lowered and runs of ASCII that is no letter as one space, and the offsets of the rows in them."""
    low = np.where(_LETTER[data], data, np.uint8(32))
    low = np.where((low >= 65) & (low <= 90), low + np.uint8(32), low)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    keep[at[(at > 0) & (at < len(low))]] = True
    return low[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts the substrings of ``codes``; state 0 is the start."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nexts


_RESTART = np.int32(1 << 30)


class Automata:
    """The languages' automata as one table: row of a state and class -> start of the next state's row, with a bit for a new phrase."""

    def __init__(self, texts: dict[str, bytes]):
        self.languages = sorted(texts)
        folded = {}
        for name, text in texts.items():
            data = np.frombuffer(text, np.uint8)
            folded[name] = fold(data, np.array([0, len(data)]))[0]
        seen = np.unique(np.concatenate(list(folded.values()))) if folded else np.zeros(0, np.uint8)
        self.classes = np.zeros(256, np.uint8)  # 0: a byte that no language has
        self.classes[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        tables, self.start, self.bits, base = [], [], [], 0
        for name in self.languages:
            nexts = suffix_automaton(self.classes[folded[name]].tolist())
            state = np.repeat(np.arange(len(nexts)), [len(x) for x in nexts])
            symbol = np.array([c for x in nexts for c in x], np.int64)
            target = np.array([t for x in nexts for t in x.values()], np.int64)
            fresh = base + len(nexts) * self.width  # one more state: any byte begins a phrase, one that the language lacks is a phrase of its own
            first = np.full(self.width, fresh, np.int64)
            first[symbol[state == 0]] = base + target[state == 0] * self.width
            rows = np.tile((first | _RESTART).astype(np.int32), (len(nexts) + 1, 1))
            rows[state, symbol] = base + target * self.width
            tables.append(rows.ravel())
            self.start.append(fresh)
            self.bits.append(float(np.log2(len(folded[name]) + 2)))
            base += rows.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def phrases(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each row for each language, and the row's folded bytes."""
        codes, cuts = fold(data, at)
        codes = self.classes[codes].astype(np.int32)
        size = np.diff(cuts)
        pieces = -(-size // STRETCH)
        row = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = cuts[:-1][row] + nth * STRETCH
        long = np.minimum(STRETCH, cuts[1:][row] - start)
        order = np.argsort(-long, kind="stable")
        start, long, row = start[order], long[order], row[order]
        state = np.repeat(np.array(self.start, np.int32)[:, None], len(row), 1)
        count = np.zeros((len(self.languages), len(row)), np.int32)
        active = np.searchsorted(-long, -np.arange(STRETCH), side="left")  # stretches longer than t
        for t in range(int(long[0]) if len(long) else 0):
            k = active[t]
            found = self.table[state[:, :k] + codes[start[:k] + t]]
            count[:, :k] += found >> 30
            state[:, :k] = found & (_RESTART - 1)
        out = np.array([np.bincount(row, c, len(size)) for c in count]).reshape(len(self.languages), len(size))
        return out.T, size


def train(docs: DataFrame) -> Automata:
    """Automata of each ``lang`` in ``docs`` (doc_id, text, lang) outside the held-out fold; of texts chosen by a hash of the id.

    They are whole, but where all of a language exceed its share the shortest is taken up to that share.
    """
    open_ = docs.where("text is not null and lang is not null and doc_id is not null").where(crc_of_id(F.col("doc_id")) % FOLDS != 0)
    best = Window.partitionBy("lang").orderBy("h", "doc_id")
    listed = open_.select("lang", "doc_id", F.octet_length("text").alias("bytes"), F.xxhash64("doc_id").alias("h")).where("bytes > 0").withColumn(
        "nth", F.row_number().over(best)).where(f"nth <= {TRAIN_DOCS}").orderBy("lang", "nth").collect()  # TRAIN_DOCS rows a language
    most = min(TRAIN_BYTES, ALL_TRAIN_BYTES // max(1, len({r["lang"] for r in listed})))
    chosen: dict[str, list[int]] = {}
    used: dict[str, int] = {}
    for r in listed:
        if used.get(r["lang"], 0) + r["bytes"] <= most:
            chosen.setdefault(r["lang"], []).append(r["doc_id"])
            used[r["lang"]] = used.get(r["lang"], 0) + r["bytes"]
    for r in sorted(listed, key=lambda r: (r["bytes"], r["nth"])):
        chosen.setdefault(r["lang"], [r["doc_id"]])
    ids = sorted({i for x in chosen.values() for i in x})
    texts: dict[str, set[str]] = {}
    part = F.expr(f"substring(cast(text as binary), 1, {most})").alias("part")  # what reaches the driver is bounded by the share
    for r in open_.where(F.col("doc_id").isin(ids)).select("lang", "doc_id", part).distinct().collect() if ids else []:
        if r["doc_id"] in chosen.get(r["lang"], ()):
            texts.setdefault(r["lang"], set()).add(bytes(r["part"]).decode(errors="ignore"))
    return Automata({name: "\n".join(sorted(x)).encode() for name, x in texts.items()})


def _has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def identify(docs: DataFrame, automata: Automata) -> DataFrame:
    """doc_id, lang_pred and score for each row of ``docs`` (doc_id, text).

    A null text, and one without any letter, is UNDETERMINED with score 0, and so is any text if no language was learned. The score is
    the winner's share of the inverse rates to the eighth power; of equal languages the first by name wins.
    """
    held = docs.sparkSession.sparkContext.broadcast(automata)  # at most 2 * ALL_TRAIN_BYTES states

    def run(batches):
        own = held.value
        names = np.array([*own.languages, UNDETERMINED])
        for batch in batches:
            for rows, data, at in slices(batch, most=1 << 21):
                n = rows.num_rows
                name, score = np.full(n, len(names) - 1), np.zeros(n)
                if own.languages:
                    count, size = own.phrases(data, at)
                    rate = count * np.array(own.bits) / np.maximum(size, 1)[:, None]
                    total = np.concatenate(([0], np.cumsum(_LETTER[data])))
                    plain = np.concatenate(([0], np.cumsum(_LETTER[data] & (data < 128))))
                    known = plain[at[1:]] > plain[at[:-1]]
                    for i in np.flatnonzero(~known & (total[at[1:]] > total[at[:-1]])):
                        known[i] = _has_letter(column(rows, "text")[i].as_py())
                    rate = np.maximum(rate, 1e-9)
                    least = rate.min(1, keepdims=True)
                    share = (least / rate)**8
                    name = np.where(known, rate.argmin(1), name)
                    score = np.where(known, 1 / share.sum(1), 0.0)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names[name]), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs, train(docs)).select(
        "doc_id", F.coalesce(crc_of_id(F.col("doc_id")) % FOLDS == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
