"""Best-fit packing of token sequences by exact complements.

Lengths are whole numbers up to the capacity, so the plan needs only how many pieces have each length: a table of at most ``capacity``
numbers whatever the size of the corpus. From the longest length down, the plan looks for one, two or three available lengths that fill
the gap exactly and uses that combination as often as the counts allow, which exhausts a length each time. What is left goes by best
fit, largest first, in bulk. Pieces then take their places by their rank among pieces of the same length.
"""
from __future__ import annotations

import heapq
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.llm.common import dense_ranks, store, table
from tidepanel.llm.text import column

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Different words whose ids a Python worker remembers; it starts anew beyond that.
REMEMBERED = 700_000
END_ID = 0


class _Free:
    """Availability of lengths: index gives 0 (none), 1 (one) or 2 (two or more)."""

    def __init__(self, counts: np.ndarray):
        self.level = np.minimum(counts, 2).astype(np.int8)

    def pair(self, gap: int) -> tuple[int, ...] | None:
        if gap < 2:
            return None
        low, high = self.level[1:gap // 2 + 1], self.level[gap - 1:gap - gap // 2 - 1:-1]
        fits = (low > 0) & (high > 0)
        if gap % 2 == 0 and self.level[gap // 2] < 2:
            fits[-1] = False
        at = int(np.argmax(fits))
        return (gap - at - 1, at + 1) if fits[at] else None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap exactly, fewest and longest first."""
        if gap <= 0:
            return None
        if self.level[gap]:
            return (gap,)
        two = self.pair(gap)
        if two:
            return two
        for first in np.flatnonzero(self.level[:max(gap - 1, 0)])[::-1]:
            if first * 3 < gap:  # the first is the longest of the three
                break
            self.level[first] -= 1
            rest = self.pair(gap - int(first))
            self.level[first] += 1
            if rest:
                return (int(first), *rest)
        return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences): every piece is in exactly one; ``counts[l]`` pieces have length l."""
    left = np.asarray(counts, dtype=np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while left[length] > 0:
            left[length] -= 1
            rest = _Free(left).fill(capacity - length)
            left[length] += 1
            if rest is None:
                break
            whole = (length, *rest)
            use = {x: whole.count(x) for x in whole}
            times = min(int(left[x]) // n for x, n in use.items())
            for x, n in use.items():
                left[x] -= n * times
            out.append((whole, times))
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    heap: list[int] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in gaps:
            gaps[gap] = []
            heapq.heappush(heap, gap)
        gaps[gap].append((pattern, times))

    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n > 0:
            fit = min((g for g in gaps if g >= length and gaps[g]), default=None)
            if fit is None:
                each = min(capacity // length, n)
                put((length,) * each, n // each)
                n -= each * (n // each)
                continue
            pattern, times = gaps[fit].pop()
            each = min(fit // length, n)  # as best fit does, one after the other into the same sequence
            used = min(times, n // each)
            if used < times:
                gaps[fit].append((pattern, times - used))
            put(pattern + (length,) * each, used)
            n -= each * used
    return out + [x for group in gaps.values() for x in group]


class Places:
    """The plan as arrays sorted by (length, first rank), to look up sequence and offset of a rank."""

    def __init__(self, planned: list[tuple[tuple[int, ...], int]]):
        rows, taken, sequences, offsets = [], {}, 0, []
        for lengths, times in planned:
            places: dict[int, list[int]] = {}
            at = 0
            for x in lengths:
                places.setdefault(x, []).append(at)
                at += x
            for x, where in places.items():
                rows.append((x, taken.get(x, 0), len(where), sequences, len(offsets)))
                offsets += where
                taken[x] = taken.get(x, 0) + len(where) * times
            sequences += times
        rows.sort()
        self.sequences = sequences
        self.length, self.first, self.each, self.base, self.where = np.array(rows, np.int64).reshape(-1, 5).T
        self.offsets = np.array(offsets, np.int64)
        self.of_length = np.searchsorted(self.length, np.arange(int(self.length.max(initial=0)) + 2))

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for at in np.split(order, cuts) if len(order) else []:
            a, z = self.of_length[length[at[0]]], self.of_length[length[at[0]] + 1]
            i = a + np.searchsorted(self.first[a:z], rank[at], side="right") - 1
            own = rank[at] - self.first[i]
            sequence[at] = self.base[i] + own // self.each[i]
            offset[at] = self.offsets[self.where[i] + own % self.each[i]]
        return sequence, offset


#: Characters that Python splits at and the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
_PART = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")
_WORD = re.compile(r"[^ \t\n\v\f\r]+")
_known: dict[str, "_Known"] = {}


class _Known(dict):
    """Ids of words as bytes. The tokenizer never joins letters across white space, so a text's ids are those of its words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoder = Tokenizer.from_file(path)

        self.model = self.encoder.model

    def learn(self, words: set[str]) -> None:
        rest = []
        for word in words:
            if word.isascii() and word.isprintable() and "'" not in word and "<|" not in word:  # its letters, digits and signs are encoded apart
                self[word] = np.array([t.id for part in _PART.findall(word.lower()) for t in self.model.tokenize(part)], np.uint32).tobytes()
            else:
                rest.append(word)
        for first in range(0, len(rest), 1000):
            self._learn_together(rest[first:first + 1000])

    def _learn_together(self, words: list[str]) -> None:
        """Encodes the words as one text and cuts the ids where the words begin."""
        found = self.encoder.encode(" ".join(words), add_special_tokens=False)
        begin = np.cumsum([0] + [len(w) + 1 for w in words])
        ids = np.array(found.ids, np.uint32)
        cut = np.searchsorted(np.array([a for a, _ in found.offsets], np.int64), begin)
        for i, word in enumerate(words):
            self[word] = ids[cut[i]:cut[i + 1]].tobytes()


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ids(text: str, known: _Known) -> bytes:
    found = _WORD.findall(text) if _ODD.search(text) else text.split()
    new = {w for w in found if w not in known}
    if new:
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(found)
        known.learn(new)
    return b"".join(map(known.__getitem__, found))


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of each row of ``docs``: doc_id, piece, start, length, ids (little-endian unsigned 16 or 32 bits each), ids_crc32.

    Each text's ids end with id 0; a null text counts as empty and is that id alone. A sequence longer than the capacity is cut into
    pieces of the capacity, the last may be shorter. ``path``: a tokenizer file that every worker can read; by default the public
    one as installed on the workers. Ids are stored in 16 bits if the vocabulary allows it; the checksum is over 32 bits.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])

    def run(batches):
        at = path or tokenizer_path()
        known = _known.get(at) or _known.setdefault(at, _Known(at))
        kind = np.uint16 if known.encoder.get_vocab_size() <= 1 << 16 else np.uint32
        end = np.array([END_ID], np.uint32).tobytes()
        rows: list[list] = [[] for _ in schema]
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), column(batch, "text")):
                ids = _ids(text.as_py() or "", known) + end
                for k, first in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[first:first + 4 * capacity]
                    for out, v in zip(rows, (doc_id, k, first // 4, len(own) // 4, np.frombuffer(own, np.uint32).astype(kind).tobytes(), zlib.crc32(own))):
                        out.append(v)
                    size += len(own)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)
                    rows, size = [[] for _ in schema], 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset of each row; no rows give no rows.

    At most ``capacity`` counts reach the driver; the plan has a few rows for each length and goes to the tasks whole.
    Repeated rows are packed like any others; which of two equal ones gets which place is open.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    places = Places(plan(counts, capacity))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = dense_ranks(cut.select(*names), ["length"], ["doc_id", "piece", "ids_crc32"], "rank")

    def run(batches):
        for batch in batches:
            length, rank = (column(batch, c).to_numpy() for c in ("length", "rank"))
            sequence, offset = places(length, rank)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed pieces with their ids, for a writer of training files; doc_id must be unique."""
    return placed.join(cut.select("doc_id", "piece", "ids"), ["doc_id", "piece"])


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every token piece of ``docs`` with its place in as few sequences as the plan finds. Pieces are stored once in the shared folder."""
    return place(store(pieces(docs, path, capacity), "pieces"), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
