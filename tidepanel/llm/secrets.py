"""Secret scans: fixed patterns, and strings near sensitive words that a primed compressor can't shorten.

Novelty of a candidate: bytes that zstandard, primed with a dictionary of common identifiers, needs for the surrounding text with the
candidate less those without it. A word of the surroundings or of the dictionary costs next to nothing, a random string its entropy.
"""
from __future__ import annotations

import bisect
import itertools
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.llm.common import table
from tidepanel.llm.text import column, slices

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "novel")

#: Words that make their surroundings sensitive.
SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "credential", "private", "auth", "bearer", "akia")
_SENSITIVE = re.compile("|".join(SENSITIVE), re.ASCII | re.IGNORECASE)
#: A candidate: 16 and more of these characters.
LEAST = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Code points around a candidate that count as its surroundings.
AROUND = 256
#: Bytes that each character of a reported candidate must cost.
NOVEL_AT = 0.45
IDENTIFIERS = b"""import from return def class self const let var function public private static void int string bool true false null None
username password passwd secret token api_key apikey access_key secret_key client_id client_secret authorization bearer credential config
settings environment database connection host port user admin root localhost example test default value key name id uuid hash digest sha256
md5 base64 encode decode request response header cookie session http https url path file line index data 0123456789abcdef version build"""
_compressor = None


def _cost(text: bytes) -> int:
    global _compressor
    if _compressor is None:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _compressor = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False)
    return len(_compressor.compress(text))


def _without_copies(text: str, start: int, end: int, a: int, z: int) -> str:
    """text[a:z], on one side of the span, less other copies of it, whole or cut by the edge; it is no copy if a word goes on at either end
    with another character than at the span's."""
    part, n = text[start:end], end - start
    first, last = (max(0, a - n + 1), start) if a < start else (end, min(len(text), z + n - 1))
    goes_on = lambda x, own: x != own and (x.isalnum() or x == "_")
    side = lambda i: text[i - 1:i] if i else ""
    out, i = [], text.find(part, first, last)
    while i >= 0:
        copy = not goes_on(side(i), side(start)) and not goes_on(text[i + n:i + n + 1], text[end:end + 1])
        if copy:
            out.append(text[a:max(a, i)])
            a = min(z, i + n)
        i = text.find(part, i + (n if copy else 1), last)
    return "".join([*out, text[a:z]])


def novelty(text: str, start: int, end: int) -> float:
    """Bytes a character that the span adds to its compressed surroundings, from which other copies of it are taken out."""
    before = _without_copies(text, start, end, max(0, start - AROUND), start).encode("utf-8", "replace")
    after = _without_copies(text, start, end, end, min(len(text), end + AROUND)).encode("utf-8", "replace")
    own = text[start:end].encode("utf-8", "replace")
    return (_cost(before + after + b" " + own) - _cost(before + after)) / max(1, len(own))


def _candidates(text: str) -> list[tuple[tuple[int, int] | None, list[tuple[int, int]]]]:
    """Candidates with a sensitive word in their surroundings, across line ends, each with the parts that sensitive words inside leave of it.

    Lines that consist of a candidate each and follow one of these, or go before it, belong to it: a block of any length is taken whole.
    """
    runs = [m.span() for m in _CANDIDATE.finditer(text)]
    if not runs:
        return []
    named = [m.span() for m in _SENSITIVE.finditer(text)]
    starts, ends = [s for s, _ in named], [e for _, e in named]
    near, inside = [], []
    for start, end in runs:
        i, j = bisect.bisect_left(starts, start - AROUND), bisect.bisect_left(starts, end)
        near.append(i < len(named) and ends[i] <= start or j < len(named) and ends[j] <= end + AROUND)
        own = named[bisect.bisect_left(starts, start):j]
        edges = [start, *(x for span in own for x in span), end]
        inside.append([(a, z) for a, z in zip(edges[::2], edges[1::2]) if z - a >= LEAST] if own else [])
    joined = [("\n" in (gap := text[e:s]) and not gap.strip()) for (_, e), (s, _) in itertools.pairwise(runs)]
    for i, x in enumerate(joined):
        near[i + 1] |= x and near[i]
    for i, x in reversed([*enumerate(joined)]):
        near[i] |= x and near[i + 1]
    return [(run if ok else None, parts) for run, ok, parts in zip(runs, near, inside) if ok or parts]


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: every base match, and novel strings outside them, by start and then in the order of KINDS."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)] + [("hex", *m.span()) for m in HEX.finditer(text)]
    taken = sorted((s, e) for _, s, e in found)
    reach = list(itertools.accumulate((e for _, e in taken), max))  # the farthest end so far
    novel: list[tuple[int, int]] = []

    def is_novel(span: tuple[int, int]) -> bool:
        i = bisect.bisect_left(taken, (span[1],))
        return not (i and reach[i - 1] > span[0]) and novelty(text, *span) >= NOVEL_AT

    for whole, parts in _candidates(text):
        novel += [whole] if whole and is_novel(whole) else filter(is_novel, parts)
    found += [("novel", *x) for x in novel]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))


def _suspects(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows in which a pattern or a sensitive word can be: all others have no span."""
    out = np.zeros(len(at) - 1, bool)
    other = np.concatenate(([-1], np.flatnonzero(~_HEX[data]), [len(data)]))
    for i in np.flatnonzero(np.diff(other) > HEX_LEAST):  # few: runs of hex digits, that may go from row to row
        edges = [other[i] + 1, *at[(at > other[i] + 1) & (at < other[i + 1])], other[i + 1]]
        for start, end in zip(edges, edges[1:]):
            if end - start >= HEX_LEAST:
                out[np.searchsorted(at, start, side="right") - 1] = True
    low = data.tobytes().lower()
    for word in SENSITIVE:
        key, i = word.encode(), low.find(word.encode())
        while i >= 0:
            row = int(np.searchsorted(at, i, side="right")) - 1
            out[row] = True
            i = low.find(key, int(at[row + 1]))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: spans of secrets in its whole text as an array, base spans first counted by kind.

    A null or empty text has none. Spans of one kind don't overlap; those of different kinds may.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for rows, data, at in slices(batch):
                suspects = _suspects(data, at)
                texts = column(rows, "text")
                found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(texts[i].as_py() or "")] if suspects[i] else []
                         for i in range(rows.num_rows)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from those of ``scan``."""
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"] != "novel")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("found")).alias("spans"),
                        count("novel"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents", "doc_id", "text")))
