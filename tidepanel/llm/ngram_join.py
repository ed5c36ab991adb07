"""Similarity self-join of documents on 5-word shingles, by T-occurrence search.

Two sets of n and m shingles link when ``100 * common >= 80 * union``, so they have at least ``T = ceil(4 (n + m) / 9)`` in common. As in
DivideSkip, a query merges its short inverted lists, keeps the sets found often enough, and probes its long lists for those only.

How it is spread:

1. Counting: each task reports the shingles that it saw three times or more; their sums make the table of frequent shingles. It only
   decides which lists count as long and has a bounded size; the result doesn't depend on it.
2. Short lists: each set sends its ``n - ceil(0.8 n) + 1`` least frequent shingles, as any two linked sets share one of these. Equal sets
   send them once. A list of two or more different sets names its first set as leader; all sets of the lists of one leader make a block.
   A block that is too large for a task is dealt to pairs of parts.
3. Bounds: each set has a bit map of twice to four times as many bits as shingles. Bits of one that the other lacks are shingles that
   are not common, which bounds what is; only sets with a partner in the block that the bound leaves stay, and only those send all shingles.
4. Search: each task holds the sets of a block and runs the search; it skips sets that are already joined and returns a spanning
   forest, so a block of k copies gives k - 1 links, not k^2.
5. Components of all forests.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.llm.common import store, table
from tidepanel.llm.components import components
from tidepanel.llm.text import U, column, shingle_sets, slices

#: Links need NEED / 100 of the union in common.
NEED = 80
#: Shingles that a task counts before it reports, times that make one worth a report, and rows of the table of frequent ones.
COUNTED, LOCALLY, FREQUENT, FREQUENT_ROWS = 6_000_000, 3, 16, 500_000
#: Shingles of a part of a block, about; a task holds two parts.
PART = 1 << 20
#: Ids that are broadcast at most to pick the documents of blocks; more are joined with a shuffle.
BROADCAST_IDS = 1_000_000
#: Weight of probing against merging in DivideSkip's choice of long lists.
MU = 0.01


def least_common(n: np.ndarray | int, m: np.ndarray | int):
    """Common shingles that sets of n and m need: c with 100 c >= NEED (n + m - c)."""
    return -(-(NEED * (n + m)) // (100 + NEED))


def prefix_length(n: int) -> int:
    return n + (-NEED * n // 100) + 1


def _signature(values: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(values.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _bits(values: np.ndarray) -> bytes:
    """A bit for each value of the low bits of the hashes; a power of two of bits, from two to four for each shingle."""
    if not len(values):
        return b""
    size = 1 << max(6, (2 * len(values) - 1).bit_length())
    flags = np.zeros(size, bool)
    flags[values & U(size - 1)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _sets(batches) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        for rows, data, at in slices(batch):
            yield rows.column(0).to_pylist(), shingle_sets(data, at)


def _count(batches):
    """A row for each document (its set's size and signature), and one for each shingle that repeats in this task."""
    schema = pa.schema([("shingle", pa.bool_()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("sig2", pa.int64()), ("bits", pa.binary())])
    held: list[np.ndarray] = []
    size = 0

    def report():
        values = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        times = np.diff(first, append=len(values))
        often = times >= LOCALLY
        n = int(often.sum())
        return pa.RecordBatch.from_arrays([pa.array([True] * n, pa.bool_()), pa.nulls(n, pa.int64()), pa.array(times[often].astype(np.int64)),
                                           pa.array(values[first[often]].view(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=schema)

    for ids, sets in _sets(batches):
        signatures = [_signature(s) for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array([False] * len(ids)), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                                          pa.array([a for a, _ in signatures], pa.int64()), pa.array([b for _, b in signatures], pa.int64()),
                                           pa.array([_bits(s) for s in sets], pa.binary())], schema=schema)
        held += sets
        size += sum(map(len, sets))
        if size > COUNTED:
            yield report()
            held, size = [], 0
    if size:
        yield report()


def _prefix(values: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set's least frequent shingles; ties by hash."""
    n = prefix_length(len(values))
    if len(often):
        at = np.minimum(np.searchsorted(often, values), len(often) - 1)
        known = often[at] == values
        rare = values[~known]
        if len(rare) < n:
            rest = values[known][np.lexsort((values[known], rank[at[known]]))]
            return np.concatenate([rare, rest[:n - len(rare)]])
        values = rare
    return values[:n]


def _short_lists(often, rank):
    def run(batches):
        seen: dict[int, int] = {}
        for ids, sets in _sets(batches):
            out = []
            for doc_id, values in zip(ids, sets):
                if doc_id is None or not len(values):
                    continue
                sig = _signature(values)[0]
                if seen.get(sig, doc_id + 1) <= doc_id:
                    continue  # an equal set with a smaller id has sent the same
                if len(seen) > 500_000:
                    seen.clear()
                seen[sig] = doc_id
                out.append((doc_id, sig, _prefix(values, often.value, rank.value)))
            if out:
                lens = [len(p) for _, _, p in out]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([p for _, _, p in out]).view(np.int64)), pa.array(np.repeat(np.array([s for _, s, _ in out], np.int64), lens)),
                    pa.array(np.repeat(np.array([d for d, _, _ in out], np.int64), lens))], ["shingle", "sig", "doc_id"])

    return run


def _blocks(batches):
    """(leader, doc_id) from rows sorted by (shingle, sig, doc_id): each different set of a list, with the list's first set."""
    last = None  # shingle, sig and leader of the row before
    for batch in batches:
        shingle, sig, doc = (column(batch, c).to_numpy() for c in ("shingle", "sig", "doc_id"))
        if not len(doc):
            continue
        new = np.concatenate(([last is None or last[0] != shingle[0]], shingle[1:] != shingle[:-1]))
        other = new | np.concatenate(([last is None or last[1] != sig[0]], sig[1:] != sig[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
        leader = np.where(start >= 0, doc[np.maximum(start, 0)], last[2] if last else 0)
        last = (shingle[-1], sig[-1], leader[-1])
        pairs = np.unique(np.column_stack([leader, doc])[other & ~new], axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["leader", "doc_id"])


def _full_sets(batches):
    for ids, sets in _sets(batches):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                         ["doc_id", "n", "shingles"])


def search(sets: list[np.ndarray], side: np.ndarray | None = None) -> np.ndarray:
    """A label for each set: equal labels are joined by links among ``sets``. With ``side``, only sets of different sides are compared.

    Every set queries the smaller ones. Its inverted lists are cut to the sizes that can link; the longest L are only probed.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order], np.int64)
    side = np.zeros(len(sets), np.int64) if side is None else np.asarray(side)[order]
    cross = bool(side.any()) and not bool(side.all())
    owner = np.repeat(np.arange(len(order)), size)
    values = np.concatenate([sets[i] for i in order]) if len(order) else np.zeros(0, np.uint64)
    by = np.argsort(values, kind="stable")  # lists stay in order of size
    values, owner = values[by], owner[by]
    lists = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))
    length = np.diff(lists, append=len(values))
    of = np.empty(len(values), np.int64)  # place in the set -> list
    of[by] = np.repeat(np.arange(len(lists)), length)
    begin = np.cumsum(size) - size
    label = np.arange(len(order))
    for q in range(1, len(order)):
        n = int(size[q])
        low = int(np.searchsorted(size[:q], -(-NEED * n // 100)))
        if not n or low == q or (label[low:q] == label[q]).all():
            continue
        own = of[begin[q]:begin[q] + n]
        own = own[length[own] > 1]
        need = int(least_common(n, int(size[low])))
        if len(own) < need:
            continue
        longest = int(length[own].max())
        skip = min(need - 1, int(need / (MU * np.log2(longest) + 1)))
        own = own[np.argsort(length[own], kind="stable")]
        short, long = own[:len(own) - skip], own[len(own) - skip:]
        many = length[short]
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lists[short], many)
        merged = owner[at]
        count = np.bincount(merged[(merged >= low) & (merged < q)] - low, minlength=q - low)
        found = count >= np.maximum(least_common(n, size[low:q]) - skip, 1)
        if cross:
            found &= side[low:q] != side[q]
        for c in np.flatnonzero(found) + low:
            if label[c] == label[q]:
                continue
            theirs = sets[order[c]]
            probes = values[lists[long]]
            hit = theirs[np.minimum(np.searchsorted(theirs, probes), len(theirs) - 1)] == probes
            if count[c - low] + int(hit.sum()) >= least_common(n, int(size[c])):
                label[label == label[q]] = label[c]
    out = np.empty(len(order), np.int64)
    out[order] = label
    return out


def possible(sizes: np.ndarray, bits: list[bytes], side: np.ndarray) -> np.ndarray:
    """Whether each set has a partner that it may be similar to, by sizes and bit maps."""
    out = np.zeros(len(sizes), bool)
    cross = bool(side.any()) and not bool(side.all())
    order = np.argsort(sizes, kind="stable")
    maps = {}  # number of bytes -> places in order, and their maps
    for width in sorted({len(bits[i]) for i in order}):
        at = np.array([k for k, i in enumerate(order) if len(bits[i]) == width])
        maps[width] = at, np.array([np.frombuffer(bits[order[k]], np.uint64) for k in at]).reshape(len(at), -1)
    n, side = sizes[order], side[order]
    for width, (at, rows) in maps.items():
        for other in (width // 2, width):  # a partner that is not larger has as many bits or half of them
            if other not in maps or not width:
                continue
            theirs, their_rows = maps[other]
            own_rows = rows if other == width else rows[:, :rows.shape[1] // 2] | rows[:, rows.shape[1] // 2:]
            for q, own in zip(at, own_rows):
                a = int(np.searchsorted(theirs, np.searchsorted(n, -(-NEED * n[q] // 100))))
                z = int(np.searchsorted(theirs, q))
                if a >= z:
                    continue
                m, part = n[theirs[a:z]], their_rows[a:z]
                most = np.minimum(n[q] - np.bitwise_count(own & ~part).sum(1, dtype=np.int64), m - np.bitwise_count(part & ~own).sum(1, dtype=np.int64))
                fits = most >= least_common(n[q], m)
                if cross:
                    fits &= side[theirs[a:z]] != side[q]
                if fits.any():
                    out[order[q]] = True
                    out[order[theirs[a:z][fits]]] = True
    return out


def _grouped(batches, *names: str):
    """Lists of rows with equal (leader, i, j), from rows sorted by these."""
    key, held = None, []
    for batch in batches:
        for leader, i, j, *row in zip(*(column(batch, c).to_pylist() for c in ("leader", "i", "j", *names))):
            if (leader, i, j) != key:
                if len(held) > 1:
                    yield key, held
                key, held = (leader, i, j), []
            held.append(row)
    if len(held) > 1:
        yield key, held


def _bound_blocks(batches):
    """The rows of each block that may have a partner in it, without their bit maps."""
    out = []
    for key, held in _grouped(batches, "side", "doc_id", "n", "bits"):
        found = possible(np.array([x[2] for x in held], np.int64), [x[3] for x in held], np.array([x[0] for x in held]))
        out += [(*key, x[0], x[1]) for x, f in zip(held, found) if f]
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["leader", "i", "j", "side", "doc_id"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["leader", "i", "j", "side", "doc_id"])


def _search_blocks(batches):
    """Spanning forests of the blocks."""
    for _, held in _grouped(batches, "side", "doc_id", "shingles"):
        ids = np.array([x[1] for x in held], np.int64)
        label = search([np.frombuffer(x[2], np.uint64) for x in held], np.array([x[0] for x in held]))
        by = np.lexsort((ids, label))
        first = np.concatenate(([True], label[by][1:] != label[by][:-1]))
        if not first.all():
            root = ids[by][np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
            yield pa.RecordBatch.from_arrays([pa.array(ids[by][~first]), pa.array(root[~first])], ["a", "b"])


def _links(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """Links (a, b) between ids of different sets that join all that are similar, through others or not."""
    spark = docs.sparkSession
    often = counted.where("shingle").groupBy("sig").agg(F.sum("n").alias("times")).where(F.col("times") >= FREQUENT).orderBy(
        F.desc("times"), "sig").limit(FREQUENT_ROWS).toPandas()
    values = often["sig"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(values)
    heavy = spark.sparkContext.broadcast(values[by]), spark.sparkContext.broadcast(often["times"].to_numpy(np.int64)[by])
    lists = docs.mapInArrow(_short_lists(*heavy), "shingle long, sig long, doc_id long").repartition("shingle").sortWithinPartitions("shingle", "sig", "doc_id")
    member = store(lists.mapInArrow(_blocks, "leader long, doc_id long").distinct(), "blocks")
    member = member.union(member.select("leader", F.col("leader").alias("doc_id")).distinct())
    maps = counted.where("not shingle and n > 0").groupBy("doc_id").agg(F.collect_set(F.struct("n", "bits")).alias("maps"))  # one for each text of an id
    sized = member.join(maps, "doc_id").select("leader", "doc_id", F.inline("maps"))
    sized = store(sized, "maps")
    parts = sized.groupBy("leader").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts"))
    dealt = sized.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("leader", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                         (F.col("part") > F.col("other")).cast("int").alias("side"), "doc_id", "n", "bits")
    key = ["leader", "i", "j"]
    block = "leader long, i long, j long, side long, doc_id long"
    near = store(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_bound_blocks, block), "near")
    ids = store(near.select("doc_id").distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    sets = docs.join(ids, "doc_id", "left_semi").mapInArrow(_full_sets, "doc_id long, n long, shingles binary")
    sets = sets.groupBy("doc_id").agg(F.collect_set("shingles").alias("versions"))
    full = near.join(sets, "doc_id").select(*key, "side", "doc_id", F.explode("versions").alias("shingles"))
    return full.repartition(*key).sortWithinPartitions(*key).mapInArrow(_search_blocks, "a long, b long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links reach. A null or empty text, or one without words, has no shingles and stays alone; so
    does a null doc_id, whose component is null. A text of fewer than five words has one shingle, all its words. Rows with the same
    doc_id are one document in two versions: links of either count for the id. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    counted = store(docs.mapInArrow(_count, "shingle boolean, doc_id long, n long, sig long, sig2 long, bits binary"), "sets")
    rows = counted.where("not shingle")
    copies = rows.where("n > 0 and doc_id is not null").groupBy("sig", "sig2").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1")
    same = rows.where("n > 0").join(copies, ["sig", "sig2"]).where("doc_id > b").select(F.col("doc_id").alias("a"), "b")
    found = components(_links(docs, counted).union(same))
    return rows.join(found, rows["doc_id"] == found["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their component; all columns stay, rows with a null doc_id too."""
    gone = jaccard_components(docs).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


_WORDS = "regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\\x20\\x09-\\x0D]+')"
ORACLE = {"op4_ngram_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= {NEED} * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m AS component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) ON a = d.doc_id"""}


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)
