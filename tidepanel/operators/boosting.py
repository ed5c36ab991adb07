"""Histogram boosting of many regressions at once, keyed by model.

Features turn into order-preserving integers (20 bits of a float), are counted once per (model, feature, value) and cut into at most 255 bins,
each value its own bin while there are few. Trees grow best leaf first. A split is read from sums of gradient and count per (node,
feature, bin); with squared loss the count is the Hessian. Missing values have a bin of their own and go to the side that gains more.
Gradients are whole numbers of 2^-20, so sums don't depend on the order of rows.

The same growth runs in two ways, with equal trees. Models of at most ``TASK_BYTES`` are fitted one to a task, all in one job. Larger ones
advance together: each pass sums histograms over all their rows by (model, feature, bin) with map-side combine, and only these sums reach
the driver, whose size is given by models, features and bins. Trees are as bounded: models × rounds × (2 leaves - 1) nodes.
"""
from __future__ import annotations

import heapq
from collections.abc import Generator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidepanel.session import cut_lineage

#: Bytes of a model that one task holds; beyond, its histograms are summed by Spark.
TASK_BYTES = 2_000_000_000
#: Bytes of a row in a task at most: fit, gradient, label, leaf and lists, and two for every feature.
ROW_BYTES, CELL_BYTES = 22, 2
#: Models that get a task of their own.
TASKS = 2000
#: Rows of a pass that stay in the cache, with their codes as integers or as bytes.
PART, SCAN = 1 << 14, 1 << 16
#: Combinations of bins at most that are summed together.
JOINT = 1024
#: Rows that a task packs at a time.
PACK_ROWS = 400_000
#: Rounds after which the fits of large models are written, so that a pass evaluates few trees.
WRITE_EVERY = 8
UNIT = float(1 << 20)
#: Key of a missing value; every other key is less.
MISSING = 1 << 30
#: What is added to keys to make codes from 0 on, and the code of a missing value.
ZERO, NOWHERE = 1 << 19, 1 << 20


@dataclass(frozen=True)
class Boost:
    """Rounds, leaves of a tree, learning rate, rows of a leaf at least, L2 weight, bins at most."""
    rounds: int = 150
    leaves: int = 15
    rate: float = 0.05
    least: int = 60
    l2: float = 2.0
    bins: int = 255


@dataclass
class Tree:
    feature: list[int] = field(default_factory=lambda: [-1])
    key: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, split: "Split", bins: "Bins") -> int:
        """Gives ``node`` two children, the right one behind the left; returns the left."""
        at = len(self.feature)
        edges = bins.edges[split.feature]
        self.feature[node], self.cut[node] = split.feature, int(bins.first[split.feature]) + split.cut
        self.key[node] = int(edges[split.cut]) if split.cut < len(edges) else MISSING - 1
        self.missing_left[node], self.left[node] = split.missing_left, at
        for column, v in ((self.feature, -1), (self.key, 0), (self.cut, 0), (self.missing_left, False), (self.left, 0)):
            column += [v, v]
        self.value += split.values
        return at


@dataclass(order=True)
class Split:
    loss: float
    feature: int
    cut: int
    missing_left: bool
    rows: tuple = field(compare=False)
    values: list = field(compare=False)


def order_key(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the values, equal for values that agree in about 11 bits; MISSING for NaN."""
    bits = (np.asarray(x, np.float64).astype(np.float32) + np.float32(0)).view(np.int32)
    return np.where(np.isnan(x), np.int32(MISSING), np.where(bits < 0, bits ^ 0x7FFFFFFF, bits) >> 12).astype(np.int32)


def edges_of(keys: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Last key of each bin but the last; ``keys`` ascend and exclude missing ones."""
    if len(keys) > bins:
        passed = np.cumsum(counts)
        keys = np.unique(np.append(keys[np.searchsorted(passed, passed[-1] * np.arange(1, bins) / bins)], keys[-1]))
    return keys[:-1]


class Bins:
    """Where the bins of each feature lie in a histogram: in order, that of missing values last."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = edges
        widths = np.array([len(e) + 2 for e in edges])
        self.first, self.size = np.cumsum(widths) - widths, int(widths.sum())
        self.missing = self.first + widths - 1
        self.feature = np.repeat(np.arange(len(edges)), widths - 1)  # of every cut: a bin and what lies left of it
        self.cut = np.arange(len(self.feature)) - np.repeat(np.cumsum(widths - 1) - widths + 1, widths - 1)
        self.low = self.first[self.feature]
        self.high = self.low + self.cut + 1

    def cells(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty(keys.shape, np.uint16)
        for f, e in enumerate(self.edges):
            out[:, f] = self.first[f] + np.where(keys[:, f] == MISSING, len(e) + 1, np.searchsorted(e, keys[:, f]))
        return out

    def histogram(self, cells: np.ndarray, gradient: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        """Sums of gradient and count (``n`` rows each), an array 2 × size. Cells that lie feature by feature are read fastest."""
        out = np.empty((2, self.size))
        for f, first in enumerate(self.first):
            at, width = cells[:, f].astype(np.intp), self.missing[f] + 1 - first
            at -= first
            out[0, first:first + width], out[1, first:first + width] = np.bincount(at, gradient, width), np.bincount(at, n, width)
        return out

    def best(self, hist: np.ndarray, s: Boost) -> Split | None:
        """Most gain over features, cuts and the side of missing values; ties go to the first in that order, missing to the right."""
        down = np.zeros((2, self.size + 1))
        np.cumsum(hist, axis=1, out=down[:, 1:])
        g, h = (d.take(self.high) - d.take(self.low) for d in down)
        all_g, all_h = down[:, self.missing[0] + 1]

        def gain(left_g, left_h):
            right_h, right_g = all_h - left_h, all_g - left_g
            value = left_g * left_g / (left_h + s.l2) + right_g * right_g / (right_h + s.l2)
            value[np.minimum(left_h, right_h) < s.least] = -np.inf
            return value

        right = gain(g, h)
        at, to_left = int(np.argmax(right)), False
        best, (lg, lh) = right[at], (g[at], h[at])
        lost_g, lost_h = hist[:, self.missing]
        if lost_h.any():
            cut = np.flatnonzero(lost_h[self.feature] > 0)
            more_g, more_h = g[cut] + lost_g[self.feature[cut]], h[cut] + lost_h[self.feature[cut]]
            left = gain(more_g, more_h)
            other = int(np.argmax(left))
            if left[other] > best or (left[other] == best and cut[other] < at):
                at, to_left, best, lg, lh = int(cut[other]), True, left[other], more_g[other], more_h[other]
        if not best - all_g**2 / (all_h + s.l2) > 1e-9 * UNIT:
            return None
        f, rh = int(self.feature[at]), all_h - lh
        values = [float(-s.rate * a / (b + s.l2) / UNIT) for a, b in ((lg, lh), (all_g - lg, rh))]
        if not lost_h[f]:
            to_left = bool(lh > rh)  # unseen missing values follow the many
        return Split(-float(best - all_g**2 / (all_h + s.l2)), f, int(self.cut[at]), to_left, (int(lh), int(rh)), values)

    def left_of(self, tree: "Tree", node: int, cells: np.ndarray, own=slice(None)) -> np.ndarray:
        """Which of the rows at ``node`` go left."""
        c = cells[:, tree.feature[node]][own]
        return np.where(c == self.missing[tree.feature[node]], tree.missing_left[node], c <= tree.cut[node])


def grow(bins: Bins, s: Boost) -> Generator[tuple[Tree, int], np.ndarray, Tree]:
    """A tree, best leaf first; yields it with the node whose histogram is wanted next."""
    tree, agenda, leaves = Tree(), [], 1
    hists = {0: (yield tree, 0)}
    if first := bins.best(hists[0], s):
        agenda.append((first, 0))
    while agenda and leaves < s.leaves:
        split, node = heapq.heappop(agenda)
        left, leaves = tree.split(node, split, bins), leaves + 1
        if leaves < s.leaves and max(split.rows) >= 2 * s.least:
            few = left + (split.rows[0] > split.rows[1])
            hists[few] = yield tree, few
            hists[2 * left + 1 - few] = hists[node] - hists[few]
            for child, n in zip((left, left + 1), split.rows):
                if n >= 2 * s.least and (found := bins.best(hists[child], s)):
                    heapq.heappush(agenda, (found, child))
        del hists[node]
    return tree


def spread(tree: Tree, bins: Bins, cells: np.ndarray, rows: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Moves rows from split nodes on to their leaves."""
    for node in range(len(tree.feature)):
        if node in rows and tree.feature[node] >= 0:
            own = rows.pop(node)
            left = bins.left_of(tree, node, cells, own)
            rows[tree.left[node]], rows[tree.left[node] + 1] = own[left], own[~left]
    return rows


@dataclass
class Coded:
    """Columns of bins that are summed together: a code for each combination that occurs, and the bin of every member by code."""
    members: list[int]
    codes: np.ndarray
    table: list[np.ndarray]

    def join(self, feature: int, column: np.ndarray, width: int) -> bool:
        """Takes a column in, unless that makes more than ``JOINT`` codes."""
        size = len(self.table[0]) * width
        pair = lambda a, b: self.codes[a:b].astype(np.int32) * width + column[a:b]
        if len(np.unique(pair(0, 2 * JOINT))) > JOINT:
            return False
        seen = np.zeros(size, bool)
        for a in range(0, len(column), PART):
            seen[pair(a, a + PART)] = True
        found = np.flatnonzero(seen)
        if len(found) > JOINT:
            return False
        number = np.zeros(size, np.uint8 if len(found) <= 256 else np.uint16)
        number[found] = np.arange(len(found))
        self.codes = np.concatenate([number.take(pair(a, a + PART)) for a in range(0, len(column), PART)])
        self.table = [*[t.take(found // width) for t in self.table], found % width]
        self.members.append(feature)
        return True


class Rows:
    """Rows of one model, column by column: bins of every feature, codes of features that are summed together, fits and gradients.

    A pass works on parts of the rows that stay in the cache. Large nodes are marked in ``leaf``; of small ones the rows are listed.
    """

    def __init__(self, columns: list[np.ndarray], bins: Bins, whole: np.ndarray, n: np.ndarray | None, leaves: int):
        self.columns, self.bins, self.whole, self.n, self.size = columns, bins, whole, n, len(whole)
        widths = np.append(np.diff(bins.first), bins.size - bins.first[-1])
        used = [int((np.bincount(c[:PART], minlength=1) > 0).sum()) for c in columns]
        self.groups: list[Coded] = []
        for f in sorted(range(len(columns)), key=lambda f: used[f]):
            if not any(g.join(f, columns[f], int(widths[f])) for g in self.groups):
                self.groups.append(Coded([f], columns[f], [np.arange(widths[f])]))
        sizes = np.cumsum([0, *[len(g.table[0]) for g in self.groups]])
        self.slots, self.codes = list(zip(sizes[:-1], sizes[1:])), int(sizes[-1])
        self.source = np.concatenate([np.arange(a, b) for (a, b), g in zip(self.slots, self.groups) for _ in g.members])
        self.goal = np.concatenate([bins.first[f] + t for g in self.groups for f, t in zip(g.members, g.table)])
        total = self.size if n is None else int(n.sum())
        self.fitted = np.full(self.size, float(whole.sum(dtype=np.float64) / total / UNIT))
        self.start = float(self.fitted[0])
        small = whole.dtype == np.int32 and n is None
        self.gradient = np.empty(self.size, np.int32 if small else np.float64)
        self.leaf = np.zeros(self.size, np.uint8 if 2 * leaves <= 256 else np.uint16)
        self.counts = np.zeros(self.codes)
        for a in range(0, self.size, PART):
            for (i, j), g in zip(self.slots, self.groups):
                self.counts[i:j] += np.bincount(g.codes[a:a + PART], None if n is None else n[a:a + PART], j - i)

    def _fold(self, sums: np.ndarray) -> np.ndarray:
        """Sums by code as a histogram of all features."""
        return np.array([np.bincount(self.goal, s.take(self.source), self.bins.size) for s in sums])

    def begin(self, values: np.ndarray | None) -> np.ndarray:
        """Adds the last tree to the fits; new gradients and their histogram over all rows."""
        sums, self.top = np.zeros(self.codes), 0.0
        for a in range(0, self.size, PART):
            own = slice(a, a + PART)
            if values is not None:
                self.fitted[own] += values.take(self.leaf[own])
                self.leaf[own] = 0
            g = self.fitted[own] * UNIT
            np.round(g, out=g)
            if self.n is not None:
                g *= self.n[own]
            g -= self.whole[own]
            self.top = max(self.top, float(g.max()), -float(g.min()))
            if self.top >= 1 << 31 and self.gradient.dtype == np.int32:
                self.gradient = self.gradient.astype(np.float64)
            self.gradient[own] = g
            for (i, j), c in zip(self.slots, self.groups):
                sums[i:j] += np.bincount(c.codes[own], g, j - i)
        self.lists: dict[int, np.ndarray] = {}
        self.held = {0: self.size}  # rows of the nodes that ``leaf`` marks
        # gradient and count fit into one number as long as a part's sums of both do
        most = PART * (1 if self.n is None else int(self.n.max()))
        bits = int(np.ceil(np.log2(max(1.0, self.top * PART)))) + 1
        self.unit = float(1 << bits) if bits + np.log2(most) <= 52 else None
        return self._fold(np.array([sums, self.counts]))

    def histogram(self, node: int) -> np.ndarray:
        own = self._rows(node)
        sums = np.zeros((2, self.codes))
        for a in range(0, len(own), PART):
            at = own[a:a + PART].astype(np.intp)
            g = self.gradient.take(at).astype(np.float64)
            n = None if self.n is None else self.n.take(at)
            if self.unit:
                both, part = g + (self.unit if n is None else n * self.unit), np.empty(self.codes)
                for (i, j), c in zip(self.slots, self.groups):
                    part[i:j] = np.bincount(c.codes.take(at), both, j - i)
                count = np.floor((part + self.unit / 2) / self.unit)
                sums[0] += part - count * self.unit
                sums[1] += count
            else:
                for (i, j), c in zip(self.slots, self.groups):
                    code = c.codes.take(at)
                    sums[0, i:j] += np.bincount(code, g, j - i)
                    sums[1, i:j] += np.bincount(code, n, j - i)
        return self._fold(sums)

    def _rows(self, node: int) -> np.ndarray:
        """Numbers of a node's rows; from then on they are listed."""
        if node not in self.lists:
            del self.held[node]
            found = [(np.flatnonzero(self.leaf[a:a + SCAN] == node) + a).astype(np.int32 if self.size < 1 << 31 else np.int64) for a in range(0, self.size, SCAN)]
            self.lists[node] = np.concatenate(found)
        return self.lists[node]

    def _right(self, tree: Tree, node: int, bins: np.ndarray) -> np.ndarray:
        f = tree.feature[node]
        right = bins > tree.cut[node] - int(self.bins.first[f])
        if tree.missing_left[node]:
            right &= bins != self.bins.missing[f] - int(self.bins.first[f])
        return right

    def divide(self, tree: Tree, node: int, last: bool = False) -> None:
        """Moves the rows of a split node to its children."""
        column, left = self.columns[tree.feature[node]], tree.left[node]
        if node in self.held and self.held[node] > self.size // 8:
            count, moved = self.held.pop(node), 0
            for a in range(0, self.size, SCAN):
                leaf, right = self.leaf[a:a + SCAN], self._right(tree, node, column[a:a + SCAN])
                own = leaf == node
                right &= own
                leaf += own.view(np.uint8) * self.leaf.dtype.type(left - node)
                leaf += right.view(np.uint8)
                moved += int(np.count_nonzero(right))
            self.held |= {left: count - moved, left + 1: moved}
            return
        own = self._rows(node)
        del self.lists[node]
        right = self._right(tree, node, column.take(own))
        if last:
            self.leaf[own] = right + self.leaf.dtype.type(left)
        else:
            self.lists |= {left: own.compress(~right), left + 1: own.compress(right)}

    def spread(self, tree: Tree, last: bool = False) -> None:
        """Moves rows from split nodes on to their leaves; ``last`` marks all leaves of the tree."""
        for node in range(len(tree.feature)):
            if tree.feature[node] >= 0 and (node in self.lists or node in self.held):
                self.divide(tree, node, last and tree.feature[tree.left[node]] < 0 and tree.feature[tree.left[node] + 1] < 0)
        if last:
            for node, own in self.lists.items():
                self.leaf[own] = node


def _boost(rows: Rows, s: Boost) -> tuple[float, list[Tree]]:
    trees, values = [], None
    for _ in range(s.rounds):
        hist, steps = rows.begin(values), grow(rows.bins, s)
        tree, node = next(steps)
        try:
            while True:
                tree, node = steps.send(hist)
                rows.spread(tree)
                hist = rows.histogram(node)
        except StopIteration as done:
            tree = done.value
        rows.spread(tree, True)
        values = np.array(tree.value)
        trees.append(tree)
        if len(tree.feature) == 1:  # nothing splits any more, and nothing will
            break
    return rows.start, trees


def fit_one(keys: np.ndarray, y: np.ndarray, s: Boost, n: np.ndarray | None = None) -> tuple[float, list[Tree]]:
    """(start, trees) of a model whose rows are at hand. With ``n`` a row stands for that many of the same features, and y is their sum."""
    return fit_blocks([_block(keys, np.round(y * UNIT), n)], s)


def fit_blocks(blocks: list[tuple], s: Boost) -> tuple[float, list[Tree]]:
    """``fit_one`` of packed rows (features, labels, numbers of each block), which are let go feature by feature."""
    whole = np.concatenate([_labels(b[1], b[3]) for b in blocks])
    n = np.concatenate([np.frombuffer(b[2], np.int64) for b in blocks]) if blocks[0][2] is not None else None
    lengths, features = [b[3] for b in blocks], [list(f) for f in zip(*[b[0] for b in blocks])]
    blocks.clear()  # nothing but ``features`` keeps them
    edges, columns = [], []
    for f in range(len(features)):
        codes = np.concatenate([_codes(part, length) for part, length in zip(features[f], lengths)])
        features[f] = None
        counts = np.zeros(NOWHERE + 1, np.int64)
        for a in range(0, len(codes), 1 << 20):
            own = slice(a, a + (1 << 20))
            counts += np.bincount(codes[own], minlength=NOWHERE + 1) if n is None else np.bincount(codes[own], n[own], NOWHERE + 1).astype(np.int64)
        found = np.flatnonzero(counts[:NOWHERE])
        edges.append(edges_of(found - ZERO, counts[found], s.bins).astype(np.int64))
        ends = np.concatenate([[0], edges[-1] + ZERO + 1, [NOWHERE]])
        bin_of = np.repeat(np.arange(len(ends) - 1), np.diff(ends)).astype(np.uint8 if len(ends) <= 256 else np.uint16)
        bin_of = np.append(bin_of, bin_of.dtype.type(len(ends) - 1))
        columns.append(np.concatenate([bin_of.take(codes[a:a + PART]) for a in range(0, len(codes), PART)]))
    return _boost(Rows(columns, Bins(edges), whole, n, s.leaves), s)


# -- models as rows -------------------------------------------------------------------------------------------------------------
MODEL = "rows long, start double, roots array<int>, feature array<int>, key array<int>, left array<int>, missing_left array<boolean>, value array<double>"


def _flat(rows: int, start: float, trees: list[Tree]) -> dict:
    roots = np.cumsum([0, *[len(t.feature) for t in trees]])[:-1]
    join = lambda name, shift=False: [v + int(r) if shift else v for r, t in zip(roots, trees) for v in getattr(t, name)]
    return {"rows": rows, "start": start, "roots": roots.tolist(), "feature": join("feature"), "key": join("key"), "left": join("left", True),
            "missing_left": join("missing_left"), "value": join("value")}


def _lists(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A column of equally long lists as a matrix; nulls become NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1)


def _packed(keys: np.ndarray) -> bytes:
    """A column of keys in three bytes each, the upper ones together, as they hardly differ; equal ones once."""
    if (keys == keys[0]).all():
        return keys[:1].astype(np.int32).tobytes()
    codes = np.minimum(keys + ZERO, NOWHERE)
    return codes.astype(np.uint16).tobytes() + (codes >> 16).astype(np.uint8).tobytes()


def _codes(packed: bytes, length: int) -> np.ndarray:
    """Keys of a packed column, shifted to 0 and above."""
    if len(packed) == 4:
        return np.full(length, min(int(np.frombuffer(packed, np.int32)[0]) + ZERO, NOWHERE), np.int32)
    codes = np.frombuffer(packed, np.uint8, length, 2 * length).astype(np.int32) << 16
    codes |= np.frombuffer(packed, np.uint16, length)
    return codes


def _block(keys: np.ndarray, whole: np.ndarray, n: np.ndarray | None) -> tuple[list[bytes], bytes, bytes | None, int]:
    """Features, labels in units, numbers and length of some rows."""
    labels = whole.astype(np.int32) if np.abs(whole).max() < 1 << 30 else whole.astype(np.float64)
    return [_packed(c) for c in keys.T], labels.tobytes(), None if n is None else n.astype(np.int64).tobytes(), len(whole)


def _labels(packed: bytes, length: int) -> np.ndarray:
    return np.frombuffer(packed, np.int32 if len(packed) == 4 * length else np.float64)


def pack(rows: DataFrame, keys: list[str], x: str = "x", y: str = "y", weight: str | None = None) -> DataFrame:
    """(keys, rows, entries, width, x, y, n): blocks of rows of equal keys, features as ordered integers. Rows without a label are left out.

    ``weight`` counts the rows of the same features that a row stands for; y is then the sum of their labels. Blocks may be repeated under
    further keys (origins) before ``fit_packed``, so that no row is.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    rows = rows.filter(F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).cast("double").alias("_y"), *([F.col(weight).cast("long").alias("_n")] if weight else []))

    def run(batches):
        held, size = {}, 0

        def blocks():
            for at in range(0, len(held), 1000):
                table = [(key, *(np.concatenate(parts) for parts in zip(*found))) for key, found in list(held.items())[at:at + 1000]]
                columns = [pa.array([t[0][i] for t in table], kind) for i, kind in enumerate(types)]
                packed = [_block(t[1], t[2], t[3] if weight else None) for t in table]
                numbers = [[int(t[3].sum()) if weight else len(t[2]) for t in table], [len(t[2]) for t in table], [t[1].shape[1] for t in table]]
                yield pa.record_batch([*columns, pa.array(numbers[0], pa.int64()), pa.array(numbers[1], pa.int64()), pa.array(numbers[2], pa.int32()), pa.array([p[0] for p in packed], pa.list_(pa.binary())),
                                       pa.array([p[1] for p in packed], pa.binary()), pa.array([p[2] for p in packed], pa.binary())], [*keys, "rows", "entries", "width", "x", "y", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(k).type for k in keys]
            features, whole = order_key(_lists(batch.column("_x"))), np.round(batch.column("_y").to_numpy() * UNIT)
            n = batch.column("_n").to_numpy() if weight else whole
            codes = batch.select(keys).to_pandas().groupby(keys, sort=False, dropna=False).indices if len(keys) > 1 else {(k,): v for k, v in batch.select(keys).to_pandas().groupby(keys[0], sort=False, dropna=False).indices.items()}
            for key, own in codes.items():
                key = tuple(v.item() if hasattr(v, "item") else v for v in key)
                held.setdefault(key, []).append((features[own], whole[own], n[own]))
            size += batch.num_rows
            if size >= PACK_ROWS:
                yield from blocks()
                held, size = {}, 0
        if held:
            yield from blocks()

    return rows.mapInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "rows long, entries long, width int, x array<binary>, y binary, n binary"]))


def _blocks(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("n").to_pylist(), batch.column("entries").to_pylist()))


def _unpacked(block: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(keys, labels, numbers) of the rows of a block, labels in units."""
    x, y, n, length = block
    codes = np.array([_codes(c, length) for c in x]).T
    return np.where(codes == NOWHERE, np.int32(MISSING), codes - ZERO), _labels(y, length).astype(np.float64), None if n is None else np.frombuffer(n, np.int64)


def fit(rows: DataFrame, keys: list[str], settings: Boost = Boost(), x: str = "x", y: str = "y", task_rows: int | None = None, weight: str | None = None) -> DataFrame:
    """One row per model: keys and the columns of ``MODEL``. ``rows`` has keys, an array of features (null: missing) and a label.

    Rows without a label are left out. A model without rows does not appear. ``weight``: see ``pack``.
    """
    return fit_packed(cut_lineage(pack(rows, keys, x, y, weight), "boost-blocks"), keys, settings, task_rows)


def fit_packed(blocks: DataFrame, keys: list[str], settings: Boost = Boost(), task_rows: int | None = None) -> DataFrame:
    """``fit`` of stored blocks, which are read twice; a block belongs to one model."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    shape = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + MODEL
    sizes = blocks.groupBy(*keys).agg(F.sum("rows").alias("_rows"), F.sum("entries").alias("_entries"), F.max("width").alias("_width"))
    found = {tuple(r[k] for k in keys): r for r in sizes.collect()}  # models, not rows
    most = lambda r: TASK_BYTES // (ROW_BYTES + CELL_BYTES * r["_width"]) if task_rows is None else task_rows
    large = {k: r["_rows"] for k, r in found.items() if r["_entries"] > most(r)}

    ints, flags, doubles = pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.float64())
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    out = pa.schema([(k, arrow[kinds[k]]) for k in keys] + [("rows", pa.int64()), ("start", pa.float64()), ("roots", ints), ("feature", ints), ("key", ints), ("left", ints),
                                                           ("missing_left", flags), ("value", doubles)])

    def run(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            named = zip(*[batch.column(k).to_pylist() for k in keys])
            for key, block, rows in zip(named, _blocks(batch), batch.column("rows").to_pylist()):
                held.setdefault(key, [0, []])[0] += rows
                held[key][1].append(block)
        batch = block = None  # nothing but ``held`` keeps the blocks
        for key in list(held):
            rows, own = held.pop(key)
            start, trees = fit_blocks(own, settings)
            yield pa.RecordBatch.from_pylist([{**dict(zip(keys, key)), **_flat(rows, start, trees)}], schema=out)

    spark = blocks.sparkSession
    fitted = None
    if len(found) > len(large) or not large:
        # the longest models start first, each in a task of its own; of very many the shorter ones share tasks
        own = sorted((k for k in found if k not in large), key=lambda k: -found[k]["_entries"])
        tasks = max(1, min(len(own), TASKS))
        names = spark.createDataFrame([(*k, i % tasks) for i, k in enumerate(own)], ", ".join(f"{k} {kinds[k]}" for k in keys) + ", _task int")
        fitted = blocks.join(F.broadcast(names), keys).repartitionById(tasks, F.col("_task")).mapInArrow(run, shape)
    if not large:
        return fitted
    summed = _fit_large(blocks, keys, large, settings, shape)
    return summed if fitted is None else fitted.unionByName(summed)


def _fit_large(blocks: DataFrame, keys: list[str], sizes: dict, s: Boost, shape: str) -> DataFrame:
    """All models of ``sizes`` in step: each pass is one aggregate over their rows, by (model, feature, bin)."""
    spark, names = blocks.sparkSession, list(sizes)
    number = spark.createDataFrame([(*k, i) for i, k in enumerate(names)], ", ".join(f"{k} {t}" for k, t in zip(keys, [blocks.schema[k].dataType.simpleString() for k in keys])) + ", _model int")
    rows = blocks.join(F.broadcast(number), keys).select(F.col("_model").alias("model"), "x", "y", "n", "entries")

    def to_keys(batches):
        for batch in batches:
            for i, block in enumerate(_blocks(batch)):
                features, whole, n = _unpacked(block)
                for a in range(0, len(whole), 10_000):
                    cut = slice(a, a + 10_000)
                    yield pa.record_batch([pa.array(np.full(len(whole[cut]), batch.column("model")[i].as_py(), np.int32)), pa.array(list(features[cut]), pa.list_(pa.int32())), pa.array(whole[cut]),
                                           pa.array(np.ones(len(whole[cut])) if n is None else n[cut].astype(float))], ["model", "keys", "y", "n"])

    keyed = cut_lineage(rows.mapInArrow(to_keys, "model int, keys array<int>, y double, n double"), "boost-keys")
    counts = keyed.select("model", F.col("n").cast("long").alias("_n"), F.posexplode("keys").alias("feature", "key")).groupBy("model", "feature", "key").agg(F.sum("_n").alias("n"))
    # at most 2^20 values of a feature reach one task, whatever the rows
    passed, total = W.partitionBy("model", "feature").orderBy("key"), W.partitionBy("model", "feature")
    counted = counts.filter(F.col("key") != MISSING).withColumns({
        "up": F.sum("n").over(passed), "whole": F.sum("n").over(total), "values": F.count("*").over(total), "top": F.max("key").over(total)})
    crossed = F.expr(f"up * {s.bins} div whole > (up - n) * {s.bins} div whole")  # a quantile lies on this value
    found = counted.filter((F.col("values") <= s.bins) | (F.col("key") == F.col("top")) | crossed).groupBy("model", "feature").agg(F.array_sort(F.collect_set("key")).alias("keys")).collect()
    width = len(keyed.first()["keys"])
    edges = [[np.zeros(0, np.int32)] * width for _ in names]
    for r in found:
        edges[r["model"]][r["feature"]] = np.array(r["keys"], np.int32)[:-1]
    layout = [Bins(e) for e in edges]
    starts = {r["model"]: float(r["s"] / r["n"] / UNIT) for r in keyed.groupBy("model").agg(F.sum(F.col("y").cast("decimal(38,0)")).cast("double").alias("s"), F.sum("n").alias("n")).collect()}

    def to_bins(batches):
        for batch in batches:
            model, keyed_rows = batch.column("model").to_numpy(), _lists(batch.column("keys"), np.int32)
            out, fitted = np.empty(keyed_rows.shape, np.uint16), np.empty(len(model))
            for m in np.unique(model):
                own = model == m
                out[own], fitted[own] = layout[m].cells(keyed_rows[own]), starts[m]
            yield pa.record_batch([batch.column("model"), pa.array([r.tobytes() for r in out], pa.binary()), batch.column("y"), batch.column("n"), pa.array(fitted)], ["model", "bins", "y", "n", "fitted"])

    def unpack(batch):
        return batch.column("model").to_numpy(), np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint16).reshape(-1, width)

    state = cut_lineage(keyed.mapInArrow(to_bins, "model int, bins binary, y double, n double, fitted double"), "boost-state")
    trees: list[list[Tree]] = [[] for _ in names]
    recent: list[list[Tree]] = [[] for _ in names]
    alive = set(range(len(names)))

    def boosted(model, bins, fitted, grown):
        fitted = fitted.copy()
        for m in np.unique(model):
            own = np.flatnonzero(model == m)
            for tree in grown[m]:
                for leaf, rows in spread(tree, layout[m], bins, {0: own}).items():
                    fitted[rows] += tree.value[leaf]
        return fitted

    def sums(wanted: dict[int, tuple[Tree, int]], grown):
        def add(batches):
            total = {m: np.zeros((2, layout[m].size)) for m in wanted}
            for batch in batches:
                model, bins = unpack(batch)
                fitted = boosted(model, bins, batch.column("fitted").to_numpy(), grown)
                n = batch.column("n").to_numpy()
                gradient = np.round(fitted * UNIT) * n - batch.column("y").to_numpy()
                for m, (tree, node) in wanted.items():
                    own = spread(tree, layout[m], bins, {0: np.flatnonzero(model == m)})[node]
                    total[m] += layout[m].histogram(bins[own], gradient[own], n[own])
            for m, t in total.items():
                filled = np.flatnonzero(t[1])
                yield pa.record_batch([pa.array(np.full(len(filled), m, np.int32)), pa.array(filled.astype(np.int32)), *[pa.array(c[filled].astype(np.int64)) for c in t]],
                                      ["model", "cell", "g", "h"])

        out = {m: np.zeros((2, layout[m].size)) for m in wanted}
        for r in state.mapInArrow(add, "model int, cell int, g long, h long").groupBy("model", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out[r["model"]][:, r["cell"]] = r["g"], r["h"]
        return out

    for done in range(s.rounds):
        if not alive:
            break
        steps = {m: grow(layout[m], s) for m in sorted(alive)}
        wanted = {m: next(g) for m, g in steps.items()}
        while wanted:
            hists, ready = sums(wanted, recent), {}
            for m in list(wanted):
                try:
                    ready[m] = steps[m].send(hists[m])
                except StopIteration as end:
                    trees[m].append(end.value)
                    recent[m] = [*recent[m], end.value]
                    if len(end.value.feature) == 1:
                        alive.discard(m)
            wanted = ready
        if (done + 1) % WRITE_EVERY == 0:
            grown = recent

            def advance(batches, grown=grown):
                for batch in batches:
                    model, bins = unpack(batch)
                    fitted = boosted(model, bins, batch.column("fitted").to_numpy(), grown)
                    yield pa.record_batch([batch.column("model"), batch.column("bins"), batch.column("y"), batch.column("n"), pa.array(fitted)], ["model", "bins", "y", "n", "fitted"])

            state = cut_lineage(state.mapInArrow(advance, "model int, bins binary, y double, n double, fitted double"), "boost-state")
            recent = [[] for _ in names]
    return spark.createDataFrame([(*k, *_flat(sizes[k], starts[m], trees[m]).values()) for m, k in enumerate(names)], shape)


class Forest:
    """A fitted model that scores rows of features."""

    def __init__(self, row):
        self.start, self.roots = row["start"], np.array(row["roots"], np.int64)
        self.feature, self.key, self.left = (np.array(row[c], np.int64) for c in ("feature", "key", "left"))
        self.missing_left, self.value = np.array(row["missing_left"], bool), np.array(row["value"])

    def _few(self, keys: np.ndarray) -> np.ndarray:
        """Scores of few rows, all trees at once."""
        at = np.repeat(self.roots[None, :], len(keys), axis=0)
        row = np.arange(len(keys))[:, None]
        while (inner := self.feature[at] >= 0).any():
            k = keys[row, np.where(inner, self.feature[at], 0)]
            left = np.where(k == MISSING, self.missing_left[at], k <= self.key[at])
            at = np.where(inner, self.left[at] + 1 - left, at)
        return np.cumsum(np.column_stack([np.full(len(keys), self.start), self.value[at]]), axis=1)[:, -1]

    def _many(self, keys: np.ndarray) -> np.ndarray:
        """The same, tree by tree and split by split over all rows."""
        columns, out = [np.ascontiguousarray(c) for c in keys.T], np.full(len(keys), self.start)
        feature, key, child, missing_left = (c.tolist() for c in (self.feature, self.key, self.left, self.missing_left))
        roots = [*self.roots.tolist(), len(feature)]
        for root, end in zip(roots, roots[1:]):
            leaf = np.zeros(len(keys), np.uint8 if end - root <= 256 else np.uint16)
            kind = leaf.dtype.type
            for node in range(root, end):
                if feature[node] >= 0:
                    column = columns[feature[node]]
                    right = column > key[node]
                    if missing_left[node]:
                        right &= column != MISSING
                    own = leaf == node - root
                    right &= own
                    leaf += own.view(np.uint8) * kind(child[node] - node)
                    leaf += right.view(np.uint8)
            out += self.value[root:end].take(leaf)
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        step = 4096 if len(x) < 4096 else PART
        for i in range(0, len(x), step):
            keys = order_key(x[i:i + step])
            out[i:i + step] = (self._few if len(keys) < 500 else self._many)(keys)
        return out


def forests(models: DataFrame, keys: list[str]) -> dict[tuple, Forest]:
    """Fitted models for use in tasks; there are few, and each has a bounded number of nodes."""
    return {tuple(r[k] for k in keys): Forest(r) for r in models.collect()}


def gathered(batches, rows: int = PACK_ROWS):
    """Batches of a task put together until they hold that many rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def predict(rows: DataFrame, keys: list[str], fitted: dict[tuple, Forest], x: str = "x", out: str = "raw") -> DataFrame:
    """Adds ``out``: the score by the model of the row's keys, NULL where there is none. Rows of a model meet first, as it scores many together."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", {out} double"

    def run(batches):
        for table in gathered(batches):
            features = table.column(x)  # of one length in a model only
            where = table.select(keys).to_pandas().groupby(keys if len(keys) > 1 else keys[0], sort=False).indices
            score = np.full(len(table), np.nan)
            for k, own in where.items():
                if model := fitted.get(tuple(k) if len(keys) > 1 else (k,)):
                    score[own] = model(_lists(features.take(pa.array(own))))
            yield from table.append_column(out, pa.array(score, from_pandas=True)).to_batches(10_000)

    return (rows.repartition(*keys) if len(fitted) > 1 else rows).mapInArrow(run, schema)
