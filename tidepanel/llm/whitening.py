"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter matrix.

1. Entries become integers, ``x = floor(64 c) + 1000000``. Tasks sum products of 21-bit digits by matrix products of at most 2048 rows, which
   double arithmetic holds exactly, and emit the sums in 32-bit digits; so ``n² V = n Σ x xᵀ - S Sᵀ`` is known as whole numbers.
2. Its characteristic polynomial is found modulo 31-bit primes, dealt to tasks: Hessenberg form by row operations, then the recurrence of its
   leading minors. As all eigenvalues are at least 0, no coefficient exceeds ``C(d, j) (trace / d)^j``; so many primes are used that Chinese
   remainders give it exactly.
3. A task for each component finds its root. All roots are real, so Descartes' rule is exact: the sign changes of the polynomial moved
   to a count the roots beyond a. Halving on that count isolates the root, halving on the sign sharpens it. Roots that agree in 400 bits
   count as one multiple root.
4. The same task solves ``(n² V - root) v = b`` twice in decimal arithmetic of as many digits; members of a multiple root take one of
   its orthonormal vectors each.

What the driver holds depends on the number of dimensions d only: d² whole numbers, (d + 1) × primes residues, 32 vectors.
"""
from __future__ import annotations

import math
from decimal import Context, Decimal, getcontext, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.llm.common import table
from tidepanel.llm.text import column

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: |floor(64 c)| is held to this bound, which only entries beyond 3e16 meet.
LARGEST = 1 << 61
_DIGIT, _BLOCK, _FOLD = 21, 2048, 1 << 20
#: Bits to which roots must agree to count as one, and bits that a root gains beyond those that isolate it.
SAME_BITS, MORE_BITS = 400, 130


# -- exact sums -----------------------------------------------------------------------------------------------------------------

def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    """floor(64 c) of each vector as int64; shorter vectors are continued with zeros."""
    lists = lists.cast(pa.large_list(pa.float64()))
    lengths = np.asarray(lists.value_lengths(), np.int64)
    values = np.floor(np.clip(SCALE * np.asarray(lists.flatten(), np.float64), -float(LARGEST), float(LARGEST))).astype(np.int64)
    out = np.zeros((len(lengths), d), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _products(y: np.ndarray) -> np.ndarray:
    """Σ y yᵀ as exact integers."""
    total = np.zeros((y.shape[1],) * 2, object)
    levels = max(1, -(-(int(np.abs(y).max(initial=0)).bit_length() + 1) // _DIGIT))
    digits = [(y >> (_DIGIT * a) if a == levels - 1 else (y >> (_DIGIT * a)) & ((1 << _DIGIT) - 1)).astype(np.float64) for a in range(levels)]
    for a in range(levels):
        for b in range(levels):
            part = np.zeros(total.shape, np.int64)
            for i in range(0, len(y), _BLOCK):
                part += (digits[a][i:i + _BLOCK].T @ digits[b][i:i + _BLOCK]).astype(np.int64)
            total += part.astype(object) << (_DIGIT * (a + b))
    return total


def _sums(good: DataFrame, vector: str, d: int) -> tuple[list[int], list[list[int]]]:
    """(Σ y, Σ y yᵀ) over all rows, y = floor(64 c)."""
    upper = [(i, j) for i in range(d) for j in range(i, d)]

    def add(batches):
        total = np.zeros(len(upper) + d, object)
        rows, cols = np.array([u[0] for u in upper]), np.array([u[1] for u in upper])
        for batch in batches:
            lists = column(batch, vector)
            for i in range(0, len(lists), _FOLD):
                y = _matrix(lists.slice(i, _FOLD), d)
                total[:len(upper)] += _products(y)[rows, cols]
                total[len(upper):] += (y if np.abs(y).max(initial=0) < 1 << 40 else y.astype(object)).sum(axis=0).astype(object)
        cell, digit, value = [], [], []
        for c, v in enumerate(total.tolist()):
            k = 0
            while v:
                low = v if -(1 << 32) < v < 1 << 32 else v & 0xFFFFFFFF
                cell.append(c), digit.append(k), value.append(low)
                v, k = (v - low) >> 32, k + 1
        yield pa.record_batch([pa.array(cell, pa.int32()), pa.array(digit, pa.int32()), pa.array(value, pa.int64())], ["cell", "digit", "value"])

    cells = [0] * (len(upper) + d)
    for r in good.select(vector).mapInArrow(add, "cell int, digit int, value long").groupBy("cell", "digit").agg(F.sum("value").alias("value")).collect():
        cells[r["cell"]] += r["value"] << (32 * r["digit"])  # at most a few numbers for each pair of dimensions
    products = [[0] * d for _ in range(d)]
    for (i, j), v in zip(upper, cells):
        products[i][j] = products[j][i] = v
    return cells[len(upper):], products


# -- the polynomial -------------------------------------------------------------------------------------------------------------

def _is_prime(n: int) -> bool:
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):  # these four decide all n below 3,215,031,751
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Primes from 2^31 downwards with a product above ``bound``."""
    out, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def residues(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients of the characteristic polynomial, lowest first, modulo each prime: an array primes × (d + 1)."""
    d, count = len(matrix), len(primes)
    p = np.array(primes, np.int64)
    whole = np.array(matrix, object).reshape(d, d)
    h = np.stack([(whole % q).astype(np.int64) for q in primes])
    p2, p3, each = p[:, None], p[:, None, None], np.arange(count)
    for c in range(d - 2):
        below = h[:, c + 1:, c] != 0
        pivot = np.where(below.any(axis=1), below.argmax(axis=1), 0) + c + 1
        h[each, c + 1], h[each, pivot] = h[each, pivot].copy(), h[each, c + 1].copy()
        h[each, :, c + 1], h[each, :, pivot] = h[each, :, pivot].copy(), h[each, :, c + 1].copy()
        inverse = np.array([pow(int(v), -1, int(q)) if v else 0 for v, q in zip(h[:, c + 1, c], p)], np.int64)
        u = h[:, c + 2:, c] * inverse[:, None] % p2
        h[:, c + 2:] = (h[:, c + 2:] - u[:, :, None] * h[:, c + 1:c + 2] % p3) % p3
        h[:, :, c + 1] = (h[:, :, c + 1] + (h[:, :, c + 2:] * u[:, None, :] % p3).sum(axis=2)) % p2
    minors = np.zeros((d + 1, count, d + 1), np.int64)
    minors[0, :, 0] = 1
    for k in range(1, d + 1):
        new = np.roll(minors[k - 1], 1, axis=1) - h[:, k - 1, k - 1, None] * minors[k - 1] % p2
        below = np.ones(count, np.int64)
        for i in range(k - 1, 0, -1):
            below = below * h[:, i, i - 1] % p
            new -= (below * h[:, i - 1, k - 1] % p)[:, None] * minors[i - 1] % p2
        minors[k] = new % p2
    return minors[d]


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix), lowest first, of a symmetric whole matrix without negative eigenvalues."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max(math.comb(d, j) * (trace // d + 1) ** j for j in range(d + 1))
    primes = primes_for(2 * bound)

    def reduce(batches):
        for batch in batches:
            mine = [primes[i] for i in batch.column(0).to_pylist()]
            if mine:
                yield pa.record_batch([pa.array(mine, pa.int64()), pa.array(residues(matrix, mine).tolist(), pa.list_(pa.int64()))], ["prime", "found"])

    tasks = max(1, min(len(primes), 2 * spark.sparkContext.defaultParallelism))
    found = spark.range(0, len(primes), 1, tasks).mapInArrow(reduce, "prime long, found array<long>").collect()
    product, total = math.prod(primes), [0] * (d + 1)
    for r in found:
        others = product // r["prime"]
        unit = others * pow(others, -1, r["prime"])
        total = [(t + v * unit) % product for t, v in zip(total, r["found"])]
    return [t - product if 2 * t > product else t for t in total]


# -- roots and vectors ----------------------------------------------------------------------------------------------------------

def _beyond(poly: list[int], a: int, bits: int) -> int:
    """How many roots exceed a / 2^bits, with their multiplicity."""
    d = len(poly) - 1
    q = [c << (bits * (d - j)) for j, c in enumerate(poly)]
    for start in range(d):
        for j in range(d - 1, start - 1, -1):
            q[j] += a * q[j + 1]
    signs = [c > 0 for c in q if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _positive(poly: list[int], a: int, bits: int) -> int:
    value, scale = 0, 0
    for c in reversed(poly):
        value = value * a + (c << scale)
        scale += bits
    return (value > 0) - (value < 0)


def find_root(poly: list[int], r: int) -> tuple[int, int, int, int, int]:
    """(a, bits, first, last, exact): the r-th largest root is a / 2^bits within 2^-exact of itself; roots first…last count as one."""
    hi = max(2, 1 - poly[-2])  # above the trace
    lo, bits, above_lo, above_hi = 0, 0, _beyond(poly, 0, 0), 0
    while above_lo - above_hi > 1 and (hi - lo) << SAME_BITS > hi:
        if hi - lo == 1:
            lo, hi, bits = 2 * lo, 2 * hi, bits + 1
        mid = (lo + hi) // 2
        n = _beyond(poly, mid, bits)
        lo, hi, above_lo, above_hi = (mid, hi, n, above_hi) if n >= r else (lo, mid, above_lo, n)
    if above_lo - above_hi > 1:
        return lo + hi, bits + 1, above_hi + 1, above_lo, SAME_BITS
    exact = MORE_BITS + max(64, (hi // (hi - lo)).bit_length())
    upper = _positive(poly, hi, bits) or _positive(poly, (hi << 64) + 1, bits + 64)
    while (hi - lo) << exact > lo + hi:
        if hi - lo == 1:
            lo, hi, bits = 2 * lo, 2 * hi, bits + 1
        mid = (lo + hi) // 2
        at = _positive(poly, mid, bits)
        if not at:
            return mid, bits, r, r, exact
        lo, hi = (lo, mid) if at == upper else (mid, hi)
    return lo + hi, bits + 1, r, r, exact


def _null_vectors(matrix: list[list[int]], root: Decimal, count: int) -> list[list[Decimal]]:
    """``count`` orthonormal vectors that matrix - root sends nearly to nothing, by inverse iteration with row exchanges."""
    d = len(matrix)
    rows = [[Decimal(v) for v in line] for line in matrix]
    for i in range(d):
        rows[i][i] -= root
    tiny = Decimal(10) ** (max(abs(v) for line in rows for v in line).adjusted() - getcontext().prec)
    swaps, factors = [], []
    for c in range(d):
        best = max(range(c, d), key=lambda i: abs(rows[i][c]))
        rows[c], rows[best] = rows[best], rows[c]
        swaps.append((c, best))
        if not rows[c][c]:
            rows[c][c] = tiny
        line, steps = rows[c], []
        for i in range(c + 1, d):
            if rows[i][c]:
                f = rows[i][c] / line[c]
                rows[i] = [*rows[i][:c + 1], *[v - f * w for v, w in zip(rows[i][c + 1:], line[c + 1:])]]
                steps.append((i, f))
        factors.append(steps)

    def solve(b):
        b = list(b)
        for (c, best), steps in zip(swaps, factors):
            b[c], b[best] = b[best], b[c]
            for i, f in steps:
                b[i] -= f * b[c]
        for i in range(d - 1, -1, -1):
            b[i] = (b[i] - sum(v * w for v, w in zip(rows[i][i + 1:], b[i + 1:]))) / rows[i][i]
        return b

    block = [[Decimal((j + 1) * 7919 * (i + 3) * (i + 11) % 10007 + 1) for i in range(d)] for j in range(count)]
    for _ in range(2):
        done: list[list[Decimal]] = []
        for v in map(solve, block):
            for _ in range(2):
                size = sum(x * x for x in v).sqrt()
                v = [x / size for x in v]
                for w in done:
                    share = sum(x * y for x, y in zip(v, w))
                    v = [x - share * y for x, y in zip(v, w)]
            size = sum(x * x for x in v).sqrt()
            done.append([x / size for x in v])
        block = done
    return block


def component(matrix: list[list[int]], poly: list[int], n: int, r: int) -> tuple[float, float, list[float], list[float]]:
    """(eigenvalue of V, its share of the trace, unit vector, vector over the root of the eigenvalue) of the r-th component."""
    a, bits, first, last, exact = find_root(poly, r)
    size = max(abs(v) for line in matrix for v in line).bit_length()
    with localcontext(Context(prec=60 + (size + 2 * exact) // 3, Emax=10**9, Emin=-10**9)):
        root = Decimal(a) / (1 << bits)
        v = _null_vectors(matrix, root, last - first + 1)[r - first]
        big = max(v, key=abs)
        v = [x.copy_sign(x * big) for x in v]
        e = root / (n * n)
        return float(e), float(root / -poly[-2]), [float(x) for x in v], [float(x / e.sqrt()) for x in v]


# -- the operator ---------------------------------------------------------------------------------------------------------------

def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null, NaN or infinite entry are dropped; all others are fitted and returned, equal ones each. A shorter
    vector counts as continued with zeros. ``deviation`` is Σ (n x - S)², null where it exceeds a long. Components with eigenvalue 0 do not
    exist, as nothing can be divided by their deviation: there are ``min(most, rank)``, and none if all vectors are equal or there are no rows.
    The key may be null; other columns are ignored.
    """
    spark = df.sparkSession
    good = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).where(
        F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    n, d = good.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    kind = df.schema[key].dataType
    shape = f"`{key}` {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n or not d:
        return spark.createDataFrame([], shape)
    sums, products = _sums(good, "vector", d)
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    if not any(scatter[i][i] for i in range(d)):
        return spark.createDataFrame([], shape)
    poly = polynomial(spark, scatter)
    rank = d - next(j for j, c in enumerate(poly) if c)
    wanted = min(most, rank)

    def solve(batches):
        for batch in batches:
            for r in batch.column(0).to_pylist():
                e, share, _, w = component(scatter, poly, n, r)
                yield pa.record_batch([pa.array([r], pa.int32()), pa.array([e]), pa.array([share]), pa.array([w], pa.list_(pa.float64()))], ["r", "e", "share", "w"])

    solved = sorted(spark.range(1, wanted + 1, 1, wanted).mapInArrow(solve, "r int, e double, share double, w array<double>").collect())  # of d numbers each
    weights = np.array([s["w"] for s in solved]).T
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    centred = lambda y: (y - whole).astype(np.float64) - rest

    def second_moments(batches):
        total = np.zeros((wanted, wanted))
        for batch in batches:
            for i in range(0, batch.num_rows, _BLOCK):
                z = centred(_matrix(column(batch, "vector").slice(i, _BLOCK), d)) @ weights
                total += z.T @ z
        i, j = np.triu_indices(wanted)
        yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "value"])

    moments = good.mapInArrow(second_moments, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    error = moments.agg(F.max(F.abs(F.col("value") / n - (F.col("i") == F.col("j")).cast("double")))).first()[0]

    def score(batches):
        exact = np.array(sums, object)
        for batch in batches:
            for i in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(i, _BLOCK)
                y = _matrix(column(part, "vector"), d)
                reach = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums))
                if d * reach * reach < 1 << 62:
                    deviation = pa.array(((n * y - np.array(sums, np.int64)) ** 2).sum(axis=1))
                else:
                    values = ((n * y.astype(object) - exact) ** 2).sum(axis=1)
                    deviation = pa.array([v if v < 1 << 63 else None for v in values.tolist()], pa.int64())
                z = centred(y) @ weights
                yield pa.record_batch([column(part, "key"), deviation, pa.array(list(z), pa.list_(pa.float64()))], ["key", "deviation", "z"])

    scored = good.mapInArrow(score, f"key {kind.simpleString()}, deviation long, z array<double>")
    shares = F.array(*[F.lit(s["share"]) for s in solved])
    rows = scored.select("key", "deviation", F.posexplode("z").alias("at", "whitened"))
    return rows.select(F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
