"""Source mixing: targets by brute force, optimality of the rates, copies near their targets, odd tables."""
import math
import random

import pytest

from tests.llm.conftest import LONG, SF
from tidepanel.llm import mixing as x


def targets(sizes, weights=(1, 2, 3), most=3):
    """Water-filling over (source -> size) by raising one level in small exact steps of the sorted limits."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    held, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in held]
        rest = total - sum(most * sizes[s] for s in held)
        level = rest / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * level >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in held else w[s] * level for s in order}
        held |= over


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randrange(1, 200)), f"s{i % 7}" if i % 11 else None, 1, "h") for i in range(700)]
    rows += [(1000 + i, "one two", "tiny", 2, "k") for i in range(3)] + [(5000, "five words in this row", "hot", 3, "x")] * 900
    rows += [(7000, None, "empty", 1, "a"), (7001, "", "empty", 1, "a"), (None, " \t\n", "s1", 1, "a"), (None, "null key", "s1", 1, "b"), (8000, LONG, "s2", 1, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, k string").repartition(7)


def test_targets_rates_and_copies(docs):
    rows = x.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, biggest = {}, {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    want = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-12)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(6, 0.002 * want[s]), s
    tilt = {}  # the logit of a rate is one multiple of the size in each source: the condition of the optimum
    for r in rows:
        if r["size"] and r["target"] < 3 * r["source_size"] and 1e-9 < r["rate"] < 3 - 1e-9:
            tilt.setdefault(r["source"], []).append(math.log(2 * r["rate"] / (3 - r["rate"])) / r["size"])
    assert all(max(t) - min(t) <= 1e-6 * max(abs(v) for v in t) + 1e-12 for t in tilt.values())
    met = {s: sum(r["rate"] * r["size"] for r in rows if r["source"] == s) for s in sizes}
    assert all(math.isclose(met[s], want[s], rel_tol=1e-6, abs_tol=0.01) for s in sizes)
    assert {r["taken"] for r in rows if r["source"] == "tiny"} == {6}


def test_reruns_agree_however_rows_are_dealt(docs):
    key = lambda d: sorted(map(str, x.mix(d).select("doc_id", "source", "size", "target", "copies").collect()))
    assert key(docs) == key(docs.repartition(2, "text"))


def test_empty_tables(docs):
    assert x.mix(docs.limit(0)).count() == 0
    assert {r["taken"] for r in x.mix(docs.where("source = 'empty'")).collect()} == {0}
    one = x.mix(docs.where("source = 'hot'"), weights=(5,)).collect()
    assert len(one) == 900 and {r["copies"] for r in one} == {1}


def test_query(spark):
    rows = x.op12_source_mixing(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert math.isclose(sum({r["source_size"]: r["target"] for r in rows}.values()), sum(r["size"] for r in rows), rel_tol=0.2)
