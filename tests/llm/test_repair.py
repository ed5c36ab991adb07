"""Conversation repair against enumeration of all edits, in ranges and in stretches."""
import hashlib
import itertools
import random
import re
import zlib

import pytest

from tests.llm.conftest import SF
from tidepanel.llm import repair as r

GOAL = re.compile("(s?(ua)+)?")
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def all_edits(rows):
    """(cost, audit, role:text lines) of the cheapest edits of (role, text) rows, by trying all with at most two insertions in a place."""
    seen, choices = set(), []
    for role, text in rows:
        bare = text.strip(r.SPACES)
        forced, late = not bare or (role, text) in seen, 0 if not bare or bare[-1] in ".!?" else 5
        seen.add((role, text))
        choices.append([(2, "D", [])] + ([] if forced else [(late, "K", [(role, text)])] + [(1 + late, "R", [(x, text)]) for x in ("user", "assistant")]))
    put = [(5 * k, "I" * k, [(x, "") for x in names]) for k in range(3) for names in itertools.product(("user", "assistant"), repeat=k)]
    ways = put
    for options in choices:  # only the cheapest of ways that leave the same text so far can matter
        after = {}
        for (c, a, t), (c2, a2, t2), (c3, a3, t3) in itertools.product(ways, options, put):
            new = c + c2 + c3, a + a2 + a3, t + t2 + t3
            initials = "".join(x[:1] or "?" for x, _ in new[2])
            if re.fullmatch("s?(ua)*u?", initials):
                key = tuple(new[2])
                after[key] = min(after.get(key, new), new)
        ways = list(after.values())
    return min((c, a, [f"{x}:{y}" for x, y in t]) for c, a, t in ways if GOAL.fullmatch("".join(x[:1] or "?" for x, _ in t)))


def plain(rows):
    """Result of one conversation from its damaged (turn, role, text, copies)."""
    rows = [(t, x, y) for t, x, y, k in sorted(rows, key=lambda z: (z[0] is not None, z[0] or 0, z[1] or "", z[2] or "")) for _ in range(k)]
    kinds, seen = [], set()
    for _, x, y in rows:
        bare = y.strip(r.SPACES)
        kinds.append("blank" if not bare else "duplicate" if (x, y) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((x, y))
    turns = {t for t, _, _ in rows if t is not None}
    first = [x[:1] for _, x, _ in rows]
    cost, audit, lines = all_edits([(x, y) for _, x, y in rows])
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, conversations, longest, roles=("system", "user", "assistant", "tool", "")):
    x = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "half a", "", " \n", "Well. \t", "é."]
    rows = []
    for c in range(conversations):
        turn = 0
        for _ in range(x.randrange(longest + 1)):
            rows.append((c, None if x.random() < .05 else turn, x.choice(roles), x.choice(texts), x.choice([1, 1, 1, 2, 3])))
            turn += x.choice([0, 1, 1, 1, 2])
        if x.random() < .2:
            rows.append((c, None, None, None, 0))
    return rows


SHAPE = "conv_id long, turn long, role string, text string, copies long"


@pytest.fixture(params=[256, 2])
def span(request, monkeypatch):
    monkeypatch.setattr(r, "SPAN", request.param)
    return request.param


def test_lightest_equals_all_edits(spark, span):
    rows = made(5, 120, 4)
    got = {x["conv_id"]: tuple(x[n] for n in NAMES) for x in r.repair(spark.createDataFrame(rows, SHAPE).repartition(5)).collect()}
    merged = {}
    for c, t, x, y, k in rows:
        merged.setdefault(c, {}).setdefault((t, x, y), 0)
        merged[c][t, x, y] += k
    want = {c: plain([(*key, k) for key, k in m.items()]) for c, m in merged.items()}
    assert got == want


def test_one_conversation_over_many_ranges(spark, monkeypatch):
    """A long conversation and one row repeated often; the chain of stretches equals one derivation of all rows."""
    x = random.Random(2)
    rows = [(7, t, x.choice(["user", "assistant", "system"]), f"text {x.randrange(40)}" + x.choice(".!? "), 1) for t in range(600)]
    rows += [(8, 1, "user", "again.", 1)] * 900 + [(None, 3, "user", "a.", 1), (None, 4, "assistant", "b.", 1)]
    frame = spark.createDataFrame(rows, SHAPE).repartition(6)
    want = {key: r._whole([(t, x, y, k) for c, t, x, y, k in part]) for key, part in (
        (7, rows[:600]), (8, [(8, 1, "user", "again.", 900)]), (None, rows[-2:]))}
    monkeypatch.setattr(r, "SPAN", 32)
    found = r.repair(frame).cache()
    assert {y["conv_id"]: tuple(y[n] for n in NAMES) for y in found.collect()} == want
    lines = {}
    for y in sorted(r.repaired_rows(frame, found).collect(), key=lambda z: z["place"]):
        lines.setdefault(y["conv_id"], []).append(f"{y['role']}:{y['text']}")
    assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}


def test_damage_and_empty_tables(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(6)] + [(1, None, None, None), (None, 2, "user", "x.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(str, ((y["conv_id"], y["turn"], y["role"], y["text"], y["copies"]) for y in r.damage(frame).collect())))
    want = []
    for c, t, x, y in rows:
        kind, x, y = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20, x or " ", y or " "
        want.append(str((c, None, None, None, 0) if not kind else (c, t, "user" if kind == 4 else x, "" if kind == 1 else re.sub("[.!?]", "", y) if kind == 2 else y, 2 if kind == 3 else 1)))
    assert got == sorted(want)
    assert r.repair(r.damage(frame.limit(0))).count() == 0
    alone = r.repair(spark.createDataFrame([(3, None, None, None, 0)], SHAPE)).first()
    assert tuple(alone[n] for n in NAMES) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query_returns_every_conversation(spark):
    out = r.op11_conversation_repair(spark, SF)
    ids = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct()
    assert out.count() == ids.count() == out.join(ids, "conv_id").count()
