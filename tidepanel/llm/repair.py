r"""Repair of damaged conversations as a lightest derivation.

Rows of a conversation are edited until the initials of their roles read ``(s?(ua)+)?``. An item ``(i, q)`` says that i rows are consumed and the
edited ones end in state q (nothing, ``s``, ``u`` or ``a``). A deduction keeps, reroles or deletes the next row, or inserts one; its weight is a
pair (cost, letters) that is added to the item's and appended to its audit. Knuth's agenda pops items by (cost, rows consumed, audit) and an
item popped once is final, until the goal is. The functions are superior and monotone in that order: a row raises the second part,
an insertion the first; and two audits of one item and cost never begin one another, as both consume i rows and an I costs, so what
is appended doesn't change which is less.

Rows are dealt to tasks by ranges of (conversation, turn, role, text) and sorted, so no conversation has to fit one task. A task derives those of
at most ``SPAN`` rows that begin and end inside its range. Of all others, stretches of at most ``SPAN`` rows are derived between every two
states, and the lightest chain of stretches is found for each conversation; letters are all that meets there. The hash of such a
conversation is taken from its rows as they stream past in order, as SHA-256 cannot be split.
"""
from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.llm.common import store, table
from tidepanel.llm.text import column

SPACES = " \t\n\x0b\x0c\r"
#: Rows that a task derives together, and bytes of text that it keeps of a conversation until it ends.
SPAN, SPAN_BYTES = 256, 1 << 22
DELETE, RETYPE, INSERT, UNFINISHED = 2, 1, 5, 5
#: What may follow each state; "" is before the first row. A conversation may end in "" or "a".
FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}
STATES, ENDS = ("", "s", "u", "a"), ("", "a")
ROLE = {"u": "user", "a": "assistant"}
FINE, TRUNCATED, FORCED = 0, 1, 2


# -- derivations ----------------------------------------------------------------------------------------------------------------

def deductions(step: tuple, q: str) -> Iterator[tuple[str, int, str]]:
    """(next state, cost, letters) of all ways to consume ``step`` = (initial, fault, copies); copies beyond the first are deleted."""
    initial, fault, copies = step
    rest, price = "D" * (copies - 1), DELETE * (copies - 1)
    yield q, price + DELETE, "D" + rest
    if fault != FORCED:
        more = price + (UNFINISHED if fault == TRUNCATED else 0)
        if initial == FOLLOWS[q] or (initial == "s" and not q):
            yield initial, more, "K" + rest
        yield FOLLOWS[q], more + RETYPE, "R" + rest


def lightest(steps: list[tuple], start: str = "", ends: tuple = ENDS, last: bool = True) -> dict[str, tuple[int, str]]:
    """end state -> (cost, audit) of the lightest derivation that consumes ``steps``.

    With ``last`` only the lightest of all ends is sought, and rows may be inserted after the last one too.
    """
    n, done, found = len(steps), set(), {}
    agenda = [(0, 0, "", start)]
    while agenda:
        cost, i, audit, q = heapq.heappop(agenda)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n:
            if q in ends:
                found[q] = cost, audit
                if last or len(found) == len(ends):
                    break
            if not last:
                continue
        else:
            for after, price, letters in deductions(steps[i], q):
                if (i + 1, after) not in done:
                    heapq.heappush(agenda, (cost + price, i + 1, audit + letters, after))
        after = FOLLOWS[q]
        if (i, after) not in done:
            heapq.heappush(agenda, (cost + INSERT, i, audit + "I", after))
    return found


def edited(audit: str, rows: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired rows; ``rows`` are (role, text, copies)."""
    q, at = "", 0
    for role, text, copies in rows:
        left = copies
        while left:
            letter, at = audit[at], at + 1
            left -= letter != "I"
            if letter != "D":
                q = role[:1] if letter == "K" else FOLLOWS[q]
                yield letter, role if letter == "K" else ROLE[q], "" if letter == "I" else text
    for letter in audit[at:]:
        q = FOLLOWS[q]
        yield letter, ROLE[q], ""


class Digest:
    def __init__(self):
        self.hash, self.first = hashlib.sha256(), True

    def add(self, edit: str, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False


# -- counts of a stretch --------------------------------------------------------------------------------------------------------

LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def counted(rows: list[tuple]) -> dict:
    """Counts over (turn, initial, fault, blank, copies) in order; ``first`` and ``last`` initial and turns let stretches be joined."""
    blank = sum(r[4] for r in rows if r[3])
    forced = sum(r[4] for r in rows if r[2] == FORCED) - blank
    turns = sorted({r[0] for r in rows if r[0] is not None})
    initials = [r[1] for r in rows]
    return {"blank": blank, "duplicate": forced + sum(r[4] - 1 for r in rows if r[2] != FORCED), "truncated": sum(r[2] == TRUNCATED for r in rows),
            "illegal": sum(r[4] - 1 for r in rows) + sum(p not in LEGAL for p in zip(initials, initials[1:])),
            "least": turns[0] if turns else None, "most": turns[-1] if turns else None, "turns": len(turns)}


def _gaps(c: dict) -> int:
    return c["most"] - c["least"] + 1 - c["turns"] if c["turns"] else 0


COUNTS = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _faults(text: str) -> tuple[bool, bool]:
    """(blank, truncated)"""
    bare = text.rstrip(SPACES)
    return not bare, bool(bare) and bare[-1] not in ".!?"


def _whole(rows: list[tuple]) -> tuple:
    """Result of a conversation from its (turn, role, text, copies) in order."""
    seen, marked = set(), []
    for turn, role, text, copies in rows:
        blank, cut = _faults(text)
        fault = FORCED if blank or (role, text) in seen else TRUNCATED if cut else FINE
        seen.add((role, text))
        marked.append((turn, role[:1], fault, blank, copies))
    c = counted(marked)
    cost, audit = min(lightest([(m[1], m[2], m[4]) for m in marked]).values())
    digest = Digest()
    for line in edited(audit, ((r[1], r[2], r[3]) for r in rows)):
        digest.add(*line)
    return _gaps(c), c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost, audit, digest.hash.hexdigest()


# -- the operator ---------------------------------------------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): what crc32("conv_id:turn") mod 20 does to each row; dropped rows have 0 copies and no values.

    0 drops the row, 1 empties its text, 2 takes out ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it the user's. Nulls are read as one space.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), (
        F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).alias("kind"))
    kept: Column = F.col("kind") != 0
    return rows.select(
        "conv_id", F.when(kept, F.col("turn")).alias("turn"), F.when(F.col("kind") == 4, "user").when(kept, F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).when(kept, F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).when(kept, 1).otherwise(0).alias("copies"))


def _stream(batches, names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column(batch, name).to_pylist() for name in names])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _ranges(ordered: DataFrame) -> DataFrame:
    """Results of the conversations inside a range, ``open`` false; and the rows of all others, with the place of each."""
    ids = {f.name: f.dataType.simpleString() for f in ordered.schema}
    shape = (f"open boolean, conv_id {ids['conv_id']}, gaps long, {COUNTS}, "
             f"at long, turn {ids['turn']}, role string, text string, copies long")

    def run(batches):
        part, place, held, bytes_held, current, opened, ready = TaskContext.get().partitionId() << 36, 0, [], 0, None, True, []
        schema = None

        def out(force):
            nonlocal ready
            if ready and (force or len(ready) >= 2000):
                batch, ready = _table(ready, schema), []
                return batch

        def as_open(row, at):
            return (True, current[0], *[None] * 8, at, *row)

        def close():
            nonlocal held, bytes_held
            if opened:
                ready.extend(as_open(row, at) for at, row in held)
            else:
                ready.append((False, current[0], *_whole([row for _, row in held if row[3]]), *[None] * 5))
            held, bytes_held = [], 0

        for batch in batches:
            schema = schema or pa.schema([
                ("open", pa.bool_()), ("conv_id", column(batch, "conv_id").type), ("gaps", pa.int64()), *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")],
                ("audit", pa.string()), ("repaired_sha256", pa.string()), ("at", pa.int64()), ("turn", column(batch, "turn").type), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())])
            for conv, *row in _stream([batch], ["conv_id", "turn", "role", "text", "copies"]):
                if current != (conv,):
                    if current is not None:
                        close()
                        opened = False  # only the first of a range can have begun before it
                    current = (conv,)
                held.append((part + place, tuple(row)))
                place, bytes_held = place + 1, bytes_held + len(row[2] or "")
                if opened or len(held) > SPAN or bytes_held > SPAN_BYTES:  # a long one leaves row by row
                    opened = True
                    close()
                if batch_out := out(False):
                    yield batch_out
        if current is not None:
            opened = True  # the last of a range may go on behind it
            close()
        if batch_out := out(True):
            yield batch_out

    return ordered.mapInArrow(run, shape)


def _stretches(rows: DataFrame, kinds: dict) -> DataFrame:
    """Costs and audits of each stretch of at most SPAN rows between every two states, with its counts."""
    def derive(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        rows = [(None if pd.isna(t) else int(t), i, int(f), bool(b), int(c)) for t, i, f, b, c in zip(
            pdf["turn"], pdf["initial"], pdf["fault"], pdf["blank"], pdf["copies"])]
        steps, c = [(r[1], r[2], r[4]) for r in rows], counted(rows)
        chart = [(a, z, *w) for a in STATES for z, w in lightest(steps, a, STATES, last=False).items()]
        one = pdf.iloc[:1]
        return pd.DataFrame({"conv_id": one["conv_id"], "at": one["at"], "first": [rows[0][1]], "final": [rows[-1][1]], "first_turn": pd.array([rows[0][0]], "Int64"), "last_turn": pd.array([rows[-1][0]], "Int64"),
                             **{k: pd.array([c[k]], "Int64") for k in ("blank", "duplicate", "truncated", "illegal", "least", "most", "turns")},
                             "chart": [[{"a": a, "z": z, "cost": k, "audit": s} for a, z, k, s in chart]]})

    shape = (f"conv_id {kinds['conv_id']}, at long, first string, final string, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, "
             "least long, most long, turns long, chart array<struct<a:string,z:string,cost:long,audit:string>>")
    # places of a range begin at multiples of 2^36, so a stretch never crosses ranges
    return rows.withColumn("_stretch", F.expr(f"at div {SPAN}")).groupBy("conv_id", "_stretch").applyInPandas(derive, shape)


def _chain(stretches: DataFrame, kinds: dict) -> DataFrame:
    """The lightest chain of stretches of each conversation: letters and counts only."""
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        best, c = {"": (0, "")}, dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        before = turn = None
        for row in pdf.itertuples(index=False):
            ways: dict[str, tuple[int, str]] = {}
            for way in row.chart:
                if way["a"] in best:
                    cost, audit = best[way["a"]]
                    new = cost + way["cost"], audit + way["audit"]
                    ways[way["z"]] = min(ways.get(way["z"], new), new)
            best = ways
            for k in c:
                c[k] += int(getattr(row, k))
            c["illegal"] += before is not None and (before, row.first) not in LEGAL
            c["turns"] -= turn is not None and not pd.isna(row.first_turn) and turn == int(row.first_turn)
            before, turn = row.final, None if pd.isna(row.last_turn) else int(row.last_turn)
        c["least"], c["most"] = (int(pdf["least"].min()), int(pdf["most"].max())) if c["turns"] else (None, None)
        ends = [(best[z][0] + price, best[z][1] + letters) for z, price, letters in (("", 0, ""), ("a", 0, ""), ("u", INSERT, "I"), ("s", 2 * INSERT, "II")) if z in best]
        cost, audit = min(ends)
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[:1], "gaps": [_gaps(c)], **{k: [c[k]] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": [cost], "audit": [audit]})

    return stretches.groupBy("conv_id").applyInPandas(join, f"conv_id {kinds['conv_id']}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _edited_rows(rows: DataFrame, audits: DataFrame, kinds: dict, shape: str, take) -> DataFrame:
    """``take(conv_id, edited rows)`` makes batches of a conversation's rows, which stream past in order behind its audit."""
    none = F.lit(None).cast("string")
    led = rows.select("conv_id", F.lit(1).alias("led"), "turn", "role", "text", "copies", none.alias("audit")).union(
        audits.select("conv_id", F.lit(0), F.lit(None).cast(kinds["turn"]), none, none, F.lit(0).cast("long"), "audit"))

    def run(batches):
        kind, held = None, None

        def typed():
            nonlocal kind
            for batch in batches:
                kind = column(batch, "conv_id").type
                yield batch

        def own():  # the rows up to the next audit
            nonlocal held
            for held in stream:
                if not held[1]:
                    return
                yield held[2:5]
            held = None

        stream = _stream(typed(), ["conv_id", "led", "role", "text", "copies", "audit"])
        held = next(stream, None)
        while held is not None:
            conv, audit = held[0], held[5]
            for columns in take(edited(audit, own())):
                yield pa.record_batch([pa.array([conv] * len(columns[0]), kind), *columns], names)

    names = ["conv_id", *[part.split(" ")[0] for part in shape.split(", ")]]
    by_conv = led.repartition("conv_id").sortWithinPartitions("conv_id", "led", "turn", "role", "text")
    return by_conv.mapInArrow(run, f"conv_id {kinds['conv_id']}, {shape}")


def _hashes(rows: DataFrame, audits: DataFrame, kinds: dict) -> DataFrame:
    def take(lines):
        digest = Digest()
        for line in lines:
            digest.add(*line)
        yield [pa.array([digest.hash.hexdigest()])]

    return _edited_rows(rows, audits, kinds, "repaired_sha256 string", take)


def repaired_rows(damaged: DataFrame, repaired: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows that the audits of ``repaired`` leave, numbered from 0 in each conversation."""
    def take(lines):
        place, lines = 0, iter(lines)
        while part := list(itertools.islice(lines, 1000)):
            edits, roles, texts = zip(*part)
            yield [pa.array(range(place, place + len(part)), pa.int64()), *[pa.array(c, pa.string()) for c in (edits, roles, texts)]]
            place += len(part)

    kinds = {f.name: f.dataType.simpleString() for f in damaged.schema}
    rows = damaged.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    return _edited_rows(rows, repaired, kinds, "place long, edit string, role string, text string", take)


def repair(damaged: DataFrame) -> DataFrame:
    """A row for each conversation of ``damaged`` (conv_id, turn, role, text, copies; as ``damage`` returns it).

    Order is by turn, nulls first; rows of one turn by role and text. Equal rows are one row with copies. A conversation with no copies at all has
    zeros, an empty audit and the hash of nothing. An empty role has no legal initial. conv_id may be null. Texts and conversations may be of any length; no rows give none.
    """
    kinds = {f.name: f.dataType.simpleString() for f in damaged.schema}
    rows = damaged.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    ordered = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    found = store(_ranges(ordered), "conversations")
    done = found.where("not open").select("conv_id", "gaps", *[c.split(" ")[0] for c in COUNTS.split(", ")])
    every = found.where("open").select("conv_id", "at", "turn", "role", "text", "copies")
    left = every.where("copies > 0")
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    first = left.groupBy("conv_id", "role", "text").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    marked = left.join(first, "at", "left").select(
        "conv_id", "at", "turn", F.substring("role", 1, 1).alias("initial"), "copies", (bare == "").alias("blank"),
        F.when((bare == "") | F.col("new").isNull(), FORCED).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE).alias("fault"))
    chains = store(_chain(_stretches(marked, kinds), kinds), "chains")
    hashes = _hashes(left, chains, kinds)
    long = chains.join(hashes, chains["conv_id"].eqNullSafe(hashes["conv_id"])).select(chains["*"], "repaired_sha256")
    zero = F.lit(0).cast("long")
    gone = every.groupBy("conv_id").agg(F.max("copies").alias("copies")).where("copies = 0").select(
        "conv_id", *[zero.alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.lit("").alias("audit"), F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256"))
    return done.union(long.select(done.columns)).union(gone)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))
