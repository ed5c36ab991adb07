"""Structured Streaming operators over an observation stream (id, ts, value).

Raw rows are reduced to one row per id and day before any per-id state is touched, so the state step of
a hot id sees at most one row per day. State is a few numbers per id and survives executor loss through
the checkpoint in the shared folder.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidepanel.operators.detectors import RunPosterior
from tidepanel.schema import DetectorSettings
from tidepanel.session import RECOMMENDED, scratch_path

EPOCH = "2023-12-31"
EPOCH_DAY, DAY_MS = (date.fromisoformat(EPOCH) - date(1970, 1, 1)).days, 86_400_000
#: State of transformWithState needs column families; Spark's default provider has none.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Last day of a state that has seen none.
NEVER = -10**6


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def observations(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "value")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, whatever the session says: a stream copies the settings when it starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, RECOMMENDED[PROVIDER])
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _run(stream: DataFrame, label: str) -> str:
    spark = stream.sparkSession
    out = scratch_path(spark, f"{label}-out")
    writer = stream.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, f"{label}-ckpt")).outputMode("append").trigger(availableNow=True)
    with state_store(spark):
        query = writer.start(out)
    query.awaitTermination()
    return out


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Process what is available, to a table in the shared folder."""
    return stream.sparkSession.read.schema(stream.schema).parquet(_run(stream, label))


def run_to_stream(stream: DataFrame, label: str) -> DataFrame:
    """Settle a stage in a table and stream on from it: per-id state cannot follow an aggregation in one query."""
    return read_events(stream.sparkSession, _run(stream, label), stream.schema)


def stream_aggregate(obs: DataFrame, delay: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Sum and count per id and window, emitted once the watermark passes the window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = obs.withWatermark("ts", delay).groupBy("id", w.alias("w")).agg(F.sum("value").alias("value"), F.count("*").alias("n"))
    return out.select("id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "value", "n")


def stream_sliding(obs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Trailing three days, every day."""
    return stream_aggregate(obs, delay, "3 days", "1 day")


def stream_available(obs: DataFrame, delay: str, folder: str, release: str = "ts") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Route rows by a watermark on their release time: (rows in time, late rows, counts by batch), tables under ``folder``.

    A row is late if its release lies more than ``delay`` behind the latest one of the batches before, or is unknown. Every batch writes the
    latest release seen so far beside its rows and reads that of lower numbers only. So the mark survives a restart, and a batch repeated
    after a failure replaces itself and decides as it did before.
    """
    spark = obs.sparkSession
    at = lambda name, number: f"{folder}/{name}/batch={number}"

    def route(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(at("marks", number - 1)).first()["mark"] if number else None
        late = F.col(release).isNull() | (F.lit(False) if before is None else F.col(release) < F.lit(before) - F.expr(f"interval {delay}"))
        batch.filter(~late).write.mode("overwrite").parquet(at("kept", number))
        batch.filter(late).write.mode("overwrite").parquet(at("late", number))
        batch.agg(F.count(F.when(~late, 1)).alias("kept_rows"), F.count(F.when(late, 1)).alias("late_rows")).write.mode("overwrite").parquet(at("counts", number))
        batch.agg(F.greatest(F.max(release), F.lit(before).cast("timestamp")).alias("mark")).write.mode("overwrite").parquet(at("marks", number))

    query = obs.writeStream.foreachBatch(route).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return tuple(spark.read.parquet(f"{folder}/{name}") for name in ("kept", "late", "counts"))


def daily(obs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(id, ts, d, value): one row per id and closed day, still event-timed."""
    out = obs.withWatermark("ts", delay).groupBy("id", F.window("ts", "1 day").alias("w")).agg(F.round(F.sum("value"), 2).alias("value"))
    day = F.window_time("w")
    return out.select("id", day.alias("ts"), F.datediff(day.cast("date"), F.lit(EPOCH).cast("date")).alias("d"), "value")


class PerId(StatefulProcessor):
    """Carries typed state through the days of an id in order: step(state, d, row) → (state, [output rows]).

    A day can be missing for good only once the watermark has passed its end, so a timer stands at the end of the day after the last one
    seen. When it fires, the run is over: ``ended(state)`` says what is still to be told, and the state goes. A gap between two days that
    arrive together ends the run the same way, so a replay in one batch or in many gives the same rows.
    """

    def __init__(self, step: Callable, ended: Callable, state: StructType, initial: tuple, names: list[str]):
        self.step, self.ended, self.shape, self.initial, self.names = step, ended, state, initial, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.run = handle, handle.getValueState("run", self.shape)

    def _frame(self, key, rows) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        current = tuple(self.run.get()) if self.run.exists() else self.initial
        frames = [pdf for pdf in rows if len(pdf)]
        out = []
        for row in pd.concat(frames).sort_values("d").to_dict("records") if frames else []:
            d = int(row["d"])
            if current[0] != d - 1:  # every state begins with the last day
                out += self.ended(current)
                current = self.initial
            current, produced = self.step(current, d, row)
            out += produced
        self.run.update(current)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(DAY_MS * (EPOCH_DAY + current[0] + 2))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.ended(tuple(self.run.get())) if self.run.exists() else []
        self.run.clear()
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def per_id_state(days: DataFrame, step: Callable, state_schema: str, initial: tuple, out_schema: str, ended: Callable = lambda state: [], delay: str = "1 hour") -> DataFrame:
    """``PerId`` over a stream of (id, d, …), whose event time is the end of the day; output columns begin with the id."""
    names = [f.strip().split(" ")[0] for f in out_schema.split(",")]
    ends = F.timestamp_seconds((F.col("d").cast("long") + EPOCH_DAY + 1) * 86_400 - 1)
    return days.withColumn("day_end", ends).withWatermark("day_end", delay).groupBy("id").transformWithStateInPandas(
        PerId(step, ended, StructType.fromDDL(state_schema), initial, names), StructType.fromDDL(out_schema), "append", "eventtime")


def stream_detect(days: DataFrame, settings: DetectorSettings = DetectorSettings(), threshold: float = 0.5) -> DataFrame:
    """Four scores, the EWMA alarm and its episode start per day; ``days`` carries the signal z."""
    alpha, drift = settings.ewma_alpha, settings.cusum_drift

    def step(state, d, row):
        _, e, p, n, a, b, k, was = state
        x = float(row["z"])
        e = alpha * x + (1 - alpha) * e
        p, n, k = max(0.0, p + x - drift), max(0.0, n - x - drift), k + 1
        rolling = abs((x + a + b) / min(k, 3))
        active = abs(e) > threshold
        return (d, e, p, n, x, a, k, active), [(d, abs(x), rolling, abs(e), max(p, n), active, active and not was)]

    return per_id_state(
        days, step, "last int, e double, p double, n double, a double, b double, k int, was boolean", (NEVER, 0.0, 0.0, 0.0, 0.0, 0.0, 0, False),
        "id long, d int, spike double, rolling_3m double, ewma double, cusum double, active boolean, episode boolean")


def stream_confirm(days: DataFrame, threshold: float, needed: int = 3) -> DataFrame:
    """Trigger, confirm and reject events, and pending for a candidate that is open when its run of days ends."""

    def step(state, d, row):
        last, prev, on, count, anchor, direction = state
        x = float(row["z"])
        out = []
        if last != NEVER and not on and abs(x - prev) > threshold:
            on, count, anchor, direction = True, 0, prev, math.copysign(1.0, x - prev)
            out.append((d, "trigger", direction))
        if on:
            if (x - anchor) * direction > threshold:
                count += 1
                if count >= needed:
                    out.append((d, "confirm", direction))
                    on, count = False, 0
            else:
                out.append((d, "reject", direction))
                on, count = False, 0
        return (d, x, on, count, anchor, direction), out

    def ended(state):
        return [(state[0], "pending", state[5])] if state[2] else []

    return per_id_state(days, step, "last int, prev double, act boolean, count int, anchor double, direction double",
                        (NEVER, 0.0, False, 0, 0.0, 0.0), "id long, d int, event string, direction double", ended)


def stream_bocpd(days: DataFrame, sigma: float, settings: DetectorSettings = DetectorSettings()) -> DataFrame:
    """Boundary probability per day. The state is the posterior over the lengths of the current unbroken run, however long."""

    def step(state, d, row):
        last, *posterior = state
        runs = RunPosterior(np.array([sigma]), settings, *(posterior if last != NEVER else ()))
        p = runs.observe(np.array([float(row["z"])]))[0]
        return (d, *(v[0].tolist() for v in (runs.logp, runs.mean, runs.scale))), [(d, None if not np.isfinite(p) else float(p))]

    return per_id_state(days, step, "last int, logp array<double>, mean array<double>, scale array<double>", (NEVER, [], [], []), "id long, d int, score double")


def stream_event_context(days: DataFrame, context: DataFrame, threshold: float, factor: float) -> DataFrame:
    """Stream–static join: the threshold of a day is lowered where an event was public; context is (id, d)."""
    flagged = days.join(context.select("id", "d").distinct().withColumn("_e", F.lit(True)), ["id", "d"], "left")
    limit = F.lit(threshold) * F.when(F.col("_e"), F.lit(factor)).otherwise(F.lit(1.0))
    return flagged.select("id", "d", F.coalesce("_e", F.lit(False)).alias("event_available"), (F.abs("z") > limit).alias("active"))
