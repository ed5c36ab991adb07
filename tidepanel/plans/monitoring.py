"""Monitoring plan: forecast residuals → own and peer-relative signals → scores → alarms → episodes."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.operators import detectors, signals
from tidepanel.schema import DetectorSettings


def peer_monitor(fc: DataFrame, cal: tuple[int, int], min_peers: int = 5, settings: DetectorSettings = DetectorSettings()) -> DataFrame:
    """(signal, id, m, method, score, threshold, observed, active, episode) for one-step forecasts."""
    residual = signals.forecast_residual(fc, min_peers)
    both = residual.select("id", "m", F.explode(F.array(
        F.struct(F.lit("own").alias("signal"), F.col("own").alias("z")), F.struct(F.lit("peer").alias("signal"), F.col("peer").alias("z")))).alias("s")).select("s.signal", "id", "m", "s.z")
    rows = detectors.by_method(detectors.scores(both, ["signal", "id"], settings), ["signal", "id"])
    limits = detectors.threshold_unit_max(rows, ["signal", "id"], cal, settings.threshold_quantile, ["signal"]).select("signal", "method", "threshold")
    return detectors.alarm_episodes(detectors.alarms(rows.join(limits, ["signal", "method"])), ["signal", "id", "method"])
