"""Stress by level: one row an id meets all scenarios, and each scenario gives what its altered panel gives row by row."""
import math
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import scalars
from tidepanel.operators import backtest, detectors, quantiles, signals

ONSET, CAL, SPAN = 36, (24, 35), 6


@pytest.fixture(scope="module")
def panel(spark):
    draw = random.Random(4)
    rows = [(i, m, 100 * math.exp(draw.gauss(0, 0.1)) * (1 + i % 3)) for i in range(60) for m in range(0 if i % 9 else 5, ONSET + SPAN + 2)
            if not (i % 11 == 0 and m in (20, ONSET + 1)) and not (i == 17 and m > 30)]
    regions = [(i, None if i % 13 == 0 else i % 4 if i % 4 < 3 or i < 20 else 3) for i in range(70)]
    return spark.createDataFrame(rows, "id long, m int, value double"), spark.createDataFrame(regions, "id long, region long")


def test_scenarios_equal_their_altered_panels(spark, panel):
    rows, regions = panel
    got = {(r["scope"], r["scenario"], r["shape"], r["level"], r["method"]): r for r in backtest.level_stress(rows, regions, ONSET, CAL, 10, [-0.3], ["step", "ramp"], [7]).collect()}
    known = rows.filter(F.col("m") < ONSET + SPAN)
    base = backtest.level_scores(known, regions, CAL, 10, ONSET + SPAN - 1)
    limits = detectors.threshold_per_unit(base, ["level", "unit"], CAL)
    first = lambda s, keys=(): {tuple(r[:-1]): r["first"] for r in detectors.alarms(s.filter(F.col("m") >= ONSET).join(limits, ["level", "unit", "method"])).groupBy(
        *keys, "level", "unit", "method").agg(F.min(F.when(F.col("active"), F.col("m") - ONSET)).alias("first")).collect()}
    quiet, member = first(base), {str(r["id"]): r["region"] for r in regions.collect()}
    drawn = {str(r["id"]) for r in regions.filter(scalars.id_uniform(F.lit("7"), "id") < 0.25).collect()}
    scopes = {("national", "all"), ("local", "7"), ("regional", "1"), ("regional", "2"), ("regional", "3")}
    assert {k[:2] for k in got} == scopes
    ids = {(a, b): [i for i in member if a == "national" or (i in drawn if a == "local" else str(member[i]) == b)] for a, b in scopes}
    k, plan = F.col("m") - ONSET, spark.createDataFrame([(*s, i) for s, i in ids.items()], "scope string, scenario string, hit array<string>")
    altered = known.crossJoin(F.broadcast(plan)).withColumn("value", F.when(F.array_contains("hit", F.col("id").cast("string")) & (k >= 0), F.col("value") * scalars.shock_factor(
        F.lit("ramp"), F.lit(-0.3), k, SPAN)).otherwise(F.col("value"))).drop("hit")
    every = first(backtest.level_scores(altered, regions, CAL, 10, ONSET + SPAN - 1, ["scope", "scenario"]), ["scope", "scenario"])
    for scope, scenario in sorted(scopes):
        found = {k[2:]: v for k, v in every.items() if k[:2] == (scope, scenario)}
        for level in ("local", "regional", "national"):
            for method in detectors.METHODS:
                units = {u: f for (v, u, w), f in found.items() if (v, w) == (level, method)}
                aim = {u for u in units if scope == "national" or (level == "regional" and (scope, u) == ("regional", scenario)) or (
                    level == "local" and (u in drawn if scope == "local" else str(member[u]) == scenario))}
                r, share = got[scope, scenario, "ramp", level, method], lambda x: pytest.approx(sum(x) / len(x)) if x else None
                assert (r["target_units"], r["control_units"], r["intended"]) == (len(aim), len(units) - len(aim), scope == level)
                assert r["target_rate"] == share([units[u] is not None for u in aim]) and r["control_rate"] == share([units[u] is not None for u in units if u not in aim])
                assert r["target_base_rate"] == share([quiet[level, u, method] is not None for u in aim])
                assert r["target_new_rate"] == share([units[u] is not None and quiet[level, u, method] is None for u in aim])
                seen = sorted(units[u] for u in aim if units[u] is not None)
                assert r["median_delay"] == ((seen[(len(seen) - 1) // 2] + seen[len(seen) // 2]) / 2 if seen else None)


def test_no_row_is_repeated_for_every_scenario(panel, monkeypatch):
    stored = []
    for module in (backtest, signals, quantiles):
        keep = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, label, keep=keep: stored.append(keep(df, label)) or stored[-1])
    backtest.level_stress(*panel, ONSET, CAL, 10, [-0.3, -0.2, 0.2, 0.3], ["step", "ramp"], [7, 8, 9]).count()
    crossed = panel[0].filter(f"m >= 12 and m < {ONSET + SPAN}").count() * 7 * 8  # months of the ids × scopes × grid
    assert max(df.count() for df in stored) < crossed / 4
