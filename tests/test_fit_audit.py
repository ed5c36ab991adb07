"""The audit of direct fits meets the origins with counts only."""
import pytest

from tidepanel.operators import learned


def test_fit_audit_counts_before_it_meets_origins(spark, monkeypatch):
    rows = [(i, s, h, None if (i + s) % 4 == 0 else 1.0) for i in range(5) for s in range(10 + i, 18) for h in (1, 3)]
    df = spark.createDataFrame(rows, "id long, source int, horizon int, y double")
    monkeypatch.setattr(learned, "_per_origin", lambda *a: pytest.fail("a row for every origin"))
    got = {(r["origin"], r["horizon"]): (r["rows"], r["ids"], r["max_target"], r["status"]) for r in learned.fit_audit(df, [12, 15, 30], 10).collect()}
    want = {}
    for o in (12, 15, 30):
        for h in (1, 3):
            known = [(i, s + h) for i, s, g, y in rows if g == h and y is not None and s + h <= o]
            if known:
                want[o, h] = len(known), len({i for i, _ in known}), max(t for _, t in known), "trained" if len(known) >= 10 else "seasonal_fallback"
    assert got == want
