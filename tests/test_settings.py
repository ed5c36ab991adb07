"""Registered queries run the whole grid of settings."""
from tidepanel.catalog import load

SF = "/root/testdata/sf0.001"


def test_scope_stress_covers_all_seeds_and_fractions(spark):
    got = {tuple(r) for r in load()[0]["scope_stress"](spark, SF).select("seed", "fraction").distinct().collect()}
    assert got == {(seed, f) for seed in range(20261001, 20261011) for f in (0.1, 0.25, 0.5, 0.75, 1.0)}
