"""Variants of a direct model that read the first of the same features."""
import numpy as np

from tidepanel.operators import learned
from tidepanel.operators.boosting import Boost

FIRST = 12 * 2000


def test_variants_share_rows_and_job(spark, monkeypatch):
    r = np.random.default_rng(4)
    panel = spark.createDataFrame([(i, FIRST + m, float(100 * (1 + i) * np.exp(0.2 * np.sin(m / 2) + 0.1 * r.normal()))) for i in range(30) for m in range(30)], "id long, m int, value double")
    regions = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, region long")
    near = spark.createDataFrame([(i, (i + j) % 30) for i in range(30) for j in (1, 2)], "id long, neighbor long")
    origins, kw = [FIRST + 14, FIRST + 20], {"minimum_rows": 60, "settings": Boost(rounds=5, least=10)}
    read = lambda df: sorted((r["id"], r["origin"], r["horizon"], r["status"], round(r["predicted"], 9)) for r in df.collect())
    plain = read(learned.fit_direct_horizon(panel, regions, FIRST, origins, [1], **kw))
    spatial = read(learned.fit_direct_horizon(panel, regions, FIRST, origins, [1], neighbors=near, k=2, **kw))
    made, rows = [], learned.direct_rows
    monkeypatch.setattr(learned, "direct_rows", lambda *a, **k: made.append(1) or rows(*a, **k))
    both = learned.fit_spatial(panel, regions, near, FIRST, origins, 2, **kw)
    assert read(both.filter("variant = 'plain'")) == plain and read(both.filter("variant = 'neighbors'")) == spatial and plain != spatial
    assert len(made) == 1
