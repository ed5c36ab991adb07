"""Queries for prediction intervals."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.common import base_forecasts
from tidepanel.catalog.comparisons import SCALE
from tidepanel.catalog.kit import FIRST, LAST, YEAR, query
from tidepanel.catalog.preparation import QUART
from tidepanel.functions import months
from tidepanel.operators import intervals, prep
from tidepanel.session import cut_lineage
from tidepanel.sources import tables

MODEL = "growth_bridge"
F1 = f"f AS (SELECT * FROM fc WHERE model='{MODEL}' AND horizon=1)"
OUT = "id:l target:l calibration_rows:l lower:d upper:d covered:b width:d interval_score:d"


def one_step(spark, sf):
    """Stored: the month axis, guards, scores and intervals all read it."""
    return cut_lineage(base_forecasts(spark, sf, [MODEL], [1]), "forecasts")


def scaled(spark, sf):
    return cut_lineage(base_forecasts(spark, sf, [MODEL], [1]).join(prep.scale_by_id(tables.supplier_panel(spark, sf), YEAR), "id"), "forecasts")


def oracle(pair_condition, norm="1.0::DOUBLE", level=0.8, extra="", group="", source="f"):
    g, gj = (f"{group}, ", f"AND c.{group}=t.{group}") if group else ("", "")
    return f"""WITH {F1}, {SCALE}, {extra} fn AS (SELECT f.*, greatest({norm},1.0::DOUBLE) AS norm FROM {source} f), ax AS (SELECT DISTINCT target FROM f),
pw AS (SELECT a.target, b.target AS cal_target FROM ax a JOIN ax b ON b.target<a.target {pair_condition}),
cal AS (SELECT {g} p.target, abs(actual-predicted)/norm AS s FROM fn JOIN pw p ON p.cal_target=fn.target),
rk AS (SELECT *, row_number() OVER (PARTITION BY {g} target ORDER BY s) AS r, count(*) OVER (PARTITION BY {g} target) AS n FROM cal),
qq AS (SELECT {g} target, any_value(n) AS n, coalesce(max(s) FILTER (WHERE r=ceil((n+1)*{level}::DOUBLE)), 'infinity'::DOUBLE) AS q FROM rk GROUP BY ALL),
b AS (SELECT t.id, t.target, n AS calibration_rows, actual, greatest(predicted-q*norm,0) AS lower, greatest(predicted+q*norm,0) AS upper {', t.' + group if group else ''} FROM fn t JOIN qq c ON c.target=t.target {gj}),
iv AS (SELECT *, actual BETWEEN lower AND upper AS covered, upper-lower AS width, upper-lower+2/(1-{level}::DOUBLE)*(greatest(lower-actual,0)+greatest(actual-upper,0)) AS interval_score FROM b)"""


@query("finite_quantile", "target:l rows:l q80:d q95_clamped:d", f"""
WITH {F1}, r AS (SELECT target, abs(actual-predicted) AS s, row_number() OVER (PARTITION BY target ORDER BY abs(actual-predicted)) AS r, count(*) OVER (PARTITION BY target) AS n FROM f)
SELECT target, any_value(n) AS rows, max(s) FILTER (WHERE r=ceil((n+1)*0.8::DOUBLE)) AS q80, max(s) FILTER (WHERE r=least(n,ceil((n+1)*0.95::DOUBLE))) AS q95_clamped FROM r GROUP BY target""", digits=3)
def _(spark, sf):
    rows = one_step(spark, sf).withColumn("s", F.abs(F.col("actual") - F.col("predicted")))
    a = intervals.finite_quantile(rows, ["target"], "s", 0.8, "q80").withColumnRenamed("n", "rows")
    return a.join(intervals.finite_quantile(rows, ["target"], "s", 0.95, "q95_clamped", clamp=True).drop("n"), "target")


def _policy(name, condition, **kw):
    @query(f"intervals_{name}", OUT, oracle(condition) + " SELECT * FROM iv", digits=3)
    def _(spark, sf):
        fc = one_step(spark, sf)
        return intervals.calibrated(fc, intervals.window_pairs(fc, **kw), "raw", 0.8)


_policy("fixed", f"AND b.target BETWEEN {FIRST+12} AND {FIRST+23}", policy="fixed", fixed=(FIRST + 12, FIRST + 23))
_policy("expanding", "", policy="expanding")
_policy("rolling_3m", "AND b.target>=a.target-3", policy="rolling", window=3)


def _strategy(name, norm, strategy, extra=""):
    @query(f"intervals_{name}", OUT, oracle("AND b.target>=a.target-3", norm, 0.95, extra, source="(SELECT f.*, mean_value FROM f JOIN sc USING(id))") + " SELECT * FROM iv", digits=3)
    def _(spark, sf):
        fc = scaled(spark, sf)
        return intervals.calibrated(fc, intervals.window_pairs(fc, "rolling"), strategy, 0.95)


_strategy("scaled_mean", "mean_value", "scaled_mean")
_strategy("scaled_forecast", "abs(predicted)", "scaled_forecast")


GROUPED = oracle("AND b.target>=a.target-3", level=0.8, extra=f"{QUART},", group="quartile", source="(SELECT f.*, quartile FROM f JOIN quart USING(id))")


@query("intervals_by_group", OUT + " quartile:s", GROUPED + " SELECT * FROM iv", digits=3)
def _(spark, sf):
    fc = one_step(spark, sf)
    groups = prep.expense_quartiles(tables.supplier_panel(spark, sf), YEAR)
    return intervals.calibrate_by_group(fc, groups, "quartile", intervals.window_pairs(fc, "rolling"), "raw", 0.8)


@query("interval_summary", "coverage:d minimum_date_coverage:d width:d interval_score:d dates:l rows:l minimum_group_coverage:d", GROUPED + """
SELECT avg(c) AS coverage, min(c) AS minimum_date_coverage, avg(w) AS width, avg(s) AS interval_score, count(*) AS dates, sum(n) AS rows,
 (SELECT min(c) FROM (SELECT quartile, avg(covered::INT) AS c FROM iv GROUP BY quartile)) AS minimum_group_coverage
FROM (SELECT target, avg(covered::INT) AS c, avg(width) AS w, avg(interval_score) AS s, count(*) AS n FROM iv GROUP BY target)""", digits=3)
def _(spark, sf):
    fc = one_step(spark, sf)
    groups = prep.expense_quartiles(tables.supplier_panel(spark, sf), YEAR)
    rows = intervals.calibrate_by_group(fc, groups, "quartile", intervals.window_pairs(fc, "rolling"), "raw", 0.8)
    return intervals.interval_summary(rows, "quartile")


@query("calibration_guards", "target:l cal_target:l n:l cal_n:l shared:l", f"""
WITH {F1}, ax AS (SELECT target, count(*) AS n FROM f GROUP BY 1), pw AS (SELECT a.target, b.target AS cal_target, a.n, b.n AS cal_n FROM ax a JOIN ax b ON b.target<a.target AND b.target>=a.target-3)
SELECT * FROM (SELECT p.*, (SELECT count(*) FROM f x JOIN f y ON y.id=x.id AND y.target=p.cal_target WHERE x.target=p.target) AS shared FROM pw p) WHERE shared<>n OR shared<>cal_n""")
def _(spark, sf):
    fc = one_step(spark, sf)
    return intervals.calibration_gaps(fc, intervals.window_pairs(fc, "rolling"))


@query("calibration_for_origin", "origin:l normalized_radius:d observations:l ids:l first_target:l last_target:l", f"""
WITH {F1}, {SCALE}, c AS (SELECT o.origin, f.id, f.target, abs(actual-predicted)/mean_value AS s FROM f JOIN sc USING(id) JOIN (SELECT DISTINCT target AS t, unnest([target,target+1,target+2]) AS origin FROM f) o ON o.t=f.target),
r AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY s) AS r, count(*) OVER (PARTITION BY origin) AS n FROM c)
SELECT origin, max(s) FILTER (WHERE r=least(n,ceil((n+1)*0.8::DOUBLE))) AS normalized_radius, count(*) AS observations, count(DISTINCT id) AS ids, min(target) AS first_target, max(target) AS last_target FROM r GROUP BY origin HAVING count(DISTINCT target)=3""")
def _(spark, sf):
    return intervals.calibration_for_origin(scaled(spark, sf))


#: Every target with three months before it; the state of a month is one number, carried by recursion.
ADAPTIVE = (FIRST + 15, LAST)


@query("intervals_adaptive", "id:l target:l alpha:d lower:d upper:d covered:b interval_score:d", f"""
WITH RECURSIVE {F1}, {SCALE}, fn AS (SELECT f.id, f.target, actual, predicted, greatest(mean_value,1.0::DOUBLE) AS norm FROM f JOIN sc USING(id)),
own AS (SELECT target, list({{'a': actual, 'p': predicted, 'n': norm}}) AS rs FROM fn WHERE target BETWEEN {ADAPTIVE[0]} AND {ADAPTIVE[1]} GROUP BY target),
past AS (SELECT own.target, list_sort(list(abs(actual-predicted)/norm)) AS ws FROM own JOIN fn ON fn.target BETWEEN own.target-3 AND own.target-1 GROUP BY own.target),
st AS (SELECT {ADAPTIVE[0]}::BIGINT AS target, (1-0.8::DOUBLE) AS alpha, NULL::DOUBLE AS q
 UNION ALL SELECT target+1, least(greatest(alpha+0.05::DOUBLE*((1-0.8::DOUBLE)-(1-list_avg(list_transform(rs, lambda r: (r.a BETWEEN greatest(r.p-qn*r.n,0) AND greatest(r.p+qn*r.n,0))::INT::DOUBLE)))), 0.005), 0.5), qn FROM (
  SELECT st.target, alpha, rs, coalesce(ws[ceil((len(ws)+1)*(1-alpha))::BIGINT], 'infinity'::DOUBLE) AS qn FROM st JOIN own ON own.target=st.target JOIN past ON past.target=st.target)),
iv AS (SELECT fn.*, a.alpha, b.q, greatest(predicted-b.q*norm,0) AS lower, greatest(predicted+b.q*norm,0) AS upper FROM fn JOIN st a ON a.target=fn.target JOIN st b ON b.target=fn.target+1)
SELECT id, target, alpha, lower, upper, actual BETWEEN lower AND upper AS covered, upper-lower+2/(1-0.8::DOUBLE)*(greatest(lower-actual,0)+greatest(actual-upper,0)) AS interval_score FROM iv""", digits=3)
def _(spark, sf):
    return intervals.calibrate_adaptive(scaled(spark, sf), list(range(ADAPTIVE[0], ADAPTIVE[1] + 1)), 0.8, 0.05)


@query("widen_for_events", "id:l target:l event_known:b lower:d upper:d", f"""
WITH {F1}, {SCALE}, kn AS (SELECT DISTINCT l_suppkey AS id, 12*year(l_shipdate)+month(l_shipdate)-1 AS m FROM lineitem WHERE l_discount>=0.1 AND l_tax>=0.08)
SELECT f.id, f.target, kn.id IS NOT NULL AS event_known, predicted-0.1::DOUBLE*mean_value*CASE WHEN kn.id IS NULL THEN 1 ELSE 1.5 END AS lower, predicted+0.1::DOUBLE*mean_value*CASE WHEN kn.id IS NULL THEN 1 ELSE 1.5 END AS upper
FROM f JOIN sc USING(id) LEFT JOIN kn ON kn.id=f.id AND kn.m=f.origin""", digits=4)
def _(spark, sf):
    known = tables.table(spark, sf, "lineitem").filter("l_discount >= 0.1 and l_tax >= 0.08").select(F.col("l_suppkey").alias("id"), months.month_index("l_shipdate").alias("origin"))
    return intervals.widen_for_events(scaled(spark, sf).withColumn("radius", 0.1 * F.col("mean_value")), known, 1.5)
