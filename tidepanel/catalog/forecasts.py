"""Queries for profiles, forecast models, joins and model selection."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidepanel.catalog.common import base_forecasts, mixed_profile
from tidepanel.catalog.kit import FIRST, GROWTH, HORIZONS, LAST, MIN_REGION, WEIGHT, YEAR, query
from tidepanel.functions import months, scalars
from tidepanel.operators import forecast, joins, prep, profiles, selection, trend
from tidepanel.plans.forecast_panel import audit_counts, forecast_panel, validate
from tidepanel.schema import ForecastConfig
from tidepanel.session import literal_table
from tidepanel.sources import tables

ORIGIN = 12 * 2000 + 11
EARLY = 12 * 1999 + 5
RATE = 0.172
FC = "id:l origin:l target:l horizon:l actual:d predicted:d"
WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]
CANDIDATES = {"pooled": None, "regional": 0.0, "shrink_5": 5.0, "shrink_20": 20.0, "shrink_100": 100.0}
ALL = list(forecast.MODELS)


def config(**kw):
    return ForecastConfig(origin=ORIGIN, profile_year=YEAR, horizons=HORIZONS, growth_rate=RATE, region_weight=WEIGHT, minimum_region=MIN_REGION, **kw)


def inputs(spark, sf):
    return tables.supplier_panel(spark, sf), tables.supplier_lookup(spark, sf)


@query("forecast_panel", "id:l region:l origin:l target:l horizon:l origin_value:d predicted:d regional_profile_used:b", f"""
SELECT p.id, a.region, {ORIGIN} AS origin, {ORIGIN}+horizon AS target, horizon, p.value AS origin_value,
 p.value*(t.f/a.f)*pow(1+{RATE}::DOUBLE, ({ORIGIN}%12+horizon)//12) AS predicted, a.regional AS regional_profile_used
FROM panel p CROSS JOIN hs JOIN mixp a ON a.id=p.id AND a.moy={ORIGIN}%12 JOIN mixp t ON t.id=p.id AND t.moy=({ORIGIN}+horizon)%12
WHERE p.m={ORIGIN} AND p.value>0""", digits=4)
def _(spark, sf):
    return forecast_panel(*inputs(spark, sf), config())


@query("forecast_audit", "future_rows_excluded:l unavailable_rows_excluded:l input_ids:l profile_eligible_ids:l forecast_ids:l ids_without_forecast:l global_fallback_forecasts:l", f"""
SELECT count(*) FILTER (WHERE m>{ORIGIN}) AS future_rows_excluded, 0 AS unavailable_rows_excluded, count(DISTINCT id) FILTER (WHERE m<={ORIGIN}) AS input_ids,
 (SELECT count(*) FROM elig) AS profile_eligible_ids, (SELECT count(*) FROM panel JOIN elig USING(id) WHERE m={ORIGIN} AND value>0) AS forecast_ids,
 count(DISTINCT id) FILTER (WHERE m<={ORIGIN}) - (SELECT count(*) FROM panel JOIN elig USING(id) WHERE m={ORIGIN} AND value>0) AS ids_without_forecast,
 (SELECT count(*)*4 FROM panel p JOIN mixp x ON x.id=p.id AND x.moy=0 AND NOT x.regional WHERE m={ORIGIN} AND value>0) AS global_fallback_forecasts FROM panel""")
def _(spark, sf):
    panel, lookup = inputs(spark, sf)
    validate(panel, lookup, config())
    return audit_counts(panel, forecast_panel(panel, lookup, config()), config())


@query("profile_global", "moy:l factor:d", "SELECT moy, f AS factor FROM pg")
def _(spark, sf):
    return profiles.to_rows(profiles.profile_global(tables.supplier_panel(spark, sf), YEAR), [], "p_global")


@query("profile_regional", "region:l members:l moy:l factor:d", "SELECT region, members, moy, f AS factor FROM pr")
def _(spark, sf):
    return profiles.to_rows(profiles.profile_regional(*inputs(spark, sf), YEAR, MIN_REGION), ["region", "members"], "p_region")


@query("profile_mix", "id:l region:l regional_profile_used:b moy:l factor:d", "SELECT id, region, regional AS regional_profile_used, moy, f AS factor FROM mixp")
def _(spark, sf):
    return profiles.to_rows(mixed_profile(spark, sf), ["id", "region", "regional_profile_used"], "profile")


@query("profile_per_category", "category:s moy:l factor:d", f"""
SELECT category, moy, t/avg(t) OVER (PARTITION BY category) AS factor FROM (SELECT category, m%12 AS moy, sum(value) AS t FROM cpanel JOIN celig USING(category,id)
WHERE m BETWEEN {FIRST} AND {FIRST+11} GROUP BY ALL)""")
def _(spark, sf):
    return profiles.to_rows(profiles.profile_global(tables.supplier_category_panel(spark, sf), YEAR, ["category"]), ["category"], "p_global")


@query("profile_shrunk", "id:l moy:l factor:d", """
SELECT e.id, g.moy, exp(coalesce(members/(members+100.0::DOUBLE),0)*ln(coalesce(r.f,g.f)) + (1-coalesce(members/(members+100.0::DOUBLE),0))*ln(g.f)) AS factor
FROM elig e LEFT JOIN lookup USING(id) CROSS JOIN pg g LEFT JOIN pr r ON r.region=lookup.region AND r.moy=g.moy""")
def _(spark, sf):
    return profiles.to_rows(profiles.profile_shrunk(*inputs(spark, sf), YEAR, MIN_REGION, 100.0), ["id"], "profile")


@query("rolling_origin", "id:l region:l origin:l target:l horizon:l model:s actual:d predicted:d",
       "SELECT id, region, origin, target, horizon, model, actual, predicted FROM fc", digits=4)
def _(spark, sf):
    return base_forecasts(spark, sf)


def _single(model):
    @query(f"fc_{model}", FC, f"SELECT * FROM fc WHERE model='{model}'", digits=4)
    def _(spark, sf):
        return base_forecasts(spark, sf, [model])


for _model in ALL:
    _single(_model)


@query("ratio_shrunk", FC + " candidate:s", """
SELECT o.*, c.candidate, level*exp(coalesce(c.w,0)*ln(coalesce(rt.f/ro.f, gt.f/go.f))+(1-coalesce(c.w,0))*ln(gt.f/go.f)) AS predicted
FROM orows o LEFT JOIN lookup USING(id) JOIN pg gt ON gt.moy=target%12 JOIN pg go ON go.moy=origin%12
LEFT JOIN pr rt ON rt.region=lookup.region AND rt.moy=target%12 LEFT JOIN pr ro ON ro.region=lookup.region AND ro.moy=origin%12,
LATERAL (SELECT unnest(['pooled','regional','shrink_5','shrink_20','shrink_100']) AS candidate, unnest([0.0::DOUBLE, rt.members/(rt.members+0.0::DOUBLE),
 rt.members/(rt.members+5.0::DOUBLE), rt.members/(rt.members+20.0::DOUBLE), rt.members/(rt.members+100.0::DOUBLE)]) AS w) c""", digits=4)
def _(spark, sf):
    return forecast.shrunk_candidates(*inputs(spark, sf), YEAR, HORIZONS, CANDIDATES, MIN_REGION)


@query("robust_anchor", FC + " anchor:s", """
SELECT o.id, origin, target, horizon, actual, anchor, lvl*ft.f AS predicted FROM (SELECT o.*, l2.value/f2.f AS a, l1.value/f1.f AS b, level/f0.f AS c FROM orows o
 LEFT JOIN panel l2 ON l2.id=o.id AND l2.m=origin-2 LEFT JOIN panel l1 ON l1.id=o.id AND l1.m=origin-1
 JOIN mixp f2 ON f2.id=o.id AND f2.moy=(origin-2)%12 JOIN mixp f1 ON f1.id=o.id AND f1.moy=(origin-1)%12 JOIN mixp f0 ON f0.id=o.id AND f0.moy=origin%12) o
JOIN mixp ft ON ft.id=o.id AND ft.moy=target%12,
LATERAL (SELECT unnest(['last','mean_3m','median_3m','weighted_3m']) AS anchor, unnest([c,(a+b+c)/3,list_sort([a,b,c])[2],0.2::DOUBLE*a+0.3::DOUBLE*b+0.5::DOUBLE*c]) AS lvl)""", digits=4)
def _(spark, sf):
    return forecast.robust_anchor(tables.supplier_panel(spark, sf), mixed_profile(spark, sf), YEAR, HORIZONS)


@query("calendar_features", "m:l days:l mon:l tue:l wed:l thu:l fri:l sat:l sun:l", """
SELECT m, count(*) AS days, count(*) FILTER (WHERE isodow(d)=1) AS mon, count(*) FILTER (WHERE isodow(d)=2) AS tue, count(*) FILTER (WHERE isodow(d)=3) AS wed,
 count(*) FILTER (WHERE isodow(d)=4) AS thu, count(*) FILTER (WHERE isodow(d)=5) AS fri, count(*) FILTER (WHERE isodow(d)=6) AS sat, count(*) FILTER (WHERE isodow(d)=7) AS sun
FROM (SELECT m, unnest(generate_series(make_date((m//12)::INT,(m%12+1)::INT,1), last_day(make_date((m//12)::INT,(m%12+1)::INT,1)), INTERVAL 1 DAY)) AS d
 FROM (SELECT DISTINCT m FROM panel)) GROUP BY m""")
def _(spark, sf):
    return forecast.calendar_dimension(tables.supplier_panel(spark, sf))


DIM = "day(last_day(make_date((({m})//12)::INT,(({m})%12+1)::INT,1)))"


@query("day_corrected", FC, f"""
SELECT o.*, level/{DIM.format(m='origin')}*(gt.f/{DIM.format(m=f'{FIRST}+target%12')})/(go.f/{DIM.format(m=f'{FIRST}+origin%12')})*{DIM.format(m='target')} AS predicted
FROM orows o JOIN pg gt ON gt.moy=target%12 JOIN pg go ON go.moy=origin%12""", digits=4)
def _(spark, sf):
    return forecast.day_corrected(tables.supplier_panel(spark, sf), YEAR, HORIZONS)


@query("fc_delayed", FC + " lag:l decision:l", f"""
SELECT o.id, o.m AS origin, o.m+1+lag AS target, 1+lag AS horizon, t.value AS actual, o.value*(mt.f/mo.f) AS predicted, lag, o.m+lag AS decision
FROM panel o JOIN elig USING(id) JOIN ct USING(id) CROSS JOIN (SELECT unnest([0,1,2]) AS lag) JOIN panel t ON t.id=o.id AND t.m=o.m+1+lag
JOIN mixp mt ON mt.id=o.id AND mt.moy=(o.m+1+lag)%12 JOIN mixp mo ON mo.id=o.id AND mo.moy=o.m%12
WHERE o.m>={FIRST+11} AND o.m<=complete_through AND o.value>0 AND t.value>0""", digits=4)
def _(spark, sf):
    return forecast.delayed(*inputs(spark, sf), YEAR, [0, 1, 2], models=["seasonal_mix"], minimum=MIN_REGION, weight=WEIGHT)


@query("fc_frozen_vs_adaptive", "id:l target:l anchor_kind:s anchor:l actual:d predicted:d", f"""
SELECT t.id, t.m AS target, anchor_kind, anchor, t.value AS actual, a.value*gt.f/ga.f AS predicted FROM panel t JOIN elig USING(id),
LATERAL (SELECT unnest(['rolling','frozen']) AS anchor_kind, unnest([t.m-1, {FIRST+11}+((t.m-{FIRST+12})//6)*6]) AS anchor) x
JOIN panel a ON a.id=t.id AND a.m=anchor JOIN pg gt ON gt.moy=t.m%12 JOIN pg ga ON ga.moy=anchor%12 WHERE t.m>={FIRST+12} AND t.value>0 AND a.value>0""", digits=4)
def _(spark, sf):
    return forecast.frozen_vs_rolling(tables.supplier_panel(spark, sf), YEAR)


@query("fc_month_mean", "id:l m:l residual:d", f"""
SELECT id, m, ln(value)-x AS residual FROM panel JOIN (SELECT id, m%12 AS moy, avg(ln(value)) AS x FROM panel WHERE m<={EARLY} AND value>0 GROUP BY ALL) p USING(id)
WHERE p.moy=m%12 AND m>{EARLY} AND value>0""")
def _(spark, sf):
    return forecast.month_mean_residual(tables.supplier_panel(spark, sf), EARLY)


@query("fc_case_seasonal", "id:l origin:l target:l actual:d predicted:d", f"""
WITH big AS (SELECT id FROM (SELECT id, region, expense, row_number() OVER (PARTITION BY region ORDER BY expense DESC, id) AS k FROM
 (SELECT id, avg(value) AS expense FROM panel JOIN elig USING(id) WHERE m BETWEEN {FIRST} AND {FIRST+11} GROUP BY id) JOIN lookup USING(id)) WHERE k=1)
SELECT id, origin, target, actual, predicted FROM fc JOIN big USING(id) WHERE model='seasonal_pooled' AND horizon=1""", digits=4)
def _(spark, sf):
    from tidepanel.operators.accuracy import select_cases

    panel, lookup = inputs(spark, sf)
    cases = select_cases(panel, lookup, YEAR, "region")
    return base_forecasts(spark, sf, ["seasonal_pooled"], [1]).join(cases.select("id"), "id", "left_semi")


@query("yoy_growth", "id:l m:l value:d year_ago:d growth:d", """
SELECT a.id, a.m, a.value, b.value AS year_ago, a.value/b.value-1 AS growth FROM panel a JOIN panel b ON b.id=a.id AND b.m=a.m-12 WHERE a.value>0 AND b.value>0""")
def _(spark, sf):
    return forecast.yoy(tables.supplier_panel(spark, sf))


@query("growth_available", "origin:l rate:d", """
WITH rec AS (SELECT 12*year(o_orderdate)+11 AS y, count(*)*1e-4 AS rate, make_date((year(o_orderdate)+1)::INT,3,15) AS available_from FROM orders GROUP BY ALL)
SELECT origin, arg_max(rate, available_from) AS rate FROM (SELECT DISTINCT m AS origin FROM panel) JOIN rec ON available_from <= last_day(make_date((origin//12)::INT,(origin%12+1)::INT,1)) GROUP BY origin""")
def _(spark, sf):
    orders = tables.table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg((F.count("*") * 1e-4).alias("rate"))
    records = orders.select("rate", F.make_date(F.col("y") + 1, F.lit(3), F.lit(15)).alias("available_from"))
    return forecast.growth_available(tables.supplier_panel(spark, sf).select(F.col("m").alias("origin")), records)


RATES = f"""rates AS (SELECT region, origin, CASE WHEN good=3 THEN r ELSE {GROWTH} END AS rate, CASE WHEN good=3 THEN 'regional' ELSE 'fallback' END AS source, minimum_peers FROM (
 SELECT s.region, origin, count(*) FILTER (WHERE peers>=15) AS good, median(g) FILTER (WHERE peers>=15) AS r, min(coalesce(peers,0)) AS minimum_peers
 FROM (SELECT DISTINCT region FROM elig JOIN lookup USING(id) WHERE region IS NOT NULL) s CROSS JOIN (SELECT DISTINCT m AS origin, unnest([m-2,m-1,m]) AS m FROM panel) o
 LEFT JOIN (SELECT region, a.m, median(a.value/b.value-1) AS g, count(*) AS peers FROM panel a JOIN panel b ON b.id=a.id AND b.m=a.m-12 JOIN elig e ON e.id=a.id JOIN lookup l ON l.id=a.id
  WHERE a.value>0 AND b.value>0 AND region IS NOT NULL GROUP BY ALL) g ON g.region=s.region AND g.m=o.m GROUP BY ALL))"""


def growth_rates(spark, sf):
    panel, lookup = inputs(spark, sf)
    return forecast.regional_growth_rate(panel, lookup, YEAR, panel.select(F.col("m").alias("origin")), 15, GROWTH)


@query("regional_growth_rate", "region:l origin:l rate:d source:s minimum_peers:l", f"WITH {RATES} SELECT * FROM rates")
def _(spark, sf):
    return growth_rates(spark, sf)


@query("fc_adaptive_growth", FC + " source:s", f"""
WITH {RATES} SELECT f.* REPLACE (predicted*pow(1+coalesce(rate,{GROWTH}), (f.origin%12+horizon)//12) AS predicted), coalesce(source,'fallback') AS source
FROM fc f LEFT JOIN rates r ON r.region=f.region AND r.origin=f.origin WHERE model='seasonal_mix'""", digits=4)
def _(spark, sf):
    return forecast.adaptive_growth(base_forecasts(spark, sf, ["seasonal_mix"]), growth_rates(spark, sf), GROWTH)


@query("diagnose_by_origin", "origin:l horizon:l mae:d control_mae:d", f"""
WITH {RATES} SELECT f.origin, horizon, avg(abs(actual-predicted*pow(1+coalesce(rate,{GROWTH}),(f.origin%12+horizon)//12))) AS mae, avg(abs(actual-predicted)) AS control_mae
FROM fc f LEFT JOIN rates r ON r.region=f.region AND r.origin=f.origin WHERE model='seasonal_mix' GROUP BY ALL""", digits=4)
def _(spark, sf):
    base = base_forecasts(spark, sf, ["seasonal_mix"]).withColumn("control", F.col("predicted"))
    out = forecast.adaptive_growth(base, growth_rates(spark, sf), GROWTH)
    return out.groupBy("origin", "horizon").agg(
        F.avg(scalars.abs_error()).alias("mae"), F.avg(scalars.abs_error("actual", "control")).alias("control_mae"))


@query("apply_growth_grid", FC + " rate:d bridges:l", """
SELECT f.* REPLACE (predicted*pow(1+g.rate, (origin%12+horizon)//12) AS predicted), g.rate, (origin%12+horizon)//12 AS bridges
FROM fc f CROSS JOIN (SELECT unnest([0.0,0.07,0.12,0.17]::DOUBLE[]) AS rate) g WHERE model='seasonal_mix'""", digits=4)
def _(spark, sf):
    return forecast.growth_grid(base_forecasts(spark, sf, ["seasonal_mix"]), [0.0, 0.07, 0.12, 0.17])


CAT = f"""crate AS (SELECT l_returnflag AS category, avg(l_tax) AS rate FROM lineitem GROUP BY 1),
fixed AS (SELECT category, id FROM celig WHERE id IN (SELECT id FROM celig WHERE category='ALL')),
cg AS (SELECT category, moy, t/avg(t) OVER (PARTITION BY category) AS f FROM (SELECT category, m%12 AS moy, sum(value) AS t FROM cpanel JOIN celig USING(category,id)
 WHERE m BETWEEN {FIRST} AND {FIRST+11} GROUP BY ALL)),
cr AS (SELECT category, region, moy, t/avg(t) OVER (PARTITION BY category, region) AS f FROM (SELECT category, region, m%12 AS moy, sum(value) AS t FROM cpanel JOIN celig USING(category,id)
 JOIN lookup USING(id) WHERE m BETWEEN {FIRST} AND {FIRST+11} GROUP BY ALL HAVING count(*)>={MIN_REGION})),
cm AS (SELECT e.category, e.id, lookup.region, g.moy, 0.5::DOUBLE*g.f+0.5::DOUBLE*coalesce(r.f,g.f) AS f FROM fixed e LEFT JOIN lookup USING(id) JOIN cg g USING(category)
 LEFT JOIN cr r ON r.category=e.category AND r.region=lookup.region AND r.moy=g.moy)"""


@query("fc_per_category", "category:s " + FC + " model:s", f"""
WITH {CAT} SELECT o.category, o.id, o.m AS origin, o.m+horizon AS target, horizon, t.value AS actual, model,
 o.value*ft.f/fo.f*pow(1+CASE WHEN model='control' THEN 0 ELSE coalesce(rate,0) END, (o.m%12+horizon)//12) AS predicted
FROM cpanel o CROSS JOIN hs JOIN cpanel t ON t.category=o.category AND t.id=o.id AND t.m=o.m+horizon JOIN cm fo ON fo.category=o.category AND fo.id=o.id AND fo.moy=o.m%12
JOIN cm ft ON ft.category=o.category AND ft.id=o.id AND ft.moy=(o.m+horizon)%12 LEFT JOIN crate ON crate.category=o.category CROSS JOIN (SELECT unnest(['control','category_rate']) AS model)
WHERE o.m>={FIRST+11} AND o.value>0 AND t.value>0""", digits=4)
def _(spark, sf):
    rates = tables.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("category")).agg(F.avg("l_tax").alias("rate"))
    return forecast.category_growth(tables.supplier_category_panel(spark, sf), tables.supplier_lookup(spark, sf), YEAR, HORIZONS, rates, WEIGHT, MIN_REGION)


@query("chain_index", "m:l factor:d level:d", """
WITH t AS (SELECT m, 1+avg(x)/100 AS factor FROM (SELECT 12*year(l_shipdate)+month(l_shipdate)-1 AS m, l_discount AS x FROM lineitem) GROUP BY m)
SELECT m, factor, exp(sum(ln(factor)) OVER (ORDER BY m)) AS level FROM t""")
def _(spark, sf):
    f = tables.table(spark, sf, "lineitem").select(months.month_index("l_shipdate").alias("m"), "l_discount").groupBy("m").agg((1 + F.avg("l_discount") / 100).alias("factor"))
    return forecast.chain_index(f)


@query("deseasonalize", "id:l m:l value:d", "SELECT p.id, m, value/f AS value FROM panel p JOIN mixp x ON x.id=p.id AND x.moy=m%12", digits=4)
def _(spark, sf):
    return forecast.deseasonalize(tables.supplier_panel(spark, sf), mixed_profile(spark, sf))


TREND = f"""tr AS (SELECT * FROM (SELECT id, m AS origin, regr_slope(value, m-{FIRST}) OVER w AS slope, regr_intercept(value, m-{FIRST}) OVER w AS intercept, count(*) OVER w AS n
 FROM panel WHERE m>={FIRST} WINDOW w AS (PARTITION BY id ORDER BY m)) WHERE n>=12)"""


def origin_keys(spark, sf, horizons=HORIZONS):
    return forecast.origin_rows(tables.supplier_panel(spark, sf), YEAR, horizons).select("id", "origin", "target", "horizon", "actual")


def linear(spark, sf):
    return trend.trend_forecasts(origin_keys(spark, sf), trend.linear_trend(tables.supplier_panel(spark, sf), FIRST), FIRST)


@query("trend_regression", FC, f"WITH {TREND} SELECT o.*, greatest(intercept+slope*(target-{FIRST}),0) AS predicted FROM orows o JOIN tr USING(id,origin)", digits=1)
def _(spark, sf):
    return linear(spark, sf)


@query("trend_with_profile", FC, f"""
WITH flat AS (SELECT p.id, m, value/f AS value FROM panel p JOIN mixp x ON x.id=p.id AND x.moy=m%12), {TREND.replace('FROM panel', 'FROM flat')}
SELECT o.*, greatest(greatest(intercept+slope*(target-{FIRST}),0)*f,0) AS predicted FROM orows o JOIN tr USING(id,origin) JOIN mixp x ON x.id=o.id AND x.moy=target%12""", digits=1)
def _(spark, sf):
    return trend.profile_trend_forecasts(origin_keys(spark, sf), tables.supplier_panel(spark, sf), mixed_profile(spark, sf), FIRST)


@query("trend_fourier", "id:l origin:l target:l horizon:l predicted:d")
def _(spark, sf):
    return trend.fourier_ridge(tables.supplier_panel(spark, sf), FIRST, HORIZONS)


def _mean_of_last_year(histories, horizon):
    return np.repeat(histories[:, -12:].mean(axis=1, keepdims=True), horizon, axis=1)


#: Every month from the end of the profile year on.
HOOK_ORIGINS = list(range(12 * 1996 + 11, 12 * 2000 + 12))


@query("forecast_with", "id:l origin:l target:l horizon:l predicted:d", f"""
SELECT c.id, o.origin, o.origin+horizon AS target, horizon, avg(value) AS predicted FROM ct c CROSS JOIN (SELECT unnest({HOOK_ORIGINS}) AS origin) o CROSS JOIN hs
JOIN panel p ON p.id=c.id AND p.m BETWEEN o.origin-11 AND o.origin WHERE complete_through>=o.origin GROUP BY ALL""", digits=4)
def _(spark, sf):
    return trend.forecast_with(tables.supplier_panel(spark, sf), HOOK_ORIGINS, HORIZONS, _mean_of_last_year, FIRST)


# -- selection ----------------------------------------------------------------------------------
PAIRS = """pairs AS (SELECT id, origin, target, horizon, a.actual, a.predicted AS predicted_a, b.predicted AS predicted_b, abs(a.actual-a.predicted) AS loss_a, abs(b.actual-b.predicted) AS loss_b
 FROM (SELECT * FROM fc WHERE model='seasonal_mix') a JOIN (SELECT * FROM fc WHERE model='seasonal_local') b USING(id,origin,target,horizon))"""


def pairs(spark, sf):
    return selection.matched_pairs(base_forecasts(spark, sf, ["seasonal_mix", "seasonal_local"]), "seasonal_mix", "seasonal_local")


@query("pair_models", "id:l origin:l target:l horizon:l sides:s same_actual:b", """
SELECT id, origin, target, horizon, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'both' WHEN a.id IS NOT NULL THEN 'a' ELSE 'b' END AS sides,
 a.actual IS NOT DISTINCT FROM b.actual AS same_actual FROM (SELECT * FROM fc WHERE model='growth_bridge') a FULL JOIN (SELECT * FROM fc WHERE model='same_month_yoy') b USING(id,origin,target,horizon)""")
def _(spark, sf):
    return selection.pair_models(base_forecasts(spark, sf, ["growth_bridge", "same_month_yoy"]), "growth_bridge", "same_month_yoy")


@query("common_keys", "id:l origin:l target:l horizon:l model:s predicted:d", """
SELECT id, origin, target, horizon, model, predicted FROM fc WHERE (id,origin,target,horizon) IN (SELECT (id,origin,target,horizon) FROM fc GROUP BY id,origin,target,horizon HAVING count(DISTINCT model)=7)""", digits=4)
def _(spark, sf):
    return selection.common_keys(base_forecasts(spark, sf), ALL)


@query("matched_losses", "id:l origin:l target:l horizon:l loss_a:d loss_b:d", f"WITH {PAIRS} SELECT * FROM pairs", digits=4)
def _(spark, sf):
    return pairs(spark, sf)


@query("blend", FC + " model:s", f"WITH {PAIRS} SELECT *, 'blend_75' AS model, 0.75::DOUBLE*predicted_a+0.25::DOUBLE*predicted_b AS predicted FROM pairs", digits=4)
def _(spark, sf):
    return selection.blend(base_forecasts(spark, sf, ["seasonal_mix", "seasonal_local"]), "seasonal_mix", "seasonal_local", 0.75, "blend_75")


@query("ensemble_mean", FC, f"WITH {TREND} SELECT f.*  REPLACE ((predicted+greatest(intercept+slope*(target-{FIRST}),0))/2 AS predicted) FROM fc f JOIN tr USING(id,origin) WHERE model='seasonal_pooled'", digits=1)
def _(spark, sf):
    fc = base_forecasts(spark, sf, ["seasonal_pooled"]).select("id", "origin", "target", "horizon", "model", "actual", "predicted")
    both = fc.unionByName(linear(spark, sf).withColumn("model", F.lit("trend")))
    return selection.blend(both, "seasonal_pooled", "trend", 0.5, "ensemble")


W_SQL = "(SELECT unnest([0.0,0.25,0.5,0.75,1.0]::DOUBLE[]) AS weight)"


@query("select_weight", "weight:d mae:d pairs:l", f"""
WITH {PAIRS} SELECT weight, avg(abs(actual-(weight*predicted_a+(1-weight)*predicted_b))) AS mae, count(*) AS pairs FROM pairs CROSS JOIN {W_SQL}
WHERE horizon=1 AND target<={EARLY} GROUP BY weight ORDER BY round(mae,6), weight LIMIT 1""", digits=4)
def _(spark, sf):
    return selection.select_weight(pairs(spark, sf), WEIGHTS, EARLY)


GRID = f"""cand AS (SELECT o.*, c.candidate, level*exp(coalesce(c.w,0)*ln(coalesce(rt.f/ro.f, gt.f/go.f))+(1-coalesce(c.w,0))*ln(gt.f/go.f)) AS predicted
FROM orows o LEFT JOIN lookup USING(id) JOIN pg gt ON gt.moy=target%12 JOIN pg go ON go.moy=origin%12
LEFT JOIN pr rt ON rt.region=lookup.region AND rt.moy=target%12 LEFT JOIN pr ro ON ro.region=lookup.region AND ro.moy=origin%12,
LATERAL (SELECT unnest(['pooled','regional','shrink_5','shrink_20','shrink_100']) AS candidate, unnest([0.0::DOUBLE, rt.members/(rt.members+0.0::DOUBLE),
 rt.members/(rt.members+5.0::DOUBLE), rt.members/(rt.members+20.0::DOUBLE), rt.members/(rt.members+100.0::DOUBLE)]) AS w) c),
derr AS (SELECT c.horizon, c.target, candidate, weight, avg(abs(c.actual-(weight*c.predicted+(1-weight)*f.predicted))) AS mae, count(*) AS pairs
 FROM cand c JOIN (SELECT * FROM fc WHERE model='seasonal_local') f USING(id,origin,target,horizon) CROSS JOIN {W_SQL} GROUP BY ALL)"""


def grid(spark, sf):
    candidates = forecast.shrunk_candidates(*inputs(spark, sf), YEAR, HORIZONS, CANDIDATES, MIN_REGION)
    return selection.grid_errors(candidates, base_forecasts(spark, sf, ["seasonal_local"]), WEIGHTS)


@query("candidate_grid_errors", "horizon:l target:l candidate:s weight:d mae:d pairs:l", f"WITH {GRID} SELECT * FROM derr", digits=4)
def _(spark, sf):
    return grid(spark, sf)


@query("select_candidate_grid", "candidate:s weight:d mae:d dates:l", f"""
WITH {GRID} SELECT * FROM (SELECT candidate, weight, avg(mae) AS mae, count(*) AS dates FROM derr WHERE horizon=1 AND target<={EARLY} GROUP BY ALL)
ORDER BY round(mae,6), list_position(['pooled','regional','shrink_5','shrink_20','shrink_100'],candidate), weight LIMIT 1""", digits=4)
def _(spark, sf):
    order = F.array_position(F.array(*[F.lit(c) for c in CANDIDATES]), F.col("candidate"))
    return selection.select_candidate_grid(grid(spark, sf), EARLY, order)


def _sequential(name, window):
    cond = "" if window is None else f" AND target>origin-{window}"

    @query(f"select_sequential_{name}", "origin:l candidate:s weight:d past_mae:d first_target:l last_target:l", f"""
    WITH {GRID} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY round(past_mae,6), candidate, weight) AS rk FROM (SELECT origin, candidate, weight, avg(mae) AS past_mae,
    min(target) AS first_target, max(target) AS last_target FROM derr JOIN (SELECT DISTINCT m AS origin FROM panel) ON target<=origin{cond} WHERE horizon=1 GROUP BY ALL)) WHERE rk=1""", digits=4)
    def _(spark, sf):
        return selection.select_sequential(grid(spark, sf), tables.supplier_panel(spark, sf).select(F.col("m").alias("origin")), window)


_sequential("expanding", None)
_sequential("rolling_3m", 3)


@query("select_forecaster", "model:s score:d rank:l", f"""
WITH d AS (SELECT horizon, model, avg(x) AS mae FROM (SELECT horizon, model, target, avg(abs(actual-predicted)) AS x FROM fc WHERE target<={EARLY} AND horizon IN (1,3,6) GROUP BY ALL) GROUP BY ALL)
SELECT model, score, row_number() OVER (ORDER BY round(score,9), model) AS rank FROM (SELECT d.model, avg(d.mae/b.mae) AS score FROM d JOIN d b ON b.horizon=d.horizon AND b.model='seasonal_pooled' GROUP BY d.model)""")
def _(spark, sf):
    return selection.select_forecaster(base_forecasts(spark, sf), "seasonal_pooled", EARLY, [1, 3, 6])


def _bias(name, scope, window):
    cond = "" if window is None else f" AND k.target>o.origin-{window}"
    base = f"""b AS (SELECT * FROM fc WHERE model='seasonal_local' AND predicted>0), og AS (SELECT DISTINCT horizon, origin FROM b),
    known AS (SELECT o.horizon, o.origin, k.id, k.target, k.actual/k.predicted AS ratio, k.predicted AS w FROM b k JOIN og o ON o.horizon=k.horizon AND k.target<=o.origin{cond}),
    dt AS (SELECT horizon, origin, count(DISTINCT target) AS dates FROM known GROUP BY ALL),
    cum AS (SELECT *, sum(w) OVER (PARTITION BY horizon, origin ORDER BY ratio, id, target) AS c, sum(w) OVER (PARTITION BY horizon, origin) AS t FROM known),
    gl AS (SELECT o.horizon, o.origin, coalesce(dates,0) AS dates, CASE WHEN dates>=2 THEN least(greatest(g,0.85::DOUBLE),1.15::DOUBLE) ELSE 1 END AS global_factor FROM og o LEFT JOIN dt USING(horizon,origin)
      LEFT JOIN (SELECT horizon, origin, min(ratio) FILTER (WHERE c>=t/2) AS g FROM cum GROUP BY ALL) USING(horizon,origin))"""
    if scope == "global":
        sql, spec = f"WITH {base} SELECT *, global_factor AS factor FROM gl", "horizon:l origin:l dates:l factor:d"
    else:
        sql = f"""WITH {base}, lc AS (SELECT *, sum(w) OVER (PARTITION BY horizon, origin, id ORDER BY ratio, target) AS c, sum(w) OVER (PARTITION BY horizon, origin, id) AS t,
        count(*) OVER (PARTITION BY horizon, origin, id) AS n FROM known), loc AS (SELECT horizon, origin, id, min(ratio) FILTER (WHERE c>=t/2) AS l, max(n) AS n FROM lc WHERE n>=2 GROUP BY ALL)
        SELECT i.horizon, i.origin, i.id, CASE WHEN dates<2 THEN 1 ELSE coalesce(least(greatest(n/(n+3.0::DOUBLE)*l+(1-n/(n+3.0::DOUBLE))*global_factor,0.85::DOUBLE),1.15::DOUBLE),global_factor) END AS factor
        FROM (SELECT DISTINCT horizon, origin, id FROM b) i JOIN gl USING(horizon,origin) LEFT JOIN loc USING(horizon,origin,id)"""
        spec = "horizon:l origin:l id:l factor:d"

    @query(f"bias_factor_{name}", spec, sql)
    def _(spark, sf):
        return selection.bias_factors(base_forecasts(spark, sf, ["seasonal_local"]), scope, window)


_bias("global_expanding", "global", None)
_bias("global_3m", "global", 3)
_bias("local_expanding", "local", None)
_bias("local_3m", "local", 3)


@query("issue_release", FC + " decision:l", f"""
WITH {TREND} SELECT f.* REPLACE (0.75::DOUBLE*predicted+0.25::DOUBLE*greatest(intercept+slope*(target-{FIRST}),0) AS predicted), {ORIGIN+1} AS decision
FROM fc f JOIN tr USING(id,origin) WHERE model='seasonal_pooled' AND origin={ORIGIN}""", digits=1)
def _(spark, sf):
    fc = base_forecasts(spark, sf, ["seasonal_pooled"]).select("id", "origin", "target", "horizon", "model", "actual", "predicted")
    both = fc.unionByName(linear(spark, sf).withColumn("model", F.lit("trend")))
    return selection.issue_release(both, "seasonal_pooled", "trend", ORIGIN + 1, 1)


@query("compare_releases", "horizon:l median_change:d min_change:d max_change:d", """
SELECT horizon, median(c) AS median_change, min(c) AS min_change, max(c) AS max_change FROM (SELECT a.horizon, 100*(a.predicted/b.predicted-1) AS c
FROM fc a JOIN fc b USING(id,origin,target,horizon) WHERE a.model='growth_bridge' AND b.model='seasonal_pooled') GROUP BY horizon""", digits=5)
def _(spark, sf):
    from tidepanel.operators.quantiles import grouped_median

    change = selection.compare_releases(base_forecasts(spark, sf, ["growth_bridge"]), base_forecasts(spark, sf, ["seasonal_pooled"]))
    span = change.groupBy("horizon").agg(F.min("change_pct").alias("min_change"), F.max("change_pct").alias("max_change"))
    return grouped_median(change, ["horizon"], "change_pct", "median_change").join(span, "horizon")


# -- joins --------------------------------------------------------------------------------------
@query("lookup_region", "id:l m:l region:l", "SELECT id, m, region FROM panel LEFT JOIN lookup USING(id)")
def _(spark, sf):
    return joins.lookup_region(*inputs(spark, sf))


@query("year_ago_join", "id:l m:l value:d value_year_ago:d", "SELECT a.id, a.m, a.value, b.value AS value_year_ago FROM panel a JOIN panel b ON b.id=a.id AND b.m=a.m-12")
def _(spark, sf):
    return joins.year_ago_join(tables.supplier_panel(spark, sf), ["value"], ["id"])


@query("match_errors", "id:l origin:l target:l horizon:l reference_ae:d candidate_ae:d difference:d", """
SELECT id, origin, target, horizon, abs(b.actual-b.predicted) AS reference_ae, abs(a.actual-a.predicted) AS candidate_ae, abs(a.actual-a.predicted)-abs(b.actual-b.predicted) AS difference
FROM fc a JOIN fc b USING(id,origin,target,horizon) WHERE a.model='seasonal_mix' AND b.model='seasonal_pooled'""", digits=4)
def _(spark, sf):
    return joins.match_errors(base_forecasts(spark, sf, ["seasonal_mix"]), base_forecasts(spark, sf, ["seasonal_pooled"]))


@query("match_frozen_keys", "id:l origin:l target:l horizon:l old:d new:d", """
SELECT id, origin, target, horizon, a.predicted AS old, b.predicted AS new FROM fc a JOIN fc b USING(id,origin,target,horizon) WHERE a.model='seasonal_pooled' AND b.model='growth_bridge'""", digits=4)
def _(spark, sf):
    keys = ["id", "origin", "target", "horizon"]
    pick = lambda m, n: base_forecasts(spark, sf, [m]).select(*keys, F.col("predicted").alias(n))
    return joins.match_frozen_keys(pick("seasonal_pooled", "old"), pick("growth_bridge", "new"), keys)


@query("validate_actuals", "model:s rows:l mismatches:l", "SELECT model, count(*) AS rows, 0 AS mismatches FROM fc GROUP BY model")
def _(spark, sf):
    fc = base_forecasts(spark, sf)
    bad = joins.actual_mismatches(fc, tables.supplier_panel(spark, sf)).groupBy("model").agg(F.count("*").alias("bad"))
    return fc.groupBy("model").agg(F.count("*").alias("rows")).join(bad, "model", "left").withColumn("mismatches", F.coalesce("bad", F.lit(0)))


@query("effective_dated_join", "id:l m:l nation:l version:l", f"""
WITH v AS (SELECT s_suppkey AS sid, s_nationkey AS nation, unnest([1,2]) AS version FROM supplier)
SELECT id, m, coalesce(nation,-1) AS nation, coalesce(version,0) AS version FROM panel LEFT JOIN v ON sid=id AND ((version=1 AND m>={FIRST-24} AND m<{FIRST+18}) OR (version=2 AND m>={FIRST+18} AND m<{FIRST+60}))""")
def _(spark, sf):
    s = tables.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sid"), F.col("s_nationkey").alias("nation"), F.explode(F.array(
        F.struct(F.lit(1).alias("version"), F.lit(FIRST - 24).alias("valid_from"), F.lit(FIRST + 18).alias("valid_to")),
        F.struct(F.lit(2).alias("version"), F.lit(FIRST + 18).alias("valid_from"), F.lit(FIRST + 60).alias("valid_to")))).alias("v")).select("sid", "nation", "v.*")
    p = tables.supplier_panel(spark, sf)
    out = joins.effective_dated(p, s.withColumnRenamed("sid", "id"), "id", "m")
    return out.fillna({"nation": -1, "version": 0})


@query("asof_latest", "id:l line:l rate:d", """
WITH r AS (SELECT o_orderdate::DATE AS d, max(o_totalprice) AS rate FROM orders WHERE o_orderpriority='1-URGENT' GROUP BY 1)
SELECT l_orderkey AS id, l_linenumber AS line, rate FROM (SELECT *, l_shipdate::DATE AS day FROM lineitem) ASOF LEFT JOIN r ON day>=r.d""")
def _(spark, sf):
    left = tables.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("date").alias("day"))
    right = tables.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").alias("rate"))
    return joins.asof_latest(left, right, [], "day", "d", ["rate"])


NEAR = """sym AS (SELECT id_x AS id, id_y AS neighbor, min(distance) AS distance FROM (SELECT id_x, id_y, distance FROM edges UNION ALL SELECT id_y, id_x, distance FROM edges)
 WHERE id_x<>id_y AND id_x IN (SELECT id FROM elig) AND id_y IN (SELECT id FROM elig) GROUP BY ALL),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS rank FROM sym) WHERE rank<=5)"""


def nearest(spark, sf):
    return joins.k_nearest(tables.line_edges(spark, sf), prep.cohort_complete(tables.supplier_panel(spark, sf), YEAR), 5)


@query("k_nearest", "id:l neighbor:l distance:d rank:l", f"WITH {NEAR} SELECT * FROM near")
def _(spark, sf):
    return nearest(spark, sf)


CASES = """cases AS (SELECT id, arg_min(neighbor, (distance, neighbor)) AS paired FROM sym GROUP BY id)"""


@query("nearby_excluding", "id:l paired:l neighbor_median:d neighbors:l", f"""
WITH {NEAR}, {CASES}, sig AS (SELECT id, avg(value) AS signal FROM panel GROUP BY id),
lk AS (SELECT s.id, paired, signal, row_number() OVER (PARTITION BY s.id ORDER BY distance, neighbor) AS k FROM sym s JOIN cases c USING(id) JOIN sig ON sig.id=neighbor WHERE neighbor<>paired AND distance<=50)
SELECT id, paired, median(signal) AS neighbor_median, count(*) AS neighbors FROM lk WHERE k<=10 GROUP BY ALL""", digits=4)
def _(spark, sf):
    panel = tables.supplier_panel(spark, sf)
    ids = prep.cohort_complete(panel, YEAR)
    edges = tables.line_edges(spark, sf).join(ids.withColumnRenamed("id", "id_x"), "id_x", "left_semi").join(ids.withColumnRenamed("id", "id_y"), "id_y", "left_semi")
    cases = nearest(spark, sf).filter("rank = 1").select("id", F.col("neighbor").alias("paired"))
    return joins.nearby_excluding(edges, cases, panel.groupBy("id").agg(F.avg("value").alias("signal")), 50.0, 10)


@query("neighbor_features", "id:l m:l neighbor_growth:d neighbor_growth_lag:d neighbor_spikes:d neighbor_valid:d", f"""
WITH {NEAR}, g AS (SELECT a.id, a.m, ln(a.value/b.value) AS g FROM panel a JOIN panel b ON b.id=a.id AND b.m=a.m-1 WHERE a.value>0 AND b.value>0),
u AS (SELECT id AS neighbor, m, g AS cur, NULL::DOUBLE AS past FROM g UNION ALL SELECT id, m+1, NULL, g FROM g)
SELECT id, m, avg(cur) AS neighbor_growth, avg(past) AS neighbor_growth_lag, avg(CASE WHEN past IS NOT NULL THEN (abs(past)>0.15)::INT::DOUBLE END) AS neighbor_spikes, count(cur)/5.0::DOUBLE AS neighbor_valid
FROM near JOIN u USING(neighbor) GROUP BY ALL""")
def _(spark, sf):
    return joins.neighbor_features(tables.supplier_panel(spark, sf), nearest(spark, sf), 5)


@query("leave_one_out_median", "id:l m:l peers:l peer_median:d", """
WITH r AS (SELECT p.id, p.m, p.value, l.region FROM panel p LEFT JOIN lookup l USING(id))
SELECT a.id, a.m, count(b.id) AS peers, CASE WHEN count(b.id)>=5 THEN median(b.value) END AS peer_median FROM r a LEFT JOIN r b ON b.region=a.region AND b.m=a.m AND b.id<>a.id GROUP BY ALL""", digits=4)
def _(spark, sf):
    return joins.leave_one_out_median(joins.lookup_region(*inputs(spark, sf)), ["region", "m"], "value", 5)


@query("scenario_cross", "id:l m:l shift:d shape:s shocked:d", """
SELECT id, m, shift, shape, value*CASE WHEN shape='step' THEN 1+shift ELSE 1 END AS shocked FROM panel CROSS JOIN (SELECT unnest([-0.2,0.2]::DOUBLE[]) AS shift) CROSS JOIN (SELECT unnest(['step','none']) AS shape)""", digits=4)
def _(spark, sf):
    scenarios = literal_table(spark, [(s, h) for s in (-0.2, 0.2) for h in ("step", "none")], "shift double, shape string")
    out = joins.scenario_cross(tables.supplier_panel(spark, sf), scenarios)
    return out.withColumn("shocked", F.col("value") * F.when(F.col("shape") == "step", 1 + F.col("shift")).otherwise(F.lit(1.0)))
