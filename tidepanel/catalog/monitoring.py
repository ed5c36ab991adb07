"""Queries for signals, detectors, thresholds, alarms and injected-shock back-tests."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.common import base_forecasts
from tidepanel.catalog.forecasts import inputs
from tidepanel.catalog.kit import FIRST, LAST, MIN_REGION, YEAR, query
from tidepanel.functions import scalars
from tidepanel.schema import DetectorSettings
from tidepanel.operators import backtest, detectors, forecast, prep, signals
from tidepanel.operators.quantiles import bounded_median
from tidepanel.sources import tables

CAL = (FIRST + 12, FIRST + 23)
ONSET = 12 * 1999
SPAN = 6
BT_CAL = (FIRST + 12, ONSET - 1)
WATCH = FIRST + 24
LN105 = "ln(1.05::DOUBLE)"


def growth_sql(rel, keys="", last=None, name="gr"):
    k = f"{keys}, " if keys else ""
    on = "".join(f" AND {{a}}.{c.strip()}=s.{c.strip()}" for c in keys.split(",") if c.strip())
    stop = "max(m)" if last is None else str(last)
    return f"""{name} AS (SELECT {', '.join('s.' + c.strip() for c in keys.split(',') if c.strip()) + ', ' if keys else ''}s.id, s.m, CASE WHEN a.value>0 AND b.value>0 THEN ln(a.value/b.value) END AS growth
 FROM (SELECT {k}id, unnest(range(a, b)) AS m FROM (SELECT {k}id, min(m)+12 AS a, {stop}+1 AS b FROM {rel} GROUP BY {k}id)) s
 LEFT JOIN {rel} a ON a.id=s.id AND a.m=s.m{on.format(a='a')} LEFT JOIN {rel} b ON b.id=s.id AND b.m=s.m-12{on.format(a='b')})"""


def level_sql(cal, keys="", src="gr", name="zz"):
    k = f"{keys}, " if keys else ""
    u = f"{k}id"
    return f"""{name}c AS (SELECT *, growth - median(growth) OVER (PARTITION BY {k}m) AS z0 FROM {src}),
{name} AS (SELECT c.* EXCLUDE (growth, z0), z0 - base AS z FROM {name}c c JOIN (SELECT {u}, median(z0) AS base FROM {name}c WHERE m BETWEEN {cal[0]} AND {cal[1]} GROUP BY ALL) USING({u}))"""


def scores_sql(rel, keys, name="sc"):
    """Four detector scores per unit; runs are islands of observed months."""
    return f"""{name}r AS (SELECT *, m - row_number() OVER (PARTITION BY {keys} ORDER BY m) AS isl FROM {rel} WHERE z IS NOT NULL),
{name}w AS (SELECT *, avg(z) OVER (PARTITION BY {keys}, isl ORDER BY m ROWS 2 PRECEDING) AS r3, list(z) OVER (PARTITION BY {keys}, isl ORDER BY m) AS zs,
 sum(z-0.025::DOUBLE) OVER (PARTITION BY {keys}, isl ORDER BY m) AS cp, sum(-z-0.025::DOUBLE) OVER (PARTITION BY {keys}, isl ORDER BY m) AS cn FROM {name}r),
{name}v AS (SELECT *, abs(z) AS spike, abs(r3) AS rolling_3m, abs(list_reduce(list_prepend(0.0::DOUBLE, zs), lambda s, x: 0.45::DOUBLE*x+0.55::DOUBLE*s)) AS ewma,
 greatest(cp-least(0, min(cp) OVER (PARTITION BY {keys}, isl ORDER BY m)), cn-least(0, min(cn) OVER (PARTITION BY {keys}, isl ORDER BY m))) AS cusum FROM {name}w),
{name} AS (SELECT r.*, v.spike, v.rolling_3m, v.ewma, v.cusum FROM {rel} r LEFT JOIN {name}v v USING({keys}, m)),
{name}m AS (SELECT * EXCLUDE (spike, rolling_3m, ewma, cusum), z IS NOT NULL AS observed FROM {name}, LATERAL (SELECT unnest(['spike','rolling_3m','ewma','cusum']) AS method, unnest([spike,rolling_3m,ewma,cusum]) AS score))"""


BASE = f"{growth_sql('panel')}, {level_sql(CAL)}"
SC = f"{BASE}, {scores_sql('zz', 'id')}"
TH = f"""th AS (SELECT method, quantile_cont(x,0.99) AS threshold, count(*) AS units FROM (SELECT id, method, max(score) AS x FROM scm WHERE m BETWEEN {CAL[0]} AND {CAL[1]} GROUP BY ALL) WHERE x IS NOT NULL GROUP BY method)"""
AL = f"""al AS (SELECT *, coalesce(score>threshold,false) AS active FROM scm JOIN th USING(method)),
ep AS (SELECT *, active AND NOT coalesce(lag(active) OVER (PARTITION BY id, method ORDER BY m), false) AS episode FROM al)"""


def growth(spark, sf):
    return signals.yoy_log(tables.supplier_panel(spark, sf))


def level_signal(spark, sf):
    return signals.signal_yoy_level(growth(spark, sf), CAL)


def wide_scores(spark, sf):
    return detectors.scores(level_signal(spark, sf), ["id"])


def method_scores(spark, sf):
    return detectors.by_method(wide_scores(spark, sf), ["id"])


def alarm_rows(spark, sf):
    rows = method_scores(spark, sf)
    limits = detectors.threshold_unit_max(rows, ["id"], CAL, 0.99).select("method", "threshold")
    return detectors.alarm_episodes(detectors.alarms(rows.join(F.broadcast(limits), "method")), ["id", "method"])  # one row per method


@query("signal_yoy_level", "id:l m:l z:d", f"WITH {BASE} SELECT * FROM zz")
def _(spark, sf):
    return level_signal(spark, sf)


@query("signal_yoy_linear", "id:l m:l z:d", f"""
WITH {growth_sql('panel')}, c AS (SELECT *, growth - median(growth) OVER (PARTITION BY m) AS z0 FROM gr),
l AS (SELECT id, regr_slope(z0, m-{CAL[0]}) AS b, regr_intercept(z0, m-{CAL[0]}) AS a FROM c WHERE m BETWEEN {CAL[0]} AND {CAL[1]} GROUP BY id)
SELECT id, m, z0-a-b*(m-{CAL[0]}) AS z FROM c JOIN l USING(id)""")
def _(spark, sf):
    return signals.signal_yoy_linear(growth(spark, sf), CAL)


@query("signal_levels", "level:s unit:s m:l z:d", f"""
WITH {growth_sql('panel')}, e AS (SELECT region FROM gr JOIN lookup USING(id) WHERE region IS NOT NULL GROUP BY region HAVING count(DISTINCT id)>={MIN_REGION}),
r AS (SELECT gr.*, region, median(growth) OVER (PARTITION BY region, m) AS rm FROM gr JOIN lookup USING(id) WHERE region IN (SELECT region FROM e))
SELECT 'local' AS level, id::VARCHAR AS unit, m, growth-rm AS z FROM r WHERE rm IS NOT NULL UNION ALL SELECT DISTINCT 'regional', region::VARCHAR, m, rm FROM r WHERE rm IS NOT NULL
UNION ALL SELECT 'national', 'panel', m, median(growth) FROM gr GROUP BY m HAVING count(growth)>0""")
def _(spark, sf):
    return signals.signal_levels(growth(spark, sf), tables.supplier_lookup(spark, sf), MIN_REGION)


RES = """own AS (SELECT id, region, target AS m, CASE WHEN actual>0 AND predicted>0 THEN ln(actual/predicted) END AS own FROM fc WHERE model='growth_bridge' AND horizon=1),
pe AS (SELECT a.id, a.m, count(b.own) AS peers, CASE WHEN count(b.own)>=5 THEN median(b.own) END AS peer_median FROM own a LEFT JOIN own b ON b.region=a.region AND b.m=a.m AND b.id<>a.id GROUP BY ALL)"""


@query("signal_forecast_residual", "id:l m:l own:d peers:l peer_median:d peer:d", f"WITH {RES} SELECT id, m, own, peers, peer_median, own-peer_median AS peer FROM own JOIN pe USING(id,m)")
def _(spark, sf):
    return signals.forecast_residual(base_forecasts(spark, sf, ["growth_bridge"], [1]))


@query("signal_deseasonal_level", "id:l m:l z:d", "SELECT id, m, ln(value)-ln(f) AS z FROM panel JOIN pg ON moy=m%12")
def _(spark, sf):
    return signals.signal_deseasonal_level(tables.supplier_panel(spark, sf), YEAR)


REL = f"""{growth_sql('panel')}, gl AS (SELECT gr.*, region FROM gr LEFT JOIN lookup USING(id)),
pm AS (SELECT a.id, a.m, CASE WHEN count(b.growth)>=5 THEN median(b.growth) END AS p FROM gl a LEFT JOIN gl b ON b.region=a.region AND b.m=a.m AND b.id<>a.id GROUP BY ALL),
rz AS (SELECT id, m, growth-p AS z0 FROM gl JOIN pm USING(id,m)),
rel AS (SELECT id, m, z0-c AS z FROM rz JOIN (SELECT id, median(z0) AS c FROM rz WHERE m BETWEEN {FIRST+12} AND {FIRST+14} GROUP BY id HAVING count(z0)=3) USING(id))"""


def relative(spark, sf):
    return signals.signal_relative_yoy(growth(spark, sf), tables.supplier_lookup(spark, sf), (FIRST + 12, FIRST + 14))


@query("signal_relative_yoy", "id:l m:l z:d", f"WITH {REL} SELECT * FROM rel")
def _(spark, sf):
    return relative(spark, sf)


MAD = f"""cm AS (SELECT id, median(z) AS c FROM zz WHERE m BETWEEN {CAL[0]} AND {CAL[1]} GROUP BY id HAVING count(z)>0),
md AS (SELECT id, median(abs(z-c)) AS mad FROM zz JOIN cm USING(id) WHERE m BETWEEN {CAL[0]} AND {CAL[1]} AND z IS NOT NULL GROUP BY id)"""


@query("noise_multiplier", "id:l mad:d multiplier:d", f"""
WITH {BASE}, {MAD}, p AS (SELECT greatest(median(mad),0.0001) AS p FROM md) SELECT id, mad, p/greatest(0.5::DOUBLE*mad+0.5::DOUBLE*p,0.0001) AS multiplier FROM md, p""")
def _(spark, sf):
    return signals.noise_scale(level_signal(spark, sf), CAL, 0.5, 0.0001)


@query("prior_sigma", "sigma:d", f"WITH {BASE}, {MAD} SELECT greatest(1.4826::DOUBLE*median(mad),0.02) AS sigma FROM md")
def _(spark, sf):
    return signals.prior_sigma(level_signal(spark, sf), CAL, 1.4826, 0.02)


GAPPY = f"""pz AS (SELECT s.id, s.m, ln(p.value) - a AS z FROM (SELECT id, a, unnest(range(lo, hi+1)) AS m FROM (SELECT id, avg(ln(value)) FILTER (WHERE m<={CAL[1]}) AS a, min(m) FILTER (WHERE m>{CAL[1]}) AS lo, max(m) AS hi FROM parts GROUP BY id)
 WHERE a IS NOT NULL AND lo IS NOT NULL) s LEFT JOIN parts p USING(id,m))"""


def gappy_signal(spark, sf):
    """Log value of every part after the calibration months, around its own mean in them; most months are missing."""
    rows = tables.part_panel(spark, sf).withColumn("x", F.log(scalars.positive_or_null("value")))
    mean = rows.filter(F.col("m") <= CAL[1]).groupBy("id").agg(F.avg("x").alias("a")).filter("a is not null")
    return rows.filter(F.col("m") > CAL[1]).join(mean, "id").select("id", "m", (F.col("x") - F.col("a")).alias("z"))


@query("runs", "id:l m:l run_start:l position:l", f"""
WITH {GAPPY}, r AS (SELECT *, m-row_number() OVER (PARTITION BY id ORDER BY m) AS isl FROM pz WHERE z IS NOT NULL)
SELECT id, m, min(m) OVER (PARTITION BY id, isl) AS run_start, m-min(m) OVER (PARTITION BY id, isl)+1 AS position FROM r""")
def _(spark, sf):
    return detectors.runs(gappy_signal(spark, sf), ["id"])


ISLANDS = "isl AS (SELECT *, m-row_number() OVER (PARTITION BY id ORDER BY m) AS isl FROM pz WHERE z IS NOT NULL)"
RUN = "OVER (PARTITION BY id, isl ORDER BY m"
#: Each score by windows over the islands of observed months: the EWMA as a sum of powers, CUSUM as the rise of a sum above its minimum so far.
ALONE = {
    "spike": f"WITH {GAPPY} SELECT id, m, abs(z) AS score FROM pz",
    "rolling_3m": f"WITH {GAPPY}, {ISLANDS}, w AS (SELECT id, m, abs(avg(z) {RUN} ROWS 2 PRECEDING)) AS score FROM isl) SELECT pz.id, pz.m, score FROM pz LEFT JOIN w USING(id, m)",
    "ewma": f"WITH {GAPPY}, {ISLANDS}, n AS (SELECT *, row_number() {RUN}) AS i FROM isl), w AS (SELECT id, m, abs(0.45::DOUBLE*pow(0.55::DOUBLE,i)*sum(z*pow(0.55::DOUBLE,-i)) {RUN})) AS score FROM n) SELECT pz.id, pz.m, score FROM pz LEFT JOIN w USING(id, m)",
    "cusum": f"WITH {GAPPY}, {ISLANDS}, c AS (SELECT *, sum(z-0.025::DOUBLE) {RUN}) AS p, sum(-z-0.025::DOUBLE) {RUN}) AS n FROM isl), w AS (SELECT id, m, greatest(p-least(0, min(p) {RUN})), n-least(0, min(n) {RUN}))) AS score FROM c) SELECT pz.id, pz.m, score FROM pz LEFT JOIN w USING(id, m)",
}


def _score(method):
    @query(f"score_{method}", "id:l m:l score:d", ALONE[method])
    def _(spark, sf):
        return detectors.scores(gappy_signal(spark, sf), ["id"]).select("id", "m", F.col(method).alias("score"))


for _m in detectors.METHODS:
    _score(_m)


@query("score_cusum_spike", "id:l m:l observed:b score:d", f"""
WITH {SC}, {TH}, t AS (SELECT max(threshold) FILTER (WHERE method='cusum') AS c, max(threshold) FILTER (WHERE method='spike') AS s FROM th)
SELECT id, m, z IS NOT NULL AS observed, CASE WHEN z IS NOT NULL THEN greatest(cusum/c, spike/s) END AS score FROM sc, t""")
def _(spark, sf):
    wide = wide_scores(spark, sf)
    return detectors.cusum_spike(wide, detectors.threshold_unit_max(detectors.by_method(wide, ["id"]), ["id"], CAL, 0.99), ["id"])


@query("threshold_unit_max", "method:s threshold:d units:l", f"WITH {SC}, {TH} SELECT * FROM th")
def _(spark, sf):
    return detectors.threshold_unit_max(method_scores(spark, sf), ["id"], CAL, 0.99)


@query("threshold_per_unit", "id:l method:s threshold:d", f"""
WITH {SC} SELECT id, method, greatest(max(score),{LN105}) AS threshold FROM scm WHERE m BETWEEN {CAL[0]} AND {CAL[1]} GROUP BY ALL HAVING max(score) IS NOT NULL""")
def _(spark, sf):
    return detectors.threshold_per_unit(method_scores(spark, sf), ["id"], CAL)


@query("threshold_pooled", "method:s threshold:d scores:l", f"""
WITH {SC} SELECT method, quantile_cont(score,0.99) AS threshold, count(score) AS scores FROM scm WHERE m BETWEEN {CAL[0]} AND {CAL[1]} AND score IS NOT NULL GROUP BY method""")
def _(spark, sf):
    return detectors.threshold_pooled(method_scores(spark, sf), CAL, 0.99)


@query("alarms", "id:l m:l method:s active:b", f"WITH {SC}, {TH}, {AL} SELECT * FROM al")
def _(spark, sf):
    return alarm_rows(spark, sf)


@query("alarm_episodes", "id:l m:l method:s", f"WITH {SC}, {TH}, {AL} SELECT id, m, method FROM ep WHERE episode")
def _(spark, sf):
    return alarm_rows(spark, sf).filter("episode")


BURDEN = "method:s units:l observed_months:l unavailable_months:l active_months:l episodes:l units_with_alarm:l active_per100:d episodes_per100:d"
BURDEN_SQL = """SELECT method, count(DISTINCT id) AS units, count(*) FILTER (WHERE observed) AS observed_months, count(*) FILTER (WHERE NOT observed) AS unavailable_months, count(*) FILTER (WHERE active) AS active_months,
 count(*) FILTER (WHERE episode) AS episodes, count(DISTINCT id) FILTER (WHERE active) AS units_with_alarm, 100*count(*) FILTER (WHERE active)/count(*) FILTER (WHERE observed) AS active_per100,
 100*count(*) FILTER (WHERE episode)/count(*) FILTER (WHERE observed) AS episodes_per100"""


@query("monitoring_burden", BURDEN, f"WITH {SC}, {TH}, {AL} {BURDEN_SQL} FROM ep WHERE m>={WATCH} GROUP BY method")
def _(spark, sf):
    return detectors.monitoring_burden(alarm_rows(spark, sf).filter(F.col("m") >= WATCH), ["method"])


@query("background_rates", "method:s units:l alarm_rate:d mean_alarm_months:d first_alarm:l", f"""
WITH {SC}, {TH}, {AL} SELECT method, count(*) AS units, avg((a>0)::INT) AS alarm_rate, avg(a) AS mean_alarm_months, min(f) AS first_alarm FROM (SELECT method, id, count(*) FILTER (WHERE active) AS a, min(m) FILTER (WHERE active) AS f FROM al WHERE m>={WATCH} GROUP BY ALL) GROUP BY method""")
def _(spark, sf):
    return backtest.background_rates(alarm_rows(spark, sf).filter(F.col("m") >= WATCH), ["method"], "id")


@query("candidate_alerts", "id:l first_alarm:l max_score:d median_signal:d median_yoy_before:d median_yoy_after:d", f"""
WITH {SC}, {TH}, {AL}, f AS (SELECT id, min(m) FILTER (WHERE active) AS first_alarm, max(score) AS max_score FROM al WHERE method='rolling_3m' AND m>={WATCH} GROUP BY id)
SELECT f.*, (SELECT median(z) FROM zz WHERE zz.id=f.id AND m>={WATCH}) AS median_signal, (SELECT median(100*(exp(growth)-1)) FROM gr WHERE gr.id=f.id AND m<{WATCH} AND m>={CAL[0]}) AS median_yoy_before,
 (SELECT median(100*(exp(growth)-1)) FROM gr WHERE gr.id=f.id AND m>={WATCH}) AS median_yoy_after FROM f WHERE first_alarm IS NOT NULL""")
def _(spark, sf):
    rows = alarm_rows(spark, sf).filter("method = 'rolling_3m'")
    return detectors.candidate_alerts(rows, level_signal(spark, sf), growth(spark, sf), (CAL[0], WATCH - 1), (WATCH, LAST))


@query("peer_residual_monitor", "signal:s " + BURDEN, f"""
WITH {RES}, z1 AS (SELECT 'own' AS signal, id, m, own AS z FROM own UNION ALL SELECT 'peer', id, m, own-peer_median FROM own JOIN pe USING(id,m)),
dn AS (SELECT signal, id, unnest(range(a, b)) AS m FROM (SELECT signal, id, min(m) AS a, max(m)+1 AS b FROM z1 GROUP BY signal, id)), z AS (SELECT d.*, z1.z FROM dn d LEFT JOIN z1 USING(signal,id,m)), {scores_sql('z', 'signal, id')},
th AS (SELECT signal, method, quantile_cont(x,0.99) AS threshold FROM (SELECT signal, id, method, max(score) AS x FROM scm WHERE m BETWEEN {CAL[0]} AND {CAL[1]} GROUP BY ALL) WHERE x IS NOT NULL GROUP BY ALL),
al AS (SELECT *, coalesce(score>threshold,false) AS active FROM scm JOIN th USING(signal,method)), ep AS (SELECT *, active AND NOT coalesce(lag(active) OVER (PARTITION BY signal, id, method ORDER BY m), false) AS episode FROM al)
{BURDEN_SQL.replace('SELECT method', 'SELECT signal, method')} FROM ep WHERE m>={WATCH} GROUP BY signal, method""")
def _(spark, sf):
    from tidepanel.plans.monitoring import peer_monitor

    rows = peer_monitor(base_forecasts(spark, sf, ["growth_bridge"], [1]), CAL)
    return detectors.monitoring_burden(rows.filter(F.col("m") >= WATCH), ["signal", "method"])


LEV = f"""full_ AS (SELECT id FROM panel WHERE m BETWEEN {FIRST} AND {12*2001+5} AND value>0 GROUP BY id HAVING count(*)={12*2001+6-FIRST}),
lv AS (SELECT id, m, ln(value)-ln(f) AS x FROM panel JOIN pg ON moy=m%12 JOIN full_ USING(id) WHERE m<={12*2001+5}),
jt AS (SELECT greatest(quantile_cont(x,0.99),{LN105}) AS threshold FROM (SELECT id, max(abs(d)) AS x FROM (SELECT id, m, x-lag(x) OVER (PARTITION BY id ORDER BY m) AS d FROM lv) WHERE m BETWEEN {FIRST+1} AND {WATCH-1} GROUP BY id))"""
CONFIRM = f"""RECURSIVE {LEV}, st AS (
 SELECT id, m, x, threshold AS t, false AS act, 0 AS cnt, 0.0::DOUBLE AS anchor, 0.0::DOUBLE AS dir, false AS trig, false AS conf, false AS rej FROM lv, jt WHERE m={WATCH-1}
 UNION ALL SELECT id, m, x, t, ab AND NOT (ab AND NOT valid) AND NOT (valid AND c2>=3) AS act, CASE WHEN (ab AND NOT valid) OR (valid AND c2>=3) THEN 0 ELSE c2 END, a2, d2, s2, valid AND c2>=3, ab AND NOT valid FROM (
  SELECT *, CASE WHEN s2 THEN 0 ELSE cnt END + valid::INT AS c2 FROM (SELECT *, ab AND (x-a2)*d2>t AS valid FROM (SELECT *, act OR s2 AS ab, CASE WHEN s2 THEN px ELSE anchor END AS a2, CASE WHEN s2 THEN sign(x-px) ELSE dir END AS d2 FROM (
   SELECT l.id, l.m, l.x, st.x AS px, t, act, cnt, anchor, dir, NOT act AND abs(l.x-st.x)>t AS s2 FROM st JOIN lv l ON l.id=st.id AND l.m=st.m+1))))"""


def confirmations(spark, sf):
    panel = tables.supplier_panel(spark, sf)
    stop = 12 * 2001 + 5
    from tidepanel.operators.quantiles import grouped_quantile

    # The profile comes from every id complete in the profile year, the monitored ids from the balanced cohort.
    levels = signals.signal_deseasonal_level(panel, YEAR).join(prep.cohort_balanced(panel, FIRST, stop), "id", "left_semi").filter(F.col("m") <= stop).withColumnRenamed("z", "x")
    before = levels.select("id", (F.col("m") + 1).alias("m"), F.col("x").alias("px"))
    jumps = levels.filter(F.col("m").between(FIRST + 1, WATCH - 1)).join(before, ["id", "m"]).groupBy("id").agg(F.max(F.abs(F.col("x") - F.col("px"))).alias("j"))
    limit = grouped_quantile(jumps, [], "j", {"q": 0.99}).select(F.greatest("q", F.lit(detectors.EFFECT_FLOOR)).alias("threshold"))
    thresholds = levels.select("id").distinct().crossJoin(F.broadcast(limit))
    return detectors.confirm_shift(levels, ["id"], thresholds, WATCH)


@query("confirm_shift", "id:l m:l event:s direction:d", f"""
WITH {CONFIRM}), st2 AS (SELECT * FROM st)
SELECT id, m, 'trigger' AS event, dir AS direction FROM st2 WHERE trig UNION ALL SELECT id, m, 'confirm', dir FROM st2 WHERE conf UNION ALL SELECT id, m, 'reject', dir FROM st2 WHERE rej
UNION ALL SELECT id, m, 'pending', dir FROM st2 WHERE act AND m={12*2001+5}""")
def _(spark, sf):
    return confirmations(spark, sf)


@query("direction_metrics", "event:s units:l up_rate:d down_rate:d events:l", f"""
WITH {CONFIRM}), e AS (SELECT id, 'trigger' AS event, dir FROM st WHERE trig UNION ALL SELECT id, 'confirm', dir FROM st WHERE conf), n AS (SELECT count(*) AS n FROM full_)
SELECT event, max(n) AS units, count(DISTINCT id) FILTER (WHERE dir>0)/max(n) AS up_rate, count(DISTINCT id) FILTER (WHERE dir<0)/max(n) AS down_rate, count(*) AS events FROM e, n GROUP BY event""")
def _(spark, sf):
    panel = tables.supplier_panel(spark, sf)
    n = prep.cohort_balanced(panel, FIRST, 12 * 2001 + 5).agg(F.count("*").alias("units"))
    e = confirmations(spark, sf).filter(F.col("event").isin("trigger", "confirm"))
    out = e.groupBy("event").agg(F.count_distinct(F.when(F.col("direction") > 0, F.col("id"))).alias("u"), F.count_distinct(F.when(F.col("direction") < 0, F.col("id"))).alias("d"), F.count("*").alias("events"))
    return out.crossJoin(F.broadcast(n)).withColumn("up_rate", F.col("u") / F.col("units")).withColumn("down_rate", F.col("d") / F.col("units"))


@query("window_detection", "method:s active_per100:d any_alarm:d window_alarm:d", f"""
WITH {SC}, {TH}, {AL} SELECT method, 100*avg(s) AS active_per100, avg(a) AS any_alarm, avg(w) AS window_alarm FROM (SELECT id, method, avg(active::INT) AS s, max(active::INT) AS a, max(active::INT) FILTER (WHERE m BETWEEN {ONSET} AND {ONSET+1}) AS w FROM al WHERE m>={WATCH} GROUP BY ALL) GROUP BY method""")
def _(spark, sf):
    return detectors.window_detection(alarm_rows(spark, sf), ["method"], (WATCH, LAST), (ONSET, ONSET + 1), ["id"], F.lit(True))


def bocpd_sql(rel: str, sigma: str, name: str = "bo") -> str:
    """Run posteriors of observed rows (id, m, z), one row a step: log weight, mean and scale of every length. Needs WITH RECURSIVE."""
    s = DetectorSettings()
    density = lambda mean, scale, n: (f"(lgamma({s.bocpd_alpha}+({n})/2.0+0.5)-lgamma({s.bocpd_alpha}+({n})/2.0)-0.5*ln(2*({s.bocpd_alpha}+({n})/2.0)*pi())-0.5*ln({scale}*(1+1.0/({s.bocpd_kappa}+({n})))/({s.bocpd_alpha}+({n})/2.0))"  # noqa: E731
                                      f"-({s.bocpd_alpha}+({n})/2.0+0.5)*ln(1+(z-{mean})*(z-{mean})/(2*({s.bocpd_alpha}+({n})/2.0)*({scale}*(1+1.0/({s.bocpd_kappa}+({n})))/({s.bocpd_alpha}+({n})/2.0)))))")
    mean = lambda mean, n: f"({mean}+(z-{mean})/({s.bocpd_kappa}+({n})+1.0))"
    scale = lambda mean, scale, n: f"({scale}+0.5*(1-1.0/({s.bocpd_kappa}+({n})+1.0))*(z-{mean})*(z-{mean}))"
    mu, fresh = f"{s.bocpd_mu}::DOUBLE", f"({sigma})*({sigma})"
    begin = f"[{mean(mu, 0)}]", f"[{scale(mu, fresh, 0)}]"
    grown = f"list_prepend({mean(mu, 0)}, list_transform(mu, lambda v, n: {mean('v', 'n')}))", f"list_prepend({scale(mu, fresh, 0)}, list_transform(mu, lambda v, n: {scale('v', 'sc[n]', 'n')}))"
    joint = f"list_prepend(ln({s.bocpd_hazard!r}::DOUBLE)+{density(mu, fresh, 0)}, list_transform(lp, lambda v, n: v+ln(1-{s.bocpd_hazard!r}::DOUBLE)+{density('mu[n]', 'sc[n]', 'n')}))"
    return f"""{name}l AS (SELECT id, m, z::DOUBLE AS z, row_number() OVER (PARTITION BY id ORDER BY m) AS i FROM {rel} WHERE z IS NOT NULL),
{name} AS (SELECT id, i, m, NULL::DOUBLE AS score, [0.0::DOUBLE] AS lp, {begin[0]} AS mu, {begin[1]} AS sc FROM {name}l WHERE i=1
 UNION ALL SELECT id, i, m, CASE WHEN goes THEN exp(jt[1]-tot) END, CASE WHEN goes THEN list_transform(jt, lambda v: v-tot) ELSE [0.0::DOUBLE] END, CASE WHEN goes THEN {grown[0]} ELSE {begin[0]} END, CASE WHEN goes THEN {grown[1]} ELSE {begin[1]} END
 FROM (SELECT *, list_max(jt)+ln(list_sum(list_transform(jt, lambda v: exp(v-list_max(jt))))) AS tot FROM (SELECT l.id, l.i, l.m, z, lp, mu, sc, l.m=b.m+1 AS goes, {joint} AS jt FROM {name} b JOIN {name}l l ON l.id=b.id AND l.i=b.i+1)))"""


@query("score_bocpd", "id:l m:l z:d score:d", f"""
WITH RECURSIVE {BASE}, {MAD}, sg AS (SELECT greatest(1.4826::DOUBLE*median(mad),0.02) AS sigma FROM md), {bocpd_sql('zz', 'SELECT sigma FROM sg')} SELECT zz.id, zz.m, zz.z, score FROM zz LEFT JOIN bo USING(id, m)""")
def _(spark, sf):
    s = level_signal(spark, sf)
    return detectors.score_bocpd(s, ["id"], signals.prior_sigma(s, CAL, 1.4826, 0.02))


#: The prefix sums of a scaled series and, month by month, the least cost F and last start B of every prefix; then the way back.
PENALTIES = (2.0, 8.0, 16.0, 32.0)
SEGMENTS = f"""RECURSIVE {BASE}, {MAD}, sg AS (SELECT greatest(1.4826::DOUBLE*median(mad),0.02) AS sigma FROM md),
zv AS (SELECT id, list(m ORDER BY m) AS ms, list(z/sigma ORDER BY m) AS zs FROM zz, sg WHERE z IS NOT NULL GROUP BY id),
zp AS (SELECT id, ms, len(zs) AS n, list_prepend(0.0::DOUBLE, list_transform(range(1, len(zs)+1), lambda j: list_sum(zs[1:j]))) AS c1, list_prepend(0.0::DOUBLE, list_transform(range(1, len(zs)+1), lambda j: list_sum(list_transform(zs[1:j], lambda x: x*x)))) AS c2 FROM zv),
pn AS (SELECT unnest([{', '.join(f'{p}::DOUBLE' for p in PENALTIES)}]) AS penalty),
dp AS (SELECT id, penalty, n, c1, c2, 1::BIGINT AS j, [-penalty, 'inf'::DOUBLE] AS f, [0::BIGINT, 0] AS b FROM zp, pn WHERE n>=4
 UNION ALL SELECT id, penalty, n, c1, c2, j+1, list_append(f, list_min(q)+penalty), list_append(b, list_position(q, list_min(q))-1) FROM (
  SELECT *, list_transform(range(0, j), lambda i: f[i+1] + CASE WHEN i=1 THEN 'inf'::DOUBLE ELSE c2[j+2]-c2[i+1]-(c1[j+2]-c1[i+1])*(c1[j+2]-c1[i+1])/(j+1-i) END) AS q FROM dp WHERE j<n)),
wb AS (SELECT id, penalty, b[n+1] AS j, b, ms FROM dp JOIN zp USING(id, n) WHERE dp.j=n UNION ALL SELECT id, penalty, b[j+1], b, ms FROM wb WHERE j>0 AND b[j+1]>0)"""


def sigma(spark, sf):
    return signals.prior_sigma(level_signal(spark, sf), CAL, 1.4826, 0.02)


@query("offline_changepoints_l2", "id:l penalty:d m:l", f"WITH {SEGMENTS} SELECT id, penalty, ms[j+1] AS m FROM wb WHERE j>0")
def _(spark, sf):
    return detectors.offline_changepoints(level_signal(spark, sf), ["id"], list(PENALTIES), sigma(spark, sf))


@query("offline_changepoints_rbf", "id:l penalty:d m:l")
def _(spark, sf):
    return detectors.offline_changepoints(level_signal(spark, sf), ["id"], [2.0, 8.0], sigma(spark, sf), "rbf")


@query("penalty_under_budget", "penalty:d alarms:l per100:d passes:b chosen:b", f"""
WITH {SEGMENTS}, ct2 AS (SELECT penalty, count(id) AS alarms FROM pn LEFT JOIN (SELECT * FROM wb WHERE j>0) USING(penalty) GROUP BY penalty), r AS (SELECT *, 100*alarms/(SELECT count(z) FROM zz)::DOUBLE AS per100 FROM ct2)
SELECT penalty, alarms, per100, per100<=4 AS passes, coalesce(penalty=(SELECT min(penalty) FROM r WHERE per100<=4), false) AS chosen FROM r""")
def _(spark, sf):
    s = level_signal(spark, sf)
    found = detectors.offline_changepoints(s, ["id"], list(PENALTIES), sigma(spark, sf))
    return detectors.penalty_under_budget(found, s.agg(F.count("z").alias("months")), list(PENALTIES), 4.0).fillna({"alarms": 0})


@query("least_penalty", "penalty:d alarms:l per100:d")
def _(spark, sf):
    """The same budget by every optimal segmentation; tested against the rates of all penalties on small panels."""
    s = level_signal(spark, sf)
    return detectors.least_penalty(detectors.segmentations(s, ["id"], 1.0, 64.0, sigma(spark, sf)), s.agg(F.count("z").alias("months")), 4.0)


# -- back-tests ---------------------------------------------------------------------------------
SEEDS, SHIFTS, SHAPES = tuple(range(20261001, 20261011)), (-0.2, 0.2), ("step", "pulse", "ramp")
LASTK = ONSET + SPAN - 1
U = "('0x'||substr(sha256(seed||':'||id),1,12))::UBIGINT::DOUBLE/281474976710656"


def bt_sql(seeds=SEEDS, shifts=SHIFTS, shapes=SHAPES, fractions=(0.25,), lead=0, group="", noise=False):
    """Altered panels scored from scratch; ``group`` is a further key (category), ``noise`` scales signals."""
    g, on = (f"{group}, ", f", {group}") if group else ("", "")
    keys, source = f"seed, shift, shape, fraction{on}", "cpanel" if group else "panel"
    raw = "r" if noise else ""
    scale = lambda name, k: f""",
{name} AS (SELECT a.* EXCLUDE (z), z*multiplier AS z FROM {name}r a JOIN nm USING({g}id))""" if noise else ""  # noqa: E731
    mad = f""",
cm AS (SELECT {g}id, median(z) AS c FROM zzr WHERE m BETWEEN {BT_CAL[0]} AND {BT_CAL[1]} GROUP BY ALL HAVING count(z)>0), md AS (SELECT {g}id, median(abs(z-c)) AS mad FROM zzr JOIN cm USING({g}id) WHERE m BETWEEN {BT_CAL[0]} AND {BT_CAL[1]} AND z IS NOT NULL GROUP BY ALL),
nm AS (SELECT {g}id, p/greatest(0.5::DOUBLE*mad+0.5::DOUBLE*p,0.0001) AS multiplier FROM (SELECT *, greatest(median(mad) OVER ({f'PARTITION BY {group}' if group else ''}),0.0001) AS p FROM md))""" if noise else ""
    five = lambda rel, k: f"SELECT {k}id, m, z IS NOT NULL AS observed, unnest(['spike','rolling_3m','ewma','cusum','cusum_spike']) AS method, unnest([spike,rolling_3m,ewma,cusum,CASE WHEN z IS NOT NULL THEN greatest(cusum/tc, spike/ts) END]) AS score FROM {rel} {f'JOIN tp USING({group})' if group else 'CROSS JOIN tp'}"
    return f"""sn AS (SELECT * FROM (SELECT unnest({list(seeds)}::BIGINT[]) AS seed) CROSS JOIN (SELECT unnest({list(shifts)}::DOUBLE[]) AS shift) CROSS JOIN (SELECT unnest({list(shapes)}) AS shape) CROSS JOIN (SELECT unnest({list(fractions)}::DOUBLE[]) AS fraction)),
kn AS (SELECT {source}.* FROM {source} JOIN (SELECT id FROM panel WHERE m BETWEEN {FIRST} AND {ONSET-1} AND value>0 GROUP BY id HAVING count(*)={ONSET-FIRST}) USING(id) WHERE m<={LASTK}),
{growth_sql('kn', group, LASTK)}, {level_sql(BT_CAL, group, name='zz' + raw)}{mad}{scale('zz', g)}, {scores_sql('zz', g + 'id')},
th0 AS (SELECT {g}method, quantile_cont(x,0.99) AS threshold FROM (SELECT {g}id, method, max(score) AS x FROM scm WHERE m BETWEEN {BT_CAL[0]} AND {BT_CAL[1]} GROUP BY ALL) WHERE x IS NOT NULL GROUP BY ALL),
tp AS (SELECT {g}max(threshold) FILTER (WHERE method='cusum') AS tc, max(threshold) FILTER (WHERE method='spike') AS ts FROM th0 {'GROUP BY ' + group if group else ''}), th AS (SELECT * FROM th0 UNION ALL SELECT {g}'cusum_spike', 1.0 FROM tp),
b5 AS ({five('sc', g)}), b4 AS (SELECT {g}id, m, method, observed, threshold, coalesce(score>threshold,false) AS base_alarm FROM b5 JOIN th USING({g}method) WHERE m>={ONSET-lead}),
ch AS (SELECT {keys}, id, m, {U} < fraction AS treated, value*CASE WHEN m>={ONSET} AND {U} < fraction THEN CASE shape WHEN 'step' THEN 1+shift WHEN 'pulse' THEN CASE WHEN m={ONSET} THEN 1+shift ELSE 1 END ELSE 1+shift*(m-{ONSET})/5.0::DOUBLE END ELSE 1 END AS value FROM kn CROSS JOIN sn),
{growth_sql('ch', keys, LASTK, 'cg')}, {level_sql(BT_CAL, keys, 'cg', 'cz' + raw)}{scale('cz', keys)}, {scores_sql('cz', keys + ', id', 'cs')}, c5 AS ({five('cs', keys + ', ')}),
res AS (SELECT {keys}, id, {U} < fraction AS treated, m-{ONSET} AS k, method, b4.observed, base_alarm, coalesce(score>threshold,false) AS changed_alarm, coalesce(score>threshold,false) AND NOT base_alarm AS new_alarm, CASE WHEN shape='ramp' THEN 1 ELSE 0 END AS onset
 FROM c5 JOIN b4 USING({g}id,m,method) WHERE m>={ONSET-lead})"""


SCN = "seed:l shift:d shape:s fraction:d method:s"
SCN_SQL = "seed, shift, shape, fraction, method"
BT = bt_sql()


def cohort_panel(spark, sf):
    panel = tables.supplier_panel(spark, sf)
    return panel.join(prep.cohort_observed_through(panel, FIRST, ONSET - 1), "id", "left_semi")


def results(spark, sf, seeds=SEEDS, shifts=SHIFTS, shapes=SHAPES, fractions=(0.25,), lead=0, form=backtest.path_counts, **kw):
    return form(cohort_panel(spark, sf), backtest.scenario_table(spark, seeds, shifts, shapes, fractions), ONSET, BT_CAL, span=SPAN, lead=lead, **kw)


@query("inject_shock", "seed:l shift:d shape:s fraction:d id:l m:l treated:b value:d", f"WITH {BT} SELECT * FROM ch", digits=3)
def _(spark, sf):
    return backtest.inject_shock(cohort_panel(spark, sf).filter(F.col("m") <= LASTK), backtest.scenario_table(spark, SEEDS, SHIFTS, SHAPES), ONSET, SPAN)


@query("new_alarms", SCN + " id:l treated:b k:l observed:b base_alarm:b changed_alarm:b new_alarm:b", f"WITH {BT} SELECT * FROM res")
def _(spark, sf):
    return results(spark, sf, form=backtest.run)


def category_results(spark, sf, **kw):
    """The cohort of the total, each category with its own medians, thresholds and assignment by id."""
    panel = tables.supplier_category_panel(spark, sf).join(cohort_panel(spark, sf).select("id").distinct(), "id", "left_semi")
    return backtest.path_counts(panel, backtest.scenario_table(spark, SEEDS, SHIFTS, SHAPES), ONSET, BT_CAL, span=SPAN, group=["category"], **kw)


ATTRIBUTION = "new_at_onset:d new_by_second:d new_by_third:d new_any:d later_only:d median_delay:d base_treated:d changed_treated:d base_control:d changed_control:d new_control:d"


def attribution_sql(keys):
    return f"""u AS (SELECT {keys}, id, treated, bool_or(new_alarm AND k=onset) AS a1, bool_or(new_alarm AND k BETWEEN onset AND onset+1) AS a2, bool_or(new_alarm AND k BETWEEN onset AND onset+2) AS a3, bool_or(new_alarm AND k>=onset) AS ev,
 min(k-onset) FILTER (WHERE new_alarm AND k>=onset) AS d, bool_or(base_alarm) AS b, bool_or(changed_alarm) AS c, bool_or(new_alarm) AS n FROM res GROUP BY ALL)
SELECT {keys}, avg(a1::INT) FILTER (WHERE treated) AS new_at_onset, avg(a2::INT) FILTER (WHERE treated) AS new_by_second, avg(a3::INT) FILTER (WHERE treated) AS new_by_third, avg(ev::INT) FILTER (WHERE treated) AS new_any,
 avg((ev AND NOT a1)::INT) FILTER (WHERE treated) AS later_only, median(d) FILTER (WHERE treated) AS median_delay, avg(b::INT) FILTER (WHERE treated) AS base_treated, avg(c::INT) FILTER (WHERE treated) AS changed_treated,
 avg(b::INT) FILTER (WHERE NOT treated) AS base_control, avg(c::INT) FILTER (WHERE NOT treated) AS changed_control, avg(n::INT) FILTER (WHERE NOT treated) AS new_control FROM u GROUP BY ALL"""


@query("attribution_by_category", "category:s " + SCN + " " + ATTRIBUTION, f"WITH {bt_sql(group='category')}, {attribution_sql(SCN_SQL + ', category')}")
def _(spark, sf):
    return backtest.attribution_metrics(category_results(spark, sf))


@query("attribution_noise_scaled", SCN + " " + ATTRIBUTION, f"WITH {bt_sql(noise=True)}, {attribution_sql(SCN_SQL)}")
def _(spark, sf):
    return backtest.attribution_metrics(results(spark, sf, noise=(0.5, 0.0001)))


@query("attribution_metrics", SCN + " " + ATTRIBUTION, f"WITH {BT}, {attribution_sql(SCN_SQL)}")
def _(spark, sf):
    return backtest.attribution_metrics(results(spark, sf))


@query("observed_window_metrics", SCN + " treated_n:l control_n:l observed_first:l new_by_first:d observed_third:l new_by_third:d unobserved_treated_months:l new_control_per100:d base_control_per100:d", f"""
WITH {BT}, u AS (SELECT {SCN_SQL}, id, treated, bool_and(observed OR k<>onset) AS o1, bool_and(observed OR k NOT BETWEEN onset AND onset+2) AS o3, bool_or(new_alarm AND k=onset) AS a1, bool_or(new_alarm AND k BETWEEN onset AND onset+2) AS a3,
 count(*) FILTER (WHERE k>=onset AND NOT observed) AS un, count(*) FILTER (WHERE k>=onset AND observed) AS ob, count(*) FILTER (WHERE k>=onset AND new_alarm) AS nw, count(*) FILTER (WHERE k>=onset AND base_alarm) AS ba FROM res GROUP BY ALL)
SELECT {SCN_SQL}, count(*) FILTER (WHERE treated) AS treated_n, count(*) FILTER (WHERE NOT treated) AS control_n, count(*) FILTER (WHERE treated AND o1) AS observed_first, avg(a1::INT) FILTER (WHERE treated AND o1) AS new_by_first,
 count(*) FILTER (WHERE treated AND o3) AS observed_third, avg(a3::INT) FILTER (WHERE treated AND o3) AS new_by_third, sum(un) FILTER (WHERE treated) AS unobserved_treated_months,
 100*sum(nw) FILTER (WHERE NOT treated)/sum(ob) FILTER (WHERE NOT treated) AS new_control_per100, 100*sum(ba) FILTER (WHERE NOT treated)/sum(ob) FILTER (WHERE NOT treated) AS base_control_per100 FROM u GROUP BY ALL""")
def _(spark, sf):
    return backtest.observed_window_metrics(results(spark, sf))


CALENDAR = f"""cd AS (SELECT {SCN_SQL}, lag, id, treated, any_value(onset) AS onset, bool_and(observed OR k NOT BETWEEN onset AND onset+2) AS ok, bool_or(new_alarm AND observed AND k>=onset AND k+lag<=onset) AS a1, bool_or(new_alarm AND observed AND k>=onset AND k+lag<=onset+1) AS a2,
 bool_or(new_alarm AND observed AND k>=onset AND k+lag<=onset+2) AS a3, min(k+lag-onset) FILTER (WHERE new_alarm AND observed AND k>=onset AND k+lag<=5) AS d, count(*) FILTER (WHERE observed AND k>=onset AND k+lag>5) AS pend,
 count(*) FILTER (WHERE observed AND k>=onset AND k+lag<=5) AS dl, count(*) FILTER (WHERE observed AND k>=onset AND k+lag<=5 AND new_alarm) AS nw, count(*) FILTER (WHERE observed AND k>=onset AND k+lag<=5 AND base_alarm) AS ba
 FROM res CROSS JOIN (SELECT unnest([0,1,2]) AS lag) GROUP BY ALL),
cal AS (SELECT {SCN_SQL}, lag, count(*) FILTER (WHERE treated) AS treated_n, count(*) FILTER (WHERE treated AND ok) AS evaluated_n, avg(a1::INT) FILTER (WHERE treated AND ok) AS new_by_first, avg(a2::INT) FILTER (WHERE treated AND ok) AS new_by_second,
 avg(a3::INT) FILTER (WHERE treated AND ok) AS new_by_third, avg((d IS NOT NULL)::INT) FILTER (WHERE treated AND ok) AS new_by_end, median(d) FILTER (WHERE treated AND ok) AS median_delay, sum(pend) FILTER (WHERE treated) AS pending_months,
 sum(dl) FILTER (WHERE NOT treated) AS delivered_control_months, 100*sum(nw) FILTER (WHERE NOT treated)/sum(dl) FILTER (WHERE NOT treated) AS new_control_per100, 100*sum(ba) FILTER (WHERE NOT treated)/sum(dl) FILTER (WHERE NOT treated) AS base_control_per100 FROM cd GROUP BY ALL)"""


def calendar(spark, sf):
    return backtest.calendar_delay_metrics(results(spark, sf), [0, 1, 2], SPAN)


@query("calendar_delay_metrics", SCN + " lag:l treated_n:l evaluated_n:l new_by_first:d new_by_second:d new_by_third:d new_by_end:d median_delay:d pending_months:l delivered_control_months:l new_control_per100:d base_control_per100:d",
       f"WITH {BT}, {CALENDAR} SELECT * FROM cal")
def _(spark, sf):
    return calendar(spark, sf)


RATES = f"""ru AS (SELECT {SCN_SQL}, id, treated, bool_or(base_alarm) AS b, bool_or(changed_alarm) AS c, min(k) FILTER (WHERE changed_alarm) AS f, bool_or(changed_alarm AND k<1) AS c1, bool_or(changed_alarm AND k<3) AS c3 FROM res GROUP BY ALL),
rr AS (SELECT {SCN_SQL}, count(*) FILTER (WHERE treated) AS treated_n, count(*) FILTER (WHERE NOT treated) AS control_n, avg(c::INT) FILTER (WHERE treated) AS treated_rate, avg(b::INT) FILTER (WHERE treated) AS treated_base_rate,
 avg((c AND NOT b)::INT) FILTER (WHERE treated) AS new_rate, avg(c::INT) FILTER (WHERE treated AND NOT b) AS new_rate_quiet, avg((b AND NOT c)::INT) FILTER (WHERE treated) AS suppressed_rate, avg(c::INT) FILTER (WHERE NOT treated) AS control_rate,
 avg(b::INT) FILTER (WHERE NOT treated) AS control_base_rate, avg(c1::INT) FILTER (WHERE treated) AS by_first, avg(c3::INT) FILTER (WHERE treated) AS by_third, median(f) FILTER (WHERE treated) AS median_delay FROM ru GROUP BY ALL)"""
RATE_COLS = " treated_n:l control_n:l treated_rate:d treated_base_rate:d new_rate:d new_rate_quiet:d suppressed_rate:d control_rate:d control_base_rate:d by_first:d by_third:d median_delay:d"
SCOPE = dict(shifts=(-0.2, 0.2), shapes=("step",), fractions=(0.1, 0.25, 0.5, 0.75, 1.0))


@query("scope_stress", SCN + RATE_COLS, f"WITH {bt_sql(**SCOPE)}, {RATES} SELECT * FROM rr")
def _(spark, sf):
    return backtest.alarm_rates(results(spark, sf, **SCOPE))


@query("shape_robustness", SCN + RATE_COLS + " precision:d", f"""
WITH {BT}, {RATES} SELECT *, CASE WHEN 0.25::DOUBLE*treated_rate+0.75::DOUBLE*control_rate>0 THEN 0.25::DOUBLE*treated_rate/(0.25::DOUBLE*treated_rate+0.75::DOUBLE*control_rate) END AS precision FROM rr""")
def _(spark, sf):
    return backtest.alarm_rates(results(spark, sf))


@query("seed_summary", "shift:d shape:s method:s new_by_third_mean:d new_by_third_min:d new_by_third_max:d", f"""
WITH {BT}, {CALENDAR} SELECT shift, shape, method, avg(new_by_third) AS new_by_third_mean, min(new_by_third) AS new_by_third_min, max(new_by_third) AS new_by_third_max FROM cal WHERE lag=0 GROUP BY ALL""")
def _(spark, sf):
    from tidepanel.operators.accuracy import seed_summary

    return seed_summary(calendar(spark, sf).filter("lag = 0"), ["shift", "shape", "method"], ["new_by_third"])


PARETO_KEYS = "seed, shift, shape, fraction, lag"


@query("pareto_frontier", SCN + " lag:l new_by_third:d base_control_per100:d", f"""
WITH {BT}, {CALENDAR} SELECT a.* FROM cal a WHERE NOT EXISTS (SELECT 1 FROM cal b WHERE b.seed=a.seed AND b.shift=a.shift AND b.shape=a.shape AND b.lag=a.lag AND b.base_control_per100<=a.base_control_per100 AND b.new_by_third>=a.new_by_third
 AND (b.base_control_per100<a.base_control_per100 OR b.new_by_third>a.new_by_third))""")
def _(spark, sf):
    from tidepanel.session import cut_lineage

    table = cut_lineage(calendar(spark, sf), "calendar")
    return backtest.pareto_frontier(table, ["seed", "shift", "shape", "fraction", "lag"], "base_control_per100", "new_by_third")


ENV = f"WITH {BT}, {CALENDAR}, env AS (SELECT shape, method, min(new_by_third) AS detection_min, max(new_by_third) AS detection_max, max(base_control_per100) AS burden_max, count(*) AS scenarios FROM cal GROUP BY ALL)"


@query("scenario_envelope", "shape:s method:s detection_min:d detection_max:d burden_max:d scenarios:l", f"{ENV} SELECT * FROM env")
def _(spark, sf):
    return backtest.scenario_envelope(calendar(spark, sf), ["shape", "method"], "base_control_per100", "new_by_third")


@query("capacity_choice", "shape:s cap:d eligible:s best:d methods:s", f"""
{ENV}, r AS (SELECT env.*, cap, max(detection_min) OVER (PARTITION BY shape, cap) AS best FROM env CROSS JOIN (SELECT unnest([1.0,2.0,10.0]::DOUBLE[]) AS cap) WHERE burden_max<=cap)
SELECT shape, cap, string_agg(method, ',' ORDER BY method) AS eligible, max(best) AS best, string_agg(method, ',' ORDER BY method) FILTER (WHERE detection_min=best) AS methods FROM r GROUP BY ALL""")
def _(spark, sf):
    from tidepanel.session import cut_lineage

    env = backtest.scenario_envelope(calendar(spark, sf), ["shape", "method"], "base_control_per100", "new_by_third")
    return backtest.capacity_choice(cut_lineage(env, "envelope"), ["shape"], [1.0, 2.0, 10.0])


@query("choose_under_capacity", "side:s method:s detection:d burden:d", f"""
WITH {BT}, {CALENDAR}, mm AS (SELECT CASE WHEN seed=20261001 THEN 'selection' ELSE 'evaluation' END AS side, method, avg(new_by_third) AS detection, avg(base_control_per100) AS burden FROM cal WHERE lag=1 AND shape='step' GROUP BY ALL)
SELECT * FROM mm WHERE method IN (SELECT method FROM mm WHERE side='selection' AND burden<=20 AND detection>=0 ORDER BY detection DESC, burden, method LIMIT 1)""")
def _(spark, sf):
    return backtest.choose_under_capacity(calendar(spark, sf).filter("lag = 1 and shape = 'step'"), [20261001], 20.0, 0.0, "new_by_third", "base_control_per100")


LOCAL_SEEDS = list(SEEDS[:3])
LV_KEYS = "scope, scenario, shift, shape"
LV_U = "('0x'||substr(sha256(scenario||':'||{id}),1,12))::UBIGINT::DOUBLE/281474976710656"


def levels_sql(src, keys, name):
    """Panel, regional and local signals of a growth relation, each around its calibration median."""
    k = f"{keys}, " if keys else ""
    return f"""{name}r AS (SELECT g.*, region, median(growth) OVER (PARTITION BY {k}region, m) AS rm FROM {src} g JOIN lookup USING(id) WHERE region IN (SELECT region FROM le)),
{name}l AS (SELECT {k}'local' AS level, id::VARCHAR AS unit, m, growth-rm AS z FROM {name}r WHERE rm IS NOT NULL UNION ALL SELECT DISTINCT {k}'regional', region::VARCHAR, m, rm FROM {name}r WHERE rm IS NOT NULL
 UNION ALL SELECT {k}'national', 'panel', m, median(growth) FROM {src} GROUP BY {k}m HAVING count(growth)>0),
{name} AS (SELECT l.* EXCLUDE (z), z-c AS z FROM {name}l l JOIN (SELECT {k}level, unit, median(z) AS c FROM {name}l WHERE m BETWEEN {BT_CAL[0]} AND {BT_CAL[1]} GROUP BY ALL) USING({k}level, unit))"""


LEVEL_STRESS = f"""kn AS (SELECT panel.* FROM panel JOIN (SELECT id FROM panel WHERE m BETWEEN {FIRST} AND {ONSET-1} AND value>0 GROUP BY id HAVING count(*)={ONSET-FIRST}) USING(id) WHERE m<={LASTK}),
mem AS (SELECT id, region FROM lookup WHERE region IS NOT NULL AND id IN (SELECT id FROM kn)),
scp AS (SELECT 'national' AS scope, 'all' AS scenario UNION ALL SELECT 'local', unnest({[str(x) for x in LOCAL_SEEDS]}) UNION ALL SELECT 'regional', region::VARCHAR FROM (SELECT region FROM mem GROUP BY region HAVING count(*)>={MIN_REGION} ORDER BY count(*) DESC, region LIMIT 3)),
ch AS (SELECT {LV_KEYS}, id, m, value*CASE WHEN m>={ONSET} AND coalesce(scope='national' OR (scope='regional' AND region::VARCHAR=scenario) OR (scope='local' AND {LV_U.format(id='id')}<0.25), false)
  THEN CASE shape WHEN 'step' THEN 1+shift ELSE 1+shift*(m-{ONSET})/5.0::DOUBLE END ELSE 1 END AS value
 FROM kn LEFT JOIN mem USING(id) CROSS JOIN scp CROSS JOIN (SELECT unnest([-0.2,0.2]::DOUBLE[]) AS shift) CROSS JOIN (SELECT unnest(['step','ramp']) AS shape)),
{growth_sql('kn', last=LASTK)}, {growth_sql('ch', LV_KEYS, LASTK, 'cg')},
le AS (SELECT region FROM gr JOIN lookup USING(id) WHERE region IS NOT NULL GROUP BY region HAVING count(DISTINCT id)>={MIN_REGION}),
{levels_sql('gr', '', 'lb')}, {levels_sql('cg', LV_KEYS, 'lc')}, {scores_sql('lb', 'level, unit', 'bs')}, {scores_sql('lc', LV_KEYS + ', level, unit', 'ls')},
lt AS (SELECT level, unit, method, greatest(max(score),{LN105}) AS threshold FROM bsm WHERE m BETWEEN {BT_CAL[0]} AND {BT_CAL[1]} GROUP BY ALL HAVING max(score) IS NOT NULL),
qt AS (SELECT level, unit, method, max(coalesce(score>threshold,false)::INT) AS base FROM bsm JOIN lt USING(level,unit,method) WHERE m>={ONSET} GROUP BY ALL),
fd AS (SELECT {LV_KEYS}, level, unit, method, max(a) AS found, min(CASE WHEN a=1 THEN m-{ONSET} END) AS delay FROM (SELECT lsm.*, coalesce(score>threshold,false)::INT AS a FROM lsm JOIN lt USING(level,unit,method) WHERE m>={ONSET}) GROUP BY ALL),
jd AS (SELECT fd.*, base, coalesce(CASE level WHEN 'national' THEN scope='national' WHEN 'regional' THEN scope='national' OR (scope='regional' AND unit=scenario)
  ELSE scope='national' OR (scope='local' AND {LV_U.format(id='unit')}<0.25) OR (scope='regional' AND region::VARCHAR=scenario) END, false) AS target
 FROM fd JOIN qt USING(level,unit,method) LEFT JOIN (SELECT id::VARCHAR AS unit, region FROM mem) USING(unit))"""


@query("level_stress", "scope:s scenario:s shift:d shape:s level:s method:s intended:b target_units:l control_units:l target_rate:d target_base_rate:d target_new_rate:d control_rate:d median_delay:d", f"""
WITH {LEVEL_STRESS} SELECT {LV_KEYS}, level, method, scope=level AS intended, count(*) FILTER (WHERE target) AS target_units, count(*) FILTER (WHERE NOT target) AS control_units, avg(found) FILTER (WHERE target) AS target_rate,
 avg(base) FILTER (WHERE target) AS target_base_rate, avg((found=1 AND base=0)::INT) FILTER (WHERE target) AS target_new_rate, avg(found) FILTER (WHERE NOT target) AS control_rate, median(delay) FILTER (WHERE target) AS median_delay FROM jd GROUP BY ALL""")
def _(spark, sf):
    return backtest.level_stress(cohort_panel(spark, sf), tables.supplier_lookup(spark, sf), ONSET, BT_CAL, MIN_REGION, [-0.2, 0.2], ["step", "ramp"], LOCAL_SEEDS)


@query("background_by_level", "level:s method:s units:l alarm_rate:d mean_alarm_months:d first_alarm:d", f"""
WITH {LEVEL_STRESS}, bu AS (SELECT level, unit, method, count(*) FILTER (WHERE coalesce(score>threshold,false)) AS a, min(m) FILTER (WHERE score>threshold) AS f FROM bsm JOIN lt USING(level,unit,method) WHERE m>={ONSET} GROUP BY ALL)
SELECT level, method, count(*) AS units, avg((a>0)::INT) AS alarm_rate, avg(a) AS mean_alarm_months, min(f) AS first_alarm FROM bu GROUP BY ALL""")
def _(spark, sf):
    """Unaltered months from the onset on, at each level and with the thresholds of each unit."""
    from tidepanel.session import cut_lineage

    scored = cut_lineage(backtest.level_scores(cohort_panel(spark, sf).filter(F.col("m") <= LASTK), tables.supplier_lookup(spark, sf), BT_CAL, MIN_REGION, LASTK), "level-scores")
    limits = detectors.threshold_per_unit(scored, ["level", "unit"], BT_CAL)
    rows = detectors.alarms(scored.filter(F.col("m") >= ONSET).join(limits, ["level", "unit", "method"]))
    return backtest.background_rates(rows, ["level", "method"], "unit")


@query("induced_error_path", "shift:d k:l induced:d", f"""
WITH a AS (SELECT t.id, t.m, t.value AS v, p.value AS q, gt.f AS ft, go.f AS fo FROM panel t JOIN elig USING(id) JOIN panel p ON p.id=t.id AND p.m=t.m-1 JOIN pg gt ON gt.moy=t.m%12 JOIN pg go ON go.moy=(t.m-1)%12 WHERE t.m BETWEEN {ONSET} AND {LASTK} AND t.value>0 AND p.value>0)
SELECT shift, m-{ONSET} AS k, median(ln(v*(1+shift)/(q*CASE WHEN m-1>={ONSET} THEN 1+shift ELSE 1 END*ft/fo))-ln(v/(q*ft/fo))) AS induced FROM a CROSS JOIN (SELECT unnest([-0.2,0.2]::DOUBLE[]) AS shift) GROUP BY ALL""")
def _(spark, sf):
    panel = tables.supplier_panel(spark, sf)

    def errors(p, extra):
        fc = forecast.frozen_vs_rolling(p, YEAR).filter((F.col("anchor_kind") == "rolling") & F.col("target").between(ONSET, LASTK))
        return fc.select(*extra, "id", (F.col("target") - ONSET).alias("k"), scalars.log_ratio("actual", "predicted").alias("error"))

    base = errors(panel, [])
    changed = None
    for shift in (-0.2, 0.2):  # two settings, each its own altered panel
        p = panel.withColumn("value", F.when(F.col("m") >= ONSET, F.col("value") * (1 + shift)).otherwise(F.col("value")))
        part = errors(p, []).withColumn("shift", F.lit(shift))
        changed = part if changed is None else changed.unionByName(part)
    return backtest.induced_error_path(base, changed, ["shift"])


# -- event matching -----------------------------------------------------------------------------
MATCH_KEYS = ["split", "seed", "method", "shape", "shift", "id"]
MATCH = f"""{bt_sql(lead=1)},
al AS (SELECT seed, shift, shape, method, id, k, changed_alarm AS a FROM res WHERE treated
 UNION ALL SELECT seed, 0::DOUBLE, 'no_change', method, id, k, base_alarm FROM res WHERE NOT treated AND shift={SHIFTS[0]} AND shape='{SHAPES[0]}'),
ep AS (SELECT *, a AND NOT coalesce(lag(a) OVER w AND lag(k) OVER w = k-1, false) AS e FROM al WINDOW w AS (PARTITION BY seed, shift, shape, method, id ORDER BY k)),
u AS (SELECT seed, shift, shape, method, id, count(*) FILTER (WHERE e) AS n, bool_or(e AND k=0) AS f0, bool_or(e AND k=1) AS f1, bool_or(e AND k=2) AS f2 FROM ep WHERE k>=0 GROUP BY ALL),
mc AS (SELECT *, CASE shape WHEN 'no_change' THEN 0 WHEN 'step' THEN (f0 OR f1)::INT WHEN 'ramp' THEN (f0 OR f1 OR f2)::INT ELSE least(2, f0::INT+f1::INT+f2::INT) END AS tp, CASE shape WHEN 'no_change' THEN 0 WHEN 'pulse' THEN 2 ELSE 1 END AS nt,
 CASE shape WHEN 'no_change' THEN 0 WHEN 'ramp' THEN (f0 OR f1 OR f2)::INT ELSE (f0 OR f1)::INT END AS onset_tp, CASE WHEN shape='pulse' THEN (CASE WHEN f0 THEN f1 OR f2 ELSE f2 END)::INT ELSE 0 END AS neutral FROM u),
me AS (SELECT CASE WHEN seed={SEEDS[0]} THEN 'selection' ELSE 'evaluation' END AS split, seed, method, shape, shift, id, tp, n-tp AS fp, nt-tp AS fn, onset_tp, n-onset_tp-neutral AS onset_fp, least(nt,1)-onset_tp AS onset_fn FROM mc)"""


def matched(spark, sf, form=backtest.unit_paths):
    """Alarm episodes from the onset on against the injected boundaries, per unit and scenario; per path with ``n`` units from ``path_counts``.

    An episode that began the month before the onset is none at the onset. Untreated units are scored once a seed, on the
    unaltered panel, as ``no_change``.
    """
    rows = results(spark, sf, lead=1, form=form)
    control = ~F.col("treated")
    rows = rows.filter(F.col("treated") | ((F.col("shift") == SHIFTS[0]) & (F.col("shape") == SHAPES[0])))
    active = F.transform("path", lambda p: F.when(control, p["base_alarm"]).otherwise(p["changed_alarm"]))
    begins = F.filter(F.sequence(F.lit(0), F.lit(SPAN - 1)), lambda k: F.get("_a", k + 1) & ~F.get("_a", k))  # the path starts one month early
    found = rows.withColumn("_a", active).withColumn("found", begins).withColumn(
        "shape", F.when(control, "no_change").otherwise(F.col("shape"))).withColumn("shift", F.when(control, 0.0).otherwise(F.col("shift")))
    months = lambda *k: F.array(*[F.lit(x) for x in k]).cast("array<int>")
    truth = F.when(F.col("shape") == "no_change", months()).when(F.col("shape") == "pulse", months(0, 1)).when(F.col("shape") == "ramp", months(1)).otherwise(months(0))
    split = F.when(F.col("seed") == SEEDS[0], "selection").otherwise("evaluation")
    keys = MATCH_KEYS if "id" in rows.columns else [*MATCH_KEYS[:-1], "n"]
    return detectors.match_events(found.withColumn("truth", truth).withColumn("split", split), keys)


@query("match_events", "split:s seed:l method:s shape:s shift:d id:l tp:l fp:l fn:l onset_tp:l onset_fp:l onset_fn:l", f"WITH {MATCH} SELECT * FROM me")
def _(spark, sf):
    return matched(spark, sf)


#: Distances of the matched pairs and the delay of the onset, shape by shape; two starts are never adjacent.
EVENTS = """ev AS (SELECT me.*, CASE shape WHEN 'step' THEN CASE WHEN f0 THEN 0 WHEN f1 THEN 1 ELSE 0 END WHEN 'ramp' THEN CASE WHEN f1 THEN 0 WHEN f2 THEN 1 WHEN f0 THEN -1 ELSE 0 END WHEN 'pulse' THEN f2::INT ELSE 0 END AS signed,
 CASE shape WHEN 'step' THEN CASE WHEN f0 THEN 0 WHEN f1 THEN 1 END WHEN 'ramp' THEN CASE WHEN f1 THEN 0 WHEN f2 THEN 1 WHEN f0 THEN 0 END WHEN 'pulse' THEN CASE WHEN f0 THEN 0 WHEN f1 THEN 1 END END AS delay
 FROM me JOIN mc USING(seed, shift, shape, method, id)),
es AS (SELECT split, method, CASE WHEN grouping(shape)=1 THEN 'all' ELSE shape END AS shape, count(*) AS series, sum(ev.tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(ev.onset_tp) AS otp, sum(onset_fp) AS ofp, sum(onset_fn) AS ofn,
 sum(CASE WHEN shape='no_change' THEN fp END) AS nf, count(*) FILTER (WHERE shape='no_change') AS nn, sum(signed) AS sg, sum(abs(signed)) AS ab, avg(delay) AS mean_onset_delay FROM ev GROUP BY GROUPING SETS ((split, method, shape), (split, method)))"""


@query("event_scores", "split:s method:s shape:s series:l tp:l fp:l fn:l precision:d recall:d f1:d onset_f1:d null_per100:d mean_signed_error:d mean_abs_error:d mean_onset_delay:d", f"""
WITH {MATCH}, {EVENTS} SELECT split, method, shape, series, tp, fp, fn, tp/nullif(tp+fp,0)::DOUBLE AS precision, tp/nullif(tp+fn,0)::DOUBLE AS recall, 2*tp/nullif(2*tp+fp+fn,0)::DOUBLE AS f1, 2*otp/nullif(2*otp+ofp+ofn,0)::DOUBLE AS onset_f1,
 100*nf/nullif(nn*{SPAN},0)::DOUBLE AS null_per100, sg/nullif(tp,0)::DOUBLE AS mean_signed_error, ab/nullif(tp,0)::DOUBLE AS mean_abs_error, mean_onset_delay FROM es""")
def _(spark, sf):
    return detectors.event_scores(matched(spark, sf, backtest.path_counts), ["split", "method"], SPAN)


@query("choose_detector", "split:s method:s onset_f1:d null_per100:d", f"""
WITH {MATCH}, dsc AS (SELECT split, method, 2*sum(onset_tp)/nullif(2*sum(onset_tp)+sum(onset_fp)+sum(onset_fn),0)::DOUBLE AS onset_f1, 100*sum(fp) FILTER (WHERE shape='no_change')/(count(*) FILTER (WHERE shape='no_change')*{SPAN})::DOUBLE AS null_per100 FROM me GROUP BY ALL)
SELECT split, method, onset_f1, null_per100 FROM dsc WHERE split='selection' AND null_per100<=5 ORDER BY onset_f1 DESC NULLS LAST, method LIMIT 1""")
def _(spark, sf):
    return detectors.choose_detector(detectors.event_scores(matched(spark, sf, backtest.path_counts), ["split", "method"], SPAN), "selection", "onset_f1", 5.0)


@query("recheck_detector_table", "split:s method:s onset_tp:l", f"WITH {MATCH} SELECT split, method, sum(onset_tp)+1 AS onset_tp FROM me WHERE method='ewma' GROUP BY ALL")
def _(spark, sf):
    """Rows where the score table disagrees with counts taken again from the per-series rows: those of the method that is wrong on purpose."""
    from tidepanel.operators.accuracy import metric_mismatches
    from tidepanel.session import cut_lineage

    rows = cut_lineage(matched(spark, sf), "matched")
    saved = detectors.event_scores(rows, ["split", "method"], SPAN).filter("shape = 'all'").select("split", "method", (F.col("onset_tp") + (F.col("method") == "ewma").cast("int")).alias("onset_tp"), "onset_recall")
    again = rows.groupBy("split", "method").agg(F.sum("onset_tp").alias("onset_tp"), (F.sum("onset_tp") / F.sum(F.col("onset_tp") + F.col("onset_fn"))).alias("onset_recall"))
    return metric_mismatches(saved, again, ["split", "method"], ["onset_tp", "onset_recall"], 1e-12)
