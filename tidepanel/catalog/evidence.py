"""Queries for external events and text evidence."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.monitoring import scores_sql
from tidepanel.catalog.kit import query
from tidepanel.functions import scalars
from tidepanel.operators import detectors, events, text
from tidepanel.session import literal_table
from tidepanel.sources import tables

DAY0 = "2023-12-31"
EXPIRY, WINDOW = 14, 2
HOSTS = r"src[0-2]\.example\.org"


def day_number(c):
    return F.datediff(c, F.lit(DAY0).cast("date"))


def registry(spark, sf):
    return tables.error_registry(spark, sf)


def listed(spark, sf):
    return events.event_registry(registry(spark, sf), HOSTS)


@query("event_registry", "claim_id:l episode_id:s region:l id:l available_from:t source_url:s",
       "SELECT *, trim(ids,'[]')::BIGINT AS id FROM registry WHERE regexp_full_match(regexp_extract(source_url,'://([^/]+)',1), 'src[0-2]\\.example\\.org')")
def _(spark, sf):
    return listed(spark, sf)


CL = "cl AS (SELECT *, CASE WHEN claim_id%7=0 THEN '[]' ELSE ids END AS ids2 FROM registry)"


@query("expand_claims", "claim_id:l id:l regional_exposure:b", f"""
WITH {CL}, u AS (SELECT DISTINCT user_id AS id, user_id%5 AS region FROM events) SELECT claim_id, trim(ids2,'[]')::BIGINT AS id, false AS regional_exposure FROM cl WHERE ids2<>'[]'
UNION ALL SELECT claim_id, u.id, true FROM cl LEFT JOIN u USING(region) WHERE ids2='[]'""")
def _(spark, sf):
    r = registry(spark, sf).withColumn("ids", F.when(F.col("claim_id") % 7 == 0, F.lit("[]")).otherwise(F.col("ids")))
    users = tables.table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct().withColumn("region", F.col("id") % 5)
    return events.expand_claims(r, users)


DAYS = "rows_ AS (SELECT id, d AS m, value FROM days), ev AS (SELECT trim(ids,'[]')::BIGINT AS id, region, episode_id, claim_id, datediff('day', DATE '2023-12-31', available_from) AS available, datediff('day', DATE '2023-12-31', event_start) AS event_start FROM registry)"


def day_rows(spark, sf):
    return tables.user_days(spark, sf).select("id", F.col("d").alias("m"), "value")


def day_events(spark, sf):
    r = events.event_registry(registry(spark, sf), r".*")
    return r.select("claim_id", "id", "region", "episode_id", day_number(F.col("available_from")).alias("available"), day_number(F.col("event_start")).alias("event_start"))


@query("known_at_origin", "id:l origin:l", f"WITH {DAYS} SELECT DISTINCT r.id, r.m AS origin FROM rows_ r WHERE EXISTS (SELECT 1 FROM ev WHERE ev.id=r.id AND available<=r.m)")
def _(spark, sf):
    keys = day_rows(spark, sf).select("id", F.col("m").alias("origin")).distinct()
    e = day_events(spark, sf).select("id", F.col("available").alias("available_from"))
    return events.known_at_origin(keys, e, F.col("origin"))


WIN = f"win AS (SELECT r.*, lag, EXISTS (SELECT 1 FROM ev WHERE ev.id=r.id AND available<=r.m+1+lag AND r.m>=available AND r.m<available+{WINDOW}) AS event_available FROM rows_ r CROSS JOIN (SELECT unnest([0,1,2]) AS lag))"


def windowed(spark, sf, rows):
    e = day_events(spark, sf).select("id", F.col("available").alias("start"), "available")
    rows = rows.withColumn("lag", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return events.event_in_window(rows, e, "m", F.col("m") + 1 + F.col("lag"), WINDOW)


@query("event_in_window", "id:l m:l lag:l event_available:b", f"WITH {DAYS}, {WIN} SELECT * FROM win")
def _(spark, sf):
    return windowed(spark, sf, day_rows(spark, sf))


# Daily monitoring: spike score of log value around the user's own mean of the first days, threshold at the 90 % quantile of those days.
CALIBRATION = 7
MON = f"""mz AS (SELECT id, m, ln(value) - avg(ln(value)) FILTER (WHERE m<={CALIBRATION}) OVER (PARTITION BY id) AS z FROM rows_ WHERE value>0),
mt AS (SELECT quantile_cont(abs(z),0.9) AS threshold FROM mz WHERE m<={CALIBRATION}), ma AS (SELECT id, m, abs(z) AS score, threshold, true AS observed, abs(z)>threshold AS active FROM mz, mt WHERE m>{CALIBRATION} AND z IS NOT NULL)"""


def monitored(spark, sf):
    rows = day_rows(spark, sf).filter("value > 0").withColumn("x", F.log("value"))
    mean = rows.filter(F.col("m") <= CALIBRATION).groupBy("id").agg(F.avg("x").alias("a"))
    z = rows.join(mean, "id").select("id", "m", F.abs(F.col("x") - F.col("a")).alias("score"), F.lit("spike").alias("method"))
    limit = detectors.threshold_pooled(z.filter(F.col("m") <= CALIBRATION), (0, CALIBRATION), 0.9).select("threshold")
    return detectors.alarms(z.filter(F.col("m") > CALIBRATION).crossJoin(F.broadcast(limit))).withColumn("observed", F.lit(True))


POL = f"""pol AS (SELECT a.*, lag, event_available, policy, factor, score>threshold*factor AS act FROM (SELECT ma.*, lag, EXISTS (SELECT 1 FROM ev WHERE ev.id=ma.id AND available<=ma.m+1+lag AND ma.m>=available AND ma.m<available+{WINDOW}) AS event_available FROM ma CROSS JOIN (SELECT unnest([0,1,2]) AS lag)) a,
LATERAL (SELECT unnest(['baseline','event_conditioned','global']) AS policy, unnest([1.0::DOUBLE, CASE WHEN event_available THEN 0.75::DOUBLE ELSE 1 END, 0.75::DOUBLE]) AS factor))"""


def policies(spark, sf):
    return events.conditioned_alarms(windowed(spark, sf, monitored(spark, sf).drop("active")), 0.75)


@query("event_conditioned_threshold", "policy:s lag:l observed_periods:l event_periods:l active_periods:l unlabeled_active:l", f"""
WITH {DAYS}, {MON}, {POL} SELECT policy, lag, count(*) AS observed_periods, count(*) FILTER (WHERE event_available) AS event_periods, count(*) FILTER (WHERE act) AS active_periods, count(*) FILTER (WHERE act AND NOT event_available) AS unlabeled_active FROM pol GROUP BY ALL""")
def _(spark, sf):
    return policies(spark, sf).groupBy("policy", "lag").agg(
        F.count("*").alias("observed_periods"), F.count(F.when(F.col("event_available"), 1)).alias("event_periods"), F.count(F.when(F.col("active"), 1)).alias("active_periods"),
        F.count(F.when(F.col("active") & ~F.col("event_available"), 1)).alias("unlabeled_active"))


@query("exposed_case_summary", "id:l policy:s lag:l active_periods:l event_periods:l", f"""
WITH {DAYS}, {MON}, {POL} SELECT id, policy, lag, count(*) FILTER (WHERE act) AS active_periods, count(*) FILTER (WHERE event_available) AS event_periods FROM pol WHERE id IN (SELECT id FROM ev) GROUP BY ALL""")
def _(spark, sf):
    return events.exposed_case_summary(policies(spark, sf), day_events(spark, sf), ["policy", "lag"])


@query("events_asof_features", "id:l origin:l regional_episodes:d regional_known:b local_episodes:d local_known:b", f"""
WITH {DAYS}, k AS (SELECT id, m AS origin, id%5 AS region FROM rows_),
rg AS (SELECT k.region, origin, count(DISTINCT episode_id) AS n FROM (SELECT DISTINCT region, origin FROM k) k JOIN ev ON ev.region=k.region AND available<=origin AND available>origin-{EXPIRY} GROUP BY ALL),
lc AS (SELECT k.id, origin, count(DISTINCT episode_id) AS n FROM k JOIN ev ON ev.id=k.id AND available<=origin AND available>origin-{EXPIRY} GROUP BY ALL)
SELECT k.id, k.origin, rg.n AS regional_episodes, rg.n IS NOT NULL AS regional_known, lc.n AS local_episodes, lc.n IS NOT NULL AS local_known FROM k LEFT JOIN rg ON rg.region=k.region AND rg.origin=k.origin LEFT JOIN lc ON lc.id=k.id AND lc.origin=k.origin""")
def _(spark, sf):
    keys = day_rows(spark, sf).select("id", F.col("m").alias("origin"), (F.col("id") % 5).alias("region"))
    return events.asof_features(keys, day_events(spark, sf), EXPIRY)


LEAD = f"""ob AS (SELECT id, max(m) AS last_observed FROM rows_ WHERE value>0 GROUP BY id),
ld AS (SELECT ev.claim_id, ev.id, lag, available, event_start, last_observed, (SELECT min(m) FROM ma WHERE ma.id=ev.id AND active AND m>=greatest(available,event_start) AND m+1+lag>=available) AS hit FROM ev CROSS JOIN (SELECT unnest([0,1,2]) AS lag) LEFT JOIN ob ON ob.id=ev.id),
lt AS (SELECT claim_id, id, lag, CASE WHEN available>last_observed+1+lag THEN 'outside_window' WHEN hit IS NOT NULL THEN 'subsequent_alert' ELSE 'right_censored' END AS status, hit, available, event_start FROM ld)"""


def leads(spark, sf):
    rows = day_rows(spark, sf)
    observed = rows.filter("value > 0").groupBy("id").agg(F.max("m").alias("last_observed"))
    return events.lead_table(day_events(spark, sf), monitored(spark, sf).filter("active"), observed, rows.select("id").distinct(), [0, 1, 2])


@query("lead_table", "claim_id:l id:l lag:l status:s alarm_target:d news_to_alert_days:d event_to_news_days:l", f"""
WITH {DAYS}, {MON}, {LEAD} SELECT claim_id, id, lag, status, CASE WHEN status='subsequent_alert' THEN hit END AS alarm_target, CASE WHEN status='subsequent_alert' THEN hit+1+lag-available END AS news_to_alert_days, available-event_start AS event_to_news_days FROM lt""")
def _(spark, sf):
    return leads(spark, sf)


@query("alert_lead", "lag:l status:s rows:l median_days:d min_days:l max_days:l", f"""
WITH {DAYS}, {MON}, {LEAD} SELECT lag, status, count(*) AS rows, coalesce(median(CASE WHEN status='subsequent_alert' THEN hit+1+lag-available END),-1) AS median_days, coalesce(min(CASE WHEN status='subsequent_alert' THEN hit+1+lag-available END),-1) AS min_days,
 coalesce(max(CASE WHEN status='subsequent_alert' THEN hit+1+lag-available END),-1) AS max_days FROM lt GROUP BY ALL""")
def _(spark, sf):
    # Lead days are small integers: the exact percentile buffers one count per distinct day.
    return leads(spark, sf).groupBy("lag", "status").agg(
        F.count("*").alias("rows"), F.percentile("news_to_alert_days", 0.5).alias("median_days"), F.min("news_to_alert_days").alias("min_days"), F.max("news_to_alert_days").alias("max_days")).fillna(-1)


METHOD_LEADS = f"""mq AS (SELECT id, m, z FROM mz WHERE z IS NOT NULL), {scores_sql('mq', 'id')}, mh AS (SELECT method, quantile_cont(score,0.9) AS threshold FROM scm WHERE m<={CALIBRATION} AND score IS NOT NULL GROUP BY method),
al AS (SELECT id, m, method FROM scm JOIN mh USING(method) WHERE m>{CALIBRATION} AND score>threshold), ob AS (SELECT id, max(m) AS last_observed FROM rows_ WHERE value>0 GROUP BY id),
ld AS (SELECT ev.claim_id, ev.id, method, lag, available, last_observed, (SELECT min(m) FROM al WHERE al.id=ev.id AND al.method=mh.method AND m>=greatest(available,event_start) AND m+1+lag>=available) AS hit,
 (SELECT min(m) FROM rows_ r WHERE r.id=ev.id AND value>0 AND m>=greatest(available,event_start) AND m+1+lag>=available) AS shown FROM ev CROSS JOIN mh CROSS JOIN (SELECT unnest([0,1,2]) AS lag) LEFT JOIN ob ON ob.id=ev.id),
lm AS (SELECT *, CASE WHEN available>last_observed+1+lag THEN 'outside_window' WHEN hit IS NOT NULL THEN 'subsequent_alert' ELSE 'right_censored' END AS status FROM ld)"""


def method_leads(spark, sf):
    """Four detectors on the daily signal around the mean of the calibration days, each with its own pooled threshold."""
    rows = day_rows(spark, sf).filter("value > 0").withColumn("x", F.log("value"))
    mean = rows.filter(F.col("m") <= CALIBRATION).groupBy("id").agg(F.avg("x").alias("a"))
    scored = detectors.by_method(detectors.scores(rows.join(mean, "id").select("id", "m", (F.col("x") - F.col("a")).alias("z")), ["id"]), ["id"])
    limits = detectors.threshold_pooled(scored, (0, CALIBRATION), 0.9).select("method", "threshold")
    active = detectors.alarms(scored.filter(F.col("m") > CALIBRATION).join(F.broadcast(limits), "method")).filter("active")  # one row a method
    return events.lead_by_method(day_events(spark, sf), active, rows, day_rows(spark, sf).select("id").distinct(), list(detectors.METHODS), [0, 1, 2])


@query("lead_by_method", "method:s lag:l status:s rows:l alarms:l alert_days:l data_rows:l data_days:l", f"""
WITH {DAYS}, {MON}, {METHOD_LEADS} SELECT method, lag, status, count(*) AS rows, count(*) FILTER (WHERE status='subsequent_alert') AS alarms, coalesce(sum(CASE WHEN status='subsequent_alert' THEN hit+1+lag-available END),0) AS alert_days,
 count(*) FILTER (WHERE status<>'outside_window' AND shown IS NOT NULL) AS data_rows, coalesce(sum(CASE WHEN status<>'outside_window' THEN shown+1+lag-available END),0) AS data_days FROM lm GROUP BY ALL""")
def _(spark, sf):
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return method_leads(spark, sf).groupBy("method", "lag", "status").agg(
        F.count("*").alias("rows"), F.count("alarm_target").alias("alarms"), zero("news_to_alert_days").alias("alert_days"), F.count("news_to_data_days").alias("data_rows"), zero("news_to_data_days").alias("data_days"))


@query("first_after", "claim_id:l id:l first_episode:d censored:b lag:l", f"""
WITH {DAYS}, {MON} SELECT claim_id, id, lag, f AS first_episode, f IS NULL AS censored FROM (SELECT ev.claim_id, ev.id, lag, (SELECT min(m) FROM ma WHERE ma.id=ev.id AND active AND m>=event_start AND m+1+lag>=available) AS f FROM ev CROSS JOIN (SELECT unnest([0,1]) AS lag))""")
def _(spark, sf):
    return events.lead_sensitivity(monitored(spark, sf).filter("active"), day_events(spark, sf), [0, 1])


@query("lead_sensitivity", "lag:l cases:l censored:l", f"""
WITH {DAYS}, {MON}, c AS (SELECT id, arg_min(available, claim_id) AS available, arg_min(event_start, claim_id) AS event_start FROM ev GROUP BY id)
SELECT lag, count(*) AS cases, count(*) FILTER (WHERE f IS NULL) AS censored FROM (SELECT c.id, lag, (SELECT min(m) FROM ma WHERE ma.id=c.id AND active AND m>=event_start AND m+1+lag>=available) AS f FROM c CROSS JOIN (SELECT unnest([0,1,2]) AS lag)) GROUP BY lag""")
def _(spark, sf):
    cases = day_events(spark, sf).groupBy("id").agg(F.min_by("available", "claim_id").alias("available"), F.min_by("event_start", "claim_id").alias("event_start"))
    return events.lead_sensitivity(monitored(spark, sf).filter("active"), cases, [0, 1, 2]).groupBy("lag").agg(F.count("*").alias("cases"), F.count(F.when(F.col("censored"), 1)).alias("censored"))


@query("coverage_status", "id:l status:s", """
SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT id FROM elig) THEN 'forecast' WHEN c_custkey IN (SELECT id FROM panel) THEN 'ineligible' ELSE 'no_series' END AS status FROM customer""")
def _(spark, sf):
    from tidepanel.catalog.kit import YEAR
    from tidepanel.operators import prep

    panel = tables.supplier_panel(spark, sf)
    ids = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return events.coverage_status(ids, prep.cohort_complete(panel, YEAR), panel.select("id").distinct())


@query("events_visible", "claim_id:l episode_id:s", "SELECT claim_id, episode_id FROM registry WHERE region=2 AND available_from<=DATE '2024-01-20' AND ids='[7]'")
def _(spark, sf):
    return events.events_visible(registry(spark, sf), 2, 7, "2024-01-20")


@query("direction_claims", "id:l origin:l target:l direction:d direction_known:b", """
WITH c AS (SELECT event_id AS claim_id, user_id%5 AS region, datediff('day', DATE '2023-12-31', ts::DATE)+1 AS available, datediff('day', DATE '2023-12-31', ts::DATE)+3 AS target, CASE WHEN value>10 THEN 1 ELSE -1 END AS direction FROM events WHERE event_type='signup'),
k AS (SELECT id, id%5 AS region, d AS origin, d+1 AS target FROM days),
j AS (SELECT k.id, k.origin, k.target, arg_max(direction, available*10000000+claim_id) AS direction FROM k LEFT JOIN c ON c.region=k.region AND c.target=k.target AND c.available<=k.origin GROUP BY ALL)
SELECT id, origin, target, direction, direction IS NOT NULL AS direction_known FROM j""")
def _(spark, sf):
    e = tables.table(spark, sf, "events").filter("event_type = 'signup'")
    d = day_number(F.col("ts").cast("date"))
    claims = e.select(F.col("event_id").alias("claim_id"), (F.col("user_id") % 5).alias("region"), (d + 1).alias("available"), (d + 3).alias("target"), F.when(F.col("value") > 10, 1).otherwise(-1).alias("direction"))
    keys = tables.user_days(spark, sf).select("id", (F.col("id") % 5).alias("region"), F.col("d").alias("origin"), (F.col("d") + 1).alias("target"))
    return events.direction_claims(keys, claims)


@query("diversity_gate", "dates:l targets:l fit_allowed:b", "SELECT count(DISTINCT ts::DATE) AS dates, count(DISTINCT event_type) AS targets, count(DISTINCT ts::DATE)>=3 AND count(DISTINCT event_type)>=3 AS fit_allowed FROM events")
def _(spark, sf):
    return events.diversity(tables.table(spark, sf, "events").select(F.col("ts").cast("date").alias("published"), F.col("event_type").alias("target")))


TITLE = "regexp_extract(html,'<title>([^<]*)</title>',1)"


def page_titles(spark, sf):
    return tables.table(spark, sf, "pages").select("page_id", "url", "html", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


# Settings of the alias list: words that stand for a region in titles.
ALIASES = {"the": 1, "and": 2, "of": 3, "der": 4, "que": 5}


@query("mentions_90d", "region:l day:l mentions:l", f"""
WITH t AS (SELECT page_id, page_id%300 AS day, unnest(list_distinct(string_split(lower({TITLE}),' '))) AS alias FROM pages), a AS (SELECT unnest(['the','and','of','der','que']) AS alias, unnest([1,2,3,4,5]) AS region),
n AS (SELECT region, day, count(DISTINCT page_id) AS n FROM t JOIN a USING(alias) GROUP BY ALL)
SELECT region, day, coalesce(sum(n) OVER (PARTITION BY region ORDER BY day RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING),0) AS mentions FROM n""")
def _(spark, sf):
    aliases = literal_table(spark, list(ALIASES.items()), "alias string, region long")
    return events.mentions_before(page_titles(spark, sf).withColumn("day", (F.col("page_id") % 300).cast("int")), aliases)


@query("resolve_place", "mention:l status:s id:l", """
WITH p AS (SELECT p_name AS name, p_brand AS region, 2024 AS year, count(*) AS n, min(p_partkey) AS id FROM part GROUP BY ALL), m AS (SELECT p_partkey AS mention, p_name AS name, p_brand AS region, CASE WHEN p_size<=5 THEN 2023 ELSE 2024 END AS year FROM part)
SELECT mention, CASE WHEN n IS NULL THEN 'not_found' WHEN n>1 THEN 'ambiguous_exact' ELSE 'exact' END AS status, CASE WHEN n=1 THEN id ELSE -1 END AS id FROM m LEFT JOIN p USING(name,region,year)""")
def _(spark, sf):
    part = tables.table(spark, sf, "part")
    places = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("region"), F.lit(2024).alias("year"))
    mentions = part.select(F.col("p_partkey").alias("mention"), F.col("p_name").alias("name"), F.col("p_brand").alias("region"), F.when(F.col("p_size") <= 5, 2023).otherwise(2024).alias("year"))
    return text.resolve_place(mentions, places).fillna(-1, ["id"])


@query("quoted_place", "quote_id:l status:s id:l", f"""
WITH a AS (SELECT alias, count(DISTINCT page_id) AS places, min(page_id) AS id FROM (SELECT page_id, unnest(list_distinct(string_split(lower({TITLE}),' '))) AS alias FROM pages) WHERE alias<>'' GROUP BY alias),
t AS (SELECT doc_id, unnest(list_distinct(string_split(lower(text),' '))) AS alias FROM documents),
h AS (SELECT doc_id, max(places) AS worst, count(DISTINCT CASE WHEN places=1 THEN id END) AS ids, min(CASE WHEN places=1 THEN id END) AS id FROM t JOIN a USING(alias) GROUP BY doc_id)
SELECT d.doc_id AS quote_id, CASE WHEN worst IS NULL THEN 'no_alias' WHEN worst>1 OR ids>1 THEN 'ambiguous_quote' ELSE 'quoted' END AS status, CASE WHEN worst=1 AND ids=1 THEN id ELSE -1 END AS id FROM documents d LEFT JOIN h USING(doc_id)""")
def _(spark, sf):
    aliases = page_titles(spark, sf).select(F.col("page_id").alias("id"), F.explode(F.array_distinct(F.split(F.lower("title"), " "))).alias("alias")).filter("alias <> ''")
    quotes = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("quote_id"), F.col("text").alias("quote"))
    return text.quoted_place(quotes, aliases).fillna(-1, ["id"])


@query("validate_event_rows", "doc_id:l errors:s confidence:d", """
SELECT doc_id, concat_ws(',', CASE WHEN doc_id%3=0 AND instr(text, 'zq'||substr(text,20,30))=0 THEN 'unsupported_quote' END, CASE WHEN doc_id%5=0 THEN 'future_event_date' END, CASE WHEN doc_id%7=0 THEN 'availability_mismatch' END) AS errors,
 CASE WHEN doc_id%4=0 THEN -1.0 ELSE n_chars/1000000.0::DOUBLE END AS confidence FROM documents""")
def _(spark, sf):
    d = tables.table(spark, sf, "documents")
    pub = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))
    rows = d.select(
        "doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("zq"), F.substring("text", 20, 30))).otherwise(F.substring("text", 20, 30)).alias("quote"), pub.alias("published"),
        F.when(F.col("doc_id") % 5 == 0, F.date_add(pub, 3)).otherwise(pub).alias("event_date"), F.when(F.col("doc_id") % 7 == 0, pub).otherwise(F.date_add(pub, 1)).alias("available_from"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("unknown")).otherwise((F.col("n_chars") / 1000000).cast("string")).alias("confidence"))
    return text.validate_event_rows(rows).withColumn("errors", F.array_join("errors", ",")).fillna(-1.0, ["confidence"])


def captures(spark, sf):
    """Capture texts composed from the pages: address line, header with a written date, heading, body."""
    p = page_titles(spark, sf)
    day, month = (F.col("page_id") % 28 + 1).cast("int"), (F.col("page_id") % 12 + 1).cast("int")
    name = F.element_at(F.array(*[F.lit(m) for m in text.MONTHS_GENITIVE]), month)
    year = F.when(F.col("page_id") % 9 == 0, 2026).otherwise(2024)
    title = F.concat(F.lit("Прогноз на "), day.cast("string"), F.lit(" "), name, F.lit(" 2024 года"))
    header = F.when(F.col("page_id") % 11 == 0, F.lit("")).otherwise(F.concat(day.cast("string"), F.lit(" "), name, F.lit(" "), year.cast("string"), F.lit(", 12:00")))
    return p.select("page_id", F.concat(title, F.lit(" ("), F.regexp_replace("url", r"[?#].*$", ""), F.lit(")\nsearch metadata\n\n"), header, F.lit("\n\n100\n\n# "), title, F.lit("\n\n"), F.col("title")).alias("text"))


@query("parse_captures", "page_id:l exclusion:s published:t available_from:t target_date:t precision:s", """
WITH c AS (SELECT page_id, (page_id%28+1)::INT AS d, (page_id%12+1)::INT AS mo, CASE WHEN page_id%9=0 THEN 2026 ELSE 2024 END AS y, regexp_extract(url,'://([^/?#:]+)',1) AS host FROM pages),
p AS (SELECT *, CASE WHEN page_id%11<>0 THEN make_date(y,mo,d) END AS published FROM c)
SELECT page_id, CASE WHEN host NOT LIKE '%.example.com' THEN 'host_not_allowed' WHEN published IS NULL THEN 'no_header_date' WHEN published>DATE '2024-12-31' THEN 'publication_outside_history' ELSE 'none' END AS exclusion,
 published, published+1 AS available_from, make_date(2024,mo,d) AS target_date, 'day' AS precision FROM p""")
def _(spark, sf):
    return text.parse_captures(captures(spark, sf), r"(?:[a-z0-9-]+\.)*example\.com", "2023-01-01", "2024-12-31").fillna("none", ["exclusion"])


@query("title_date", "id:l target:t precision:s early:b", """
WITH o AS (SELECT o_orderkey AS id, o_orderdate::DATE AS d FROM orders)
SELECT id, CASE id%4 WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN date_trunc('month', d)::DATE END AS target, CASE id%4 WHEN 0 THEN 'day' WHEN 1 THEN 'day' WHEN 2 THEN 'month' ELSE 'none' END AS precision,
 coalesce(d-5 < date_trunc('month', CASE id%4 WHEN 3 THEN NULL ELSE d END), false) AS early FROM o""")
def _(spark, sf):
    o = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"))
    pick = lambda names: F.element_at(F.array(*[F.lit(m) for m in names]), F.month("d"))
    y = F.year("d").cast("string")
    title = F.when(F.col("id") % 4 == 0, F.concat(F.lit("Прогноз на "), F.date_format("d", "dd.MM.yyyy"))).when(
        F.col("id") % 4 == 1, F.concat(F.lit("Прогноз на "), F.dayofmonth("d").cast("string"), F.lit(" "), pick(text.MONTHS_GENITIVE), F.lit(" "), y, F.lit(" года"))).when(
        F.col("id") % 4 == 2, F.concat(F.lit("Прогноз на "), pick(text.MONTHS_NOMINATIVE), F.lit(" месяц "), y, F.lit(" года"))).otherwise(F.concat(F.lit("Прогноз за "), y, F.lit(" год")))
    out = o.withColumn("title", title).withColumn("target", text.title_date("title")).withColumn("precision", text.title_precision("title"))
    return out.withColumn("early", F.coalesce(text.monthly_early(F.date_sub("d", 5), F.col("target")), F.lit(False))).fillna("none", ["precision"])


@query("feed_items", "link:s published:t title:s", """
WITH f AS (SELECT page_id, make_date(CASE WHEN page_id%6=0 THEN 2026 ELSE 2024 END, (page_id%12+1)::INT, (page_id%28+1)::INT) AS d, 'https://'||regexp_extract(url,'://([^/?#:]+)',1)||'/'||(page_id//2) AS link, regexp_extract(url,'://([^/?#:]+)',1) AS host FROM pages)
SELECT link, min(d) AS published, min('item '||page_id) AS title FROM f WHERE d<=DATE '2024-12-31' AND host LIKE '%.example.org' GROUP BY link""")
def _(spark, sf):
    p = tables.table(spark, sf, "pages").withColumn("host", scalars.url_host("url")).filter("host like '%.example.org'")
    month = F.element_at(F.array(*[F.lit(m) for m in text.MONTHS_FEED]), (F.col("page_id") % 12 + 1).cast("int"))
    date = F.concat(F.lit("Sat, "), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit(" "), month, F.when(F.col("page_id") % 6 == 0, F.lit(" 2026")).otherwise(F.lit(" 2024")), F.lit(" 10:00:00 +0300"))
    link = F.concat(F.lit("https://"), F.col("host"), F.lit("/"), F.floor(F.col("page_id") / 2).cast("string"))
    item = F.concat(F.lit("<item><title>item "), F.col("page_id").cast("string"), F.lit("</title><link>"), link, F.lit("</link><pubDate>"), date, F.lit("</pubDate></item>"))
    foreign = F.lit("<item><title>x</title><link>https://evil.example.net/a</link><pubDate>Sat, 06 Apr 2024 10:00:00 +0300</pubDate></item>")
    feeds = p.select(F.concat(F.lit("https://"), F.col("host"), F.lit("/rss")).alias("feed_url"), F.concat(F.lit("<rss><channel>"), item, foreign, F.lit("</channel></rss>")).alias("xml"))
    return text.feed_items(feeds, "2023-01-01", "2024-12-31")


def saved_pages(spark, sf):
    """Page texts with navigation, a date line, the document text and a footer."""
    d = tables.table(spark, sf, "documents").select("doc_id", "text", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).alias("published"))
    shown = F.when(F.col("doc_id") % 5 == 0, F.date_add("published", 400)).otherwise(F.col("published"))
    line = F.concat_ws(" ", F.dayofmonth(shown).cast("string"), F.element_at(F.array(*[F.lit(m) for m in text.MONTHS_GENITIVE]), F.month(shown)), F.year(shown).cast("string"))
    source = F.when(F.col("doc_id") % 4 == 0, F.lit("Source: search")).otherwise(F.lit("Source: open"))
    return d.withColumn("source", source).withColumn("page", F.concat(source, F.lit("\nmenu\n"), line, F.lit(", 08:42\n"), F.col("text"), F.lit("\nОцените материал\nfooter")))


@query("article_excerpt", "doc_id:l n:l digest:s", """
SELECT doc_id, CASE WHEN doc_id%4<>0 AND doc_id%5<>0 THEN length(text)+1 ELSE -1 END AS n, CASE WHEN doc_id%4<>0 AND doc_id%5<>0 THEN md5(text||chr(10)) ELSE '' END AS digest FROM documents""")
def _(spark, sf):
    out = saved_pages(spark, sf).select("doc_id", text.article_excerpt("page", "published", "Source: open", "Оцените материал").alias("body"))
    return out.select("doc_id", F.coalesce(F.length("body"), F.lit(-1)).alias("n"), F.coalesce(F.md5("body"), F.lit("")).alias("digest"))


@query("page_reliable", "doc_id:l reliable:b", "SELECT doc_id, doc_id%4<>0 AND doc_id%5<>0 AND length(text)>=400 AS reliable FROM documents")
def _(spark, sf):
    return saved_pages(spark, sf).select("doc_id", (text.page_reliable("source", "page", "published", "Source: open", 10) & (F.length("text") >= 400)).alias("reliable"))


@query("batch_complete", "doc_id:l problem:s", """
WITH o AS (SELECT doc_id FROM labels WHERE doc_id%2=0 UNION ALL SELECT doc_id FROM labels WHERE doc_id%10=0)
SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM o) UNION ALL SELECT doc_id, 'repeated' FROM o GROUP BY doc_id HAVING count(*)>1 UNION ALL SELECT doc_id, 'foreign' FROM o WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def _(spark, sf):
    labels = tables.table(spark, sf, "labels").select("doc_id")
    outputs = labels.filter("doc_id % 2 = 0").unionByName(labels.filter("doc_id % 10 = 0"))
    return text.batch_problems(tables.table(spark, sf, "documents").select("doc_id"), outputs, "doc_id")
