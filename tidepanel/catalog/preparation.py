"""Queries for sources, sinks, panel preparation and scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.common import base_forecasts
from tidepanel.catalog.kit import FIRST, HORIZONS, LAST, YEAR, query
from tidepanel.functions import months, scalars
from tidepanel.operators import guards, prep
from tidepanel.session import delete_at_exit, scratch_path
from tidepanel.sources import panel as readers, sinks, tables

CAL = 12 * 1998 + 11


@query("panel_monthly", "id:l m:l value:d", "SELECT * FROM panel")
def _(spark, sf):
    return tables.supplier_panel(spark, sf)


@query("panel_by_category", "id:l category:s m:l value:d", "SELECT * FROM cpanel")
def _(spark, sf):
    return tables.supplier_category_panel(spark, sf)


def stored(spark, name, write) -> str:
    """A path in the shared folder that ``write`` has filled; deleted when the application ends."""
    path = scratch_path(spark, "files") + f"-{name}"
    write(path)
    delete_at_exit(spark, path)
    return path


@query("read_category_cutoff", "id:l m:l value:d",
       f"SELECT id, m, value FROM cpanel WHERE category='N' AND m<={CAL}")
def _(spark, sf):
    """The panel goes to a file and comes back through the reader, whose predicates reach the scan."""
    panel = tables.supplier_category_panel(spark, sf)
    path = stored(spark, "panel.parquet", lambda p: sinks.write_frozen(panel.select(
        "id", "category", F.make_date(F.floor(F.col("m") / 12).cast("int"), F.col("m") % 12 + 1, F.lit(1)).alias("month"), "value", F.lit(None).cast("date").alias("available_from")), p))
    return readers.with_month_index(readers.read_category_cutoff(spark, path, "N", f"{CAL // 12}-{CAL % 12 + 1:02d}-28"))


@query("read_edges", "id_x:l id_y:l distance:d", "SELECT id_x, id_y, distance FROM edges WHERE type='A'")
def _(spark, sf):
    """Edges as CSV with twelve digits, read by their declared schema."""
    path = stored(spark, "edges.csv", lambda p: sinks.write_csv(tables.line_edges(spark, sf).select("id_x", "id_y", "distance", "type"), p))
    return readers.read_edges(spark, path, "A")


@query("forecast_files", "id:l target:l horizon:l predicted:d", f"SELECT id, target, horizon, predicted FROM fc WHERE model='growth_bridge' AND origin={FIRST + 23}", digits=4)
def _(spark, sf):
    """Forecasts written by origin; one origin is one folder, and two columns of it are read."""
    fc = base_forecasts(spark, sf, ["growth_bridge"])
    path = stored(spark, "forecasts.parquet", lambda p: sinks.write_forecasts(fc.select("id", "origin", "target", "horizon", "predicted"), p))
    return readers.read_columns(spark, path, ["id", "origin", "target", "horizon", "predicted"]).filter(F.col("origin") == FIRST + 23)


@query("fingerprint", "n:l distinct_rows:l total:d",
       "SELECT count(*) AS n, count(DISTINCT (id, m)) AS distinct_rows, sum(value) AS total FROM panel", digits=2)
def _(spark, sf):
    panel = tables.supplier_panel(spark, sf)
    print_ = sinks.fingerprint(panel).select("n")
    return print_.crossJoin(F.broadcast(panel.agg(F.count_distinct("id", "m").alias("distinct_rows"), F.sum("value").alias("total"))))


@query("export_nested", "id:l categories:l points:l",
       "SELECT id, count(DISTINCT category) AS categories, count(*) AS points FROM cpanel GROUP BY id")
def _(spark, sf):
    # The nested document is parsed back, so the counts prove that nothing was lost in nesting.
    nested = sinks.export_nested(tables.supplier_category_panel(spark, sf).select(
        "id", "category", F.lit(1).alias("horizon"), F.col("m").alias("target"), F.col("value").alias("predicted")))
    doc = F.from_json("document", "map<string,map<string,array<array<string>>>>")
    parsed = nested.select("id", F.explode(doc).alias("category", "by_h"))
    return parsed.select("id", "category", F.explode("by_h").alias("h", "points")).groupBy("id").agg(
        F.count_distinct("category").alias("categories"), F.sum(F.size("points")).alias("points"))


@query("resumable_units", "id:l m:l value:d", "SELECT id, m, value FROM panel")
def _(spark, sf):
    """A first run stores the months of the calibration, a second one only those that are missing."""
    panel = tables.supplier_panel(spark, sf)

    def write(path):
        sinks.write_resumable(panel.filter(F.col("m") <= CAL), path, ["m"], "v1")
        sinks.write_resumable(panel, path, ["m"], "v1")

    return spark.read.parquet(stored(spark, "units", write))


@query("normalize_month", "id:l m:l label:s",
       "SELECT o_orderkey AS id, 12*year(o_orderdate)+month(o_orderdate)-1 AS m, strftime(o_orderdate,'%Y-%m') AS label FROM orders")
def _(spark, sf):
    o = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM").alias("text"))
    return o.select("id", months.parse_month("text").alias("m")).withColumn("label", months.month_label("m"))


@query("validate_ids", "table_name:s bad_rows:l",
       "SELECT 'lineitem' AS table_name, count(*) FILTER (WHERE l_suppkey IS NULL OR l_suppkey<0) AS bad_rows FROM lineitem "
       "UNION ALL SELECT 'orders', count(*) FILTER (WHERE o_custkey IS NULL OR o_custkey<0) FROM orders")
def _(spark, sf):
    def bad(name, column):
        return guards.bad_ids(tables.table(spark, sf, name), column).agg(F.count("*").alias("bad_rows")).withColumn("table_name", F.lit(name))

    return bad("lineitem", "l_suppkey").unionByName(bad("orders", "o_custkey"))


@query("duplicate_keys", "id:l line:l n:l",
       "SELECT l_orderkey AS id, l_linenumber AS line, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*)>1")
def _(spark, sf):
    l = tables.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"))
    return guards.duplicates(l, ["id", "line"])


@query("cutoff_counts", "rows:l future_rows:l unavailable_rows:l kept_rows:l", f"""
SELECT count(*) AS rows, count(*) FILTER (WHERE m>{CAL}) AS future_rows,
  count(*) FILTER (WHERE m<={CAL} AND make_date(((m+1)//12)::INT, ((m+1)%12+1)::INT, 1) + (id%60)::INT > DATE '1999-01-20') AS unavailable_rows,
  count(*) FILTER (WHERE m<={CAL} AND make_date(((m+1)//12)::INT, ((m+1)%12+1)::INT, 1) + (id%60)::INT <= DATE '1999-01-20') AS kept_rows FROM panel""")
def _(spark, sf):
    panel = tables.supplier_panel(spark, sf).withColumn(
        "available_from", F.date_add(months.release_date("m", F.lit(0)), F.pmod("id", F.lit(60)).cast("int")))
    return prep.cutoff_counts(panel, CAL, "1999-01-20")


@query("densify", "id:l m:l value:d", f"""
SELECT i.id, g.m, p.value FROM (SELECT DISTINCT id FROM parts) i CROSS JOIN (SELECT unnest(range({FIRST},{FIRST+24})) AS m) g
LEFT JOIN parts p ON p.id=i.id AND p.m=g.m""")
def _(spark, sf):
    return prep.densify(tables.part_panel(spark, sf), FIRST, FIRST + 23)


@query("wide_and_long", "id:l m:l value:d", f"SELECT id, m, value FROM panel WHERE m BETWEEN {FIRST} AND {LAST}")
def _(spark, sf):
    return prep.to_long(prep.to_wide(tables.supplier_panel(spark, sf), range(FIRST, LAST + 1))).filter("value is not null")


@query("cohort_complete", "id:l", "SELECT id FROM elig")
def _(spark, sf):
    return prep.cohort_complete(tables.supplier_panel(spark, sf), YEAR)


@query("cohort_balanced", "id:l",
       f"SELECT id FROM panel WHERE m BETWEEN {FIRST} AND {12*2001+5} AND value>0 GROUP BY id HAVING count(*)={12*2001+6-FIRST}")
def _(spark, sf):
    return prep.cohort_balanced(tables.supplier_panel(spark, sf), FIRST, 12 * 2001 + 5)


@query("cohort_observed_through", "id:l",
       f"SELECT id FROM panel WHERE m BETWEEN {FIRST} AND {CAL} AND value>0 GROUP BY id HAVING count(*)={CAL+1-FIRST}")
def _(spark, sf):
    return prep.cohort_observed_through(tables.supplier_panel(spark, sf), FIRST, CAL)


@query("cohort_fixed_across", "category:s id:l",
       "SELECT category, id FROM celig WHERE id IN (SELECT id FROM celig WHERE category='ALL')")
def _(spark, sf):
    return prep.cohort_fixed_across(tables.supplier_category_panel(spark, sf), tables.TOTAL, YEAR)


@query("prefix_complete", "id:l origin:l",
       f"SELECT id, unnest(range({FIRST}, complete_through+1)) AS origin FROM ct")
def _(spark, sf):
    return prep.prefix_complete(tables.supplier_panel(spark, sf), FIRST)


@query("active_across_categories", "id:l active_through:l", f"""
SELECT id, min(ct) AS active_through FROM (SELECT id, category, max(m) AS ct FROM (SELECT *, m - row_number() OVER
  (PARTITION BY id, category ORDER BY m) AS k FROM cpanel WHERE m>={FIRST} AND value>0) WHERE k={FIRST-1} GROUP BY ALL)
GROUP BY id HAVING count(*)=4""")
def _(spark, sf):
    return prep.active_across_categories(tables.supplier_category_panel(spark, sf), FIRST, 4)


@query("evaluation_pairs", "id:l origin:l target:l horizon:l reason:s", f"""
SELECT e.id, o.origin, o.origin+horizon AS target, horizon,
  CASE WHEN complete_through IS NULL OR complete_through<origin THEN 'missing_history'
       WHEN t.value IS NULL OR t.value<=0 THEN 'missing_target' ELSE 'retained' END AS reason
FROM elig e LEFT JOIN ct USING(id) CROSS JOIN (SELECT unnest(range({FIRST+11},{LAST})) AS origin) o CROSS JOIN hs
LEFT JOIN panel t ON t.id=e.id AND t.m=origin+horizon WHERE origin+horizon<={LAST}""")
def _(spark, sf):
    return prep.evaluation_pairs(tables.supplier_panel(spark, sf), YEAR, HORIZONS, LAST)


HASH = "('0x'||substr(sha256('{seed}:'||{id}),1,12))::UBIGINT::DOUBLE/281474976710656"


@query("sample_ids", "id:l",
       f"SELECT c_custkey AS id FROM customer ORDER BY {HASH.format(seed=42, id='c_custkey')}, c_custkey LIMIT 256")
def _(spark, sf):
    return prep.sample_ids(tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), 256, 42)


@query("assign_treated", "id:l treated:b",
       f"SELECT c_custkey AS id, {HASH.format(seed=20261001, id='c_custkey')} < 0.25 AS treated FROM customer")
def _(spark, sf):
    return prep.assign_treated(tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), 20261001)


@query("sample_per_group", "id:l nation:l", f"""
WITH c AS (SELECT c_custkey AS id, c_nationkey AS nation FROM customer),
s AS (SELECT id FROM c ORDER BY {HASH.format(seed=42, id='id')}, id LIMIT 10)
SELECT id, nation FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY {HASH.format(seed=7, id='id')}, id) AS k FROM c
WHERE nation NOT IN (SELECT nation FROM c JOIN s USING(id))) WHERE k<=3""")
def _(spark, sf):
    ids = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return prep.sample_per_group(ids, prep.sample_ids(ids, 10, 42), "nation", 3, 7)


@query("coverage_by_month", "cohort:s m:l observed:l missing:l", f"""
WITH g AS (SELECT unnest(range({FIRST},{LAST+1})) AS m),
bal AS (SELECT id FROM panel WHERE m BETWEEN {FIRST} AND {12*2001+5} AND value>0 GROUP BY id HAVING count(*)={12*2001+6-FIRST})
SELECT 'profile_year' AS cohort, g.m, count(p.id) AS observed, (SELECT count(*) FROM elig)-count(p.id) AS missing
FROM g LEFT JOIN (SELECT * FROM panel JOIN elig USING(id)) p ON p.m=g.m GROUP BY g.m
UNION ALL SELECT 'balanced', g.m, count(p.id), (SELECT count(*) FROM bal)-count(p.id)
FROM g LEFT JOIN (SELECT * FROM panel JOIN bal USING(id)) p ON p.m=g.m GROUP BY g.m""")
def _(spark, sf):
    panel = tables.supplier_panel(spark, sf)
    return prep.coverage_by_month(panel, {
        "profile_year": prep.cohort_complete(panel, YEAR), "balanced": prep.cohort_balanced(panel, FIRST, 12 * 2001 + 5)}, FIRST, LAST)


@query("coverage_history_target", "target:l origin:l horizon:l ids:l history_eligible:l incomplete_history:l unobserved_target:l scored:l", f"""
SELECT target, target-2 AS origin, 2 AS horizon, count(*) AS ids, count(*) FILTER (WHERE ready) AS history_eligible,
  count(*) FILTER (WHERE NOT ready) AS incomplete_history, count(*) FILTER (WHERE ready AND v IS NULL) AS unobserved_target,
  count(*) FILTER (WHERE ready AND v IS NOT NULL) AS scored
FROM (SELECT e.id, target, coalesce(complete_through>=target-2, false) AS ready, p.value AS v FROM elig e LEFT JOIN ct USING(id)
  CROSS JOIN (SELECT unnest(range({FIRST+14},{LAST+1})) AS target) LEFT JOIN panel p ON p.id=e.id AND p.m=target) GROUP BY target""")
def _(spark, sf):
    panel = tables.supplier_panel(spark, sf)
    return prep.coverage_history_target(panel, prep.cohort_complete(panel, YEAR), FIRST, range(FIRST + 14, LAST + 1), 1)


@query("lookup_version", "id:l year:l region:l", """
WITH v AS (SELECT s_suppkey AS id, unnest([1994,1997,2000]) AS year, s_nationkey AS region FROM supplier)
SELECT * FROM v WHERE year=(SELECT max(year) FROM v WHERE year<=1998)""")
def _(spark, sf):
    s = tables.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.explode(F.array(F.lit(1994), F.lit(1997), F.lit(2000))).alias("year"), F.col("s_nationkey").alias("region"))
    return prep.lookup_version(s, 1998)


QUART = f"""q AS (SELECT id, avg(value) AS expense FROM panel JOIN elig USING(id) WHERE m BETWEEN {FIRST} AND {FIRST+11} GROUP BY id),
qc AS (SELECT quantile_cont(expense,[0.25,0.5,0.75]) AS c FROM q),
quart AS (SELECT id, expense, CASE WHEN expense<=c[1] THEN 'Q1' WHEN expense<=c[2] THEN 'Q2' WHEN expense<=c[3] THEN 'Q3' ELSE 'Q4' END AS quartile FROM q, qc)"""


@query("expense_quartiles", "id:l expense:d quartile:s", f"WITH {QUART} SELECT * FROM quart", digits=4)
def _(spark, sf):
    return prep.expense_quartiles(tables.supplier_panel(spark, sf), YEAR)


@query("scale_by_id", "id:l mean_value:d mean_change:d", f"""
SELECT id, avg(value) AS mean_value, avg(abs(d)) AS mean_change FROM (SELECT *, value - lag(value) OVER (PARTITION BY id ORDER BY m) AS d
FROM panel WHERE m BETWEEN {FIRST} AND {FIRST+11}) GROUP BY id""", digits=4)
def _(spark, sf):
    return prep.scale_by_id(tables.supplier_panel(spark, sf), YEAR)


@query("crosswalk_unique", "side:s code:s n:l", """
WITH p AS (SELECT DISTINCT p_brand, p_type FROM part)
SELECT 'p_brand' AS side, p_brand AS code, count(*) AS n FROM p GROUP BY ALL HAVING count(*)>1
UNION ALL SELECT 'p_type', p_type, count(*) FROM p GROUP BY ALL HAVING count(*)>1""")
def _(spark, sf):
    return guards.not_unique_pairs(tables.table(spark, sf, "part"), "p_brand", "p_type")


@query("label_period", "period:s rows:l ids:l", f"""
SELECT CASE WHEN m BETWEEN {FIRST} AND {FIRST+23} THEN 'early' WHEN m BETWEEN {FIRST+24} AND {FIRST+47} THEN 'late' ELSE 'other' END AS period,
count(*) AS rows, count(DISTINCT id) AS ids FROM panel GROUP BY 1""")
def _(spark, sf):
    p = tables.supplier_panel(spark, sf).withColumn("period", prep.label_period("m", range(FIRST, FIRST + 24), range(FIRST + 24, FIRST + 48)))
    return p.groupBy("period").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))


@query("calendar_functions", "id:l target:l bridges:l release:t decision:l origin:l horizon:l o_sin:d o_cos:d last_day:t", """
SELECT o_orderkey AS id, m+5 AS target, (m%12+5)//12 AS bridges, make_date(((m+3)//12)::INT,((m+3)%12+1)::INT,1) AS release, m+4 AS decision, m+2 AS origin,
 3 AS horizon, sin(2*pi()/12*(m%12+1)) AS o_sin, cos(2*pi()/12*(m%12+1)) AS o_cos, last_day(o_orderdate::DATE) AS last_day
FROM (SELECT *, 12*year(o_orderdate)+month(o_orderdate)-1 AS m FROM orders)""")
def _(spark, sf):
    o = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), months.month_index("o_orderdate").alias("m"))
    timing = months.delay_timing(months.target_month("m", F.lit(5)), F.lit(2))
    phase = scalars.season_phase(months.month_of_year("m"), "o")
    return o.select("id", months.target_month("m", F.lit(5)).alias("target"), months.year_bridges("m", F.lit(5)).alias("bridges"),
                    months.release_date("m", F.lit(2)).alias("release"), *[c.alias(n) for n, c in timing.items()],
                    *[c.alias(n) for n, c in phase.items()], months.month_end("m").alias("last_day"))


@query("numeric_functions", "id:l line:l log_ratio:d clipped:d pct:d back:d real:d step:d pulse:d ramp:d", """
SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_discount>0 THEN ln(l_extendedprice/l_discount) END AS log_ratio,
 least(greatest(l_quantity,10.0),30.0) AS clipped, CASE WHEN l_tax>0 THEN 100*(l_discount/l_tax-1) END AS pct, 100*(exp(l_tax)-1) AS back,
 CASE WHEN l_discount>0 THEN l_extendedprice/l_discount END AS real,
 CASE WHEN k BETWEEN 0 AND 5 THEN 1+l_tax ELSE 1 END AS step, CASE WHEN k=0 THEN 1+l_tax ELSE 1 END AS pulse,
 CASE WHEN k BETWEEN 0 AND 5 THEN 1+l_tax*k/5.0::DOUBLE ELSE 1 END AS ramp FROM (SELECT *, l_linenumber-2 AS k FROM lineitem)""")
def _(spark, sf):
    l = tables.table(spark, sf, "lineitem")
    k = F.col("l_linenumber") - 2
    shock = lambda s: scalars.shock_factor(F.lit(s), "l_tax", k)
    return l.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), scalars.log_ratio("l_extendedprice", "l_discount").alias("log_ratio"),
        scalars.clip("l_quantity", 10, 30).alias("clipped"), scalars.pct_change("l_discount", "l_tax").alias("pct"),
        scalars.log_percent_to_percent("l_tax").alias("back"), scalars.real_value("l_extendedprice", "l_discount").alias("real"),
        shock("step").alias("step"), shock("pulse").alias("pulse"), shock("ramp").alias("ramp"))


@query("missing_values", "id:l finite_value:d positive_value:d", """
SELECT c_custkey AS id, CASE WHEN c_acctbal<>0 THEN c_acctbal END AS finite_value, CASE WHEN c_acctbal>0 THEN c_acctbal END AS positive_value FROM customer""")
def _(spark, sf):
    x = F.when(F.col("c_acctbal") == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return tables.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), scalars.finite_or_null(x).alias("finite_value"), scalars.positive_or_null(x).alias("positive_value"))


@query("url_functions", "page_id:l host:s allowed:b", r"""
SELECT page_id, lower(regexp_extract(url,'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)',1)) AS host,
 regexp_full_match(lower(regexp_extract(url,'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)',1)), '(?:[a-z0-9-]+\.)*example\.com') AS allowed FROM pages""")
def _(spark, sf):
    return tables.table(spark, sf, "pages").select(
        "page_id", scalars.url_host("url").alias("host"), scalars.host_allowed("url", r"(?:[a-z0-9-]+\.)*example\.com").alias("allowed"))


@query("id_list_parse", "claim_id:l id:l", "SELECT claim_id, unnest(from_json(ids,'[\"BIGINT\"]')) AS id FROM registry")
def _(spark, sf):
    return tables.error_registry(spark, sf).select("claim_id", F.explode_outer(scalars.parse_id_list("ids")).alias("id"))
