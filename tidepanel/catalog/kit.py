"""Registry of queries. Each entry pairs a Spark plan with the SQL that states the same result.

Doubles are rounded the same way on both sides, because sums depend on the order of addition.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

DIGITS = 6
# Means of cents often end exactly half-way; a small shift takes such values off the rounding boundary.
NUDGE = 0.0137
KINDS = {"l": "bigint", "d": "double", "s": "string", "b": "boolean", "t": "date"}
SQL_KINDS = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN", "t": "DATE"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Parameters shared by plans and SQL.
YEAR = 1996
FIRST = 12 * YEAR
LAST = 12 * 2001 + 10
HORIZONS = (1, 3, 6, 12)
MIN_REGION = 10
WEIGHT = 0.5
GROWTH = 0.05


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def finish(df: DataFrame, spec: str, digits: int = DIGITS) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        c = F.col(name).cast(KINDS[kind])
        out.append((F.round(c + NUDGE * 10.0**-digits, digits) if kind == "d" else c).alias(name))
    return df.select(*out)


def finish_sql(body: str, spec: str, digits: int = DIGITS) -> str:
    out = []
    for name, kind in _columns(spec):
        c = f"CAST({name} AS {SQL_KINDS[kind]})"
        nudged = f"round({c} + {NUDGE * 10.0**-digits!r}::DOUBLE, {digits}) + 0.0::DOUBLE"
        out.append((nudged if kind == "d" else c) + f" AS {name}")
    return f"{PRELUDE}\nSELECT {', '.join(out)} FROM (\n{body}\n)"


def query(name: str, spec: str, sql: str | None = None, digits: int = DIGITS):
    """Register a plan under ``name``; ``sql`` may use every relation of the prelude."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: finish(fn(spark, sf_dir), spec, digits)
        if sql is not None:
            ORACLES[name] = finish_sql(sql, spec, digits)
        return fn

    return register


# Relations every oracle may use; an unused relation costs nothing.
PRELUDE = f"""WITH
panel AS (SELECT l_suppkey AS id, 12*year(l_shipdate)+month(l_shipdate)-1 AS m, round(sum(l_extendedprice),2) AS value
  FROM lineitem GROUP BY ALL),
fine AS (SELECT l_suppkey AS id, l_returnflag AS category, 12*year(l_shipdate)+month(l_shipdate)-1 AS m,
  sum(l_extendedprice) AS value FROM lineitem GROUP BY ALL),
cpanel AS (SELECT id, category, m, round(value,2) AS value FROM fine
  UNION ALL SELECT id, 'ALL', m, round(sum(value),2) FROM fine GROUP BY id, m),
parts AS (SELECT l_partkey AS id, 12*year(l_shipdate)+month(l_shipdate)-1 AS m, round(sum(l_extendedprice),2) AS value
  FROM lineitem GROUP BY ALL),
part_regions AS (SELECT p_partkey AS id, CAST(regexp_extract(p_brand,'([0-9]+)$',1) AS BIGINT) AS region FROM part),
lookup AS (SELECT s_suppkey AS id, n_regionkey::BIGINT AS region, s_nationkey::BIGINT AS nation, r_name AS region_name,
  n_name AS nation_name FROM supplier LEFT JOIN nation ON s_nationkey=n_nationkey LEFT JOIN region ON n_regionkey=r_regionkey),
days AS (SELECT user_id AS id, datediff('day', DATE '2023-12-31', ts::DATE) AS d, round(sum(value),2) AS value, count(*) AS n
  FROM events GROUP BY ALL),
edges AS (SELECT l_suppkey AS id_x, l_partkey AS id_y, l_extendedprice/1000 AS distance, l_returnflag AS type FROM lineitem),
registry AS (SELECT event_id AS claim_id, 'ep' || json_extract_string(props,'$.k') AS episode_id, (user_id % 5)::BIGINT AS region,
  '[' || user_id || ']' AS ids, ts::DATE AS published_date, ts::DATE + 1 AS available_from, ts::DATE AS event_start,
  'https://src' || (event_id % 4) || '.example.org/' || event_id AS source_url FROM events WHERE event_type='error'),
elig AS (SELECT id FROM panel WHERE m BETWEEN {FIRST} AND {FIRST+11} AND value>0 GROUP BY id HAVING count(*)=12),
celig AS (SELECT category, id FROM cpanel WHERE m BETWEEN {FIRST} AND {FIRST+11} AND value>0 GROUP BY ALL HAVING count(*)=12),
pg0 AS (SELECT m%12 AS moy, sum(value) AS t FROM panel JOIN elig USING(id) WHERE m BETWEEN {FIRST} AND {FIRST+11} GROUP BY 1),
pg AS (SELECT moy, t/avg(t) OVER () AS f FROM pg0),
pr0 AS (SELECT region, m%12 AS moy, sum(value) AS t, count(*) AS members FROM panel JOIN elig USING(id) JOIN lookup USING(id)
  WHERE m BETWEEN {FIRST} AND {FIRST+11} AND region IS NOT NULL GROUP BY 1,2 HAVING count(*)>={MIN_REGION}),
pr AS (SELECT region, moy, members, t/avg(t) OVER (PARTITION BY region) AS f FROM pr0),
mixp AS (SELECT e.id, l.region, g.moy, (1-{WEIGHT}::DOUBLE)*g.f + {WEIGHT}::DOUBLE*coalesce(r.f,g.f) AS f, r.f IS NOT NULL AS regional
  FROM elig e LEFT JOIN lookup l USING(id) CROSS JOIN pg g LEFT JOIN pr r ON r.region=l.region AND r.moy=g.moy),
ct AS (SELECT id, max(m) AS complete_through FROM (SELECT id, m, m - row_number() OVER (PARTITION BY id ORDER BY m) AS k
  FROM panel WHERE m>={FIRST} AND value>0) WHERE k={FIRST-1} GROUP BY id),
hs AS (SELECT unnest([{','.join(map(str,HORIZONS))}]) AS horizon),
orows AS (SELECT o.id, o.m AS origin, horizon, o.m+horizon AS target, o.value AS level, t.value AS actual
  FROM panel o JOIN elig USING(id) JOIN ct USING(id) CROSS JOIN hs JOIN panel t ON t.id=o.id AND t.m=o.m+horizon
  WHERE o.m>={FIRST+11} AND o.m<=complete_through AND o.value>0 AND t.value>0),
wide AS (SELECT o.*, l.region, ya.value AS year_ago, oy.value AS origin_year_ago, lt.value AS local_target, lo.value AS local_origin,
  gt.f AS g_target, go.f AS g_origin, mt.f AS m_target, mo.f AS m_origin, (origin%12+horizon)//12 AS k
  FROM orows o LEFT JOIN lookup l USING(id)
  LEFT JOIN panel ya ON ya.id=o.id AND ya.m=o.target-12 LEFT JOIN panel oy ON oy.id=o.id AND oy.m=o.origin-12 AND oy.value>0
  LEFT JOIN panel lt ON lt.id=o.id AND lt.m={FIRST}+o.target%12 LEFT JOIN panel lo ON lo.id=o.id AND lo.m={FIRST}+o.origin%12
  JOIN pg gt ON gt.moy=o.target%12 JOIN pg go ON go.moy=o.origin%12
  JOIN mixp mt ON mt.id=o.id AND mt.moy=o.target%12 JOIN mixp mo ON mo.id=o.id AND mo.moy=o.origin%12),
fc0 AS (SELECT id, region, origin, target, horizon, actual, level, year_ago, model, predicted FROM wide,
  LATERAL (SELECT unnest(['last','year_ago','seasonal_pooled','seasonal_local','same_month_yoy','seasonal_mix','growth_bridge']) AS model,
    unnest([level, year_ago, level*g_target/g_origin, level*local_target/local_origin, year_ago*level/origin_year_ago,
      level*(m_target/m_origin), level*(m_target/m_origin)*pow(1+{GROWTH}::DOUBLE,k)]) AS predicted)),
fc AS (SELECT * REPLACE (greatest(predicted,0.0::DOUBLE) AS predicted) FROM fc0 WHERE predicted IS NOT NULL)"""
