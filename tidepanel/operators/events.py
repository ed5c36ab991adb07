"""Dated external events against a panel. Availability decides everything; absence is unknown, not zero.

Periods are integers (months or days). A window of an event is expanded to the few periods it covers,
so every time condition becomes an equality join plus a filter.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidepanel.functions import scalars
from tidepanel.operators import guards


#: Parts of the ids of a region that claims meet one by one.
CLAIM_PARTS = 64


def event_registry(registry: DataFrame, host_pattern: str) -> DataFrame:
    """Claims of the allowed hosts, one row per listed id."""
    return registry.filter(scalars.host_allowed("source_url", host_pattern)).withColumn("id", F.explode(scalars.parse_id_list("ids"))).drop("ids")


def expand_claims(registry: DataFrame, lookup: DataFrame) -> DataFrame:
    """Listed ids; without a list every id of the region; without any id one row with a NULL id."""
    listed = registry.withColumn("id", F.explode_outer(scalars.parse_id_list("ids")))
    named = listed.filter("id is not null").withColumn("regional_exposure", F.lit(False))
    # a region is one key of many claims and ids: its ids are dealt to parts, and a claim without a list meets each part of its region
    bare = listed.filter("id is null").drop("id").withColumn("regional_exposure", F.lit(True))
    dealt = lookup.select("id", "region").withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(CLAIM_PARTS)).cast("int"))
    spread = bare.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(CLAIM_PARTS - 1)))).repartition(CLAIM_PARTS, "region", "_part")
    found = spread.join(dealt, ["region", "_part"]).drop("_part")
    none = bare.join(lookup.select("region").distinct(), "region", "left_anti").withColumn("id", F.lit(None).cast(lookup.schema["id"].dataType))
    return named.unionByName(found).unionByName(none).drop("ids")


def known_at_origin(keys: DataFrame, events: DataFrame, period_end: Column) -> DataFrame:
    """Keys (id, origin) with any event public by the end of the origin; one date per id decides it."""
    first = events.groupBy("id").agg(F.min("available_from").alias("_first"))
    return keys.join(first, "id").filter(F.col("_first") <= period_end).drop("_first")


def event_in_window(rows: DataFrame, events: DataFrame, period: str, release: Column, window: int) -> DataFrame:
    """Adds ``event_available``: an event of the id whose window covers the period and is public at its release.

    ``events`` is (id, start, available): the first covered period and the availability on the scale of
    ``release``. Earlier periods are never relabelled.
    """
    cover = events.withColumn(period, F.explode(F.sequence(F.col("start"), F.col("start") + window - 1)))
    best = cover.groupBy("id", period).agg(F.min("available").alias("_available"))
    out = rows.join(best, ["id", period], "left")
    return out.withColumn("event_available", F.coalesce(F.col("_available") <= release, F.lit(False))).drop("_available")


def conditioned_alarms(rows: DataFrame, factor: float) -> DataFrame:
    """Three policies at once: baseline, lowered threshold where an event is public, lowered everywhere."""
    low = F.lit(float(factor))
    policies = F.array(
        F.struct(F.lit("baseline").alias("policy"), F.lit(1.0).alias("factor")),
        F.struct(F.lit("event_conditioned").alias("policy"), F.when(F.col("event_available"), low).otherwise(F.lit(1.0)).alias("factor")),
        F.struct(F.lit("global").alias("policy"), low.alias("factor")))
    out = rows.withColumn("_p", F.explode(policies)).select("*", "_p.policy", "_p.factor").drop("_p")
    return out.withColumn("active", F.col("observed") & F.coalesce(F.col("score") > F.col("threshold") * F.col("factor"), F.lit(False)))


def exposed_case_summary(rows: DataFrame, exposed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(exposed.select("id").distinct(), "id", "left_semi").groupBy("id", *keys).agg(
        F.count(F.when(F.col("active"), 1)).alias("active_periods"), F.count(F.when(F.col("event_available"), 1)).alias("event_periods"))


def asof_features(keys: DataFrame, events: DataFrame, expiry: int, verified_only: bool = False) -> DataFrame:
    """Distinct episodes public within ``expiry`` periods up to each origin, for the region and the id.

    ``keys`` is (id, region, origin); ``events`` is (id, region, episode_id, available, verified) with the
    availability as a period. Unknown stays NULL beside its flag.
    """
    e = events.filter("verified") if verified_only else events
    live = e.withColumn("origin", F.explode(F.sequence(F.col("available"), F.col("available") + expiry - 1)))
    regional = live.groupBy("region", "origin").agg(F.count_distinct("episode_id").alias("regional_episodes"))
    local = live.filter("id is not null").groupBy("id", "origin").agg(F.count_distinct("episode_id").alias("local_episodes"))
    out = keys.join(regional, ["region", "origin"], "left").join(local, ["id", "origin"], "left")
    return out.withColumn("regional_known", F.col("regional_episodes").isNotNull()).withColumn("local_known", F.col("local_episodes").isNotNull())


def alarm_calendar(alarms: DataFrame, period: str = "m") -> DataFrame:
    """(id, alarm_periods): sorted alarm periods of each id; the calendar bounds the array."""
    return alarms.groupBy("id").agg(F.sort_array(F.collect_set(period)).alias("alarm_periods"))


def lead_table(claims: DataFrame, alarms: DataFrame, observed: DataFrame, series_ids: DataFrame, lags: list[int]) -> DataFrame:
    """claim × id × lag: first alarm released at or after the news, days of lead, or why there is none.

    All times are day numbers: an observation of day d is released on day d + 1 + lag. ``claims`` is
    (claim_id, id, available, event_start); ``observed`` is (id, last_observed).
    """
    rows = claims.withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags])))
    rows = rows.join(observed, "id", "left").join(alarm_calendar(alarms), "id", "left").join(series_ids.select("id", F.lit(True).alias("_has")), "id", "left")
    release = lambda p: p + 1 + F.col("lag")
    anchor = F.greatest("available", F.coalesce("event_start", "available"))
    later = F.filter(F.coalesce("alarm_periods", F.array().cast("array<int>")), lambda p: (p >= anchor) & (release(p) >= F.col("available")))
    hit = F.get(later, F.lit(0))
    rows = rows.withColumn("alarm_target", hit).withColumn("_last_release", release(F.col("last_observed")))
    status = (
        F.when(F.col("id").isNull() | (F.col("last_observed").isNull() & F.col("_has").isNull()), "no_series")
        .when(F.col("last_observed").isNull(), "not_eligible").when(F.col("available") > F.col("_last_release"), "outside_window")
        .when(F.col("alarm_target").isNotNull(), "subsequent_alert").otherwise("right_censored"))
    rows = rows.withColumn("status", status)
    ok = F.col("status") == "subsequent_alert"
    return rows.select(
        "claim_id", "id", "lag", "status", F.when(ok, F.col("alarm_target")).alias("alarm_target"),
        F.when(ok, release(F.col("alarm_target")) - F.col("available")).alias("news_to_alert_days"), (F.col("available") - F.col("event_start")).alias("event_to_news_days"))


def lead_by_method(claims: DataFrame, alarms: DataFrame, observed: DataFrame, series_ids: DataFrame, methods: list[str], lags: list[int]) -> DataFrame:
    """``lead_table`` for each of ``methods``, beside the first observation that could have shown the event.

    ``alarms`` is (id, method, m), ``observed`` (id, m); a method without any alarm of an id has a row all the same. The calendars of an
    id, alarms by method among them, are one row, so claims are joined once and fan out to methods and lags behind the join.
    """
    own = alarms.groupBy("id", "method").agg(F.sort_array(F.collect_set("m")).alias("periods"))
    own = own.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("method", "periods"))).alias("by_method"))
    seen = observed.groupBy("id").agg(F.sort_array(F.collect_set("m")).alias("seen"))
    none = F.array().cast("array<int>")
    rows = claims.join(seen, "id", "left").join(own, "id", "left").join(series_ids.select("id", F.lit(True).alias("_has")), "id", "left")
    rows = rows.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods]))).withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags])))
    release = lambda p: p + 1 + F.col("lag")
    anchor = F.greatest("available", F.coalesce("event_start", "available"))
    first = lambda periods: F.get(F.filter(F.coalesce(periods, none), lambda p: (p >= anchor) & (release(p) >= F.col("available"))), F.lit(0))
    last = F.element_at("seen", -1)
    rows = rows.withColumns({"alarm_target": first(F.try_element_at("by_method", F.col("method"))), "_shown": first(F.col("seen"))})
    status = (
        F.when(F.col("id").isNull() | (F.col("seen").isNull() & F.col("_has").isNull()), "no_series").when(F.col("seen").isNull(), "not_eligible")
        .when(F.col("available") > release(last), "outside_window").when(F.col("alarm_target").isNotNull(), "subsequent_alert").otherwise("right_censored"))
    rows = rows.withColumn("status", status)
    ok = F.col("status") == "subsequent_alert"
    return rows.select("claim_id", "id", "method", "lag", "status", F.when(ok, F.col("alarm_target")).alias("alarm_target"),
                       F.when(ok, release(F.col("alarm_target")) - F.col("available")).alias("news_to_alert_days"),
                       F.when(F.col("status").isin("subsequent_alert", "right_censored"), release(F.col("_shown")) - F.col("available")).alias("news_to_data_days"))


def coverage_status(ids: DataFrame, forecast_ids: DataFrame, series_ids: DataFrame) -> DataFrame:
    out = ids.join(forecast_ids.select("id", F.lit(1).alias("_f")), "id", "left").join(series_ids.select("id", F.lit(1).alias("_s")), "id", "left")
    return out.withColumn("status", F.when(F.col("_f") == 1, "forecast").when(F.col("_s") == 1, "ineligible").otherwise("no_series")).drop("_f", "_s")


def lead_sensitivity(episodes: DataFrame, cases: DataFrame, lags: list[int]) -> DataFrame:
    """First episode from the event on that is released after the news, per case and lag; censored otherwise."""
    rows = cases.withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags]))).join(alarm_calendar(episodes), "id", "left")
    later = F.filter(F.coalesce("alarm_periods", F.array().cast("array<int>")), lambda p: (p >= F.col("event_start")) & (p + 1 + F.col("lag") >= F.col("available")))
    return rows.withColumn("first_episode", F.get(later, F.lit(0))).withColumn("censored", F.col("first_episode").isNull()).drop("alarm_periods")


def events_visible(registry: DataFrame, region: int, ident: int, cutoff) -> DataFrame:
    """Claims a reader of one id may see: same region, listed id if any, public by the cutoff."""
    listed = scalars.parse_id_list("ids")
    return registry.filter((F.col("region") == region) & (F.col("available_from") <= F.lit(cutoff).cast("date"))).filter(
        listed.isNull() | (F.size(listed) == 0) | F.array_contains(listed, F.lit(ident).cast("bigint")))


def direction_claims(keys: DataFrame, claims: DataFrame) -> DataFrame:
    """Latest public direction (−1/+1) of (region, target) at each origin; absent stays NULL.

    Claims of one (region, target) collapse to one row per availability period before the join.
    """
    steps = claims.groupBy("region", "target", "available").agg(F.max_by("direction", "claim_id").alias("direction"))
    w = W.partitionBy("region", "target").orderBy("available")
    spans = steps.withColumn("until", F.lead("available").over(w))
    cond = (keys["region"] == spans["region"]) & (keys["target"] == spans["target"]) & (spans["available"] <= keys["origin"]) & (
        spans["until"].isNull() | (spans["until"] > keys["origin"]))
    out = keys.join(spans, cond, "left").drop(spans["region"]).drop(spans["target"])
    return out.withColumn("direction_known", F.col("direction").isNotNull()).drop("until", "available")


def diversity(claims: DataFrame, minimum: int = 3) -> DataFrame:
    return claims.agg(F.count_distinct("published").alias("dates"), F.count_distinct("target").alias("targets")).withColumn(
        "fit_allowed", (F.col("dates") >= minimum) & (F.col("targets") >= minimum))


def diversity_gate(claims: DataFrame, minimum: int = 3) -> DataFrame:
    guards.assert_empty(diversity(claims, minimum).filter("not fit_allowed"), "too few publication dates or covered targets")
    return claims


def mentions_before(titles: DataFrame, aliases: DataFrame, days: int = 90) -> DataFrame:
    """(region, day, mentions): titles naming the region in the ``days`` days before each day with a mention.

    Counts per (region, day) come first, so the running window holds calendar days, not titles.
    """
    tokens = titles.select("page_id", "day", F.explode(F.array_distinct(F.split(F.lower("title"), " "))).alias("alias"))
    daily = tokens.join(F.broadcast(aliases), "alias").groupBy("region", "day").agg(F.count_distinct("page_id").alias("n"))  # alias list: settings
    w = W.partitionBy("region").orderBy("day").rangeBetween(-days, -1)
    return daily.withColumn("mentions", F.coalesce(F.sum("n").over(w), F.lit(0)))
