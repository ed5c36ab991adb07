"""Hand-computed values of the published contracts."""
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import months, scalars
from tidepanel.operators import accuracy, detectors, forecast, guards, inference, intervals, joins, prep, profiles, selection, signals, text, events, backtest
from tidepanel.plans.forecast_panel import audit_counts, forecast_panel, validate
from tidepanel.schema import DetectorSettings, ForecastConfig

M = lambda y, m: 12 * y + m - 1


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def small_input(panel_of, spark):
    values = {i: {M(2023, m): (100 + i) * m for m in range(1, 13)} for i in (1, 2)}
    for i in (1, 2):
        values[i][M(2024, 12)] = 2400 + i
    lookup = spark.createDataFrame([(1, 10), (2, 10)], "id long, region long")
    return panel_of(values), lookup


def config(**kw):
    base = dict(origin=M(2024, 12), profile_year=2023, horizons=(1, 12), growth_rate=0.172, region_weight=0.5, minimum_region=1)
    return ForecastConfig(**{**base, **kw})


def test_forecast_hand_value(spark, panel_of):
    panel, lookup = small_input(panel_of, spark)
    validate(panel, lookup, config())
    out = {(r["id"], r["horizon"]): r for r in forecast_panel(panel, lookup, config()).collect()}
    assert out[1, 1]["predicted"] == pytest.approx(2401 / 12 * 1.172)
    assert out[1, 1]["target"] == M(2025, 1)
    assert out[2, 12]["predicted"] == pytest.approx(2402 * 1.172)
    audit = audit_counts(panel, forecast_panel(panel, lookup, config()), config()).first()
    assert (audit["input_ids"], audit["profile_eligible_ids"], audit["forecast_ids"], audit["future_rows_excluded"]) == (2, 2, 2, 0)


@pytest.mark.parametrize("patch", [dict(region_weight=2.0), dict(horizons=(0,)), dict(horizons=(1.5,)), dict(horizons=(1, 1)), dict(growth_rate=-1.0), dict(profile_year=2025), dict(geography_year=2025), dict(horizons=())])
def test_bad_config(patch):
    with pytest.raises(ValueError):
        config(**patch)


def test_bad_input(spark, panel_of):
    panel, lookup = small_input(panel_of, spark)
    with pytest.raises(ValueError):
        validate(panel.unionByName(panel.limit(1)), lookup, config())
    with pytest.raises(ValueError):
        validate(panel, lookup.unionByName(lookup.limit(1)), config())
    with pytest.raises(ValueError):
        validate(panel.drop("value"), lookup, config())
    with pytest.raises(ValueError):
        validate(panel.withColumn("id", -F.col("id")), lookup, config())
    with pytest.raises(ValueError):
        prep.available_as_of(panel.withColumn("available_from", F.lit(None).cast("date")), "2025-01-01")
    with pytest.raises(ValueError):
        validate(panel.filter(F.col("m") < M(2024, 12)), lookup, config())


def test_year_bridges(spark):
    cases = [((2023, 12), 1, 1), ((2023, 10), 5, 1), ((2023, 12), 12, 1), ((2023, 1), 11, 0), ((2023, 2), 24, 2)]
    for (y, m), h, k in cases:
        assert one(spark, k=months.year_bridges(F.lit(M(y, m)), F.lit(h)))["k"] == k


def test_release_and_delay(spark):
    r = one(spark, d=months.release_date(F.lit(M(2024, 4)), F.lit(1)), **months.delay_timing(F.lit(M(2024, 9)), F.lit(1)))
    assert r["d"] == dt.date(2024, 6, 1)
    assert (r["decision"], r["origin"], r["horizon"]) == (M(2024, 8), M(2024, 7), 2)


def test_calendar_counts(spark):
    r = forecast.calendar_dimension(spark.createDataFrame([(M(2024, 2),)], "m int")).first()
    assert [r[c] for c in ("days", "mon", "tue", "wed", "thu", "fri", "sat", "sun")] == [29, 4, 4, 4, 5, 4, 4, 4]


def test_regional_growth(spark, panel_of):
    values = {i: {m: 100.0 for m in range(M(2023, 1), M(2025, 12) + 1)} for i in range(12)}
    for i in values:
        values[i].update({M(2024, 10): 120.0, M(2024, 11): 110.0, M(2024, 12): 115.0})
    panel, regions = panel_of(values), spark.createDataFrame([(i, 1) for i in range(12)], "id long, region long")
    origins = spark.createDataFrame([(M(2024, 12),)], "origin int")
    r = forecast.regional_growth_rate(panel, regions, 2023, origins, 10, 0.172).first()
    assert r["rate"] == pytest.approx(0.15) and r["source"] == "regional" and r["minimum_peers"] == 12
    assert forecast.regional_growth_rate(panel, regions, 2023, origins, 13, 0.172).first()["rate"] == 0.172


def test_scores_reset_after_gap(spark):
    z = spark.createDataFrame([(1, 0, 0.4), (1, 1, None), (1, 2, 0.2), (2, 0, 1.0), (2, 1, 1.0)], "id long, m int, z double")
    got = {(r["id"], r["m"]): r for r in detectors.scores(z, ["id"]).collect()}
    assert got[1, 2]["ewma"] == pytest.approx(0.09) and got[1, 2]["cusum"] == pytest.approx(0.175)
    assert got[1, 1]["ewma"] is None and got[1, 2]["rolling_3m"] == pytest.approx(0.2)
    quarter = {(r["id"], r["m"]): r for r in detectors.scores(z, ["id"], DetectorSettings(ewma_alpha=0.25)).collect()}
    assert [quarter[2, m]["ewma"] for m in (0, 1)] == pytest.approx([0.25, 0.4375])
    drift = {(r["id"], r["m"]): r for r in detectors.scores(z.withColumn("z", F.lit(0.2)), ["id"], DetectorSettings(cusum_drift=0.1)).collect()}
    assert [drift[2, m]["cusum"] for m in (0, 1)] == pytest.approx([0.1, 0.2])


def test_settings_are_strict():
    good = {f: getattr(DetectorSettings(), f) for f in DetectorSettings.__dataclass_fields__}
    assert DetectorSettings.from_mapping(good) == DetectorSettings()
    for bad in ({**good, "extra": 1.0}, {k: v for k, v in good.items() if k != "ewma_alpha"}, {**good, "ewma_alpha": True}, {**good, "noise_floor": float("nan")}, {**good, "threshold_quantile": 1.0}, {**good, "bocpd_alpha": 1.0}):
        with pytest.raises(ValueError):
            DetectorSettings.from_mapping(bad)


def test_noise_multiplier(spark):
    rows = [(i, m, float((m % 2) * (i + 1))) for i in (0, 1) for m in range(6)]
    out = {r["id"]: r["multiplier"] for r in signals.noise_scale(spark.createDataFrame(rows, "id long, m int, z double"), (0, 5), 0.25, 0.0001).collect()}
    assert out[0] == pytest.approx(0.75 / (0.25 * 0.5 + 0.75 * 0.75)) and out[1] == pytest.approx(0.75 / (0.25 + 0.75 * 0.75))


def test_episodes(spark):
    rows = spark.createDataFrame([(1, i, a) for i, a in enumerate([False, True, True, False, True])], "id long, m int, active boolean")
    assert [r["m"] for r in detectors.alarm_episodes(rows, ["id"]).filter("episode").orderBy("m").collect()] == [1, 4]


def test_confirmation_machine(spark):
    levels = {1: [0, 1, 1, 1, 1, 1], 2: [0, 1, 0, 0, 0, 0], 3: [0, 0, 0, 0, 1, 1]}
    df = spark.createDataFrame([(i, m, float(x)) for i, xs in levels.items() for m, x in enumerate(xs)], "id long, m int, x double")
    got = sorted((r["id"], r["m"], r["event"]) for r in detectors.confirm_shift(df, ["id"], spark.createDataFrame([(i, 0.5) for i in levels], "id long, threshold double"), 1).collect())
    assert got == [(1, 1, "trigger"), (1, 3, "confirm"), (2, 1, "trigger"), (2, 2, "reject"), (3, 4, "trigger"), (3, 5, "pending")]


def test_interval_score_and_widening(spark):
    for y, want in ((-1, 20), (5, 10), (11, 20)):
        assert one(spark, s=intervals.interval_score(F.lit(float(y)), F.lit(0.0), F.lit(10.0), 0.2))["s"] == pytest.approx(want)
    rows = spark.createDataFrame([(1, 5, 100.0, 10.0), (2, 5, 100.0, 10.0)], "id long, origin int, predicted double, radius double")
    got = {r["id"]: (r["lower"], r["upper"]) for r in intervals.widen_for_events(rows, spark.createDataFrame([(1, 5)], "id long, origin int"), 1.5).collect()}
    assert got == {1: (85.0, 115.0), 2: (90.0, 110.0)}


def test_date_balance_and_wins(spark):
    fc = spark.createDataFrame([(1, 1, "a", 1, "m", 100.0, 100.0), (1, 1, "b", 1, "m", 100.0, 200.0), (2, 1, "b", 1, "m", 100.0, 200.0), (3, 1, "a", 1, "m", 100.0, 100.0), (4, 1, "a", 1, "m", 100.0, 100.0)],
                               "id long, origin int, target string, horizon int, model string, actual double, predicted double")
    r = accuracy.summary(fc.withColumn("year_ago", F.lit(100.0)).withColumn("level", F.lit(100.0))).first()
    assert (r["mae"], r["mae_pooled"]) == (50.0, 40.0)
    pairs = spark.createDataFrame([(1, "t", 10.0, 5.0), (2, "t", 10.0, 15.0), (3, "t", 10.0, 10.0)], "id long, target string, loss_a double, loss_b double").withColumn("horizon", F.lit(1))
    p = accuracy.paired_stats(pairs).first()
    assert (p["ids_win"], p["ids_loss"], p["ids_tie"], p["mae_difference"]) == (1, 1, 1, 0.0)


def test_holm_and_t_tail(spark):
    ps = [0.01, 0.03, 0.2, None]
    got = {r["k"]: r["p_holm"] for r in inference.holm(spark.createDataFrame(list(enumerate(ps)), "k int, p double"), "p").collect()}
    assert [got[0], got[1], got[2]] == pytest.approx([0.03, 0.06, 0.2]) and got[3] is None
    # Two-sided 5 % points of Student's t.
    for dof, t in ((1, 12.7062047), (2, 4.3026527), (7, 2.3646243), (10, 2.2281389), (57, 2.0024655)):
        assert one(spark, p=scalars.student_two_sided_p(F.lit(t), F.lit(dof)))["p"] == pytest.approx(0.05, abs=1e-7)


def test_dm_policy(spark):
    rows = [(h, t, 0.0, float(t % 3) + 1) for h in (1, 6) for t in range(10)]
    got = {r["horizon"]: r for r in inference.dm_test(spark.createDataFrame(rows, "horizon int, target int, loss_a double, loss_b double")).collect()}
    d = [t % 3 + 1 for t in range(10)]
    mean = sum(d) / 10
    lrv = sum((x - mean) ** 2 for x in d) / 10
    assert got[1]["statistic"] == pytest.approx(mean / (math.sqrt(lrv / 10) / math.sqrt((10 + 1 - 2) / 10)))
    assert got[6]["status"] == "too_few_dates" and got[6]["statistic"] is None


def test_neighbors(spark):
    edges = spark.createDataFrame([(3, 1, 0.0), (1, 2, 0.0), (3, 2, 5.0), (1, 1, 0.0), (1, 9, -1.0)], "id_x long, id_y long, distance double")
    ids = spark.createDataFrame([(1,), (2,), (3,), (9,)], "id long")
    assert sorted((r["id"], r["neighbor"]) for r in joins.k_nearest(edges, ids, 1).collect()) == [(1, 2), (2, 1), (3, 1)]


def test_selection_ignores_late_errors(spark):
    rows = [(h, m, t, 100.0, 100.0 - e) for h in (1, 3, 6) for m, e in (("seasonal_pooled", 10.0), ("x", 5.0), ("y", 7.0)) for t in (1, 2)]
    df = spark.createDataFrame(rows, "horizon int, model string, target int, actual double, predicted double")
    late = spark.createDataFrame([(1, "x", 9, 1e9, 0.0)], df.schema)
    for frame in (df, df.unionByName(late)):
        assert selection.select_forecaster(frame, "seasonal_pooled", 2, [1, 3, 6]).filter("rank = 1").first()["model"] == "x"


def test_pairing_is_strict(spark):
    base = [(1, 1, 2, 1, "a", 5.0, 4.0), (1, 1, 2, 1, "b", 5.0, 6.0)]
    schema = "id long, origin int, target int, horizon int, model string, actual double, predicted double"
    r = selection.matched_pairs(spark.createDataFrame(base, schema), "a", "b").first()
    assert (r["loss_a"], r["loss_b"]) == (1.0, 1.0)
    for extra in ([(2, 1, 2, 1, "a", 5.0, 4.0)], [(1, 1, 2, 1, "a", 5.0, 4.0)], [(3, 1, 2, 1, "a", 5.0, 4.0), (3, 1, 2, 1, "b", 6.0, 4.0)]):
        with pytest.raises(Exception, match="same keys once"):
            selection.matched_pairs(spark.createDataFrame(base + extra, schema), "a", "b").collect()


def test_lead_and_windows(spark):
    claims = spark.createDataFrame([(1, 7, 100, 98)], "claim_id long, id long, available int, event_start int")
    observed, ids = spark.createDataFrame([(7, 300)], "id long, last_observed int"), spark.createDataFrame([(7,)], "id long")
    hit = spark.createDataFrame([(7, 90), (7, 120)], "id long, m int")
    got = {r["lag"]: (r["status"], r["news_to_alert_days"]) for r in events.lead_table(claims, hit, observed, ids, [0, 3]).collect()}
    assert got == {0: ("subsequent_alert", 21), 3: ("subsequent_alert", 24)}
    none = events.lead_table(claims, hit.filter("m < 95"), observed, ids, [0]).first()
    assert none["status"] == "right_censored" and none["event_to_news_days"] == 2
    rows = spark.createDataFrame([(1, m) for m in range(1, 8)] + [(2, 4)], "id long, m int")
    e = spark.createDataFrame([(1, 4, 4)], "id long, start int, available int")
    assert sorted((r["id"], r["m"]) for r in events.event_in_window(rows, e, "m", F.col("m") + 1, 2).filter("event_available").collect()) == [(1, 4), (1, 5)]


def test_asof_features_contract(spark):
    seen, later, stale = M(2021, 9), M(2021, 10), M(2022, 2)
    rows = [(11, 4, "ep-a", seen, False)] * 2 + [(11, 4, "ep-b", later, False), (12, 8, "ep-c", seen, False)]
    e = spark.createDataFrame(rows, "id long, region long, episode_id string, available int, verified boolean")
    asked = [(11, 4, seen - 1), (11, 4, seen), (77, 4, seen), (11, 4, stale)]
    keys = spark.createDataFrame(asked, "id long, region long, origin int")
    got = {(r["id"], r["origin"]): (r["regional_episodes"], r["regional_known"], r["local_episodes"], r["local_known"]) for r in events.asof_features(keys, e, 3).collect()}
    assert got == {(11, seen - 1): (None, False, None, False), (11, seen): (1, True, 1, True), (77, seen): (1, True, None, False), (11, stale): (None, False, None, False)}
    assert events.asof_features(keys, e, 3, verified_only=True).filter("regional_known").count() == 0


# Words that the parser itself looks for stay as they are: month names and the word for month.
def test_dates_in_titles(spark):
    want = {"Сводка на 17.03.2021": ("2021-03-17", "day"), "Сводка на 30 февраля 2021 года": ("None", None), "Сводка за 2021 год": ("None", None),
            "Сводка на май месяц 2021 года": ("2021-05-01", "month"), "Сводка на 9 мая 2021 года": ("2021-05-09", "day")}
    rows = spark.createDataFrame([(k,) for k in want], "title string").select("title", text.title_date("title").alias("t"), text.title_precision("title").alias("p")).collect()
    for r in rows:
        day, precision = want[r["title"]]
        assert str(r["t"]) == day and (precision is None or r["p"] == precision)
    day = lambda d: F.lit(d).cast("date")
    r = one(spark, before=text.monthly_early(day("2021-05-31"), day("2021-06-05")), same=text.monthly_early(day("2021-06-01"), day("2021-06-05")), unknown=text.monthly_early(day("2021-05-31"), day(None)))
    assert (r["before"], r["same"], r["unknown"]) == (True, False, None)


def test_captures(spark):
    def capture(header, host="office.example.org"):
        return f"Сводка на 9 мая 2021 года (https://{host}/item/7)\nfound by search\n\n{header}\n\n35\n\n# Heading\n\nBody"

    rows = [("good", capture("8 мая 2021, 07:15")), ("late", capture("8 мая 2025, 07:15")), ("foreign", capture("8 мая 2021, 07:15", "other.test")),
            ("after heading", "Name (https://office.example.org/item/7)\n# Name\n8 мая 2021, 07:15")]
    out = {r["k"]: r for r in text.parse_captures(spark.createDataFrame(rows, "k string, text string"), r"office\.example\.org", "2020-01-01", "2022-12-31").collect()}
    assert {k: r["exclusion"] for k, r in out.items()} == {"good": None, "late": "publication_outside_history", "foreign": "host_not_allowed", "after heading": "no_header_date"}
    assert (str(out["good"]["available_from"]), str(out["good"]["target_date"])) == ("2021-05-09", "2021-05-09")


def test_feeds(spark):
    entry = lambda name, day: f"<item><title>{name}</title><link>https://wire.example.net/{name}</link>" + (f"<pubDate>{day}</pubDate>" if day else "") + "</item>"
    kept, late = "Wed, 12 May 2021 18:30:00 +0200", "Mon, 12 May 2025 18:30:00 +0200"
    xml = "<rss><channel>" + entry("a", kept) * 2 + entry("b", late) + entry("c", "") + "</channel></rss>"
    got = text.feed_items(spark.createDataFrame([("https://wire.example.net/rss", xml)], "feed_url string, xml string"), "2020-01-01", "2022-12-31").collect()
    assert [(r["link"], str(r["published"])) for r in got] == [("https://wire.example.net/a", "2021-05-12")]


def test_excerpts(spark):
    page = "Kind: article\nmenu\n12 мая 2021, 18:30\n# Bridge closed\nDetour in place.\nRate this page\nfooter"
    rows = spark.createDataFrame([(page, "2021-05-12"), (page, "2021-05-13"), (page.replace("article", "list"), "2021-05-12")], "t string, d string")
    whole, *none = [r[0] for r in rows.select(text.article_excerpt("t", F.col("d").cast("date"), "Kind: article", "Rate this page")).collect()]
    assert "Detour in place." in whole and "menu" not in whole and "footer" not in whole and none == [None, None]


def test_places(spark):
    places = spark.createDataFrame([("Alder", 1, 5, 2021), ("Birch", 2, 6, 2021), ("Birch", 3, 6, 2021)], "name string, id long, region long, year int")
    asked = spark.createDataFrame([("Birch", 6, 2021), ("Alder", 5, 2020), ("Alder", 5, 2021)], "name string, region long, year int")
    got = {(r["name"], r["year"]): (r["status"], r["id"]) for r in text.resolve_place(asked, places).collect()}
    assert got == {("Birch", 2021): ("ambiguous_exact", None), ("Alder", 2020): ("not_found", None), ("Alder", 2021): ("exact", 1)}


def test_sinks(spark, tmp_path, panel_of):
    from tidepanel.sources import panel as readers, sinks

    df = panel_of({1: {0: 1.23456789012345, 1: 2.0}, 2: {0: 3.0}})
    path = str(tmp_path / "units")
    assert sinks.write_resumable(df.filter("m = 0"), path, ["m"], "v1") == 1
    assert sinks.write_resumable(df, path, ["m"], "v1") == 1
    assert sinks.write_resumable(df, path, ["m"], "v1") == 0
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        sinks.write_resumable(df, path, ["m"], "v2")
    computed = spark.sparkContext.accumulator(0)

    def compute(rows):
        def read(batches):
            for batch in batches:
                computed.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(read, rows.schema)

    again = str(tmp_path / "again")
    assert [sinks.write_resumable(df.filter(c), again, ["m"], "v1", compute) for c in ("m = 0", "m < 9", "m < 9")] == [1, 1, 0] and computed.value == 3
    lost = str(tmp_path / "lost")  # rows that were written but never named
    df.write.partitionBy("m").parquet(lost)
    assert sinks.write_resumable(df, lost, ["m"], "v1") == 2 and spark.read.parquet(lost).count() == 3
    sinks.write_frozen(df, str(tmp_path / "frozen"))
    with pytest.raises(Exception):
        sinks.write_frozen(df, str(tmp_path / "frozen"))
    sinks.write_csv(df, str(tmp_path / "out.csv"), 4)
    assert readers.read_table(spark, str(tmp_path / "out.csv"), df.schema).agg(F.max("value")).first()[0] == 3.0
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.json")
    sinks.write_forecasts(df.withColumn("origin", F.col("m")), str(tmp_path / "fc.parquet"))
    assert readers.read_columns(spark, str(tmp_path / "fc.parquet"), ["id"]).columns == ["id"]
    a, b = sinks.fingerprint(df).first(), sinks.fingerprint(df.orderBy(F.desc("id"))).first()
    assert a == b and a != sinks.fingerprint(df.withColumn("value", F.col("value") + 1)).first()
