"""Operators on small generated rows with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from thermoflux.functions import scalars as sc
from thermoflux.operators import aggregates as a
from thermoflux.operators import control, curves, drivers, gapfill, regression, season
from thermoflux.operators import joins as j
from thermoflux.operators import windows as w
from thermoflux.sources import io


def test_tail_probabilities(spark):
    # published values of the one-sample tests
    got = a.with_p(spark.createDataFrame([(-2.084432, 116), (6.080315, 116), (-8.346010, 116)], "t double, df long")).collect()
    for r, p in zip(got, (0.0393157, 1.57630e-8, 1.69503e-13), strict=True):
        assert r["p"] == pytest.approx(p, rel=1e-4)
    f = spark.createDataFrame([(4.0, 1.0, 116.0)], "f double, a double, b double").select(a.f_tail("f", "a", "b").alias("p")).first()["p"]
    t = spark.createDataFrame([(2.0, 116)], "t double, df long")
    assert f == pytest.approx(a.with_p(t).first()["p"], rel=1e-9)  # F(1, n) is the square of t(n)


def test_division_by_zero_gives_null(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 2.0)], "site_id long, x double")
    assert a.one_sample_t(df, "x", ("site_id",)).first()["t"] is None
    assert w.zscore(df, ["x"], ("site_id",)).filter("x IS NOT NULL").count() == 0


def test_site_from_path(spark):
    df = spark.createDataFrame([("a/FLX_CH-Dav_FLUXNET_HR_1.csv",), ("a/FLX_CH-Dav_FLUXNET_HH_1.csv",), ("a/._AMF_US-Ha1_BASE_HH_1.csv",), ("a/notes.txt",)], "path string")
    assert [tuple(r) for r in io.prefer_half_hourly(df).select("site_id", "path").collect()] == [("CH-Dav", "a/FLX_CH-Dav_FLUXNET_HH_1.csv")]


def test_parse_year_list(spark):
    df = spark.createDataFrame([("2013:2015",), ("2008,  2012, 2013, 2022",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(sc.parse_year_list(F.col("t"))).collect()] == [[2013, 2014, 2015], [2008, 2012, 2013, 2022], [], []]


def test_read_selected_names_missing(spark):
    with pytest.raises(ValueError, match="TS"):
        io.read_selected(spark.range(1), ["id", "TS"])


def test_join_config_refuses_two_rows(spark):
    c = spark.createDataFrame([(1, 2.0), (1, 3.0)], "site_id long, ta_min double")
    with pytest.raises(ValueError):
        j.join_config(spark.range(3).withColumnRenamed("id", "site_id"), c, {"ta_min": 0.0})


def test_range_join_by_buckets_is_the_same(spark, monkeypatch):
    rows = spark.range(0, 400).select((F.col("id") % 2).alias("site_id"), F.col("id").alias("DOY"))
    periods = spark.createDataFrame([(0, 3, 90), (0, 80, 81), (1, -5, 40), (1, 399, 500)], "site_id long, a long, b long")
    small = sorted(map(tuple, j.range_join(rows, periods, "DOY", "a", "b").select("site_id", "DOY", "a").collect()))
    monkeypatch.setattr(j, "BROADCAST_ROWS", 1)
    assert small == sorted(map(tuple, j.range_join(rows, periods, "DOY", "a", "b").select("site_id", "DOY", "a").collect()))


def test_day_night(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 80.0, 0.0, 0.0)], "site_id long, LAT double, LONG double, utc_offset double")
    rows = spark.sql("SELECT site_id, timestamp_ntz'2020-03-20 00:15:00' + make_dt_interval(0, h) AS stamp FROM range(1, 3) s(site_id), range(24) r(h)")
    rows = rows.unionByName(spark.sql("SELECT 2L AS site_id, timestamp_ntz'2020-06-20 01:15:00' AS stamp UNION ALL SELECT 2L, timestamp_ntz'2020-12-20 12:15:00'"))
    got = {(r["site_id"], r["stamp"].month, r["stamp"].hour): r["daytime"] for r in sc.day_night_flag(rows, sites, 0.5).collect()}
    assert [got[1, 3, h] for h in (3, 7, 12, 17, 21)] == [False, True, True, True, False]
    assert got[2, 6, 1] is True and got[2, 12, 12] is False  # polar day and night


def test_circular_runs(spark):
    def run(active, temp):
        days = spark.createDataFrame([(1, i + 1, bool(x), float(t)) for i, (x, t) in enumerate(zip(active, temp, strict=True))], "site_id long, DOY long, act boolean, t double")
        return [tuple(r) for r in w.circular_runs(days, "act", "t").select("site_id", "gStart", "gEnd", "trimmed_days").collect()]

    # an off-season over the year's end, and a warmer dip that stays inside
    assert run([0, 0, 1, 1, 0, 1, 1, 0], [0, 1, 5, 6, 7, 6, 5, 1]) == [(1, 3, 7, 0)]
    # an off-season in the middle: the longer end of the axis stays, the other is trimmed
    assert run([1, 1, 0, 0, 1, 1, 1, 1], [5, 5, 0, 0, 5, 5, 5, 5]) == [(1, 5, 8, 2)]
    assert run([1, 1, 1], [5, 5, 5]) == [(1, 1, 3, 0)]


def test_ols_recovers_coefficients(spark):
    rng = random.Random(1)
    rows = [(s, x, z, 3 + s + 2 * x - 0.5 * z + rng.gauss(0, 1e-3)) for s in (0, 1) for x, z in ((rng.random() * 9, rng.random() * 5) for _ in range(200))]
    for r in regression.ols(spark.createDataFrame(rows, "site_id long, x double, z double, y double"), "y", ["x", "z"]).collect():
        assert r["coef"] == pytest.approx([3 + r["site_id"], 2, -0.5], abs=1e-2) and r["r2"] > 0.999


def test_repair_periods(spark):
    rows = spark.sql("SELECT 1L AS site_id, CAST(2000 + y AS long) AS YEAR, CAST(d AS long) AS DOY, y * 1000 + d AS stamp, 10 + 8 * sin(d / 20.0D) AS TA FROM range(3) a(y), range(1, 200) b(d)")
    rows = rows.withColumn("TS", F.when((F.col("YEAR") == 2001) & F.col("DOY").between(90, 100), F.lit(-50.0)).otherwise(2 + 0.5 * F.col("TA"))).withColumn("QC", F.lit(0))
    bad = spark.createDataFrame([(1, 2001, 90, 100)], "site_id long, YEAR long, DOY_start int, DOY_end int")
    got = regression.repair_periods(rows, bad, 1, ["stamp"], min_rows=50).filter("TS_repair_flag = 1").collect()
    assert len(got) == 11 and all(r["TS"] == pytest.approx(2 + 0.5 * r["TA"], abs=1e-6) and r["QC"] == 1 for r in got)


def test_thermal_response_recovers_slope(spark):
    rng = random.Random(2)
    rows, e = [], 0.0
    for win in range(6):
        for year in range(12):
            e = 0.4 * e + rng.gauss(0, 0.05) if year else rng.gauss(0, 0.05)
            ts = 10 + win + rng.gauss(0, 1)
            rows.append((1, win, 2000 + year, ts, 0.3 * win - 0.06 * ts + e))
    r = regression.thermal_response(spark.createDataFrame(rows, "site_id long, window long, growing_year long, TS double, lnRatio double")).first()
    assert r["TAS"] == pytest.approx(-0.06, abs=0.02) and r["TASp"] < 0.01 and 0 <= r["rho"] < 0.9


def test_curves_recover_parameters(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        t, s, g = rng.uniform(0, 25), rng.uniform(5, 40), rng.uniform(0, 10)
        y = 25 / (10 + 25) * 0
        y = (1.5 + 0.2 * g) * math.exp(0.09 * t - 0.0012 * t * t) * s / (8 + s)
        rows.append((1, 0, t, s, g, 2 * math.exp(0.08 * t - 0.001 * t * t) + rng.gauss(0, 0.05), y + rng.gauss(0, 0.02)))
    df = spark.createDataFrame(rows, "site_id long, window long, TS double, SWC double, GPP double, a double, b double")
    ref = spark.createDataFrame([(1, 0, 12.0, 20.0, 5.0)], "site_id long, window long, TS double, SWC double, GPP double")
    r = curves.er_curve(df.withColumn("NEE", F.col("a")), ref).first()
    assert r["C0"] == pytest.approx(2, abs=0.1) and r["alpha"] == pytest.approx(0.08, abs=0.01) and r["beta"] == pytest.approx(-0.001, abs=4e-4)
    assert r["ERref"] == pytest.approx(2 * math.exp(0.08 * 12 - 0.001 * 144), rel=0.02)
    r = curves.er_curve(df.withColumn("NEE", F.col("b")), ref, direct=True).first()
    assert r["ERref"] == pytest.approx((1.5 + 1.0) * math.exp(0.09 * 12 - 0.0012 * 144) * 20 / 28, rel=0.03)
    assert r["Hs"] == pytest.approx(8, abs=2.5) and r["k2"] == pytest.approx(0.2, abs=0.08)


def test_ustar_threshold_finds_planted(spark):
    rng = random.Random(4)
    rows = [(1, 0, i, rng.uniform(0, 20), u, (5.0 if u > 0.2 else 25 * u) + rng.gauss(0, 0.02)) for i in range(6000) for u in [rng.uniform(0, 0.8)]]
    r = gapfill.ustar_threshold(spark.createDataFrame(rows, "site_id long, season long, id long, TA double, USTAR double, NEE double")).first()
    assert r["threshold"] == pytest.approx(0.2, abs=0.05)


def test_thresholds_fall_back(spark):
    rng = random.Random(5)

    def rows(year, season, n, limit):
        return [(1, year, season, rng.uniform(0, 20), u, (5.0 if u > limit else 5 * u / limit) + rng.gauss(0, 0.02)) for _ in range(n) for u in [rng.uniform(0, 0.8)]]

    data = rows(2000, 1, 3000, 0.2) + rows(2000, 2, 3000, 0.3) + rows(2000, 3, 50, 0.1) + rows(2001, 1, 150, 0.4) + rows(2001, 2, 150, 0.4) + rows(2001, 3, 700, 0.4)[:150] + rows(2002, 1, 20, 0.1)
    df = spark.createDataFrame(data, "site_id long, YEAR long, season long, TA double, USTAR double, NEE double")
    got = {(r["YEAR"], r["season"]): r for r in gapfill.ustar_thresholds(df, least_in_class=60).collect()}
    assert [got[k]["mode"] for k in sorted(got)] == ["season", "season", "year", "pooled", "pooled", "pooled", "site"]
    assert got[2000, 1]["threshold"] == pytest.approx(0.2, abs=0.06) and got[2000, 3]["threshold"] == got[2000, 2]["threshold"]
    assert got[2001, 1]["threshold"] == pytest.approx(0.4, abs=0.1) and got[2002, 1]["threshold"] == pytest.approx((got[2000, 2]["threshold"] + got[2001, 1]["threshold"]) / 2)


def test_dyadic_blocks_make_up_the_period(spark):
    rng = random.Random(3)
    spans = [(a, a + n) for a in (-70, -1, 0, 5, 1000) for n in (0, 1, 2, 3, 7, 8, 30, 365, 4000)] + [(a, a + rng.randint(0, 10**6)) for a in range(20)]
    d = spark.createDataFrame(spans, "a long, b long").withColumn("x", j.dyadic_blocks(F.col("a"), F.col("b"), 21))
    for r in d.collect():
        parts = sorted((x["block"] << x["level"], (x["block"] + 1) << x["level"]) for x in r["x"])
        assert parts[0][0] == r["a"] and parts[-1][1] == r["b"] + 1 and all(p[1] == q[0] for p, q in zip(parts, parts[1:]))
        assert len(parts) <= 2 * max(1, (r["b"] - r["a"] + 1).bit_length())


def test_range_join_of_long_and_nested_periods(spark):
    """Short, long and nested periods, one key with hundreds: every pair once, in few copies."""
    rng = random.Random(7)
    periods = [(1, k, float(a), float(a + rng.choice([0.0, 0.5, 2, 30, 400, 5000]))) for k in range(300) for a in [rng.randint(-100, 4000)]] + [(1, 1000, -1e5, 1e5), (2, 1001, 3.0, 3.0), (2, 1002, 9.0, 8.0), (None, 1003, 0.0, 9.0)]
    rows = [(i % 3 or None, i, rng.choice([rng.randint(-200, 9000) * 1.0, rng.uniform(-200, 9000), 3.0])) for i in range(1500)] + [(1, 5000, None)]
    p = spark.createDataFrame(periods, "site_id long, k long, a double, b double")
    d = spark.createDataFrame(rows, "site_id long, i long, v double")
    want = sorted((i, k) for s, i, v in rows for t, k, a, b in periods if s is not None and s == t and v is not None and a <= v <= b)
    out = j.range_join(d, p, "v", "a", "b")
    assert set(out.columns) == {"site_id", "i", "v", "k", "a", "b"}
    assert sorted((r["i"], r["k"]) for r in out.collect()) == want and len(want) > 5000
    # no row is listed more often than a length has binary digits, no period in more than twice that
    digits = (2 * 10**5 + 1).bit_length()
    blocks = p.select(F.size(j.dyadic_blocks(F.floor("a"), F.floor("b"), digits)).alias("n")).agg(F.max("n")).first()[0]
    levels = p.select(F.explode(j.dyadic_blocks(F.floor("a"), F.floor("b"), digits)).alias("x")).select("x.level").distinct().count()
    assert blocks <= 2 * digits and levels <= digits
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan and "NestedLoop" not in plan


def test_control_year_replaces_long_gap(spark):
    def year(y, ts, missing):
        return [(1, y, d, ts, False) for d in range(1, 41)], [(1, y, d, 1.0) for d in range(1, 41) if d not in missing]

    ac, nights = [], []
    for y, ts, missing in ((2000, 10.0, set(range(5, 25))), (2001, 10.4, {7}), (2002, 9.5, {3, 9})):
        x, n = year(y, ts, missing)
        ac += x
        nights += n
    t = control.yearly_table(
        spark.createDataFrame(ac, "site_id long, growing_year long, DOY long, TS double, daytime boolean"), spark.createDataFrame(nights, "site_id long, growing_year long, DOY long, NEE double"),
        spark.createDataFrame([(1, 1, 40)], "site_id long, gStart long, gEnd long"),
    )
    assert {r["growing_year"]: r["max_gap"] for r in t.collect()} == {2000: 20, 2001: 1, 2002: 1}
    assert control.control_year(t).first()["control_year"] == 2001


def test_cyclic_smooth_by_force(spark):
    """The smooth from sums of harmonics against the one from the rows' own basis, for full, thin and constant sites."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(1, d, float(np.sin(d / 40) * 3 + rng.normal()), int(rng.integers(1, 9))) for d in range(1, 367) if d % 7] + [(2, d, float(rng.normal()), 1) for d in (3, 50, 90, 200, 300)] + [(3, d, 2.5, 2) for d in range(1, 30)]
    got = {}
    for r in season.cyclic_smooth(spark.createDataFrame(rows, "site_id long, DOY long, value double, n_years int"), "value", "n_years").collect():
        got.setdefault(r["site_id"], {})[r["DOY"]] = r["smooth"]
    for site in (1, 2):
        t, y, w = (np.array([r[i] for r in rows if r[0] == site], float) for i in (1, 2, 3))
        k = np.arange(1, min(12, (len(t) - 1) // 2) + 1)

        def basis(days, k=k):
            a = 2 * np.pi * np.outer(days, k) / 366
            return np.concatenate([np.ones((len(days), 1)), np.cos(a), np.sin(a)], axis=1)

        b, pen, best = basis(t), np.concatenate([[0.0], k**4, k**4]), None
        for lam in np.logspace(-6, 6, 49):
            m = b.T @ (b * w[:, None]) + np.diag(lam * pen)
            coef = np.linalg.solve(m, b.T @ (w * y))
            score = (len(y) - 1) * np.log((w * y * y).sum() - coef @ (b.T @ (w * y))) + np.linalg.slogdet(m)[1] - 2 * len(k) * np.log(lam)
            best = min(best or (score, coef), (score, coef), key=lambda x: x[0])
        np.testing.assert_allclose([got[site][d] for d in range(1, 367)], basis(np.arange(1, 367)) @ best[1], rtol=1e-6, atol=1e-6)
    assert set(got[3].values()) == {2.5}


def test_season_report_agrees_with_the_season(spark):
    """Reasons, edges and thresholds from the smooth that the season itself has; southern sites on their own axis."""
    def site(k, shift, level=10.0, days=range(1, 366)):
        wave = [math.cos(2 * math.pi * (d - shift) / 366) for d in days]
        return [(k, 2000, d, 1, 0, 5 + 4 * v, level + 10 * v, 20.0) for d, v in zip(days, wave)]

    rows = site(1, 200) + site(2, 15) + site(3, 200, level=-30.0) + site(4, 200, days=range(1, 100)) + [(5, 2000, d, 1, 0, 1.0 + d % 2, None, None) for d in range(1, 366)]
    df = spark.createDataFrame(rows, "site_id long, YEAR long, DOY long, NIGHT int, QC int, NEE double, TS double, TA double")
    got = {r["site_id"]: r for r in season.season_report(df, south=F.col("site_id") == 2).collect()}
    assert [got[k]["reason"] for k in range(1, 6)] == [None, None, "no active day", "too few days of night flux", "too few days of temperature"]
    north, south = got[1], got[2]
    assert north["status"] == "ok" and north["offStart"] == north["gEnd"] + 1 and north["offEnd"] == north["gStart"] - 1 and north["nee_threshold"] == pytest.approx(1 + 0.2 * 8, abs=0.05)
    assert south["gStart"] >= 183 and south["gEnd"] > 366 and south["offStart"] == south["gEnd"] + 1 and south["offEnd"] == south["gStart"] - 1
    assert got[3]["nee_threshold"] is not None and got[4]["nee_threshold"] is None
    seasons = {r["site_id"]: tuple(r) for r in season.active_season(df, F.col("site_id") == 2).collect()}
    assert seasons == {k: (k, got[k]["gStart"], got[k]["gEnd"], got[k]["trimmed_days"]) for k in (1, 2)}
    assert {r["site_id"]: r["reason"] for r in season.season_status(df).collect()} == {k: got[k]["reason"] for k in got}


def test_cyclic_smooth_follows_course(spark):
    rows = [(1, d, 10 + 5 * math.sin(2 * math.pi * d / 366), 3) for d in range(1, 367) if not 150 < d < 170]
    got = season.cyclic_smooth(spark.createDataFrame(rows, "site_id long, DOY long, value double, n_years long"), "value", "n_years").collect()
    assert len(got) == 366 and all(abs(r["smooth"] - (10 + 5 * math.sin(2 * math.pi * r["DOY"] / 366))) < 0.1 for r in got)


def test_forest_queries_use_the_whole_job(spark):
    import inspect

    def of(f):
        return {n: p.default for n, p in inspect.signature(f).parameters.items()}

    assert (of(drivers.forest)["trees"], of(drivers.forest)["node"], of(drivers.forest)["mtry"]) == (500, 30, 1)
    assert (of(drivers.permutation_importance)["repeats"], of(drivers.permutation_importance)["trees"]) == (50, 500)
    assert (of(drivers.tune)["nodes"], of(drivers.tune)["trees"], of(drivers.tune)["k"]) == (40, 500, 5)
    assert tuple(of(drivers.bootstrap_dependence)[c] for c in ("times", "points", "trees", "node")) == (200, 51, 500, 30)


def test_tuning(spark):
    rng = random.Random(6)
    rows = [(i, i % 2, x, z, 5 * x + rng.gauss(0, 0.1)) for i in range(200) for x, z in [(rng.random(), rng.random())]]
    df = spark.createDataFrame(rows, "id long, s long, x double, z double, y double")
    scores = drivers.tune(df, "y", ["x", "z"], ["s"], "id", nodes=30, trees=20, k=4)
    assert scores.count() == 2 * 30 * 2
    best = drivers.best_setting(scores).first()
    assert best["mtry"] == 2 and best["node"] < 15 and best["RMSE"] < 0.4


def test_soil_temperature_queries_reach_every_site(spark):
    from thermoflux.plans import registry
    from thermoflux.plans.models import m1b, m2, m3
    from thermoflux.plans.views import obs_multi

    d = "/root/testdata/sf0.01"
    assert registry
    measured = {r["site_id"]: r["n"] for r in obs_multi(spark, d).groupBy("site_id").agg({"TS": "count"}).withColumnRenamed("count(TS)", "n").collect()}
    for q in (m1b, m2):
        assert {r["site_id"] for r in q(spark, d).collect() if r["n"] > measured[r["site_id"]]} == set(measured)
    assert {r["site_id"] for r in m3(spark, d).collect() if r["TS_repair_flag"] == 1} == set(measured)


def test_future_widens_sparse_windows(spark):
    from thermoflux.operators import future

    # 51 rows and some more a year: a window of 14 days and 7 on either side holds fewer than 30
    rows = [(1, y, 1 + d // 31, d, 5 + 10 * math.sin(d / 40), 6 + 10 * math.sin(d / 40), 2 * math.exp(0.08 * (5 + 10 * math.sin(d / 40)))) for y in range(2000, 2006) for d in [*range(100, 201, 2), *range(101, 101 + 2 * (y - 2000), 2)]]
    nights = spark.createDataFrame(rows, "site_id long, YEAR long, MONTH long, DOY long, TS double, TA double, NEE double")
    windows = spark.createDataFrame([(1, k, 100 + 14 * k, min(113 + 14 * k, 200)) for k in range(8)], "site_id long, window long, w_start long, w_end long")
    got = {(r["window"], r["YEAR"]): r for r in future.widened(nights, windows, 40).groupBy("window", "YEAR", "extend_days").count().collect()}
    for (k, y), r in got.items():
        def inside(e):
            return sum(1 for x in rows if x[1] == y and 100 + 14 * k - e <= x[3] <= min(113 + 14 * k, 200) + e)

        want = next((e for e in range(7, 57, 7) if inside(e) >= 40), 56)
        assert (r["extend_days"], r["count"]) == (want, inside(want))
    assert len(got) == 48
    warming = spark.createDataFrame([(1, *[1.0] * 12)], ["site_id", *[f"Tmin{m}" for m in range(1, 13)]])
    out = future.future_respiration(nights, windows, warming, spark.createDataFrame([(1, -0.02)], "site_id long, TAS double")).first()
    # the mean over the days of any year whose soil is warmer than 1 degree
    course = list({r[3]: r[6] for r in rows if r[4] > 1}.values())
    assert out["present"] == pytest.approx(sum(course) / len(course), rel=0.1) and out["future"] > out["present"]


def test_night_course_fills_holes(spark):
    from thermoflux.operators import future

    # one time of day; the second day has no air temperature, the fourth no soil temperature, the fifth falls into two months
    rows = [(1, 2000, 3, 60, 2, 0, 1.0, 2.0), (1, 2000, 3, 61, 2, 0, None, 4.0), (1, 2000, 3, 62, 2, 0, 5.0, 6.0), (1, 2000, 3, 63, 2, 0, 7.0, None), (1, 2000, 3, 64, 2, 0, 9.0, 10.0), (1, 2001, 4, 64, 2, 0, 99.0, 99.0)]
    nights = spark.createDataFrame(rows, "site_id long, YEAR long, MONTH long, DOY long, HOUR long, MINUTE long, TA double, TS double")
    got = {r["DOY"]: (r["MONTH"], r["TA"], r["TS"]) for r in future.night_course(nights).collect()}
    assert got == {60: (3, 1.0, 2.0), 61: (3, 3.0, 4.0), 62: (3, 5.0, 6.0), 63: (3, 7.0, pytest.approx(8.0)), 64: (3, 9.0, 10.0)}


def test_stored_tables_are_removed_on_demand(spark):
    import os

    df = io.stored(spark.range(5), "mine")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    assert io.remove_stored(spark) >= 1 and not os.path.exists(os.path.dirname(path)) and io.remove_stored(spark) == 0


def test_a_job_removes_its_own_tables_only(spark):
    with io.Job() as outer:
        mine = io.stored(spark.range(3), "outer")
        with io.Job() as inner:
            other = io.stored(spark.range(4), "inner")
        also = io.stored(spark.range(5), "outer")
    elsewhere = io.stored(spark.range(6), "session")
    assert inner.remove(spark) == 1 and inner.remove(spark) == 0
    with pytest.raises(Exception, match="(?i)exist|found"):
        other.count()
    assert mine.count() == 3 and also.count() == 5 and elsewhere.count() == 6
    assert outer.remove(spark) == 2 and elsewhere.count() == 6


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    class Cluster:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="checkpoint"):
        io.scratch(Cluster, "x")
