"""Models that SQL cannot express, recomputed in numpy from the collected rows of the smallest view."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermoflux.functions import scalars as sc
from thermoflux.operators import aggregates as a
from thermoflux.operators import curves, regression, response
from thermoflux.plans import registry
from thermoflux.plans.models import _FEATURES, _RESPONSE, _WARMER, _chain, _curve_rows, _features, _reference, m1b, m2
from thermoflux.plans.views import ORDER, obs_multi

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def obs(spark):
    assert registry
    df = obs_multi(spark, DATA).toPandas().sort_values(["site_id", *ORDER], kind="stable").reset_index(drop=True)
    for name, n in (("d1", 4), ("d8", 32)):
        df[name] = df.groupby("site_id")["TA"].transform(lambda x, n=n: x.rolling(n).mean())
    # the rule of soil temperatures: the n rows before a row, itself left out; its own value where there is none
    for name, n in (("p1", 4), ("p8", 32)):
        df[name] = [own["TA"].iloc[max(0, i - n) : i].mean() if i else own["TA"].iloc[0] for _, own in df.groupby("site_id") for i in range(len(own))]
    return df


BEFORE = ("TA", "p1", "p8")


def fitted(train, xs=("TA", "d1", "d8")):
    t = train.dropna(subset=["TS", *xs])
    x = np.column_stack([np.ones(len(t)), t[list(xs)]])
    return len(t), np.linalg.lstsq(x, t["TS"], rcond=None)[0]


def predicted(coef, rows, xs=("TA", "d1", "d8")):
    return coef[0] + rows[list(xs)].to_numpy() @ coef[1:]


def test_soil_temperature_with_three_regressors(spark, obs):
    got = {r["site_id"]: r for r in m1b(spark, DATA).collect()}
    assert set(got) == set(obs["site_id"])
    for site, own in obs.groupby("site_id"):
        n, coef = fitted(own[own["TA"] > 5], BEFORE)
        ts = predicted(coef, own, BEFORE) if n >= 30 else own["TS"].to_numpy()
        assert got[site]["TS_status"] == ("replaced" if n >= 30 else "too_few")
        assert got[site]["n"] == np.isfinite(ts).sum() and got[site]["ts"] == pytest.approx(np.nanmean(ts), rel=1e-6)


def test_soil_temperature_by_row_and_status(spark, obs):
    """Every value, with training dates, a limit that some rows meet exactly, and sites without configuration or with too few rows."""
    edge = float(np.sort(obs.loc[obs["site_id"] == 1, "TA"])[300])
    config = [(1, "1996-03-01", "1999-06-30", edge), (2, None, None, None), (3, "1997-01-01", "1997-01-05", 0.0)]
    df = obs_multi(spark, DATA).withColumn("TA_QC", F.col("QC") + 5)
    out = regression.soil_temperature(df, spark.createDataFrame(config, "site_id long, start string, end string, ta_min double"), 4, ORDER)
    got = out.toPandas().sort_values(["site_id", *ORDER], kind="stable").reset_index(drop=True)
    for site, own in obs.groupby("site_id"):
        day, train = own["stamp"].dt.strftime("%Y-%m-%d"), None
        if site == 1:
            train = own[(day >= "1996-03-01") & (day <= "1999-06-30") & (own["TA"] > edge)]
            assert (own["TA"] == edge).any()
        elif site == 2:
            train = own
        rows = got[got["site_id"] == site]
        want = own["TS"].to_numpy() if train is None else predicted(fitted(train, BEFORE)[1], own, BEFORE)
        np.testing.assert_allclose(rows["TS"].to_numpy(float), want, rtol=1e-7)
        assert set(rows["TS_status"]) == {"too_few" if site == 3 else "not_configured" if train is None else "replaced"}
        assert (rows["TS_QC"].isna() if train is None else rows["TS_QC"] == rows["TA_QC"]).all()


def test_reconstruction_from_donors(spark, obs):
    mean = obs.groupby("site_id")["TA"].mean()
    got = {r["site_id"]: r for r in m2(spark, DATA).collect()}
    for site, own in obs.groupby("site_id"):
        near = sorted((abs(mean[site] - v), d) for d, v in mean.items() if d != site)[:3]
        pool = obs[obs["site_id"].isin([d for _, d in near]) & (obs["TA"] > 0)]
        ts = predicted(fitted(pool, BEFORE)[1], own, BEFORE)
        assert got[site]["TS_status"] == "replaced"
        assert got[site]["n"] == np.isfinite(ts).sum() and got[site]["ts"] == pytest.approx(np.nanmean(ts), rel=1e-6)


def test_donors_keep_their_own_limits(spark, obs):
    donors = spark.createDataFrame([(1, 2), (1, 3), (4, 2)], "target long, donor long")
    config = spark.createDataFrame([(2, "1997-01-01", None, 20.0), (9, None, None, 0.0)], "site_id long, start string, end string, ta_min double")
    out = regression.reconstruct_from_donors(obs_multi(spark, DATA), donors, 4, ORDER, config).groupBy("site_id", "TS_status").agg(F.avg("TS").alias("ts"))
    got = {r["site_id"]: r for r in out.collect()}
    two = obs[(obs["site_id"] == 2) & (obs["stamp"] >= "1997-01-01") & (obs["TA"] > 20)]
    three = obs[(obs["site_id"] == 3) & (obs["TA"] > 0)]
    for target, pool in ((1, pd.concat([two, three])), (4, two)):
        ts = predicted(fitted(pool, BEFORE)[1], obs[obs["site_id"] == target], BEFORE)
        assert got[target]["TS_status"] == "replaced" and got[target]["ts"] == pytest.approx(np.nanmean(ts), rel=1e-6)
    assert got[2]["TS_status"] == "not_configured" and got[2]["ts"] == pytest.approx(obs.loc[obs["site_id"] == 2, "TS"].mean())


def test_repaired_periods(spark, obs):
    bad = pd.DataFrame([(1, 1997, 50, 120), (2, 1999, 10, 200)], columns=["site_id", "YEAR", "DOY_start", "DOY_end"])
    out = regression.repair_periods(obs_multi(spark, DATA), spark.createDataFrame(bad), 4, ORDER, min_rows=20)
    got = {r["site_id"]: r for r in out.groupBy("site_id").agg(F.sum("TS").alias("ts"), F.sum("TS_repair_flag").alias("k"), F.count("TS").alias("n")).collect()}
    for site, own in obs.groupby("site_id"):
        ts, k = own["TS"].to_numpy(float).copy(), 0
        for b in bad[bad["site_id"] == site].itertuples():
            inside = ((own["YEAR"] == b.YEAR) & own["DOY"].between(b.DOY_start, b.DOY_end)).to_numpy()
            _, coef = fitted(own[~inside & own["QC"].isin([0, 1]) & own["DOY"].between(b.DOY_start - 30, b.DOY_end + 30)])
            new = predicted(coef, own)
            done = inside & np.isfinite(new)
            ts[done], k = new[done], k + done.sum()
        assert got[site]["k"] == k and got[site]["n"] == np.isfinite(ts).sum() and got[site]["ts"] == pytest.approx(np.nansum(ts), rel=1e-6)
    assert sum(r["k"] for r in got.values()) > 0


def loss(p, names, rows, prior, sd, s2):
    return ((rows["NEE"] - curves._model(p, {c: rows[c].to_numpy(float) for c in ("TS", "SWC", "GPP")}, names)[0]) ** 2).sum() / s2 + (((p - prior) / sd) ** 2).sum()


@pytest.mark.parametrize("kind", ["yearly", "direct without soil water"])
def test_curves_are_optimal(spark, kind):
    """No nearby parameters within the bounds have a smaller penalised loss than the ones found."""
    rows = _curve_rows(spark, DATA)
    rng = np.random.default_rng(1)
    if kind == "yearly":
        names, by = ["C0", "alpha", "beta"], ["site_id", "window", "YEAR"]
        pooled = curves.er_curve(rows, _reference(rows))
        got = curves.er_curve(rows, _reference(rows), by=tuple(by), priors=pooled, min_rows=5).toPandas()
        prior = {(r["site_id"], r["window"]): r for r in pooled.collect()}
    else:
        names, by, prior = ["C0", "alpha", "beta", "k2"], ["site_id", "window"], None
        got = curves.er_curve(rows, _reference(rows), direct=True, use_swc=False).toPandas()
        assert "Hs" not in got.columns
    assert len(got) > 3
    data = rows.select(*by, "TS", "NEE", "SWC", "GPP").dropna(subset=["TS", "NEE"] if prior else ["TS", "NEE", "GPP"]).toPandas()
    lo, hi = (np.array([curves.BOUNDS[n][i] for n in names]) for i in (0, 1))
    for r in got.head(12).to_dict("records"):
        own = data[np.logical_and.reduce([data[c] == r[c] for c in by])]
        assert len(own) == r["n"]
        if prior:
            pr = prior[r["site_id"], r["window"]]
            p0, sd = np.array([pr[n] for n in names]), np.maximum(np.array([pr[f"{n}_sd"] for n in names]) * 3, 1e-4)
        else:
            p0, sd = np.array([max(float(np.percentile(own["NEE"], 50, method="inverted_cdf")) / 2, 0.1), 0.05, -0.001, 0.1]), np.array([5.0, 0.1, 0.01, 2.0])
        best = np.array([r[n] for n in names])
        # the optimum belongs to the noise of the step before, which the last estimate repeats but for rounding
        s2 = r["sigma"] ** 2
        at = loss(best, names, own, p0, sd, s2)
        for _ in range(60):
            q = np.clip(best + rng.normal(size=len(names)) * np.array([0.05, 0.005, 2e-4, 0.02])[: len(names)], lo, hi)
            assert loss(q, names, own, p0, sd, s2) >= at - 0.02 * (1 + abs(at))
        assert r["RMSE"] == pytest.approx(math.sqrt(np.mean((own["NEE"] - curves._model(best, {c: own[c].to_numpy(float) for c in ("TS", "SWC", "GPP")}, names)[0]) ** 2)), rel=1e-6)


@pytest.mark.parametrize("direct", [False, True])
def test_large_groups_are_fitted_by_aggregates(spark, monkeypatch, direct):
    """The same optimum, errors and references whether a group is summed in a task or over all executors."""
    rows = _curve_rows(spark, DATA).filter("site_id < 3")
    want = curves.er_curve(rows, _reference(rows), direct=direct).toPandas().sort_values(["site_id", "window"])
    monkeypatch.setattr(curves, "TASK_ROWS", 20)
    monkeypatch.setattr(curves, "TOGETHER", 4)
    df = curves.er_curve(rows.repartition(3), _reference(rows), direct=direct)
    got = df.toPandas().sort_values(["site_id", "window"])
    assert len(want) >= 5 and list(got.columns) == list(want.columns)
    for c in want.columns:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-6, err_msg=c)


def test_sums_are_exact():
    """Squared errors and their derivatives on sums by distinct predictors are those of the rows."""
    rng = np.random.default_rng(3)
    x = {"TS": rng.integers(0, 9, 200) / 2, "GPP": rng.integers(0, 3, 200) * 1.0}
    y, names, p = rng.normal(size=200), ["C0", "alpha", "beta", "k2"], np.array([1.0, 0.1, -0.004, 0.3])
    d = pd.DataFrame(x | {"y": y, "yy": y * y, "n": 1.0}).groupby(["TS", "GPP"], as_index=False).sum()
    own = curves.Sums({c: d[c].to_numpy() for c in x}, *[d[c].to_numpy() for c in ("n", "y", "yy")], names)
    f, j = curves._model(p, x, names)
    e, jj, jr = own.step(p)
    assert e == pytest.approx(((y - f) ** 2).sum()) and own.errors(p) == pytest.approx(e)
    np.testing.assert_allclose(jj, j.T @ j)
    np.testing.assert_allclose(jr, j.T @ (y - f))


def test_variance_inflation(spark):
    df = _features(spark, "/root/testdata/sf0.01")
    rows = df.toPandas()
    got = {(r["site_id"], r["variable"]): r["vif"] for r in regression.vif(df, _FEATURES, ("site_id",)).collect()}
    assert len(got) == 30
    for (site, x), vif in got.items():
        own = rows[rows["site_id"] == site]
        others = np.column_stack([np.ones(len(own)), own[[c for c in _FEATURES if c != x]]])
        e = own[x] - others @ np.linalg.lstsq(others, own[x], rcond=None)[0]
        assert vif == pytest.approx(((own[x] - own[x].mean()) ** 2).sum() / (e**2).sum(), rel=1e-6)


def test_coefficient_table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) + 1e4 * np.array([1, 0, 0])
    y = x @ np.array([0.5, -2.0, 0.0]) + rng.normal(size=60)
    rows = [("a", *map(float, r), float(v)) for r, v in zip(x, y)] + [("a", None, 1.0, 1.0, 1.0)] + [("few", 1.0 * i, 2.0, 3.0, 1.0) for i in range(4)] + [("same", 1.0 * i, 2.0 * i, float(i * i), 1.0 * i) for i in range(9)]
    out = regression.multiple_regression(spark.createDataFrame(rows, "k string, a double, b double, c double, y double"), "y", ["a", "b", "c"], ("k",)).collect()
    got = {(r["k"], r["term"]): r for r in out}
    assert len(got) == 12 and all(got[k, t]["estimate"] is None and got[k, t]["p"] is None for k in ("few", "same") for t in "abc")
    design = np.column_stack([np.ones(60), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    e = y - design @ beta
    s2 = e @ e / 56
    se = np.sqrt(s2 * np.diag(np.linalg.inv(design.T @ design)))
    r2 = 1 - e @ e / ((y - y.mean()) ** 2).sum()
    for i, term in enumerate(["(intercept)", "a", "b", "c"]):
        r = got["a", term]
        assert (r["n"], r["df"]) == (60, 56) and r["r2"] == pytest.approx(r2) and r["sigma"] == pytest.approx(np.sqrt(s2)) and r["f"] == pytest.approx(r2 / 3 / ((1 - r2) / 56))
        assert r["estimate"] == pytest.approx(beta[i], rel=1e-5) and r["se"] == pytest.approx(se[i], rel=1e-5) and r["p"] == pytest.approx(two_sided(beta[i] / se[i], 56), abs=2e-5)
        if i:
            others = np.delete(design, i, axis=1)
            left = x[:, i - 1] - others @ np.linalg.lstsq(others, x[:, i - 1], rcond=None)[0]
            assert r["vif"] == pytest.approx(((x[:, i - 1] - x[:, i - 1].mean()) ** 2).sum() / (left @ left), rel=1e-5)
    assert got["a", "b"]["p"] < 1e-9 and got["a", "b"]["f_p"] < 1e-9


def two_sided(t, df):
    """Two-sided tail of Student's distribution by the trapezoid rule."""
    x = np.linspace(-abs(t), abs(t), 200_001)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return 1 - np.trapezoid(c * (1 + x * x / df) ** (-(df + 1) / 2), x)


def test_slope_and_correlation_p(spark, obs):
    annual = obs_multi(spark, DATA).groupBy("site_id", "YEAR").agg(F.avg("TA").alias("TA"))
    rows = annual.toPandas()
    for r in regression.with_slope_p(regression.warming_rate(annual)).collect():
        own = rows[rows["site_id"] == r["site_id"]].sort_values("YEAR")
        n, b = len(own), np.polyfit(own["YEAR"] - 1998, own["TA"], 1)
        e = own["TA"] - np.polyval(b, own["YEAR"] - 1998)
        t = b[0] / math.sqrt((e**2).sum() / (n - 2) / ((own["YEAR"] - own["YEAR"].mean()) ** 2).sum())
        assert r["slope"] == pytest.approx(b[0], rel=1e-5) and r["p"] == pytest.approx(two_sided(t, n - 2), abs=1e-6)
    corr = a.cor_test(a.correlation_matrix(obs_multi(spark, DATA), ["TA", "TS", "NEE"])).collect()
    assert len(corr) >= 3
    for r in corr:
        if r["p"] is not None and abs(r["r"]) < 1 - 1e-12:
            t = r["r"] * math.sqrt((r["n"] - 2) / (1 - r["r"] ** 2))
            assert r["p"] == pytest.approx(two_sided(t, r["n"] - 2), abs=1e-6)


def test_slope_test_by_force(spark):
    """The interval and the permutation share against resamples drawn here from the same hashes."""
    import hashlib

    rng = np.random.default_rng(4)
    rows = [(s, 2000 + i, float(0.1 * i * s + rng.normal())) for s in (1, 2) for i in range(8)] + [(3, 2000, 1.0), (4, 2000, None), (4, 2001, 2.0)]
    df = spark.createDataFrame(rows, "site_id long, x long, v double")
    got = {r["site_id"]: r for r in a.repeated_median_test(df, "x", "v", boot=60, perm=60).collect()}

    def slope(x, y):
        own = [np.median([(y[j] - y[i]) / (x[j] - x[i]) for j in range(len(x)) if x[j] != x[i]]) for i in range(len(x)) if any(x[j] != x[i] for j in range(len(x)))]
        return float(np.median(own)) if own else None

    def number(*p):
        return int(hashlib.md5("-".join(map(str, p)).encode()).hexdigest()[:7], 16)

    assert set(got) == {1, 2}  # one point has no slope
    for s in (1, 2):
        x, y = (np.array([r[k] for r in rows if r[0] == s], float) for k in (1, 2))
        n, b = len(x), slope(x, y)
        boot = [slope(x[d], y[d]) for k in range(60) for d in [[number("trend", "draw", s, k, i) % n for i in range(n)]]]
        # a row takes the value at its place in the hash order
        perm = [slope(x, y[np.argsort(sorted(range(n), key=lambda i: (number("trend", "mix", s, k, i), i)))]) for k in range(60)]
        assert got[s]["slope"] == pytest.approx(b)
        assert [got[s]["ci_low"], got[s]["ci_high"]] == pytest.approx(list(np.percentile([v for v in boot if v is not None], [2.5, 97.5])))
        assert got[s]["p_perm"] == pytest.approx(np.mean([abs(v) >= abs(b) - 1e-12 for v in perm]))


def test_temperature_source_beyond_a_thousand_names(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "site_id long, TA double, TS double")
    choice = spark.createDataFrame([(10 + i, f"no{i}") for i in range(3000)] + [(1, "TS"), (2, None)], "site_id long, source_col string")
    assert {r["site_id"]: r["TA"] for r in sc.replace_temperature_source(df, choice).collect()} == {1: 2.0, 2: 3.0}


def test_interpolation_of_a_long_site_is_linear_in_time(spark):
    from thermoflux.operators import windows as w

    df = spark.range(300_000).select(F.lit(1).alias("site_id"), F.col("id").alias("t"), F.when(F.col("id") % 1000 == 0, F.col("id") * 2.0).alias("x"))
    out = w.interpolate_linear(df, "x", ["t"], fill_ends=True)
    assert out.agg(F.max(F.abs(F.col("x") - F.least(F.col("t"), F.lit(299_000)) * 2.0))).first()[0] < 1e-6


def gap_fill_by_force(rows):
    """{id: (filled, n_used, method, days)} by trying every stage on every pair; rows: id, site_id, day, HOUR, NEE, SW_IN, TA, VPD."""
    from thermoflux.operators import gapfill as g

    out = {}
    for r in (r for r in rows if r[4] is None):
        out[r[0]] = (None, 0, None, None)
        for method, days in g.STAGES:
            own = []
            for o in (o for o in rows if o[4] is not None and o[1] == r[1]):
                if method == g.COURSE:
                    hit = any(abs((o[2] * 24 + o[3]) - ((r[2] + j) * 24 + r[3])) <= 1 for j in range(-days, days + 1))
                else:
                    light = None if None in (o[5], r[5]) else abs(o[5] - r[5]) < max(min(50, r[5]), 20)
                    like = method == g.RADIATION or (None not in (o[6], r[6], o[7], r[7]) and abs(o[6] - r[6]) < 2.5 and abs(o[7] - r[7]) < 5)
                    hit = light and like and abs(o[2] - r[2]) <= days
                if hit:
                    own.append(o[4])
            if len(own) >= 2:
                out[r[0]] = (pytest.approx(np.mean(own)), len(own), method, days)
                break
    return out


def test_gap_filling_by_force(spark):
    """Stages against all pairs, with values at the edges of bins, weak light, missing drivers, hours about midnight and gaps without any like row."""
    from thermoflux.operators import gapfill

    rng = np.random.default_rng(8)
    rows = []
    for i in range(420):
        sw, ta, vpd = float(rng.choice([0, 5, 19, 24, 25, 45, 60, 110, 300])), float(rng.integers(-4, 8) * 1.25), float(rng.integers(0, 6) * 2.5)
        site = int(i % 4)
        day = int(rng.integers(1, 90)) if site < 2 else int(rng.integers(1, 500))
        rows.append((i, site, day, int(rng.choice([0, 1, 2, 12, 13, 22, 23])), None if rng.random() < (0.3 if site < 2 else 0.7) else float(rng.normal()), sw if rng.random() < 0.9 else None, ta if rng.random() < 0.95 else None, vpd))
    rows += [(900, 9, 1, 3, None, 10.0, 1.0, 1.0), (901, 9, 2, 3, 1.0, 10.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, site_id long, day long, HOUR long, NEE double, SW_IN double, TA double, VPD double")
    got = {r["id"]: r for r in gapfill.gap_fill_mds(df, "id").collect()}
    want = gap_fill_by_force(rows)
    assert set(got) == set(want) and want[900][2] is None
    for i, w in want.items():
        assert (got[i]["filled"], got[i]["n_used"], got[i]["method"], got[i]["days"]) == w
    kinds = {(r["method"], r["days"]) for r in got.values()}
    assert {m for m, _ in kinds} == {None, 1, 2, 3} and {(1, 7), (1, 14), (2, 7), (3, 1)} <= kinds and max(k or 0 for _, k in kinds) > 70 and any(m == 2 and k > 7 for m, k in kinds if m)
    by_quality = {(r["method"], r["days"]): r["quality"] for r in got.values()}
    assert by_quality[1, 7] == 1 and by_quality[1, 14] == 2 and by_quality[3, 1] == 2 and {q for (m, k), q in by_quality.items() if m == 3 and k > 2} == {3}


def test_sums_of_crowded_cells_by_force():
    """Running sums over many cells of one radiation against all pairs, with edges met exactly, missing drivers and cells that stand alone; and the pairs that are compared one by one."""
    from thermoflux.operators import gapfill

    rng, tol = np.random.default_rng(3), gapfill.TOLERANCE
    n, k = 6000, 300

    def drawn(size, lights):
        out = {"_d": rng.integers(1, 60, size).astype(float), "SW_IN": rng.choice(lights, size), "TA": rng.integers(-20, 20, size) * 0.5, "VPD": rng.integers(0, 12, size) * 1.0}
        for c in ("TA", "VPD"):
            out[c] = np.where(rng.random(size) < 0.05, np.nan, out[c])
        return out

    lights = [0.0, 19.0, 24.0, 60.0, 74.0]
    cells = {**drawn(n, lights), "n": rng.integers(1, 4, n).astype(float), "s": rng.normal(50, 3, n)}
    cells["SW_IN"] = np.where(np.arange(n) < 500, rng.random(n) * 100, cells["SW_IN"])
    gaps = drawn(k, [*lights, 30.5])
    got = gapfill._sums_around(gaps, cells, tol, 3)
    for i in range(k):
        far = np.abs(cells["_d"] - gaps["_d"][i])
        near = np.abs(cells["SW_IN"] - gaps["SW_IN"][i]) < max(min(50, gaps["SW_IN"][i]), 20)
        like = near & (np.abs(cells["TA"] - gaps["TA"][i]) < tol["TA"]) & (np.abs(cells["VPD"] - gaps["VPD"][i]) < tol["VPD"])
        for w in (1, 2, 3):
            want = [cells[c][m & (far <= 7 * w)].sum() for m in (like, near) for c in ("n", "s")]
            np.testing.assert_allclose(got[:, i, w - 1], want, rtol=1e-11, atol=1e-9)


def test_gap_filling_of_crowded_blocks(spark, monkeypatch):
    """Thousands of gaps of one block, dealt to several tasks that each have all its donors."""
    from thermoflux.operators import gapfill

    monkeypatch.setattr(gapfill, "TASK_GAPS", 700)
    df = spark.range(12_000).selectExpr("id", "0L AS site_id", "id % 20 AS day", "id % 24 AS HOUR", "IF(id % 3 = 0, NULL, id % 7 * 1.0D) AS NEE", "10.0D AS SW_IN", "id % 50 / 10D AS TA", "id % 40 / 10D AS VPD")
    out = gapfill.gap_fill_mds(df, "id")
    got = {r["id"]: r for r in out.collect()}
    rows = df.toPandas()
    known = rows[rows["NEE"].notna()]
    assert len(got) == rows["NEE"].isna().sum()
    for g in rows[rows["NEE"].isna()].sample(60, random_state=1).itertuples():
        own = known[((known["TA"] - g.TA).abs() < 2.5) & ((known["VPD"] - g.VPD).abs() < 5) & ((known["day"] - g.day).abs() <= 7)]
        assert (got[g.id]["n_used"], got[g.id]["filled"], got[g.id]["method"], got[g.id]["days"]) == (len(own), pytest.approx(own["NEE"].mean()), 1, 7)


def test_cells_sent_to_gaps_grow_no_faster_than_rows(spark, monkeypatch):
    """However many tasks a block's gaps would be dealt to, its cells are sent ``COPIES`` times its gaps at most, and a copy; those of blocks without gaps are not sent at all."""
    from thermoflux.operators import gapfill

    monkeypatch.setattr(gapfill, "TASK_GAPS", 50)
    sent = spark.sparkContext.accumulator(0)
    real = gapfill._sums_around

    def counted(g, c, *rest):
        sent.add(len(c["n"]))
        assert len(g["_d"]), "a block without gaps"
        return real(g, c, *rest)

    monkeypatch.setattr(gapfill, "_sums_around", counted)
    # site 0: 2,000 gaps among 4,000 cells of one block; site 1: cells alone
    df = spark.range(9000).selectExpr("id", "IF(id < 6000, 0L, 1L) AS site_id", "id % 20 + 20 AS day", "id % 24 AS HOUR", "IF(id % 3 = 0 AND id < 6000, NULL, id % 7 * 1.0D) AS NEE", "60.0D AS SW_IN", "id / 1000D AS TA", "id % 40 / 10D AS VPD")
    got = {r["id"]: r for r in gapfill.gap_fill_mds(df, "id").collect()}
    assert len(got) == 2000 and 2 * 4000 <= sent.value <= 4000 + gapfill.COPIES * 2000
    known = df.filter("NEE IS NOT NULL AND site_id = 0").toPandas()
    for g in df.filter("NEE IS NULL").toPandas().sample(40, random_state=2).itertuples():
        own = known[((known["TA"] - g.TA).abs() < 2.5) & ((known["VPD"] - g.VPD).abs() < 5) & ((known["day"] - g.day).abs() <= 7)]
        assert (got[g.id]["n_used"], got[g.id]["filled"], got[g.id]["method"], got[g.id]["days"]) == (len(own), pytest.approx(own["NEE"].mean()), 1, 7)


def test_least_squares_read_their_rows_once(spark, obs):
    """A plan with one shuffle, of the sums."""
    fit = regression.ols(obs_multi(spark, DATA), "TS", ["TA", "SWC"])
    assert fit._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_bad_periods_are_repaired_with_one_copy_of_the_rows(spark, monkeypatch):
    written = []
    monkeypatch.setattr(regression, "stored", lambda df, name, real=regression.stored: written.append(df.columns) or real(df, name))
    bad = spark.createDataFrame([(1, 1997, 50, 120)], "site_id long, YEAR long, DOY_start long, DOY_end long")
    regression.repair_periods(obs_multi(spark, DATA), bad, 4, ORDER, min_rows=20)
    assert sum("TS" in c for c in written) == 1


def test_curve_queries_read_the_source_once(spark):
    """Rows of the fits, their references and medians come from one written table."""
    assert "curve-input" in _curve_rows(spark, DATA).inputFiles()[0]


def test_thresholds_do_not_shuffle_their_rows(spark):
    """Only sums and counts are shuffled: sides with a row a group are broadcast."""
    from thermoflux.operators import gapfill

    df = spark.range(4000).selectExpr("id % 2 AS site_id", "id % 3 AS season", "id % 97 / 3D AS TA", "id % 89 / 90D AS USTAR", "id % 7 * 1D AS NEE")
    plan = gapfill.ustar_threshold(df, least_in_class=20)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_chain_recovers_the_planted_response(spark):
    """From nights to the response: failing years stay as rows without values, the others follow the planted curve and response."""
    years = _chain(spark, "/root/testdata/sf0.01").persist()
    rows = years.toPandas()
    sizes = rows.groupby("site_id").size()
    assert set(rows["window"]) == set(range(8)) and sizes[0] == 8 * 7 and sizes[1] == 8 * 6
    assert not rows.duplicated(["site_id", "window", "growing_year"]).any()
    assert not ((rows["site_id"] == 1) & (rows["growing_year"] == 1999)).any()  # no nights at all: not among the site's years
    assert (rows.loc[rows["growing_year"] == 1998, "lnRatio"].dropna() == 0).all()
    done = rows.dropna(subset=["lnRatio"])
    assert len(done) > 80 and (done["n"] >= 60).mean() > 0.9
    # the ratio of a year to the control year is the planted response to the planted warming
    want = _RESPONSE * _WARMER * (done["growing_year"] - 1998)
    assert abs(done["lnRatio"] - want).max() < 0.05 and np.corrcoef(done["lnRatio"], want)[0, 1] > 0.99
    for r in response.total_response(years).collect():
        assert -0.06 < r["TAS"] < -0.035 and r["TASp"] < 1e-6
    years.unpersist()


def test_outliers_go_only_where_enough_years_failed(spark):
    rows = [(1, 0, y, 0.01 * y if y < 12 else None if y < 18 else 9.0) for y in range(19)] + [(1, 1, y, 0.01 * y if y < 12 else None if y < 15 else 9.0) for y in range(16)]
    d = spark.createDataFrame(rows, "site_id int, window int, y int, v double")
    got = a.extreme_outliers(d, "v", ("site_id", "window")).filter("v > 5").select("window").collect()
    assert [r["window"] for r in got] == [1]
