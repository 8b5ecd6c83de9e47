"""Queries of the aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermoflux.functions import scalars as sc
from thermoflux.operators import aggregates as a
from thermoflux.plans.registry import query
from thermoflux.plans.scalars import SOUTH, south
from thermoflux.plans.views import MULTI, SUB, obs_multi, obs_sub, rounded, table
from thermoflux.sources.io import stored


@query("a1_doy_climatology", f"WITH {MULTI} SELECT site_id, DOY, round(avg(NEE), 6) AS NEE, round(avg(NEE) FILTER (WHERE NIGHT = 1), 6) AS NEE_night, round(avg(NEE) FILTER (WHERE NIGHT = 0), 6) AS NEE_day FROM obs GROUP BY 1, 2")
def a1(spark, d):
    return rounded(a.doy_climatology(obs_multi(spark, d), ["NEE"]), "NEE", "NEE_night", "NEE_day")


TWO = "two AS (SELECT site_id, DOY, avg(v) AS value, count(*) AS n_years FROM (SELECT site_id, YEAR, DOY, avg(NEE) AS v FROM obs WHERE NEE IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)"


@query("a2_two_level_climatology", f"WITH {MULTI}, {TWO} SELECT site_id, DOY, round(value, 6) AS value, n_years FROM two")
def a2(spark, d):
    return rounded(a.two_level_climatology(obs_multi(spark, d), "NEE"), "value")


@query("a3_diurnal_climatology", f"WITH {SUB} SELECT site_id, DOY, HOUR, MINUTE, round(avg(NEE), 6) AS NEE FROM sub GROUP BY 1, 2, 3, 4")
def a3(spark, d):
    return rounded(a.diurnal_climatology(obs_sub(spark, d), ["NEE"]), "NEE")


@query("a4_season_temp_range", f"WITH {MULTI}, c AS (SELECT site_id, DOY, avg(TS) AS t FROM obs GROUP BY 1, 2) SELECT site_id, round(quantile_cont(t, 0.025), 6) AS tStart, round(quantile_cont(t, 0.975), 6) AS tEnd FROM c WHERE DOY BETWEEN 60 + site_id AND 280 GROUP BY 1")
def a4(spark, d):
    obs = obs_multi(spark, d)
    clim = obs.groupBy("site_id", "DOY").agg(F.avg("TS").alias("TS"))
    seasons = obs.select("site_id").distinct().select("site_id", (60 + F.col("site_id")).alias("gStart"), F.lit(280).alias("gEnd"))
    return rounded(a.season_temp_range(clim, seasons), "tStart", "tEnd")


@query("a5_daytime_uptake", f"WITH {MULTI} SELECT site_id, YEAR, DOY, round(greatest(-sum(CASE WHEN NIGHT = 0 THEN NEE - 25 END) * (30 * 60 / 86400::DOUBLE), 0), 6) AS uptake FROM obs GROUP BY 1, 2, 3")
def a5(spark, d):
    return rounded(a.daytime_uptake(obs_multi(spark, d).withColumn("NEE", F.col("NEE") - 25), 30), "uptake")


@query("a6_season_mean_ts", f"WITH {MULTI}, {SOUTH} SELECT site_id, growing_year, round(avg(TS), 6) AS mean_TS FROM south WHERE DOY BETWEEN 200 AND 203 GROUP BY 1, 2 HAVING count(TS) = count(*)")
def a6(spark, d):
    return rounded(a.season_mean_ts(south(spark, d), F.lit(200), F.lit(203)), "mean_TS")


#: Days of the active season, with an unknown day/night flag on some days and polar days on others.
_AC = "ac AS (SELECT site_id, growing_year, DOY, CASE WHEN DOY % 23 != 0 THEN NIGHT = 0 OR DOY % 29 = 0 END AS daytime FROM (SELECT * REPLACE (l_linenumber % 2 AS NIGHT) FROM south) WHERE DOY BETWEEN 100 AND 300), nn AS (SELECT site_id, growing_year, DOY, NEE FROM south WHERE DOY BETWEEN 100 AND 300 AND l_linenumber % 2 = 1 AND l_orderkey % 3 != 0)"
STATUS = f"{_AC}, dd AS (SELECT site_id, growing_year, DOY, count(daytime) = 0 AS unknown_daytime, coalesce(bool_or(NOT daytime), false) AS nt FROM ac GROUP BY ALL), ss AS (SELECT site_id, growing_year, DOY, count(NEE) > 0 AS seen FROM nn GROUP BY ALL), st AS (SELECT site_id, growing_year, DOY, unknown_daytime, unknown_daytime OR nt AS has_night, coalesce(seen, false) AS observed, (unknown_daytime OR nt) AND NOT coalesce(seen, false) AS is_gap FROM dd LEFT JOIN ss USING (site_id, growing_year, DOY))"
RUNS = "runs AS (SELECT site_id, growing_year, g, min(DOY) AS a, max(DOY) AS b, count(*) AS k FROM (SELECT *, sum(CASE WHEN is_gap THEN 0 ELSE 1 END) OVER (PARTITION BY site_id, growing_year ORDER BY DOY ROWS UNBOUNDED PRECEDING) AS g FROM st) WHERE is_gap GROUP BY 1, 2, 3)"


def season_rows(spark, d):
    obs = south(spark, d).filter("DOY BETWEEN 100 AND 300").withColumn("NIGHT", F.col("l_linenumber") % 2)
    ac = obs.withColumn("daytime", F.when(F.col("DOY") % 23 != 0, (F.col("NIGHT") == 0) | (F.col("DOY") % 29 == 0)))
    return ac, obs.filter("NIGHT = 1 AND l_orderkey % 3 <> 0")


def status(spark, d):
    return a.night_coverage(*season_rows(spark, d))


@query("a7_night_coverage", f"WITH {MULTI}, {SOUTH}, {STATUS} SELECT * FROM st")
def a7(spark, d):
    return status(spark, d)


@query("a8_coverage_summary", f"WITH {MULTI}, {SOUTH}, {STATUS} SELECT site_id, growing_year, count(*) AS days, count(*) FILTER (WHERE NOT has_night) AS polar_days, count(*) FILTER (WHERE unknown_daytime) AS unknown_days, count(*) FILTER (WHERE has_night) AS expected_nights, count(*) FILTER (WHERE has_night AND observed) AS observed_nights, count(*) FILTER (WHERE is_gap) AS gap_nights FROM st GROUP BY 1, 2")
def a8(spark, d):
    return a.coverage_summary(status(spark, d))


@query("a9_gap_summary", f"WITH {MULTI}, {SOUTH}, {STATUS}, {RUNS} SELECT site_id, growing_year, string_agg(k::VARCHAR, ', ' ORDER BY a) AS gap_lengths, max(k) AS max_gap, sum(k * k)::BIGINT AS gap_burden FROM runs GROUP BY 1, 2")
def a9(spark, d):
    return a.gap_summary(a.gap_runs(status(spark, d)))


_GAPS = "seen AS (SELECT DISTINCT site_id, YEAR, DOY FROM obs WHERE DOY BETWEEN 100 AND 300 AND NEE IS NOT NULL AND l_partkey % 4 = 0 UNION SELECT DISTINCT site_id, YEAR, unnest([100, 300]) FROM obs), gg AS (SELECT site_id, YEAR, DOY, DOY - lag(DOY) OVER (PARTITION BY site_id, YEAR ORDER BY DOY) AS gap FROM seen)"


def edge_gaps(spark, d):
    from thermoflux.operators.windows import lag_gap

    obs = obs_multi(spark, d)
    kept = obs.filter("DOY BETWEEN 100 AND 300 AND NEE IS NOT NULL AND l_partkey % 4 = 0")
    seasons = obs.select("site_id", "YEAR").distinct().withColumns({"gStart": F.lit(100), "gEnd": F.lit(300)})
    return lag_gap(kept, seasons, by=("site_id", "YEAR"))


@query("a10_year_gap_filter", f"WITH {MULTI}, {_GAPS} SELECT site_id, YEAR, max(gap) AS max_gap, round(sum(CASE WHEN gap > 4 THEN gap ELSE 0 END) / 201.0::DOUBLE, 6) AS long_share FROM gg GROUP BY 1, 2 HAVING max(gap) < 100.5 AND sum(CASE WHEN gap > 4 THEN gap ELSE 0 END) / 201.0::DOUBLE < 0.7")
def a10(spark, d):
    gaps = edge_gaps(spark, d).withColumn("len", F.lit(201.0))
    return rounded(a.year_gap_filter(gaps, F.col("len"), 4, ("site_id", "YEAR")), "long_share")


@query("a11_annual_budget", f"WITH {MULTI}, y AS (SELECT site_id, YEAR, coalesce(sum(NEE), 0) AS a, coalesce(sum(NEE) FILTER (WHERE NIGHT = 0), 0) AS b, coalesce(sum(NEE) FILTER (WHERE NIGHT = 1), 0) AS c FROM obs GROUP BY 1, 2) SELECT site_id, round(avg(a) * 0.0216::DOUBLE, 6) AS \"all\", round(avg(b) * 0.0216::DOUBLE, 6) AS day, round(avg(c) * 0.0216::DOUBLE, 6) AS night FROM y GROUP BY 1")
def a11(spark, d):
    return rounded(a.annual_budget(obs_multi(spark, d), 0.0216), "all", "day", "night")


@query("a12_climatological_budget", f"""WITH {MULTI}, c AS (SELECT site_id, l_linenumber % 2 AS NIGHT, DOY, avg(CASE WHEN DOY % 10 > 2 THEN NEE END) AS v FROM obs GROUP BY 1, 2, 3),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS a, last_value(CASE WHEN v IS NOT NULL THEN DOY END IGNORE NULLS) OVER p AS ax, first_value(v IGNORE NULLS) OVER q AS b, first_value(CASE WHEN v IS NOT NULL THEN DOY END IGNORE NULLS) OVER q AS bx FROM c
 WINDOW p AS (PARTITION BY site_id, NIGHT ORDER BY DOY ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY site_id, NIGHT ORDER BY DOY ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT site_id, NIGHT, coalesce(v, a + (b - a) * (DOY - ax) / (bx - ax)) AS w FROM f)
SELECT site_id, round(sum(w) * 0.0216::DOUBLE, 6) AS "all", round(sum(w) FILTER (WHERE NIGHT = 0) * 0.0216::DOUBLE, 6) AS day, round(sum(w) FILTER (WHERE NIGHT = 1) * 0.0216::DOUBLE, 6) AS night FROM g GROUP BY 1""")
def a12(spark, d):
    clim = obs_multi(spark, d).groupBy("site_id", (F.col("l_linenumber") % 2).alias("NIGHT"), "DOY").agg(F.avg(F.when(F.col("DOY") % 10 > 2, F.col("NEE"))).alias("NEE"))
    return rounded(a.climatological_budget(clim, 0.0216), "all", "day", "night")


@query("a13_temperature_metrics", f"""WITH {MULTI}, dd AS (SELECT site_id, YEAR, DOY, max(TA) - min(TA) AS r, avg(TA) AS m FROM obs GROUP BY 1, 2, 3), y AS (SELECT site_id, YEAR, avg(TA) AS m, stddev_samp(TA) AS s FROM obs GROUP BY 1, 2),
e AS (SELECT site_id, YEAR, avg(r) AS dr, max(m) - min(m) AS sr FROM dd GROUP BY 1, 2)
SELECT site_id, round(avg(y.m), 6) AS mean, round(avg(s), 6) AS sd_within, round(stddev_samp(y.m), 6) AS sd_between, round(avg(dr), 6) AS daily_range, round(avg(sr), 6) AS season_range FROM y JOIN e USING (site_id, YEAR) GROUP BY 1""")
def a13(spark, d):
    return rounded(a.temperature_metrics(obs_multi(spark, d), "TA"), "mean", "sd_within", "sd_between", "daily_range", "season_range")


@query("a14_monthly_index", f"WITH {MULTI} SELECT site_id, MONTH, round(greatest(avg(NEE - 25), 0), 6) AS value, count(NEE) AS n FROM obs GROUP BY 1, 2")
def a14(spark, d):
    return rounded(a.monthly_index(obs_multi(spark, d).withColumn("x", F.col("NEE") - 25), "x"), "value")


@query("a15_site_index_means", f"WITH {MULTI}, m AS (SELECT site_id, MONTH, greatest(avg(NEE), 0) AS a, greatest(avg(SWC), 0) AS b FROM obs GROUP BY 1, 2) SELECT site_id, round(avg(a), 6) AS nee, round(avg(b), 6) AS swc FROM m GROUP BY 1")
def a15(spark, d):
    obs = obs_multi(spark, d)
    return rounded(a.site_index_means([a.monthly_index(obs, "NEE"), a.monthly_index(obs, "SWC")], ["nee", "swc"]), "nee", "swc")


@query("a16_window_reference", f"WITH {MULTI} SELECT site_id, (DOY - 50) // 14 AS win, round(avg(TS), 6) AS TS, round(avg(SWC), 6) AS SWC FROM obs WHERE DOY BETWEEN 50 AND 300 GROUP BY 1, 2")
def a16(spark, d):
    obs = obs_multi(spark, d).withColumn("win", sc.window_id(F.col("DOY"), F.lit(50), F.lit(300))).filter("win IS NOT NULL")
    return rounded(a.window_reference(obs, ["TS", "SWC"], ("site_id", "win")), "TS", "SWC")


@query("a17_fit_metrics", f"WITH {MULTI} SELECT site_id, round(sqrt(avg((NEE - TA) * (NEE - TA))), 6) AS RMSE, round(pow(corr(NEE, TA), 2), 6) AS R2, round(avg(abs(NEE - TA)), 6) AS MAE FROM obs GROUP BY 1")
def a17(spark, d):
    return rounded(a.fit_metrics(obs_multi(spark, d), "NEE", "TA"), "RMSE", "R2", "MAE")


@query("a18_ensemble_delta", f"WITH {MULTI} SELECT site_id AS cell, MONTH, round(avg(TA) FILTER (WHERE YEAR >= 1999) - avg(TA) FILTER (WHERE YEAR < 1999), 6) AS delta FROM obs GROUP BY 1, 2 HAVING count(*) FILTER (WHERE YEAR >= 1999) > 0 AND count(*) FILTER (WHERE YEAR < 1999) > 0")
def a18(spark, d):
    obs = obs_multi(spark, d).select(F.col("site_id").alias("cell"), "MONTH", F.col("TA").alias("value"), "YEAR")
    return rounded(a.ensemble_delta(obs.filter("YEAR >= 1999"), obs.filter("YEAR < 1999")), "delta")


@query("a19_neighbourhood_mean", """WITH g AS (SELECT p_partkey % 50 AS "row", p_size AS col, avg(p_retailprice) AS v FROM part GROUP BY 1, 2), o AS (SELECT unnest([0, 1, -1, 0, 0]) AS r, unnest([0, 0, 0, 1, -1]) AS c),
m AS (SELECT "row" + r AS "row", col + c AS col, avg(v) AS m FROM g, o GROUP BY 1, 2) SELECT g."row" AS "row", g.col AS col, round(m, 6) AS mean5 FROM g JOIN m ON g."row" = m."row" AND g.col = m.col""")
def a19(spark, d):
    grid = table(spark, d, "part").groupBy((F.col("p_partkey") % 50).alias("row"), F.col("p_size").alias("col")).agg(F.avg("p_retailprice").alias("value"))
    return rounded(a.neighbourhood_mean(grid), "mean5")


_X = "x AS (SELECT site_id, YEAR, MONTH, avg(NEE) - 25 AS t, avg(TA) - 24 AS p FROM obs GROUP BY 1, 2, 3)"


def _x(spark, d):
    return obs_multi(spark, d).groupBy("site_id", "YEAR", "MONTH").agg((F.avg("NEE") - 25).alias("t"), (F.avg("TA") - 24).alias("p"))


@query("a20_one_sample_t", f"WITH {MULTI}, {_X} SELECT site_id, count(t) AS n, round(avg(t), 6) AS mean, round(avg(t) / (stddev_samp(t) / sqrt(count(t))), 6) AS t, count(t) - 1 AS df FROM x GROUP BY 1 HAVING count(t) >= 3")
def a20(spark, d):
    return rounded(a.one_sample_t(_x(spark, d).withColumnRenamed("t", "v"), "v", ("site_id",)), "mean", "t")


@query("a20b_one_sample_p")
def a20b(spark, d):
    return a.with_p(a.one_sample_t(_x(spark, d).withColumnRenamed("t", "v"), "v", ("site_id",)))


@query("a21_significance_counts", f"WITH {MULTI}, {_X} SELECT site_id, count(*) FILTER (WHERE t < 0) AS n_neg, count(*) FILTER (WHERE t > 0) AS n_pos, count(*) FILTER (WHERE t < 0 AND p < 0.05) AS n_neg_sig, count(*) FILTER (WHERE t > 0 AND p < 0.05) AS n_pos_sig FROM x GROUP BY 1")
def a21(spark, d):
    return a.significance_counts(_x(spark, d), "t", "p", ("site_id",))


@query("a22_variance_shares", f"WITH {MULTI}, {_X} SELECT site_id, round((var_samp(t) + covar_samp(t, p)) / var_samp(t + p), 6) AS share_t, round((var_samp(p) + covar_samp(t, p)) / var_samp(t + p), 6) AS share_p FROM x GROUP BY 1")
def a22(spark, d):
    return rounded(a.variance_shares(_x(spark, d).filter("t IS NOT NULL").withColumn("s", F.col("t") + F.col("p")), "t", "p", "s", ("site_id",)), "share_t", "share_p")


@query("a23_one_way_anova", """WITH g AS (SELECT o_orderpriority AS k, count(*) AS n, avg(sqrt(o_totalprice)) AS m, var_pop(sqrt(o_totalprice)) AS v FROM orders GROUP BY 1),
t AS (SELECT count(*) AS k, sum(n)::BIGINT AS N, sum(n * v) AS w, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b FROM g)
SELECT k - 1 AS df1, N - k AS df2, round((b / (k - 1)) / (w / (N - k)), 4) AS F, round(b / (b + w), 8) AS R2 FROM t""")
def a23(spark, d):
    out = a.one_way_anova(table(spark, d, "orders").withColumn("y", F.sqrt("o_totalprice")), "y", "o_orderpriority")
    return out.select("df1", "df2", F.round("F", 4).alias("F"), F.round("R2", 8).alias("R2"))


@query("a23b_anova_p")
def a23b(spark, d):
    out = a.one_way_anova(table(spark, d, "orders").withColumn("y", F.sqrt("o_totalprice")), "y", "o_orderpriority")
    return out.withColumn("p", a.f_tail(F.col("F"), F.col("df1").cast("double"), F.col("df2").cast("double")))


@query("a24b_correlation_p")
def a24b(spark, d):
    return a.cor_test(a.correlation_matrix(obs_multi(spark, d), ["TA", "NEE", "SWC"], ("site_id",)))


@query("a24_correlation_matrix", f"WITH {MULTI} SELECT site_id, 'TA' AS x, 'NEE' AS y, round(corr(TA, NEE), 6) AS r, count(NEE) AS n FROM obs GROUP BY 1 UNION ALL SELECT site_id, 'TA', 'SWC', round(corr(TA, SWC), 6), count(*) FROM obs GROUP BY 1 UNION ALL SELECT site_id, 'NEE', 'SWC', round(corr(NEE, SWC), 6), count(NEE) FROM obs GROUP BY 1")
def a24(spark, d):
    return rounded(a.correlation_matrix(obs_multi(spark, d), ["TA", "NEE", "SWC"], ("site_id",)), "r")


@query("a25_estimator_summary", f"""WITH {MULTI}, x AS (SELECT site_id AS scenario, YEAR, unnest(['a', 'b']) AS component, unnest([avg(NEE), avg(TA)]) AS est, unnest([stddev_samp(NEE), stddev_samp(TA)]) / 10 AS se, unnest([25.0::DOUBLE, 24.0::DOUBLE]) AS truth FROM obs GROUP BY 1, 2)
SELECT scenario, component, round(avg(truth), 6) AS truth, round(avg(est), 6) AS mean_est, round(stddev_samp(est), 6) AS sd_est, round(avg(est - truth), 6) AS bias, round(sqrt(avg((est - truth) * (est - truth))), 6) AS rmse, round(avg(CASE WHEN abs(est - truth) <= 1.96 * se THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM x GROUP BY 1, 2""")
def a25(spark, d):
    reps = obs_multi(spark, d).groupBy(F.col("site_id").alias("scenario"), "YEAR").agg(
        F.avg("NEE").alias("est_a"), F.avg("TA").alias("est_b"), (F.stddev_samp("NEE") / 10).alias("se_a"), (F.stddev_samp("TA") / 10).alias("se_b"), F.lit(25.0).alias("true_a"), F.lit(24.0).alias("true_b"))
    return rounded(a.estimator_summary(reps, ["a", "b"]), "truth", "mean_est", "sd_est", "bias", "rmse", "coverage")


@query("a26_weighted_year_mean", f"WITH {MULTI} SELECT site_id, YEAR, round(sum(NEE * TA) FILTER (WHERE NEE IS NOT NULL) / sum(TA) FILTER (WHERE NEE IS NOT NULL), 6) AS NEE FROM obs GROUP BY 1, 2")
def a26(spark, d):
    return rounded(a.weighted_year_mean(obs_multi(spark, d), "NEE", "TA", ("site_id", "YEAR")), "NEE")


@query("a27_class_counts", "SELECT p_brand, count(*) AS n, round(avg(abs(sqrt(p_retailprice) - 38)), 6) AS mean_abs_residual FROM part GROUP BY 1")
def a27(spark, d):
    return rounded(a.class_counts(table(spark, d, "part").withColumn("e", F.sqrt("p_retailprice") - 38), "p_brand", "e"), "mean_abs_residual")


@query("a28_repeated_median_slope", f"""WITH {MULTI}, y AS (SELECT site_id, YEAR, avg(NEE) AS v FROM obs GROUP BY 1, 2), s AS (SELECT a.site_id, a.YEAR, quantile_cont((b.v - a.v) / (b.YEAR - a.YEAR), 0.5) AS m FROM y a JOIN y b ON a.site_id = b.site_id AND a.YEAR != b.YEAR GROUP BY 1, 2)
SELECT site_id, round(quantile_cont(m, 0.5), 6) AS slope FROM s GROUP BY 1""")
def a28(spark, d):
    y = obs_multi(spark, d).groupBy("site_id", "YEAR").agg(F.avg("NEE").alias("v"))
    return rounded(a.repeated_median_slope(y, "YEAR", "v"), "slope")


@query("a28b_slope_test", f"""WITH {MULTI}, y AS (SELECT site_id, YEAR AS x, avg(NEE) AS v FROM obs GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY x, v) - 1 AS i, count(*) OVER (PARTITION BY site_id) AS n FROM y), reps AS (SELECT unnest(range(0, 1000)) AS rep),
d AS (SELECT p.site_id, rep, p.i, ('0x' || substr(md5('trend-draw-' || p.site_id || '-' || rep || '-' || p.i), 1, 7))::BIGINT % n AS j FROM p, reps),
m AS (SELECT site_id, rep, i, x, row_number() OVER (PARTITION BY site_id, rep ORDER BY ('0x' || substr(md5('trend-mix-' || site_id || '-' || rep || '-' || i), 1, 7))::BIGINT, i) - 1 AS j FROM p, reps),
r AS (SELECT 0 AS kind, d.site_id, rep, d.i, q.x, q.v FROM d JOIN p q ON q.site_id = d.site_id AND q.i = d.j UNION ALL SELECT 1, m.site_id, rep, m.i, m.x, q.v FROM m JOIN p q ON q.site_id = m.site_id AND q.i = m.j
      UNION ALL SELECT 2, site_id, 0, i, x, v FROM p),
e AS (SELECT a.kind, a.site_id, a.rep, a.i, quantile_cont((b.v - a.v) / (b.x - a.x), 0.5) AS s FROM r a JOIN r b ON a.kind = b.kind AND a.site_id = b.site_id AND a.rep = b.rep AND a.x != b.x GROUP BY 1, 2, 3, 4),
t AS (SELECT kind, site_id, rep, quantile_cont(s, 0.5) AS s FROM e GROUP BY 1, 2, 3), o AS (SELECT site_id, s AS slope FROM t WHERE kind = 2)
SELECT o.site_id, round(any_value(slope), 6) AS slope, round(quantile_cont(s, 0.025) FILTER (WHERE kind = 0), 6) AS ci_low, round(quantile_cont(s, 0.975) FILTER (WHERE kind = 0), 6) AS ci_high,
 round(avg(CASE WHEN kind = 1 THEN (abs(s) >= abs(slope) - 1e-12)::INT::DOUBLE END), 6) AS p_perm FROM t JOIN o USING (site_id) GROUP BY 1""")
def a28b(spark, d):
    y = obs_multi(spark, d).groupBy("site_id", "YEAR").agg(F.avg("NEE").alias("v"))
    return rounded(a.repeated_median_test(stored(y, "annual"), "YEAR", "v"), "slope", "ci_low", "ci_high", "p_perm")


@query("a29_extreme_outliers", f"""WITH {MULTI}, x AS (SELECT site_id, l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, MONTH, CASE WHEN l_orderkey % 97 = 0 THEN NEE * 9 ELSE NEE END AS v FROM obs),
n AS (SELECT *, row_number() OVER (PARTITION BY site_id, MONTH ORDER BY v) AS r FROM x WHERE v IS NOT NULL), c AS (SELECT site_id, MONTH, count(*) AS n, ((count(*) + 1) // 2 + 1) / 2.0 AS dp FROM n GROUP BY 1, 2), mi AS (SELECT site_id, MONTH, count(*) - count(v) AS k FROM x GROUP BY 1, 2),
h AS (SELECT c.site_id, c.MONTH, avg(v) FILTER (WHERE r IN (floor(dp)::INT, ceil(dp)::INT)) AS lo, avg(v) FILTER (WHERE r IN (floor(n + 1 - dp)::INT, ceil(n + 1 - dp)::INT)) AS hi FROM n JOIN c USING (site_id, MONTH) GROUP BY 1, 2)
SELECT site_id, MONTH, count(*) AS n, count(CASE WHEN NOT ((v < lo - 3 * (hi - lo) OR v > hi + 3 * (hi - lo)) AND abs(v) > 1.5 AND k >= 5) THEN v END) AS kept FROM x JOIN h USING (site_id, MONTH) JOIN mi USING (site_id, MONTH) GROUP BY 1, 2""")
def a29(spark, d):
    x = obs_multi(spark, d).withColumn("v", F.when(F.col("l_orderkey") % 97 == 0, F.col("NEE") * 9).otherwise(F.col("NEE")))
    return a.extreme_outliers(x, "v", ("site_id", "MONTH")).groupBy("site_id", "MONTH").agg(F.count("*").alias("n"), F.count("v").alias("kept"))


@query("a30_distinct_years", f"WITH {MULTI} SELECT DISTINCT site_id, YEAR FROM obs")
def a30(spark, d):
    return obs_multi(spark, d).select("site_id", "YEAR").distinct()
