"""Queries of the sources and sinks; files are derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermoflux.plans.registry import query
from thermoflux.plans.views import MULTI, SUB, obs_multi, obs_sub, table
from thermoflux.sources import io

_NAMES = """concat(CASE WHEN s_suppkey % 11 = 0 THEN 'x/._' ELSE 'x/' END, 'FLX_', chr(cast(65 + s_nationkey % 26 AS int)), 'X-S', lpad(cast(s_suppkey % 40 AS {text}), 2, '0'), '_FLUXNET_', CASE WHEN s_suppkey % 3 = 0 THEN 'HR' ELSE 'HH' END, '_', cast(s_suppkey AS {text}), '.csv')"""


@query("s1_read_flux", f"WITH {SUB} SELECT 'XX-' || upper(left(site_id, 3)) AS site_id, count(*) AS n, count(CASE WHEN event_id % 7 != 0 THEN 1 END) AS n_nee, round(sum(CASE WHEN event_id % 7 != 0 THEN round(NEE, 3) END), 4) AS nee FROM sub GROUP BY 1")
def s1(spark, d):
    path = io.scratch(spark, "flux")
    sub = obs_sub(spark, d).select(F.concat(F.lit("XX-"), F.upper(F.substring("site_id", 1, 3))).alias("s"), F.when(F.col("event_id") % 7 == 0, -9999.0).otherwise(F.round("NEE", 3)).alias("NEE"), "event_id")
    # one write for all sites; the folder of a site is named as its file would be
    folder = F.concat(F.lit("AMF_"), "s", F.lit("_BASE_HH_1"))
    sub.withColumn("file", folder).drop("s").write.partitionBy("file").csv(path, header=True)
    got = io.read_flux(spark, path, "NEE double, event_id long")
    return got.groupBy("site_id").agg(F.count("*").alias("n"), F.count("NEE").alias("n_nee"), F.round(F.sum("NEE"), 4).alias("nee"))


@query("s2_site_from_path", f"""WITH f AS (SELECT {_NAMES.format(text='VARCHAR')} AS path FROM supplier),
g AS (SELECT path, regexp_extract(path, '(^|/)[A-Za-z]+_([A-Z][A-Z]-[A-Za-z0-9][A-Za-z0-9][A-Za-z0-9])_', 2) AS site_id FROM f WHERE path NOT LIKE '%/._%')
SELECT path, site_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY CASE WHEN path LIKE '%\\_HH\\_%' ESCAPE '\\' THEN 0 ELSE 1 END, path) AS r FROM g) WHERE r = 1""")
def s2(spark, d):
    return io.prefer_half_hourly(table(spark, d, "supplier").select(F.expr(_NAMES.format(text="string")).alias("path"))).select("path", "site_id")


@query("s3_stack_sources", f"""WITH {MULTI}, a AS (SELECT * FROM obs WHERE YEAR < 1999), b AS (SELECT * FROM obs WHERE YEAR > 1997 AND site_id != 3),
l AS (SELECT site_id, max(stamp) AS m FROM a GROUP BY 1), h AS (SELECT DISTINCT b.site_id FROM b JOIN l ON b.site_id = l.site_id AND stamp = m)
SELECT site_id, YEAR, count(*) AS n, count(extra) AS n_extra FROM (SELECT site_id, YEAR, NULL AS extra FROM a UNION ALL
 SELECT b.site_id, YEAR, 1 FROM b LEFT JOIN l ON b.site_id = l.site_id LEFT JOIN h ON b.site_id = h.site_id WHERE h.site_id IS NULL OR stamp > m) GROUP BY 1, 2""")
def s3(spark, d):
    obs = obs_multi(spark, d)
    later = obs.filter("YEAR > 1997 AND site_id <> 3").withColumn("extra", F.lit(1))
    return io.stack_sources(obs.filter("YEAR < 1999"), later).groupBy("site_id", "YEAR").agg(F.count("*").alias("n"), F.count("extra").alias("n_extra"))


@query("s4_read_selected", f"WITH {MULTI} SELECT site_id, count(TS) AS n_ts FROM obs GROUP BY 1")
def s4(spark, d):
    return io.read_selected(obs_multi(spark, d), ["site_id", "TS"], ["TS_2"]).groupBy("site_id").agg(F.count("TS").alias("n_ts"))


@query("s5_null_sentinels", "SELECT l_suppkey % 10 AS site_id, count(CASE WHEN l_linenumber != 2 THEN 1 END) AS n_tax, count(CASE WHEN l_returnflag != 'R' THEN 1 END) AS n_flag, count(CASE WHEN l_quantity > 5 THEN 1 END) AS n_qty FROM lineitem GROUP BY 1")
def s5(spark, d):
    li = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("site_id"), F.when(F.col("l_linenumber") == 2, -9999.0).otherwise(F.col("l_tax")).alias("tax"),
        F.when(F.col("l_returnflag") == "R", "-9999.0").otherwise(F.col("l_returnflag")).alias("flag"), F.when(F.col("l_quantity") <= 5, float("nan")).otherwise(F.col("l_quantity")).alias("qty"))
    return io.null_sentinels(li).groupBy("site_id").agg(F.count("tax").alias("n_tax"), F.count("flag").alias("n_flag"), F.count("qty").alias("n_qty"))


@query("s6_read_site_info", "SELECT s_suppkey::VARCHAR AS site_ID, 'a, ' || s_name AS comment, CASE WHEN s_suppkey % 2 = 0 THEN n_name END AS IGBP FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 1")
def s6(spark, d):
    path = io.scratch(spark, "site-info")
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("s_suppkey").alias("﻿site_ID"), F.concat(F.lit("a, "), "s_name").alias("comment"), F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).alias("IGBP"), F.concat(F.lit("src"), F.col("s_suppkey") % 3).alias("source"))
    s.write.csv(path, header=True, quote='"', escape='"', nullValue="")
    return io.read_site_info(spark, path, "src1").select("site_ID", "comment", "IGBP")


@query("s7_read_season_features", "SELECT s_suppkey % 3 AS src, count(*) AS n, sum(s_suppkey % 9)::BIGINT AS nyear, count(CASE WHEN s_suppkey % 3 = 1 THEN 1 END) AS n_start FROM supplier GROUP BY 1")
def s7(spark, d):
    paths = []
    for k in range(3):
        part = table(spark, d, "supplier").filter(F.col("s_suppkey") % 3 == k).select(F.col("s_suppkey").alias("site_ID"), (F.col("s_suppkey") % 9).alias("nyear"), *([F.lit(5).alias("gStart")] if k == 1 else []))
        paths.append(io.scratch(spark, "season"))
        part.write.csv(paths[-1], header=True)
    got = io.read_season_features(spark, paths)
    return got.groupBy((F.col("site_ID") % 3).cast("bigint").alias("src")).agg(F.count("*").alias("n"), F.sum("nyear").alias("nyear"), F.count("gStart").alias("n_start"))


@query("s8_read_daily_swc", f"WITH {MULTI} SELECT site_id::VARCHAR AS site_id, YEAR, MONTH, count(*) AS n, round(sum(swc), 4) AS swc FROM (SELECT site_id, YEAR, MONTH, DAY, round(max(SWC), 3) AS swc FROM obs GROUP BY ALL) GROUP BY 1, 2, 3")
def s8(spark, d):
    path = io.scratch(spark, "swc")
    obs_multi(spark, d).groupBy(F.col("site_id").alias("name"), F.to_date("stamp").alias("date")).agg(F.round(F.max("SWC"), 3).alias("SWC")).write.csv(path, header=True)
    got = io.read_daily_swc(spark, path)
    return got.groupBy("site_id", F.col("YEAR").cast("bigint").alias("YEAR"), F.col("MONTH").cast("bigint").alias("MONTH")).agg(F.count("*").alias("n"), F.round(F.sum("SWC"), 4).alias("swc"))


@query("s9_patch_from_series", f"WITH {SUB} SELECT event_id, site_id, round(CASE WHEN event_id % 5 = 0 THEN round(TS / 100, 4) * 100 ELSE TS END, 6) AS SWC, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 2 END AS QC FROM sub")
def s9(spark, d):
    path = io.scratch(spark, "supplement")
    sub = obs_sub(spark, d)
    # stamps are not unique in this view, so the event takes the place of the site
    series = sub.filter("event_id % 5 = 0").select(F.col("event_id").cast("string").alias("site_id"), F.date_format("stamp", "dd.MM.yyyy HH:mm").alias("time"), F.round(F.col("TS") / 100, 4).alias("value"))
    series.write.csv(path, header=True, sep=";")
    got = io.read_supplement(spark, path).select(F.col("site_id").cast("bigint").alias("event_id"), "value")
    base = sub.select("event_id", "site_id", F.col("TS").alias("SWC"), F.lit(2).alias("QC"))
    return io.patch_from_series(base, got, "SWC", 100.0, "QC", ("event_id",)).select("event_id", "site_id", F.round("SWC", 6).alias("SWC"), "QC")


@query("s10_read_modis", f"WITH {MULTI} SELECT site_id::VARCHAR AS ID, YEAR, count(*) AS n, count(CASE WHEN QC < 2 THEN 1 END) AS n_good FROM obs GROUP BY 1, 2")
def s10(spark, d):
    path = io.scratch(spark, "modis")
    obs_multi(spark, d).select(F.col("site_id").alias("ID"), F.date_format("stamp", "MM/dd/yy").alias("Date"), F.col("SWC").alias("value"), F.concat(F.lit("q"), "QC").alias("QC")).write.csv(path, header=True)
    got = io.read_modis(spark, path, allow=["q0", "q1"])
    # two-digit years are read into 2000-2099
    year = F.when(F.year("Date") > 2050, F.year("Date") - 100).otherwise(F.year("Date")).cast("bigint").alias("YEAR")
    return got.groupBy("ID", year).agg(F.count("*").alias("n"), F.count("value").alias("n_good"))


@query("s11_eav_extract", "SELECT l_suppkey AS SITE_ID, round(avg(CASE WHEN l_linenumber != 3 THEN l_quantity END), 6) AS N FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1")
def s11(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("SITE_ID"), F.col("l_returnflag").alias("VARIABLE"), F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("DATAVALUE"))
    return io.eav_extract(li, "N").select("SITE_ID", F.round("N", 6).alias("N"))


@query("s12_write_site_tables", f"WITH {MULTI} SELECT site_id, count(*) AS n, count(NEE) AS n_nee FROM obs GROUP BY 1")
def s12(spark, d):
    path = io.scratch(spark, "sites")
    io.write_site_tables(obs_multi(spark, d), path)
    return spark.read.parquet(path).groupBy(F.col("site_id").cast("bigint").alias("site_id")).agg(F.count("*").alias("n"), F.count("NEE").alias("n_nee"))


@query("s13_write_results", f"WITH {MULTI} SELECT site_id, count(TS) AS n FROM obs WHERE YEAR > 1996 GROUP BY 1")
def s13(spark, d):
    path = io.scratch(spark, "results")
    io.write_results(obs_multi(spark, d).filter("YEAR > 1996").groupBy("site_id").agg(F.count("TS").alias("n")), path)
    return spark.read.csv(path, header=True, schema="site_id long, n long")
