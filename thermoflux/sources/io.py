"""Reading and writing site tables (CSV and Parquet)."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Missing values as the flux products write them.
SENTINELS = (-9999.0,)
SENTINEL_TEXTS = ("NA", "NaN", "-9999", "-9999.0", "")


class Job:
    """The shared folders that the calls within ``with Job() as job:`` have made; ``job.remove(spark)`` removes these and no others, once no result
    that reads them is needed. Jobs nest: a folder belongs to the innermost one. Folders made outside any job belong to the session's."""

    def __init__(self) -> None:
        self.folders: list[str] = []

    def __enter__(self) -> Job:
        self._before = _job.set(self)
        return self

    def __exit__(self, *_) -> None:
        _job.reset(self._before)

    def remove(self, spark: SparkSession) -> int:
        """Returns how many folders there were."""
        count = len(self.folders)
        while self.folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.folders.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return count


_session = Job()
_job: ContextVar[Job] = ContextVar("job", default=_session)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset, a temporary one in local mode, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _job.get().folders.append(path)
    return path


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder, for data that is read several times; cuts its lineage. ``options`` go to the writer."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession) -> int:
    """Remove the folders made outside any ``Job`` so far, once no result that reads them is needed; returns how many."""
    return _session.remove(spark)


def site_from_path(path: Column) -> Column:
    """Site of a file name like ``FLX_CH-Dav_FLUXNET_HH_2010.csv`` or ``AMF_US-Ha1_BASE_HR_1.csv``."""
    return F.regexp_extract(path, r"(?:^|[/=])[A-Za-z]+_([A-Z]{2}-[A-Za-z0-9]{3})_", 1)


def prefer_half_hourly(files: DataFrame, path_col: str = "path") -> DataFrame:
    """One file a site: half-hourly (HH) before hourly (HR), then by name; hidden ``._`` files are skipped."""
    found = files.filter(~F.col(path_col).rlike(r"(?:^|/)\._")).withColumn("site_id", site_from_path(F.col(path_col))).filter("site_id <> ''")
    hourly = F.when(F.col(path_col).rlike(r"_HH[_.]"), 0).when(F.col(path_col).rlike(r"_HR[_.]"), 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(hourly, path_col))
    return found.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def read_flux(spark: SparkSession, path: str, schema: T.StructType, pattern: str = r"_(HH|HR)[_.]") -> DataFrame:
    """Half-hourly and hourly files below ``path``, with the site from each file's name; missing values become null."""
    df = spark.read.option("recursiveFileLookup", "true").csv(path, header=True, schema=schema, nullValue="NA", enforceSchema=False)
    df = df.withColumn("_path", F.col("_metadata.file_path")).filter(F.col("_path").rlike(pattern))
    return null_sentinels(df.withColumn("site_id", site_from_path(F.col("_path"))).drop("_path"))


def read_selected(df: DataFrame, required: list[str], optional: list[str] = ()) -> DataFrame:
    """Only the wanted columns; an error names the required ones that are missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*required, *[c for c in optional if c in df.columns])


def null_sentinels(df: DataFrame, values: tuple[float, ...] = SENTINELS) -> DataFrame:
    """Sentinels, NaN and the texts for missing become null, in every column."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | c.isin(*values), None).otherwise(c)
        elif isinstance(f.dataType, T.NumericType):
            c = F.when(c.isin(*[int(v) for v in values]), None).otherwise(c)
        elif isinstance(f.dataType, T.StringType):
            c = F.when(F.trim(c).isin(*SENTINEL_TEXTS), None).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def stack_sources(earlier: DataFrame, later: DataFrame, ts_col: str = "stamp", site_col: str = "site_id") -> DataFrame:
    """``earlier``, then the rows of ``later`` after its last stamp (all, where ``later`` lacks that stamp); columns by name."""
    last = earlier.groupBy(site_col).agg(F.max(ts_col).alias("_last"))
    has = later.join(last, site_col).filter(F.col(ts_col) == F.col("_last")).select(site_col, F.lit(True).alias("_has")).distinct()
    tail = later.join(last, site_col, "left").join(has, site_col, "left")
    tail = tail.filter(F.col("_has").isNull() | (F.col(ts_col) > F.col("_last"))).drop("_last", "_has")
    return earlier.unionByName(tail, allowMissingColumns=True)


def read_site_info(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """The site table: a UTF-8 mark before the header, quoted commas, empty texts as null; optionally one source."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, nullValue="")
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df if source is None else df.filter(F.col("source") == source)


def read_season_features(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The season tables of all sources, columns by name."""
    frames = [spark.read.csv(p, header=True, inferSchema=True, nullValue="NA") for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_daily_swc(spark: SparkSession, path: str) -> DataFrame:
    """Daily soil water (name, date, SWC) with date parts."""
    df = spark.read.csv(path, header=True, schema="name string, date string, SWC double", nullValue="NA")
    day = F.to_date("date")
    return df.select(
        F.col("name").alias("site_id"),
        day.alias("date"),
        F.year(day).alias("YEAR"),
        F.month(day).alias("MONTH"),
        F.dayofmonth(day).alias("DAY"),
        "SWC",
    )


def read_supplement(spark: SparkSession, path: str, fmt: str = "dd.MM.yyyy HH:mm") -> DataFrame:
    """A ``;``-separated series (site_id, time, value)."""
    df = spark.read.csv(path, header=True, sep=";", schema="site_id string, time string, value double", nullValue="NA")
    return df.select("site_id", F.to_timestamp_ntz("time", F.lit(fmt)).alias("stamp"), "value")


def patch_from_series(
    df: DataFrame,
    series: DataFrame,
    column: str,
    factor: float = 100.0,
    qc_col: str | None = None,
    keys: tuple[str, ...] = ("site_id", "stamp"),
) -> DataFrame:
    """Override ``column`` by ``factor`` times the series' value where it has one, and set the quality flag to 1 there."""
    s = series.select(*keys, (F.col("value") * factor).alias("_patch"))
    out = df.join(s, list(keys), "left")
    if qc_col:
        out = out.withColumn(qc_col, F.when(F.col("_patch").isNotNull(), F.lit(1)).otherwise(F.col(qc_col)))
    return out.withColumn(column, F.coalesce("_patch", column)).drop("_patch")


def read_modis(spark: SparkSession, path: str, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """Satellite series (ID, Date as month/day/two-digit year, value, QC): values of bad quality become null."""
    df = spark.read.csv(path, header=True, schema="ID string, Date string, value double, QC string", nullValue="NA")
    return screen_quality(df.withColumn("Date", F.to_date("Date", "MM/dd/yy")), "value", "QC", allow, deny)


def screen_quality(df: DataFrame, value: str, qc: str, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    ok = F.lit(True)
    if allow is not None:
        ok = ok & F.coalesce(F.col(qc).isin(*allow), F.lit(False))
    if deny is not None:
        ok = ok & ~F.coalesce(F.col(qc).isin(*deny), F.lit(False))
    return df.withColumn(value, F.when(ok, F.col(value)))


def eav_extract(df: DataFrame, variable: str, site: str = "SITE_ID", name: str = "VARIABLE", value: str = "DATAVALUE") -> DataFrame:
    """Mean of one variable of a long table by site; texts that are no numbers are ignored."""
    return df.filter(F.col(name) == variable).groupBy(site).agg(F.avg(F.expr(f"try_cast(`{value}` AS double)")).alias(variable))


def write_site_tables(df: DataFrame, path: str, site_col: str = "site_id") -> None:
    """One folder a site. Rows are spread by site and day-of-year first, so that no site is written by one task alone."""
    keys = [site_col, "DOY"] if "DOY" in df.columns else [site_col]
    df.repartition(*keys).write.mode("overwrite").partitionBy(site_col).parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """A result table (a row a site, or a few) as CSV with a header; missing values as NA."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="NA")
