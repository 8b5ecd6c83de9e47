"""Windows over a site's time-ordered rows in two levels, so that one long site uses all cores.

A site's time axis is cut into chunks of about ``CHUNK_ROWS`` rows. Rows are numbered within their chunk and the chunks' counts summed up
before (a table of one row a chunk). A frame that reaches back over a bounded number of rows gets the rows before its chunk as a
halo: copies of the last slices (``SLICES`` a chunk) of the chunks before that hold ``reach`` rows; slices are counted first, so rows are shuffled and sorted once. For an unbounded look (last and next known value) each chunk sends its first
and last known value instead, which are carried over the chunk table. Where every site fits in one chunk, plain windows do.

Stamps are taken to be spread over the axis; rows that share one stamp share a chunk. A null site is a site, and null stamps come first, as
in a plain window. ``rows`` None asks for plain windows, for groups that are bounded anyway (days of a climatology).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoflux.operators.joins import small
from thermoflux.sources.io import stored

CHUNK_ROWS = 1 << 18
#: Slices of a chunk, by which rows are copied to the chunks after it.
SLICES = 64

_START = Window.unboundedPreceding


def axis(df: DataFrame, column: str) -> Column:
    """The column as a number that grows with it, whatever the session's time zone."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.TimestampNTZType | T.DateType):
        days = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double") * 86400
        return days if isinstance(kind, T.DateType) else days + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return c.cast("timestamp").cast("double") if isinstance(kind, T.TimestampType) else c.cast("double")


def join_on(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys, nulls equal; ``other`` adds its further columns."""
    right = other.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(right[f"_on_{k}"]) for k in keys])
    return df.join(right, same, "left").drop(*[f"_on_{k}" for k in keys])


def _sliced(df: DataFrame, by: list[str], order: list[str], rows: int) -> DataFrame | None:
    """``df`` with _chunk and _slice, numbered over the site's axis; None where no site has several chunks."""
    at = axis(df, order[0])
    stats = stored(df.groupBy(*by).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.ceil(F.count(F.lit(1)) / rows).alias("_k")), "axes")
    if (stats.agg(F.max("_k")).first()[0] or 0) <= 1:
        return None
    d = join_on(df, small(stats), by)
    part = F.floor((at - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_k") * SLICES)
    d = d.withColumn("_slice", F.coalesce(F.when(F.col("_hi") > F.col("_lo"), F.least(part, F.col("_k") * SLICES - 1)), F.lit(0)).cast("long")).drop("_lo", "_hi", "_k")
    return d.withColumn("_chunk", F.floor(F.col("_slice") / SLICES))


def chunks(df: DataFrame, by: list[str], order: list[str], rows: int) -> tuple[DataFrame, DataFrame, bool]:
    """(``df`` with _chunk; the table by, _chunk, _before (rows of the site before the chunk), _rows; True), or False as the last where no site has
    several chunks."""
    d = _sliced(df, by, order, rows)
    if d is None:
        return df, df, False
    d = d.drop("_slice")
    counts = d.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(_START, -1))
    table = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
    return d, stored(table, "chunks"), True


def _numbered(d: DataFrame, table: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds the table's columns and _pos, the number of a row within its site from 1 on."""
    w = Window.partitionBy(*by, "_chunk").orderBy(*order)
    return join_on(d, table, [*by, "_chunk"]).withColumn("_pos", F.col("_before") + F.row_number().over(w))


def with_frames(df: DataFrame, reach: int, make: Callable[[WindowSpec, Column], dict[str, Column]], by: list[str], order: list[str], rows: int | None = CHUNK_ROWS) -> DataFrame:
    """``df`` with the columns that ``make(window, row number)`` gives; its frames may begin up to ``reach`` rows before a row and end at it."""
    d = _sliced(df, by, order, rows) if rows else None
    if d is None:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumns(make(w, F.row_number().over(w)))
    site = Window.partitionBy(*by)
    counts = d.groupBy(*by, "_chunk", "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    slices = stored(counts.withColumn("_end", F.sum("_rows").over(site.orderBy("_slice").rowsBetween(_START, 0))), "slices")
    table = slices.groupBy(*by, "_chunk").agg(F.min(F.col("_end") - F.col("_rows")).alias("_before"), F.max("_end").alias("_upto"))
    # only chunks that begin within reach of this one's last row
    after = F.collect_list(F.struct("_chunk", "_before")).over(site.orderBy("_chunk").rowsBetween(1, max(1, reach)))
    table = stored(table.withColumn("_next", F.filter(after, lambda x: x["_before"] < F.col("_upto") + reach)), "chunks")
    goes = F.transform(F.filter("_next", lambda x: x["_before"] < F.col("_end") + reach), lambda x: x["_chunk"])
    copied = join_on(slices, table.select(*by, "_chunk", "_next"), [*by, "_chunk"]).select(*by, "_chunk", "_slice", (F.col("_end") - F.col("_rows")).alias("_first"), goes.alias("_goes")).filter(F.size("_goes") > 0)
    copied = stored(copied, "halos")
    # rows of the site before the first one that a chunk gets
    first = copied.select(*by, F.explode("_goes").alias("_to"), "_first").unionByName(table.select(*by, F.col("_chunk").alias("_to"), F.col("_before").alias("_first")))
    first = first.groupBy(*by, "_to").agg(F.min("_first").alias("_first"))
    d = join_on(d, small(copied.select(*by, "_slice", "_goes")), [*by, "_slice"]).drop("_slice")
    d = d.withColumn("_to", F.explode(F.concat(F.array("_chunk"), F.coalesce("_goes", F.array().cast("array<bigint>"))))).drop("_goes")
    d = join_on(d, small(stored(first, "first-rows")), [*by, "_to"])
    w = Window.partitionBy(*by, "_to").orderBy(*order)
    return d.withColumns(make(w, F.col("_first") + F.row_number().over(w))).filter(F.col("_to") == F.col("_chunk")).drop("_to", "_chunk", "_first")


def with_neighbours(df: DataFrame, x: str, at: Column, by: list[str], order: list[str], rows: int | None = CHUNK_ROWS) -> DataFrame:
    """``df`` with _last and _ahead: structs (pos, at, x) of the nearest rows up to and from each one on where ``x`` is known, and
    _pos, the row's number in its site, and _size, the site's rows."""
    known = F.when(F.col(x).isNotNull(), F.struct(F.col("_pos").alias("pos"), at.alias("at"), F.col(x).alias("x")))
    d, table, several = chunks(df, by, order, rows) if rows else (df, df, False)
    if not several:
        w = Window.partitionBy(*by).orderBy(*order)
        d = df.withColumns({"_pos": F.row_number().over(w).cast("long"), "_size": F.count(F.lit(1)).over(Window.partitionBy(*by))})
        back, ahead = (Window.partitionBy(*by).orderBy(o).rowsBetween(_START, 0) for o in (F.asc("_pos"), F.desc("_pos")))
        return d.withColumns({"_last": F.last(known, True).over(back), "_ahead": F.last(known, True).over(ahead)})
    d = stored(_numbered(d, table, by, order).drop("_before", "_rows"), "numbered")
    ends = d.groupBy(*by, "_chunk").agg(F.max(known).alias("_l"), F.min(known).alias("_f"), F.max("_pos").alias("_end"))
    site = Window.partitionBy(*by)
    ends = ends.withColumns({
        "_carried": F.last("_l", True).over(site.orderBy("_chunk").rowsBetween(_START, -1)),
        "_coming": F.last("_f", True).over(site.orderBy(F.desc("_chunk")).rowsBetween(_START, -1)),
        "_size": F.max("_end").over(site),
    }).drop("_l", "_f", "_end")
    d = join_on(d, ends, [*by, "_chunk"])
    w = Window.partitionBy(*by, "_chunk")
    back, ahead = w.orderBy("_pos").rowsBetween(_START, 0), w.orderBy(F.desc("_pos")).rowsBetween(_START, 0)
    d = d.withColumns({"_last": F.coalesce(F.last(known, True).over(back), "_carried"), "_ahead": F.coalesce(F.last(known, True).over(ahead), "_coming")})
    return d.drop("_carried", "_coming", "_chunk")
