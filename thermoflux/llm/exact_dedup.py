"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

1. ``freqItems`` (the frequent-elements counters of Misra and Gries, as Spark has them) proposes at most
   ``1 / support`` digests. Every digest that holds more than ``support`` of all rows is among them.
2. The candidates are verified: one map-side combined aggregation counts their rows and finds the winner of each.
3. The verified winners - at most ``1 / support`` rows - are broadcast; their copies are settled map-side and never shuffled.
4. The digests of all other rows are counted with map-side combining and shuffled; those of two and more rows join back to them.

Cases: a null text counts as empty; of equal texts the row with the largest doc_id stays (null ids are smaller than
any other); rows with the same text and the same doc_id are one document written twice and get the same verdict;
an empty table gives an empty table; other columns of the input, whatever their names, pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoflux.llm.common import staged

#: Share of the rows beyond which a digest is heavy; 1 / SUPPORT bounds what is broadcast.
SUPPORT = 0.001

_NEW = ("keep_id", "group_size", "kept", "text_sha256")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """``docs`` with keep_id, group_size long, kept boolean and text_sha256 (input columns of these names are replaced)."""
    docs = docs.drop(*[c for c in docs.columns if c in _NEW and c not in (id_col, text_col)])
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    keyed = docs.withColumn("text_sha256", digest)

    candidates = keyed.select("text_sha256").stat.freqItems(["text_sha256"], support)
    candidates = candidates.select(F.explode("text_sha256_freqItems").alias("text_sha256")).distinct()
    counted = (
        keyed.select("text_sha256", F.col(id_col).alias("_doc"))
        .join(F.broadcast(candidates), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.max("_doc").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    # At most 1 / support rows, needed twice below; staged, so that they are computed once.
    winners = staged(counted.filter("group_size > 1"), "winners")

    heavy = keyed.join(F.broadcast(winners), "text_sha256")
    # map-side combined, so that no group's rows meet in one task; only groups of two and more travel back
    rest = keyed.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    several = groups.filter("group_size > 1")
    light = rest.join(several, "text_sha256", "left").select(
        *keyed.columns, F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size")
    )
    return heavy.unionByName(light).withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs`` as they are."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return exact_duplicates(rows, "_id", "_text", support).filter("kept").select("_row.*")
