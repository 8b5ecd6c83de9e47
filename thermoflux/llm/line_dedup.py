"""Incremental and reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code points that ``min_docs`` or
more documents hold are common: all their lines go, except in the largest id holding the key.

The index (``LineIndex``) has three tables:

* ``refs``: signed references (key, doc, n), one row for each key of a document; a deletion appends negative rows. Nothing is lost, so
  every decision can be taken back.
* ``counts``: the exact reference count of each key and the largest id that holds it. An insertion adds its counts by one join; a deletion
  subtracts, and the largest id is looked up again in ``refs`` for those keys only whose largest id went.
* ``filters``: a cuckoo filter for each shard of the keys (``cuckoo.Cuckoo``) that holds the shard's common keys. Keys that become common are
  inserted, keys that no longer are are removed; a full filter is built anew, larger, from ``counts``.

``find_drops`` asks the filters first: lines that no filter knows never leave their task. What passes is verified against the exact counts by a
join, so a false positive of a filter changes nothing. Filters are broadcast while they all take at most ``FILTER_BYTES``; beyond,
all keys go to the join.

Scale: keys are 16 bytes of a cryptographic digest, one a document and key; counts are combined map-side, so a line that a third of all documents
hold is one row a task; the verifying join can be split where a key is hot. Drops are gathered by document (id and text hash), never by id alone, so rows
without an id do not meet. A shard holds some 100,000 keys whatever the input.

Cases: a null or empty text is one empty line; a null id is smaller than any other; every row counts as a document, rows repeated exactly
included, and all rows with the largest id keep the line; inserting a document twice counts it twice, deleting an id takes all its
references out; ids of any type; other columns, whatever their names, pass through ``drop_lines`` unchanged; an empty table gives an empty index and no rows;
very long texts are split line by line, their keys sent in bounded batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoflux.llm.common import U64, staged
from thermoflux.llm.cuckoo import Cuckoo, built

BLANKS = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
#: Common keys of a shard when shards are laid out; beyond four times as many, more shards are made.
SHARD_KEYS = 1 << 17
#: Bytes of all filters up to which they are broadcast.
FILTER_BYTES = 64 << 20
#: Keys that one output batch of a text's lines holds.
BATCH = 1 << 16


@dataclass(frozen=True)
class LineIndex:
    """``refs``: key binary, doc, n long. ``counts``: key, n_docs long, top. ``filters``: shard int, keys long, slots long, buckets binary
    (null: not known, everything passes)."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS


# ---------------------------------------------------------------------------------- lines and keys


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Digest of a line's key; None for keys of fewer code points."""
    key = line.strip(BLANKS)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _texts(column: pa.Array) -> Iterator[bytes]:
    """Texts one at a time, so that a batch is not held twice."""
    for text in column.cast(pa.large_binary()):
        yield text.as_py() or b""


def _lines(text: bytes) -> Iterator[bytes]:
    """Lines of a text without a list of all."""
    at = 0
    while (end := text.find(b"\n", at)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _halves(keys: list[bytes]) -> np.ndarray:
    """64 bits of each key that the shard does not use."""
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)[:, 1].copy()


def _shard(shards: int) -> Column:
    """Shard of ``key``, by its first four bytes."""
    return (F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") % shards).cast("int").alias("shard")


def _shard_of(keys: list[bytes], shards: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">u4").reshape(-1, 4)[:, 0].astype(np.int64) % shards


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, filters: dict | None = None, shards: int = 1) -> DataFrame:
    """(key, doc, text_hash): each key of a document once. ``filters``: a broadcast of (shard: table or None); keys they do not know are left out."""
    d = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_text"))
    kind = T.StructType([T.StructField("key", T.BinaryType()), d.schema["doc"], d.schema["text_hash"]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        known = {} if filters is None else {s: None if b is None else Cuckoo(table=b) for s, b in filters.value.items()}

        def batch(keys: list[bytes], rows: list[int], b: pa.RecordBatch) -> pa.RecordBatch:
            at = np.asarray(rows, np.int64)
            if filters is not None:
                half, shard, ok = _halves(keys), _shard_of(keys, shards), np.zeros(len(keys), bool)
                for s in np.unique(shard):
                    own = shard == s
                    if s in known:
                        ok[own] = True if known[s] is None else known[s].contains(half[own])
                keys, at = [keys[i] for i in np.flatnonzero(ok)], at[ok]
            take = pa.array(at)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(schema.field(0).type), b.column(0).take(take).cast(schema.field(1).type), b.column(1).take(take)], schema=schema)

        for b in batches:
            keys, rows = [], []
            for i, text in enumerate(_texts(b.column(2))):
                seen = set()
                for line in _lines(text):
                    key = line_key(line, min_chars)
                    if key is not None and key not in seen:
                        seen.add(key)
                        keys.append(key)
                        rows.append(i)
                        if len(keys) == BATCH:
                            yield batch(keys, rows, b)
                            keys, rows = [], []
            if keys:
                yield batch(keys, rows, b)

    return d.mapInArrow(work, kind)


# ---------------------------------------------------------------------------------- the index


def _filters(keys: DataFrame, filters: DataFrame | None, shards: int) -> DataFrame:
    """Filters after ``keys`` (shard, key, change: 1 in, -1 out, 0 part of a filter that is built anew)."""
    out = "shard int, keys long, slots long, buckets binary"

    def apply(old: bytes | None, there: bool, pdf: pd.DataFrame) -> Cuckoo | None:
        change = pdf["change"].to_numpy()
        part = {c: _halves(list(pdf["key"][change == c])) if (change == c).any() else np.zeros(0, U64) for c in (-1, 0, 1)}
        if (change == 0).any():
            return built(part[0])
        if there and old is None:
            return None
        f = Cuckoo(table=old) if there else built(part[1])
        if there:
            f.remove(part[-1])
            if not f.insert(part[1]):
                return None  # found too full against expectation: unknown until it is built anew
        return f

    def rows(shard: int, f: Cuckoo | None) -> pd.DataFrame:
        n = 0 if f is None else int(np.count_nonzero(f.table))
        return pd.DataFrame({"shard": [shard], "keys": [n], "slots": [0 if f is None else f.table.size], "buckets": [None if f is None else f.tobytes()]})

    if filters is None:
        return keys.groupBy("shard").applyInPandas(lambda pdf: rows(int(pdf["shard"].iloc[0]), apply(None, False, pdf)), out)

    def both(key, have: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        old = have["buckets"].iloc[0] if len(have) else None
        if not len(pdf):
            return have
        return rows(int(key[0]), apply(old if old is None else bytes(old), len(have) > 0, pdf))

    return filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(both, out)


def _all_filters(counts: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    common = counts.filter(F.col("n_docs") >= min_docs).select("key")
    shards = max(1, -(-common.count() // SHARD_KEYS))
    return staged(_filters(common.select("key", _shard(shards), F.lit(0).alias("change")), None, shards), "line-filters"), shards


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
    """The index of a table of documents."""
    refs = staged(line_keys(docs, id_col, text_col, min_chars).select("key", "doc", F.lit(1).cast("long").alias("n")), "line-refs")
    counts = staged(refs.groupBy("key").agg(F.sum("n").alias("n_docs"), F.max("doc").alias("top")), "line-counts")
    filters, shards = _all_filters(counts, min_docs)
    return LineIndex(refs, counts, filters, shards, min_chars, min_docs)


def _changed(index: LineIndex, refs: DataFrame, counts: DataFrame, was: DataFrame) -> LineIndex:
    """The index with its filters brought to ``counts``; ``was``: key and n_docs before, of the keys that changed."""
    now = was.join(counts.select("key", F.col("n_docs").alias("_now")), "key", "left").select("key", (F.col("n_docs") >= index.min_docs).alias("_a"), (F.coalesce("_now", F.lit(0)) >= index.min_docs).alias("_b"))
    moved = staged(now.filter("_a <> _b").select("key", _shard(index.shards), F.when(F.col("_b"), 1).otherwise(-1).alias("change")), "line-moves")
    out = replace(index, refs=refs, counts=counts)
    common = counts.filter(F.col("n_docs") >= index.min_docs)
    if common.count() > 4 * SHARD_KEYS * index.shards:
        filters, shards = _all_filters(counts, index.min_docs)
        return replace(out, filters=filters, shards=shards)
    # a filter that would be overfull, or is not known, is built anew from the exact counts
    size = moved.groupBy("shard").agg(F.sum("change").alias("_more"))
    full = index.filters.join(size, "shard").filter(F.col("buckets").isNull() | (F.col("keys") + F.col("_more") > 0.8 * F.col("slots"))).select("shard")
    again = common.select("key", _shard(index.shards)).join(F.broadcast(full), "shard").select("key", "shard", F.lit(0).alias("change"))
    filters = _filters(moved.select("key", "shard", "change").unionByName(again), index.filters, index.shards)
    return replace(out, filters=staged(filters, "line-filters"))


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """The index with further documents."""
    new = staged(line_keys(docs, id_col, text_col, index.min_chars).select("key", "doc", F.lit(1).cast("long").alias("n")), "line-refs")
    delta = new.groupBy("key").agg(F.sum("n").alias("_n"), F.max("doc").alias("_top"))
    both = index.counts.join(delta, "key", "full").withColumn("_was", F.coalesce("n_docs", F.lit(0)))
    both = staged(both.select("key", (F.col("_was") + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("top", "_top").alias("top"), "_was", "_n"), "line-counts")
    was = both.filter("_n IS NOT NULL").select("key", F.col("_was").alias("n_docs"))
    return _changed(index, index.refs.unionByName(new), both.select("key", "n_docs", "top"), was)


def delete(index: LineIndex, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """The index without the documents of these ids; everything is as if they had never been inserted."""
    gone = ids.select(F.col(id_col).alias("_id")).distinct()
    own = index.refs.join(gone, index.refs["doc"].eqNullSafe(gone["_id"]), "left_semi").groupBy("key", "doc").agg((-F.sum("n")).alias("n")).filter("n < 0")
    own = staged(own, "line-refs")
    refs = index.refs.unionByName(own)
    delta = own.groupBy("key").agg(F.sum("n").alias("_n"), F.max("doc").alias("_top"))
    both = staged(index.counts.join(delta, "key", "left"), "line-changes")
    changed = both.filter("_n IS NOT NULL")
    lost = changed.filter(F.col("top").eqNullSafe(F.col("_top")) & (F.col("n_docs") + F.col("_n") > 0)).select("key")
    left = refs.join(lost, "key", "left_semi").groupBy("key", "doc").agg(F.sum("n").alias("n")).filter("n > 0")
    tops = left.groupBy("key").agg(F.max("doc").alias("_next"), F.lit(True).alias("_new"))
    counts = both.join(tops, "key", "left").select("key", (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.when(F.col("_new"), F.col("_next")).otherwise(F.col("top")).alias("top"))
    counts = staged(counts.filter("n_docs > 0"), "line-counts")
    return _changed(index, refs, counts, changed.select("key", "n_docs"))


# ---------------------------------------------------------------------------------- dropping lines


def _held(index: LineIndex, spark: SparkSession):
    """The filters as a broadcast; None where they are too large together."""
    size = index.filters.agg(F.sum(F.length("buckets"))).first()[0] or 0
    if size > FILTER_BYTES:
        return None
    rows = index.filters.select("shard", "buckets").collect()
    return spark.sparkContext.broadcast({r["shard"]: None if r["buckets"] is None else bytes(r["buckets"]) for r in rows})


def find_drops(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_hash, drops array<binary>): the keys whose lines a document loses; documents that lose none are left out."""
    hits = line_keys(docs, id_col, text_col, index.min_chars, _held(index, docs.sparkSession), index.shards)
    common = index.counts.filter(F.col("n_docs") >= index.min_docs).select("key", "top")
    lost = hits.join(common, "key").filter(~F.col("doc").eqNullSafe(F.col("top")))
    return lost.groupBy("doc", "text_hash").agg(F.collect_set("key").alias("drops"))


def _cut(rows: DataFrame, drops: DataFrame, min_chars: int) -> DataFrame:
    """``rows`` (_row, _id, _text) with n_lines, n_dropped and kept in place of _id and _text."""
    d = rows.withColumn("_hash", F.xxhash64("_text"))
    d = d.join(drops, d["_id"].eqNullSafe(drops["doc"]) & (d["_hash"] == drops["text_hash"]), "left").select("_row", "_text", "drops")
    kind = T.StructType([d.schema["_row"], *T.StructType.fromDDL("n_lines long, n_dropped long, kept string").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        for b in batches:
            lines, dropped, kept = [], [], []
            for text, drop in zip(_texts(b.column(1)), b.column(2), strict=True):
                n = text.count(b"\n") + 1
                keys = set(drop.as_py() or ())
                stay = [line for line in _lines(text) if line_key(line, min_chars) not in keys] if keys else None
                lines.append(n)
                dropped.append(n - len(stay) if keys else 0)
                kept.append((b"\n".join(stay) if keys else text).decode())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(schema.field(0).type), *[pa.array(c, schema.field(i + 1).type) for i, c in enumerate((lines, dropped, kept))]], schema=schema)

    return d.mapInArrow(work, kind)


def line_report(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept): the text that is left of every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return _cut(rows, find_drops(docs, index, id_col, text_col), index.min_chars).withColumnRenamed("_row", id_col)


def drop_lines(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines dropped from the text (null texts stay null); all columns as they are."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    cut = _cut(rows, find_drops(docs, index, id_col, text_col), index.min_chars)
    text = F.when(F.col(f"_row.{text_col}").isNotNull(), F.col("kept")).alias(text_col)
    return cut.select(*[text if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
