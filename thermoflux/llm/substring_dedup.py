"""Suffix-array dedup: removal of every byte under a string of ``length`` bytes that also starts earlier.

Windows of ``length`` bytes that are equal have the same minimiser (the least hash of their ``K``-grams), so texts are cut into
segments - runs of window starts with the same minimiser - and only segments with a common minimiser can share windows.

1. Tasks emit minimiser, segment hash and place of each segment by bucket of the minimiser; equal segments of one task are
   merged first, so copies send little. A bucket finds the minimisers that occur in different segments. Equal segments but the first are
   covered as a whole; they are equal where the 64 bits of the minimiser and 64 independent bits of the segment are (byte values of another table).
2. The first segment of each kind whose minimiser other segments share (or that may repeat itself) is fetched from its text.
3. Such segments form blocks of a bounded size by minimiser. A block is sorted into a suffix array; a breadth-first backward extension
   on its Burrows-Wheeler transform derives the common prefix lengths by increasing value: it starts from the empty string, extends
   every interval by one character on the left, and sets each boundary when it is first met. It stops at ``length``:
   neighbours whose boundary is still unset share ``length`` bytes. Of each such class all but the earliest window are covered.
4. Covered window starts are merged by document into removed byte runs.

A minimiser within a very common line meets a different segment in each of its documents. Such minimisers are found on every
64th document; that only plans the load: windows under them get the hash of the whole window as their minimiser, so they spread evenly.

Segments of a task are packed into one blob a bucket while buckets are few enough for a blob to hold some ``BLOB_SEGMENTS`` of them; beyond (some 50 GB
of text) they are plain rows, whose size does not depend on the number of buckets.

Cases: a null text is empty; texts shorter than ``length`` lose nothing; a text may repeat itself (the later start is covered, overlaps count);
rows with the same id and text are one document and get the same result; rows that share an id, or have none, with different texts are different documents,
in the order of a hash of their texts; null ids come before all others; ids are of any type that sorts; other columns are not read; an empty table gives no rows. A text of
many MB is cut into segments pass by pass, with an overlap of a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoflux.llm.common import U64, byte_values, mix, slices, span_hashes, staged

LENGTH = 100
K = 32
#: One in so many documents is looked at for minimisers that are common to many different segments.
PLAN_EVERY = 64
#: Different segments among those documents from which a minimiser counts as common, and the most that are kept.
PLAN_LEAST, PLAN_MOST = 40, 50_000
#: Bytes of segments in one block (a group with one minimiser is never divided).
BLOCK_BYTES = 1 << 19
#: Bytes of text in one numpy pass: small, as segmenting holds some twenty arrays of 8 bytes a byte.
PASS_BYTES = 1 << 19
#: Segments that one bucket of minimisers holds, about.
BUCKET_SEGMENTS = 200_000
#: Segments that a task gathers before it sends them, and that a blob holds at least on average.
CHUNK_SEGMENTS, BLOB_SEGMENTS = 500_000, 64
_MULT = 0x9E3779B97F4A7C15
_RUN = np.dtype([("key", "u8"), ("seg", "u8"), ("doc", "i8"), ("start", "i4"), ("n", "i4"), ("self", "?")])


# ---------------------------------------------------------------------------------- segments


def _other_values() -> np.ndarray:
    """A second table of byte values, independent of the one that minimisers are made of."""
    return mix(byte_values() ^ U64(0x5851F42D4C957F2D))


def _gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of ``buf`` by doubling (k a power of two)."""
    h, power, span = byte_values()[buf], _MULT, 1
    while span < k:
        h = h[:-span] * U64(power) + h[span:]
        power = power * power & 0xFFFFFFFFFFFFFFFF
        span *= 2
    return mix(h)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - span : w - span + len(x) - w + 1]) if span < w else out


def segments(buf: np.ndarray, offs: np.ndarray, length: int, common: np.ndarray) -> np.ndarray:
    """Runs of window starts (key, seg, doc row, start in the document, n, self) of a slice of documents."""
    n = len(buf) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=_RUN)
    h = _gram_hashes(buf, K)
    w = length - K + 1
    place = np.arange(len(h), dtype=U64)
    high = h & U64(0xFFFFFFFF00000000)
    left = (_sliding_min(high | place, w) & U64(0xFFFFFFFF)).astype(np.int64)
    right = U64(0xFFFFFFFF) - (_sliding_min(high | (U64(0xFFFFFFFF) - place), w) & U64(0xFFFFFFFF))
    many = right.astype(np.int64) != left
    key = h[left]
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
    start = np.arange(n) - offs[doc]
    valid = np.arange(n) + length <= offs[doc + 1]
    if len(common):
        at = np.minimum(np.searchsorted(common, key), len(common) - 1)
        fine = np.flatnonzero((common[at] == key) & valid)
        key[fine] = span_hashes(byte_values()[buf], fine, fine + length)
    first = np.ones(n, dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
    run = np.flatnonzero(first)
    size = np.diff(np.append(run, n))
    moves = np.zeros(n, dtype=bool)
    moves[1:] = left[1:] != left[:-1]
    again = np.add.reduceat((moves & ~first) | many, run) > 0
    ok = valid[run]
    out = np.zeros(int(ok.sum()), dtype=_RUN)
    run, size = run[ok], size[ok]
    out["key"], out["doc"], out["start"], out["n"], out["self"] = key[run], doc[run], start[run], size, again[ok]
    out["seg"] = span_hashes(_other_values()[buf], run, run + size + length - 1)
    return out


def all_segments(buf: np.ndarray, offs: np.ndarray, length: int, common: np.ndarray) -> Iterator[np.ndarray]:
    """``segments`` of a slice; one long text is taken pass by pass, so that working arrays stay small."""
    if len(offs) > 2 or len(buf) <= 2 * PASS_BYTES:
        yield segments(buf, offs, length, common)
        return
    for at in range(0, len(buf) - length + 1, PASS_BYTES):
        part = buf[at : at + PASS_BYTES + length - 1]
        runs = segments(part, np.array([0, len(part)]), length, common)
        runs["start"] += at
        yield runs


# ---------------------------------------------------------------------------------- packing


def _pack(runs: np.ndarray) -> bytes:
    """Columns one after the other."""
    doc = np.diff(runs["doc"], prepend=0)
    parts = [
        np.array([len(runs)], "i8"),
        runs["key"],
        runs["seg"],
        np.ascontiguousarray(doc),
        runs["start"].astype("u4"),
        runs["n"].astype("u4"),
        runs["self"],
    ]
    raw = b"".join(np.ascontiguousarray(p).tobytes() for p in parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, "i8", 1)[0])
    out = np.zeros(n, dtype=_RUN)
    at = 8
    for name, kind, size in (("key", "u8", 8), ("seg", "u8", 8), ("doc", "i8", 8), ("start", "u4", 4), ("n", "u4", 4), ("self", "?", 1)):
        out[name] = np.frombuffer(raw, kind, n, at)
        at += size * n
    out["doc"] = np.cumsum(out["doc"])
    return out


def _split_first(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs sorted by (key, seg, doc, start): the first of each segment, and the later ones, which are covered."""
    runs = runs[np.lexsort((runs["start"], runs["doc"], runs["seg"], runs["key"]))]
    same = np.zeros(len(runs), dtype=bool)
    same[1:] = (runs["key"][1:] == runs["key"][:-1]) & (runs["seg"][1:] == runs["seg"][:-1])
    twice = np.zeros(len(runs), dtype=bool)  # the same place, from a row that was given twice
    twice[1:] = same[1:] & (runs["doc"][1:] == runs["doc"][:-1]) & (runs["start"][1:] == runs["start"][:-1])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(runs))))
    at_first = (runs["doc"] == runs["doc"][lead]) & (runs["start"] == runs["start"][lead])
    return runs[~same], runs[same & ~twice & ~at_first]


# ---------------------------------------------------------------------------------- suffix blocks


def suffix_array(text: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (bytes; 0 ends a segment, at ``ends``) sorted by their first ``depth`` bytes at least.

    Ends compare by their place, so suffixes of different segments never compare beyond an end."""
    n = len(text)
    pad = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(n, dtype=U64)
    over = np.zeros(n, dtype=bool)
    for i in range(8):
        c = np.where(over, 0, pad[i : i + n])
        over |= c == 0
        word = word << U64(8) | c.astype(U64)
    order = np.argsort(word, kind="stable")
    span = 8
    while True:
        if span == 8:
            new = np.ones(n, dtype=bool)
            new[1:] = (word[order][1:] != word[order][:-1]) | over[order][1:]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        if span >= depth or new.all():
            return order
        # an end within the span has made the suffix unique already
        second = np.zeros(n, dtype=np.int64)
        second[: n - span] = rank[span:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.ones(n, dtype=bool)
        new[1:] = k[1:] != k[:-1]
        span *= 2


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the closed intervals, and the interval of each."""
    width = hi - lo + 1
    which = np.repeat(np.arange(len(lo)), width)
    return np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width) + lo[which], which


def unset_boundaries(bwt: np.ndarray, length: int) -> np.ndarray:
    """For each rank: its suffix shares at least ``length`` bytes with the one before it.

    Breadth-first: level l holds intervals of strings of l bytes. Extending one by a byte c to the left gives an interval; if the
    boundary after it is unset, the common prefix there is l, and the interval joins the next level."""
    n = len(bwt)
    order = np.argsort(bwt, kind="stable")
    lf = np.empty(n, dtype=np.int64)
    lf[order] = np.arange(n)
    c = bwt[order]
    nxt, prv = np.full(n, n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    same = c[1:] == c[:-1]
    nxt[order[:-1][same]] = order[1:][same]
    prv[order[1:][same]] = order[:-1][same]
    unset = np.ones(n + 1, dtype=bool)
    unset[0] = unset[n] = False
    ends = int(np.searchsorted(c, 1))
    unset[: ends + 1] = False  # suffixes that start with an end differ from all others
    lo, hi = np.array([0]), np.array([n - 1])
    for _ in range(length):
        at, which = _ranges(lo, hi)
        keep = bwt[at] != 0
        at, which = at[keep], which[keep]
        first, last = prv[at] < lo[which], nxt[at] > hi[which]
        a, b = lf[at[first]], lf[at[last]]
        a = a[np.lexsort((a, which[first]))]
        b = b[np.lexsort((b, which[last]))]
        new = unset[b + 1]
        # intervals that end at the last rank have no boundary to set, yet their extensions may
        go = new | (b == n - 1)
        unset[b + 1] = False
        lo, hi = a[go], b[go]
        if not len(lo):
            break
    return unset[:n]


def covered_windows(pieces: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, window start) of the windows in the pieces that equal an earlier one, sorted."""
    size = np.array([len(p) for p in pieces]) + 1
    # a byte 0 of a text must not look like an end: texts are shifted to 1..255, 0 and 255 share a code and are checked below
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", dtype=np.uint8).copy()
    ends = np.cumsum(size) - 1
    text = np.where(text == 0, np.uint8(255), text)
    text[ends] = 0
    sa = suffix_array(text, ends, length)
    bwt = text[sa - 1]
    bwt[sa == 0] = 0
    join = unset_boundaries(bwt, length)
    group = np.cumsum(~join)
    seg = np.searchsorted(ends, sa)
    begin = ends - size + 1
    offset = sa - begin[seg]
    full = offset + length < size[seg]  # windows that lie in their piece
    member = np.flatnonzero((join | np.append(join[1:], False)) & full)
    d, s, g = docs[seg[member]], starts[seg[member]] + offset[member], group[member]
    o = np.lexsort((s, d, g))
    d, s, g = d[o], s[o], g[o]
    later = np.zeros(len(g), dtype=bool)
    later[1:] = g[1:] == g[:-1]
    d, s = d[later], s[later]
    o = np.lexsort((s, d))
    return d[o], s[o]


def _as_runs(d: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted window starts as runs (doc, start, n)."""
    if not len(d):
        return d, s, s
    first = np.ones(len(d), dtype=bool)
    first[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)
    at = np.flatnonzero(first)
    return d[at], s[at], np.diff(np.append(at, len(d)))


# ---------------------------------------------------------------------------------- the job


def _common_minimisers(docs: DataFrame, length: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for runs in (r for _, _, buf, offs in slices(b.column(1), PASS_BYTES) for r in all_segments(buf, offs, length, np.zeros(0, U64))):
                yield pa.RecordBatch.from_arrays([pa.array(runs["key"].view("i8")), pa.array(runs["seg"].view("i8"))], ["key", "seg"])

    seen = docs.filter(F.pmod(F.xxhash64("doc"), F.lit(PLAN_EVERY)) == 0).mapInArrow(run, "key long, seg long").distinct()
    found = seen.groupBy("key").count().filter(F.col("count") >= PLAN_LEAST).orderBy(F.desc("count"), "key").limit(PLAN_MOST).collect()
    return np.sort(np.array([r["key"] for r in found], dtype=np.int64).view(U64))


def covered(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, start, n): runs of covered window starts of documents (doc, text)."""
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(_common_minimisers(docs, length))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, int(total // 36 // BUCKET_SEGMENTS) + 1)
    plain = buckets > CHUNK_SEGMENTS // BLOB_SEGMENTS
    send = _plain if plain else _emit

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            held, count = [], 0
            for lo, _, buf, offs in slices(b.column(1), PASS_BYTES):
                for runs in all_segments(buf, offs, length, common.value):
                    runs["doc"] = ids[lo + runs["doc"]]
                    held.append(runs)
                    count += len(runs)
                    if count > CHUNK_SEGMENTS:
                        yield send(np.concatenate(held), buckets)
                        held, count = [], 0
            if count:
                yield send(np.concatenate(held), buckets)

    packed = docs.mapInArrow(emit, _PLAIN if plain else "bucket int, blob binary")

    def reduce(key, pdf):
        own = _rows_of(pdf) if plain else np.concatenate([_unpack(x) for x in pdf["blob"]])
        if key[0] < 0:  # covered within a task already
            runs, asked = own, np.zeros(0, _RUN)
        else:
            first, runs = _split_first(own)
            new = np.ones(len(first), dtype=bool)
            new[1:] = first["key"][1:] != first["key"][:-1]
            several = np.diff(np.append(np.flatnonzero(new), len(first)))[np.cumsum(new) - 1] > 1 if len(first) else new
            asked = first[several | first["self"]]
        both = np.concatenate([runs, asked])
        k = np.concatenate([np.zeros(len(runs), "i8"), (asked["key"] | U64(1)).view("i8")])
        return pd.DataFrame({"doc": both["doc"], "start": both["start"], "n": both["n"], "key": k})

    rows = staged(packed.groupBy("bucket").applyInPandas(reduce, "doc long, start int, n int, key long"), "segments")
    whole, asked = rows.filter("key = 0").drop("key"), rows.filter("key <> 0")

    wanted = asked.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "key")).alias("runs"))
    once = docs.join(wanted, "doc").select("doc", "text", "runs")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            runs = b.column(2)
            flat, bounds = runs.values, runs.offsets.to_numpy()
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            piece, doc = [], []
            for i in range(b.num_rows):
                t = texts[i].as_buffer() if texts[i].is_valid else b""
                view = memoryview(t)
                piece += [bytes(view[start[j] : start[j] + n[j] + length - 1]) for j in range(bounds[i], bounds[i + 1])]
                doc.append(np.full(bounds[i + 1] - bounds[i], b.column(0)[i].as_py()))
            part = slice(bounds[0], bounds[-1])
            docs_ = np.concatenate([np.zeros(0, np.int64), *doc]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [flat.field("key")[part], pa.array(docs_), pa.array(start[part]), pa.array(piece, pa.binary())],
                ["key", "doc", "start", "piece"],
            )

    pieces = staged(once.mapInArrow(fetch, "key long, doc long, start int, piece binary"), "pieces")
    size = pieces.agg(F.coalesce(F.sum(F.length("piece")), F.lit(0))).first()[0]
    blocks = max(1, int(size // BLOCK_BYTES))

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["doc", "start"])
        d, s = covered_windows(list(pdf["piece"]), pdf["doc"].to_numpy(), pdf["start"].to_numpy().astype(np.int64), length)
        d, s, n = _as_runs(d, s)
        return pd.DataFrame({"doc": d, "start": s, "n": n})

    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")
    found = pieces.select(block, "doc", "start", "piece").groupBy("block").applyInPandas(lambda pdf: sort(pdf), "doc long, start int, n int")
    return whole.unionByName(found)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key) % U64(buckets)).astype(np.int64)


_PLAIN = "bucket int, key long, seg long, doc long, start int, n int, self boolean"


def _plain(runs: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Segments as rows; those covered within the task stand in buckets below zero, dealt out evenly."""
    first, later = _split_first(runs)
    both = np.concatenate([first, later])
    spread = -1 - (mix(later["doc"].view(U64) ^ later["start"].astype(U64)) % U64(buckets)).astype(np.int64)
    bucket = np.concatenate([_bucket(first["key"], buckets), spread])
    columns = [bucket.astype("i4"), both["key"].view("i8"), both["seg"].view("i8"), both["doc"], both["start"], both["n"], both["self"]]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["bucket", *_RUN.names])


def _rows_of(pdf: pd.DataFrame) -> np.ndarray:
    out = np.zeros(len(pdf), _RUN)
    for name in _RUN.names:
        x = pdf[name].to_numpy()
        out[name] = x.view(U64) if name in ("key", "seg") else x
    return out


def _emit(runs: np.ndarray, buckets: int) -> pa.RecordBatch:
    first, later = _split_first(runs)
    bucket = _bucket(first["key"], buckets)
    order = np.lexsort((first["start"], first["doc"], bucket))
    first, bucket = first[order], bucket[order]
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    names, blobs = [int(bucket[i]) for i in at], [_pack(x) for x in np.split(first, at[1:])] if len(first) else []
    if len(later):
        names.append(-1 - int(later["key"][0] % U64(buckets)))
        blobs.append(_pack(later[np.lexsort((later["start"], later["doc"]))]))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, doc): documents with a number that grows with their id.

    An integer id is its own number unless it (or null) has several texts. Then, and for other types, all (id, text hash) are sorted and numbered."""
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pairs = keyed.select("id", F.xxhash64("text").alias("_h")).distinct()
    whole = isinstance(keyed.schema["id"].dataType, T.LongType | T.IntegerType | T.ShortType | T.ByteType)
    if whole and pairs.groupBy("id").count().filter("count > 1").limit(1).count() == 0:
        return keyed.withColumn("doc", F.coalesce(F.col("id").cast("long"), F.lit(-(2**63))))
    ordered = pairs.orderBy(F.asc_nulls_first("id"), "_h").withColumn("doc", F.monotonically_increasing_id())
    numbers = staged(ordered.withColumnRenamed("id", "_id"), "numbers")  # numbered once
    keyed = keyed.withColumn("_hash", F.xxhash64("text"))
    return keyed.join(numbers, keyed["id"].eqNullSafe(numbers["_id"]) & (F.col("_hash") == F.col("_h"))).select("id", "text", "doc")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, kept (remaining bytes), n_bytes, n_removed, n_spans (maximal removed runs)."""
    narrow = _numbered(docs, id_col, text_col)
    runs = covered(narrow.select("doc", "text"), length).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lists = b.column(1).cast(pa.large_binary()), b.column(2)
            kept, size, removed, spans = [], [], [], []
            for i in range(b.num_rows):
                raw = texts[i].as_py() or b""
                own = lists[i].values
                s = own.field("start").to_numpy().astype(np.int64) if own is not None else np.zeros(0, np.int64)
                e = np.minimum(s + own.field("n").to_numpy() + length - 1, len(raw)) if len(s) else s
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                first = np.append(True, s[1:] > e[:-1])[: len(s)]
                s, e = s[first], e[np.append(first[1:], True)[: len(e)]]
                edges = [0, *np.stack([s, e], axis=1).ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
                size.append(len(raw))
                removed.append(len(raw) - len(kept[-1]))
                spans.append(len(s))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
                ["id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    joined = narrow.join(runs, "doc", "left").select("id", "text", "runs")
    kind = T.StructType([joined.schema["id"], *T.StructType.fromDDL("kept binary, n_bytes long, n_removed long, n_spans long").fields])
    return joined.mapInArrow(cut, kind).withColumnRenamed("id", id_col)
