"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, scanned over document windows.

Texts are lower-cased (A-Z only) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A benchmark item gives every
window of ``n`` consecutive words; an item with fewer words, but not none, gives one window of all its words. The
window hashes are broadcast, tasks slide over whole documents, and each hash hit is verified on the words themselves.

What is broadcast is counted first. Up to ``max_windows`` windows go out as one set. Of a larger benchmark only a bit table of a fixed
size goes out; the document windows that it lets through are joined with the benchmark windows by a shuffle, and the hits
go back to the documents by their text. The result is the same.

Cases: a null or empty text has no words, no hits and is clean; items without words are ignored; repeated items count
once, by item_id written as text (null as 'null'); an empty benchmark leaves everything clean; every row is judged by its own text, so
null and repeated ids give one row each; other columns, whatever their names, pass through ``drop_contaminated`` and ``cut_spans``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoflux.llm.common import ALNUM, lowered, slices, span_hashes, staged, word_hashes, words

N = 10
#: Windows in a broadcast set (some 500 bytes each once they are dictionaries).
MAX_WINDOWS = 400_000
#: Bits of the table that a larger benchmark is screened by (16 MB), and how many of them one row of it holds.
TABLE_BITS, ROW_BITS = 27, 15
#: Texts with hits that are broadcast back to the documents.
MAX_HIT_TEXTS = 20_000

_WINDOWS = "item string, size int, hash long, window binary"
_SCAN = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,end:int>>, contaminated boolean"


def benchmark_windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, size in words, hash, window text) of each distinct window of the benchmark items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids = batch.column(0).to_pylist()
            for lo, hi, buf, offs in slices(batch.column(1)):
                low = lowered(buf)
                s, e, count = words(low, offs, ALNUM)
                wh = word_hashes(low, s, e)
                at = np.concatenate([[0], np.cumsum(count)])
                for k in range(hi - lo):
                    size = min(n, int(count[k]))
                    if size:
                        first = np.arange(at[k], at[k + 1] - size + 1)
                        for i, h in zip(first, span_hashes(wh, first, first + size).view(np.int64), strict=True):
                            out.append((str(ids[lo + k]) if ids[lo + k] is not None else "null", size, int(h), window_text(low, s, e, i, size)))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
                ["item", "size", "hash", "window"],
            )

    return benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, _WINDOWS).distinct()


def window_text(low: np.ndarray, s: np.ndarray, e: np.ndarray, i: int, size: int) -> bytes:
    return b" ".join(low[s[j] : e[j]].tobytes() for j in range(i, i + size))


class _Set:
    """A broadcast set: sorted hashes by window size, the window texts, and the items of each window."""

    def __init__(self, rows: list):
        self.by_size: dict[int, np.ndarray] = {}
        self.known: dict[tuple[int, int], dict[bytes, set[str]]] = {}
        for r in rows:
            self.known.setdefault((r["size"], r["hash"]), {}).setdefault(bytes(r["window"]), set()).add(r["item"])
        for size in sorted({k[0] for k in self.known}):
            self.by_size[size] = np.sort(np.array([h for z, h in self.known if z == size], dtype=np.int64).view(np.uint64))

    def hits(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, set[str]]]]:
        """Word starts, ends, counts a document, and the verified (first word, size, items)."""
        low = lowered(buf)
        s, e, count = words(low, offs, ALNUM)
        doc = np.repeat(np.arange(len(count)), count)
        wh = word_hashes(low, s, e)
        found = []
        for size, table in self.by_size.items():
            if len(s) < size:
                continue
            first = np.arange(len(s) - size + 1)
            h = span_hashes(wh, first, first + size)
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(table >> np.uint64(44)).astype(np.int64)] = True
            i = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)] & (doc[: len(first)] == doc[size - 1 :]))
            at = np.searchsorted(table, h[i])
            at[at == len(table)] = 0
            for j in i[table[at] == h[i]]:
                items = self.known[size, int(h[j].view(np.int64))].get(window_text(low, s, e, j, size))
                if items:
                    found.append((int(j), size, items))
        return s, e, count, found


def _bit_table(windows: DataFrame) -> np.ndarray:
    """One bit for every leading part of a window hash that occurs."""
    place = F.shiftrightunsigned("hash", 64 - TABLE_BITS)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << ROW_BITS, dtype=np.uint8)
        bits[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"row": [int(pdf["row"].iloc[0])], "bits": [np.packbits(bits).tobytes()]})

    parts = windows.select((place % (1 << ROW_BITS)).cast("int").alias("bit"), F.shiftright(place, ROW_BITS).cast("int").alias("row")).distinct()
    # at most 2 ** (TABLE_BITS - ROW_BITS) rows
    got = parts.groupBy("row").applyInPandas(lambda pdf: pack(pdf), "row int, bits binary").toArrow()
    out = np.zeros(1 << (TABLE_BITS - 3), dtype=np.uint8)
    for row, bits in zip(got["row"].to_pylist(), got["bits"].to_pylist(), strict=True):
        at = row << (ROW_BITS - 3)
        out[at : at + len(bits)] = np.frombuffer(bits, dtype=np.uint8)
    return out


def _text_key(text_col: str) -> list[Column]:
    """Names a text: two hashes and its length."""
    text = F.col(text_col)
    return [F.xxhash64(text).alias("_k1"), F.hash(text).alias("_k2"), F.coalesce(F.octet_length(text), F.lit(-1)).alias("_k3")]


_KEY = ["_k1", "_k2", "_k3"]


def _text_hits(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """(key of the text, hits array<struct<j, size, item>>) of texts (_k1, _k2, _k3, _text) with benchmark windows."""
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most n values
    table = texts.sparkSession.sparkContext.broadcast(_bit_table(windows))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for b in batches:
            for lo, _, buf, offs in slices(b.column(3)):
                low = lowered(buf)
                s, e, count = words(low, offs, ALNUM)
                doc = np.repeat(np.arange(len(count)), count)
                wh = word_hashes(low, s, e)
                for size in sizes:
                    first = np.arange(max(0, len(s) - size + 1))
                    first = first[doc[first] == doc[first + size - 1]]
                    h = span_hashes(wh, first, first + size)
                    bit = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                    on = np.flatnonzero(bits[bit >> 3] & (128 >> (bit & 7)))
                    at = np.concatenate([[0], np.cumsum(count)])
                    for k in range(0, len(on), 10_000):
                        j = first[on[k : k + 10_000]]
                        row = pa.array(lo + doc[j])
                        yield pa.RecordBatch.from_arrays(
                            [*[b.column(i).take(row) for i in range(3)], pa.array((j - at[doc[j]]).astype(np.int32)), pa.array(np.full(len(j), size, np.int32)),
                             pa.array(h[on[k : k + 10_000]].view(np.int64)), pa.array([window_text(low, s, e, i, size) for i in j], pa.binary())],
                            [*_KEY, "j", "size", "hash", "window"],
                        )

    found = texts.mapInArrow(candidates, "_k1 long, _k2 int, _k3 int, j int, size int, hash long, window binary").distinct()
    return found.join(windows, ["size", "hash", "window"]).groupBy(*_KEY).agg(F.collect_list(F.struct("j", "size", "item")).alias("_hits"))


def _given_back(docs: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    """Rows with a text key joined with the hits of their texts."""
    return docs.join(F.broadcast(hits) if hits.count() <= MAX_HIT_TEXTS else hits, _KEY, how)


def _rows(
    found: list,
    s: np.ndarray,
    e: np.ndarray,
    count: np.ndarray,
    offs: np.ndarray,
) -> tuple[list[list[str]], list[list[tuple[int, int]]], np.ndarray]:
    """By document: the items, the hit byte spans (runs of hit words), and the number of hit words."""
    edge = np.zeros(len(s) + 1, dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(count)])
    items: list[set[str]] = [set() for _ in count]
    docs = np.searchsorted(at, [j for j, _, _ in found], side="right") - 1
    for (j, size, names), d in zip(found, docs, strict=True):
        edge[j] += 1
        edge[j + size] -= 1
        items[d] |= names
    hit = np.cumsum(edge[:-1]) > 0
    n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[at])
    spans: list[list[tuple[int, int]]] = [[] for _ in count]
    for d in np.unique(docs):
        own = hit[at[d] : at[d + 1]].astype(np.int8)
        step = np.diff(np.concatenate([[0], own, [0]]))
        for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
            spans[d].append((int(s[at[d] + a] - offs[d]), int(e[at[d] + b - 1] - offs[d])))
    return [sorted(x) for x in items], spans, n_hit


def _scan_columns(texts: pa.Array, hits: Callable) -> list[pa.Array]:
    n_words, n_hit, items, spans = [], [], [], []
    for _, _, buf, offs in slices(texts):
        s, e, count, found = hits(buf, offs)
        i, p, h = _rows(found, s, e, count, offs)
        n_words.append(count)
        n_hit.append(h)
        items += i
        spans += p
    n_words = np.concatenate([np.zeros(0, np.int64), *n_words]).astype(np.int64)
    n_hit = np.concatenate([np.zeros(0, np.int64), *n_hit]).astype(np.int64)
    struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return [
        pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())),
        pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], struct), pa.array(n_hit > 0),
    ]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = N,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside occurring windows), n_items, items, spans (byte
    offsets of maximal runs of hit words) and contaminated."""
    windows = benchmark_windows(benchmark, n)
    names = [x.split()[0] for x in ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")]
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {_SCAN}"
    docs = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    if windows.count() <= max_windows:
        block = docs.sparkSession.sparkContext.broadcast(_Set(windows.collect()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), *_scan_columns(b.column(1), block.value.hits)], [id_col, *names])

        return docs.mapInArrow(run, schema)

    keyed = docs.select(*_text_key("_text"), "_text", F.col(id_col).alias("_id"))
    hits = staged(_text_hits(keyed.select(*_KEY, "_text"), staged(windows, "windows")), "hits")
    joined = _given_back(keyed, hits, "left").select("_id", "_text", "_hits")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(2).to_pylist()
            row = 0

            def known(buf: np.ndarray, offs: np.ndarray):
                nonlocal row
                s, e, count = words(lowered(buf), offs, ALNUM)
                at = np.concatenate([[0], np.cumsum(count)])
                found = []
                for k in range(len(count)):
                    found += [(int(at[k]) + x["j"], x["size"], {x["item"]}) for x in given[row + k] or ()]
                row += len(count)
                return s, e, count, found

            yield pa.RecordBatch.from_arrays([b.column(0), *_scan_columns(b.column(1), known)], [id_col, *names])

    return joined.mapInArrow(finish, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; columns as given, no shuffle unless the benchmark is large."""
    windows = benchmark_windows(benchmark, n)
    if windows.count() > max_windows:
        rows = docs.select(F.struct("*").alias("_row"), *_text_key(text_col))
        hits = staged(_text_hits(docs.select(*_text_key(text_col), F.col(text_col).alias("_text")), staged(windows, "windows")).select(*_KEY), "hits")
        return _given_back(rows, hits, "left_anti").select("_row.*")
    block = docs.sparkSession.sparkContext.broadcast(_Set(windows.collect()))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dirty = []
            for _, _, buf, offs in slices(b.column(place)):
                _, _, count, found = block.value.hits(buf, offs)
                at = np.concatenate([[0], np.cumsum(count)])
                own = np.zeros(len(count), dtype=bool)
                own[np.searchsorted(at, [j for j, _, _ in found], side="right") - 1] = True
                dirty.append(own)
            yield b.filter(pa.array(~np.concatenate([np.zeros(0, bool), *dirty])))

    return docs.mapInArrow(run, docs.schema)


def cut_spans(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the hit spans of ``scanned`` removed from the text (each replaced by one space)."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, sp in zip(text, spans, strict=True):
            if t is not None and sp is not None and len(sp):
                raw, at, kept = t.encode(), 0, []
                for x in sp:
                    kept.append(raw[at : x["start"]])
                    at = x["end"]
                t = b" ".join([*kept, raw[at:]]).decode()
            out.append(t)
        return pd.Series(out, dtype=object)

    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    hit = scanned.filter("contaminated").select(F.col(id_col).alias("_hit_id"), F.col("spans").alias("_spans")).dropDuplicates(["_hit_id"])
    joined = rows.join(hit, rows["_id"].eqNullSafe(hit["_hit_id"]), "left")
    text = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(cut(F.col("_text"), F.col("_spans")))
    return joined.select(*[text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
