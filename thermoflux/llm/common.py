"""Shared pieces of the text operators: byte-level tokens and hashes in numpy, staging, and the document reader.

Texts stay as the UTF-8 bytes of Arrow batches. A batch is cut into slices of a bounded number of
bytes, so that working arrays stay small however long the batch is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoflux.sources.io import stored

#: Bytes of text that one numpy pass handles at once (a longer document is a slice of its own).
SLICE_BYTES = 1 << 21

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_MIX1 = U64(0xBF58476D1CE4E5B9)
_MIX2 = U64(0x94D049BB133111EB)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------------------------- staging


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts its lineage.

    ``sources.io.remove_stored`` removes such tables. ``options`` go to the writer."""
    return stored(df, name, **options)


# ---------------------------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * _MIX1
    x ^= x >> U64(27)
    x = x * _MIX2
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * _MULT)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U64(pow(int(_MULT), -1, 1 << 64))
    out = []
    for base in (_MULT, inverse):
        p = np.full(n, base, dtype=U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for at least ``n`` positions."""
    return _powers(1 << max(16, int(n).bit_length()))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run ``values[start:end]``; equal runs hash alike wherever they stand."""
    p, q = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * p[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(U64) * _MIX2)


#: Bytes whose 64-bit values are held at once.
BLOCK_BYTES = 1 << 21


def _long_hash(run: np.ndarray) -> np.ndarray:
    """Hash of one long run of bytes, block by block."""
    p, _ = powers(BLOCK_BYTES)
    total, power = np.zeros(1, U64), np.ones(1, U64)
    for lo in range(0, len(run), BLOCK_BYTES):
        own = byte_values()[run[lo : lo + BLOCK_BYTES]]
        total += power * np.sum(own * p[: len(own)], dtype=U64)
        power = power * p[BLOCK_BYTES - 1] * _MULT
    return mix(total + U64(len(run)) * _MIX2)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``span_hashes`` of runs of bytes (``starts`` ascending) that widens only a block of the bytes at a time."""
    if len(buf) <= BLOCK_BYTES:
        return span_hashes(byte_values()[buf], starts, ends)
    out = np.empty(len(starts), dtype=U64)
    long = ends - starts > BLOCK_BYTES
    for i in np.flatnonzero(long):
        out[i] = _long_hash(buf[starts[i] : ends[i]])[0]
    cuts = np.searchsorted(starts, np.arange(0, len(buf) + BLOCK_BYTES, BLOCK_BYTES))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = a + np.flatnonzero(~long[a:b])
        if len(own):
            lo, hi = starts[own[0]], ends[own].max()
            out[own] = span_hashes(byte_values()[buf[lo:hi]], starts[own] - lo, ends[own] - lo)
    return out


# ---------------------------------------------------------------------------------- tokens

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: [^\x20\x09-\x0D]+ : everything but space and the five controls from tab to carriage return.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, a-z and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def lowered(buf: np.ndarray) -> np.ndarray:
    """Lower-case A-Z only."""
    return _LOWER[buf]


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES, max_rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive rows; null texts have no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, raw, data = texts.buffers()
    offs = np.frombuffer(raw, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, n, lo + max_rows)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and counts a document of the maximal runs of bytes in ``keep``; none crosses documents."""
    n = len(buf)
    mask = np.zeros(n + 2, dtype=bool)
    mask[1:-1] = keep[buf]
    starts = mask[1:-1] & ~mask[:-2]
    ends = mask[1:-1] & ~mask[2:]
    inner = offs[(offs > 0) & (offs < n)]
    starts[inner] = mask[1:-1][inner]
    ends[inner - 1] = mask[1:-1][inner - 1]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    return s, e, np.diff(np.searchsorted(s, offs))


def crc_mod(column: str, n: int):
    """crc32 of an id written as text, modulo ``n`` (null ids count as the text 'null')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % n
