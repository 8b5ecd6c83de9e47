"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams (1 to 3 characters, A-Z lower-cased) of every document with a known language: each
task adds up its own count matrix, Spark sums the matrices into a table. The log-probability matrix (buckets x languages) is
broadcast and batches are scored in numpy by gathering the n-gram rows and summing them by document. What goes out is bounded
by ``MAX_MATRIX_BYTES``: more languages than that holds are counted and scored in blocks of languages, one pass over the texts each, with the
best language and the sum of the posteriors carried along. Buckets and predictions do not depend on the number of languages.

Cases: a null text or one without a letter is ``und`` with score 1; ties go to the language first by code point; without any
training document everything is ``und``; repeated rows count as often as they occur; other columns pass through
(lang_pred and score are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoflux.llm.common import U64, lowered, mix, slices, staged

ORDERS = (1, 2, 3)
BUCKETS = 1 << 17
MAX_MATRIX_BYTES = 64 << 20
#: Bytes of a very long text that are handled at once.
PART_BYTES = 1 << 22
#: Added to every count.
SMOOTHING = 0.5


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray  # log share of the training documents
    counts: DataFrame | None  # (lang: place in languages, bucket, n)

    def blocks(self, max_bytes: int = MAX_MATRIX_BYTES) -> list[tuple[int, int]]:
        return _blocks(len(self.languages), max_bytes)

    def weights(self, lo: int, hi: int) -> np.ndarray:
        """log P(n-gram | language) of languages lo to hi, buckets x languages."""
        own = self.counts.filter(F.col("lang").between(lo, hi - 1)).toArrow()
        counts = np.full((BUCKETS, hi - lo), SMOOTHING)
        counts[own["bucket"].to_numpy(), own["lang"].to_numpy() - lo] += own["n"].to_numpy()
        return np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32)


def _blocks(languages: int, max_bytes: int) -> list[tuple[int, int]]:
    size = max(1, max_bytes // (BUCKETS * 4))
    return [(lo, min(lo + size, languages)) for lo in range(0, languages, size)]


def _ngrams(buf: np.ndarray, offs: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: bucket of each n-gram, and the offsets of the documents in it. No n-gram crosses documents.

    A very long text (a slice of its own) comes in several parts, each with the n-grams that start in it."""
    if len(offs) == 2 and len(buf) > 2 * PART_BYTES:
        cuts = [0]
        while cuts[-1] + PART_BYTES < len(buf):
            at = cuts[-1] + PART_BYTES
            cuts.append(at - next(k for k in range(4) if buf[at - k] & 0xC0 != 0x80))  # the start of a character
        for lo, hi in zip(cuts, [*cuts[1:], len(buf)], strict=True):
            chars = int(((buf[lo:hi] & 0xC0) != 0x80).sum())
            for bucket, _ in _ngrams(buf[lo : hi + 4 * max(ORDERS)], np.array([0, min(len(buf) - lo, hi - lo + 4 * max(ORDERS))]), buckets):
                yield bucket[:chars], np.array([0, min(chars, len(bucket))])
        return
    low = lowered(buf)
    start = np.flatnonzero((low & 0xC0) != 0x80)
    size = np.diff(np.append(start, len(low)))
    char = low[start].astype(U64)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        char[more] |= low[start[more] + k].astype(U64) << U64(8 * k)
    bounds = np.searchsorted(start, offs)
    code = np.zeros(len(char), dtype=U64)
    shift = U64(64 - (buckets.bit_length() - 1))
    for n in ORDERS:
        code = code[: max(0, len(char) - n + 1)] * U64(0x100000001B3) + char[n - 1 :] + U64(n)
        ok = np.ones(len(code), dtype=bool)
        for back in range(1, n):  # n-grams that start in the last n - 1 characters of a document
            ok[(bounds[1:] - back)[(bounds[1:] - back >= 0) & (bounds[1:] - back < len(code))]] = False
        keep = np.flatnonzero(ok)
        yield (mix(code[keep]) >> shift).astype(np.int64), np.searchsorted(keep, bounds)


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_bytes: int = MAX_MATRIX_BYTES,
) -> LanguageModel:
    """Learn from every row of ``docs`` with a non-null language."""
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect())  # one row a language
    languages = [r[0] for r in found]
    docs_by = np.array([r[1] for r in found], dtype=float)

    def counted(lo: int, hi: int) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((hi - lo) * BUCKETS, dtype=np.int64)
            place = pa.array(languages[lo:hi], pa.string())
            for b in batches:
                lang = pc.index_in(b.column(1), place).to_numpy(zero_copy_only=False).astype(np.int64)
                for at, upto, buf, offs in slices(b.column(0)):
                    for bucket, bounds in _ngrams(buf, offs, BUCKETS):
                        own = np.repeat(lang[at:upto], np.diff(bounds))
                        cell, n = np.unique(own * BUCKETS + bucket, return_counts=True) if hi - lo > 32 else (
                            None,
                            np.bincount(own * BUCKETS + bucket, minlength=len(total)),
                        )
                        total[slice(None) if cell is None else cell] += n
            at = np.flatnonzero(total)
            for i in range(0, len(at), 50_000):
                part = at[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((part // BUCKETS + lo).astype(np.int32)), pa.array((part % BUCKETS).astype(np.int32)), pa.array(total[part])],
                    ["lang", "bucket", "n"],
                )

        own = rows if hi - lo == len(languages) else rows.filter(F.col("lang").between(languages[lo], languages[hi - 1]))
        return own.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    counts = None
    for lo, hi in _blocks(len(languages), max_bytes):
        part = staged(counted(lo, hi), "language-counts")
        counts = part if counts is None else counts.unionByName(part)
    return LanguageModel(languages, np.log(docs_by / max(1.0, docs_by.sum())), counts)


def _has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    low = lowered(buf)
    letter = (low >= 97) & (low <= 122)
    out = np.array([letter.any()]) if len(offs) == 2 else np.diff(np.concatenate([[0], np.cumsum(letter)])[offs]) > 0
    for d in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[d] = any(c.isalpha() for c in buf[offs[d] : offs[d + 1]].tobytes().decode())
    return out


def log_posteriors(weights: np.ndarray, prior: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Log P(language) P(text | language), texts x languages, and whether each text has a letter."""
    out, letter = [np.zeros((0, len(prior)))], [np.zeros(0, bool)]
    for _, _, buf, offs in slices(texts):
        logp = np.tile(prior, (len(offs) - 1, 1))
        for bucket, bounds in _ngrams(buf, offs, len(weights)):
            for lang in range(len(prior)):
                total = np.concatenate([[0.0], np.cumsum(weights[bucket, lang], dtype=np.float64)])
                logp[:, lang] += np.diff(total[bounds])
        out.append(logp)
        letter.append(_has_letter(buf, offs))
    return np.concatenate(out), np.concatenate(letter)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", max_bytes: int = MAX_MATRIX_BYTES) -> DataFrame:
    """``docs`` with lang_pred (a learned language, or ``und``) and score (its posterior probability)."""
    docs = docs.drop(*[c for c in ("lang_pred", "score") if c != text_col])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index(text_col)
    if not model.languages:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(1.0).alias("score"))
    blocks = model.blocks(max_bytes)
    count, width = len(model.languages), len(docs.columns)
    out = docs
    for lo, hi in blocks:
        shared = docs.sparkSession.sparkContext.broadcast((model.weights(lo, hi), model.prior[lo:hi], model.languages[lo:hi]))

        def run(batches: Iterator[pa.RecordBatch], lo=lo, hi=hi, shared=shared) -> Iterator[pa.RecordBatch]:
            weights, prior, names = shared.value
            for b in batches:
                logp, letter = log_posteriors(weights, prior, b.column(at))
                best = logp.argmax(axis=1) if b.num_rows else np.zeros(0, int)
                top = logp.max(axis=1, initial=-np.inf)
                mass = np.exp(logp - top[:, None]).sum(axis=1)
                pred = [names[i] for i in best]
                if lo:  # earlier blocks: their best language, its log probability, and the sum relative to it
                    was, before, held = (b.column(b.num_columns - 3 + i).to_numpy(zero_copy_only=False) for i in range(3))
                    pred = [x if p >= t else y for x, p, y, t in zip(was, before, pred, top, strict=True)]
                    new = np.maximum(before, top)
                    mass = held * np.exp(before - new) + mass * np.exp(top - new)
                    top = new
                if hi == count:
                    last = [
                        pa.array([p if x else "und" for p, x in zip(pred, letter, strict=True)], pa.string()),
                        pa.array(np.where(letter, 1 / mass, 1.0)),
                    ]
                    names_out = ["lang_pred", "score"]
                else:
                    last, names_out = [pa.array(pred, pa.string()), pa.array(top), pa.array(mass)], ["_pred", "_top", "_mass"]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(width)], *last], [*b.schema.names[:width], *names_out])

        if hi == len(model.languages):
            out = out.mapInArrow(run, f"{fields}, lang_pred string, score double")
        else:  # one matrix at a time on every executor
            out = staged(out.mapInArrow(run, f"{fields}, _pred string, _top double, _mass double"), "languages")
            shared.unpersist()
    return out
