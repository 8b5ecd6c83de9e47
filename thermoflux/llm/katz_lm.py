"""Scoring with a Katz backoff bigram model.

Tokens are words with A-Z lower-cased, then one end token a text; the context of the first token is a start mark.
* Unigrams: Good-Turing discounted counts over all training tokens; the freed mass is the probability of the one unknown word.
* Bigrams: P(w | v) = d(c(vw)) c(vw) / c(v) where seen, else backoff(v) P(w), with backoff(v) = (1 - sum of seen P(. | v)) /
  (1 - sum of P(w) over seen w), so every context sums to 1. A context none of whose counts is discounted frees no mass; it alone has c(v) + 1 for
  c(v). A context never seen in training has the unigram distribution.

Words travel as 64-bit hashes, those among the broadcast ones as their places; the counts live in tables partitioned by hash:
1. Unigram counts of all training texts, by word bucket. Their counts of counts give the unigram discounts; the ``KNOWN`` most frequent
   words (a fixed bound) are broadcast with their counts, which covers most tokens and all hot words.
2. Tasks turn texts into (context, word, document) occurrences, packed by context bucket. Those of words beyond the broadcast ones
   first pass their word's bucket, which adds the count. Hot contexts (all of them broadcast words) are spread over buckets by word.
3. A context bucket counts its bigrams over the training texts, and scores every occurrence as far as it can: all but the bigram discounts, of
   which it keeps the numbers a document needs, and the backoff weights, of which it keeps the sums. Counts of counts go along.
   Beyond ``COARSE`` buckets a task packs by coarse groups of buckets, and a second shuffle (``_spread``) packs each group anew by bucket, so a blob
   holds some 64 occurrences at least, however many buckets there are.
4. With the bigram discounts known, the backoff weights are resolved by context and everything is summed by document.

The order is 2: a third word would need either every occurrence routed a second time, by its two-word context, or the contexts with a frequent
second word (about a third of all tokens) resolved across buckets.

Cases: null texts are empty (one token, the end); ids are taken as unique, rows with one id (or none) are summed as one document; ids that are
no integers are named by a 64-bit hash meanwhile; a document learns nothing unless ``train`` is true; without training texts every token is
unknown with probability 1; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoflux.llm.common import NOT_SPACE, U64, lowered, mix, slices, staged, word_hashes, words

#: Counts up to this one are discounted.
K = 5
#: Most frequent words that are broadcast.
KNOWN = 1 << 18
#: Occurrences in one packed chunk of a task, and (about) in one bucket.
CHUNK_TOKENS, BUCKET_TOKENS = 1_000_000, 1_200_000
LEAST_BUCKETS = 64
#: Buckets that a chunk is packed into at most; with more, buckets are dealt out in two steps.
COARSE = CHUNK_TOKENS // 64
START, END = U64(1), U64(2)


# ---------------------------------------------------------------------------------- packed columns


def pack(*columns: np.ndarray) -> bytes:
    """Columns as byte planes, compressed; a few leading bytes hold kinds and lengths."""
    head = ";".join(f"{c.dtype.str},{len(c)}" for c in columns).encode()
    raw = b"".join(np.ascontiguousarray(c).view("u1").reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns)
    return len(head).to_bytes(4, "little") + len(raw).to_bytes(8, "little") + head + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(blob: bytes) -> list[np.ndarray]:
    h, n = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:12], "little")
    raw = pa.decompress(blob[12 + h :], decompressed_size=n, codec="zstd", asbytes=True) if n else b""
    out, at = [], 0
    for part in blob[12 : 12 + h].decode().split(";"):
        kind, size = part.split(",")
        kind, size = np.dtype(kind), int(size)
        wide = np.frombuffer(raw, "u1", size * kind.itemsize, at).reshape(kind.itemsize, size).T
        out.append(np.ascontiguousarray(wide).view(kind)[:, 0] if size else np.zeros(0, kind))
        at += size * kind.itemsize
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in as few bytes as the largest needs."""
    top = int(x.max()) if len(x) else 0
    return x.astype("u1" if top < 1 << 8 else "u2" if top < 1 << 16 else "u4" if top < 1 << 32 else "u8")


def pack_words(h: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct words as columns: steps between the places of the broadcast ones, hashes of the others."""
    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    own = known[at] == h if len(known) else np.zeros(len(h), bool)
    return [narrow(np.diff(at[own], prepend=0)), h[~own]]


def unpack_words(places: np.ndarray, rest: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.sort(np.concatenate([known[np.cumsum(places, dtype="i8")], rest]))


def pack_occurrences(v: np.ndarray, w: np.ndarray, c: np.ndarray, doc: np.ndarray, train: bool, known: np.ndarray) -> bytes:
    """Occurrences with word counts, sorted by context; words by a dictionary."""
    o = np.lexsort((w, v))
    v, w, c, doc = v[o], w[o], c[o], doc[o]
    first = np.flatnonzero(np.diff(v, prepend=v[:1] + U64(1)))
    vocab, at, back = np.unique(w, return_index=True, return_inverse=True)
    ids, dback = np.unique(doc, return_inverse=True)
    flag = np.array([train], "u1")
    return pack(
        flag,
        *pack_words(v[first], known),
        narrow(np.diff(np.append(first, len(v)))),
        *pack_words(vocab, known),
        narrow(c[at]),
        narrow(back),
        ids,
        narrow(dback),
    )


def unpack_occurrences(blob: bytes, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    flag, vk, vr, n, wk, wr, c, back, ids, dback = unpack(blob)
    v = np.repeat(unpack_words(vk, vr, known), n)
    return v, unpack_words(wk, wr, known)[back], c.astype("i8")[back], ids[dback], np.full(len(v), bool(flag[0]))


# ---------------------------------------------------------------------------------- model numbers


def discounts(n: np.ndarray) -> np.ndarray:
    """d(1..K) from counts of counts n[0..K] (of 1..K+1): Good-Turing as Katz scales it, else one absolute discount."""
    r = np.arange(1, K + 1)
    with np.errstate(all="ignore"):
        cut = (K + 1) * n[K] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:K]) - cut) / (1 - cut)
    if not np.all(np.isfinite(d)) or d.min() <= 0 or d.max() > 1:
        d = 1 - (n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0) / r
        d = np.where(d <= 0, 0.5, d)
    return d


@dataclass
class Unigrams:
    total: int
    types: int
    texts: int
    counts: np.ndarray  # of counts 1..K+1
    known: np.ndarray  # sorted hashes of the most frequent words
    known_count: np.ndarray

    def __post_init__(self) -> None:
        d = discounts(self.counts.astype(float))
        kept = 1.0 - float(((1 - d) * np.arange(1, K + 1) * self.counts[:K]).sum()) / max(1, self.total)
        if self.total and kept >= 1.0:  # nothing freed: one token's worth goes to the unknown word
            self.scale, self.unknown = self.total / (self.total + 1), 1 / (self.total + 1)
        else:
            self.scale, self.unknown = 1.0, (1.0 - kept if self.total else 1.0)
        self.d = np.concatenate([[1.0], d])

    def probability(self, c: np.ndarray) -> np.ndarray:
        p = self.scale * np.where(c <= K, self.d[np.minimum(c, K)], 1.0) * c / max(1, self.total)
        return np.where(c > 0, p, self.unknown)

    def look(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is among the broadcast ones, and its count."""
        if not len(self.known):
            return np.zeros(len(w), bool), np.zeros(len(w), "i8")
        at = np.minimum(np.searchsorted(self.known, w), len(self.known) - 1)
        ok = self.known[at] == w
        return ok, np.where(ok, self.known_count[at], 0)


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words and document rows of all tokens of a slice."""
    low = lowered(buf)
    s, e, count = words(low, offs, NOT_SPACE)
    doc = np.repeat(np.arange(len(count)), count)
    w = np.full(len(s) + len(count), END, dtype=U64)
    h = word_hashes(low, s, e)
    w[np.arange(len(s)) + doc] = np.where(h < U64(4), h + U64(4), h)  # the marks have hashes of their own
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[np.concatenate([[0], np.cumsum(count + 1)[:-1]]).astype(int)] = START
    return v, w, np.repeat(np.arange(len(count)), count + 1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    """(train, v, w, doc id) of many tokens, training texts and others apart. Columns of a batch: doc, text, train."""
    held: dict[bool, list] = {True: [], False: []}
    count = {True: 0, False: 0}
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        flag = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for lo, _, buf, offs in slices(b.column(1), 1 << 20):
            v, w, doc = tokens(buf, offs)
            for t in (True, False):
                own = flag[lo + doc] == t
                held[t].append((v[own], w[own], ids[lo + doc[own]]))
                count[t] += int(own.sum())
                if count[t] >= CHUNK_TOKENS:
                    chunk = [np.concatenate(x) for x in zip(*held[t], strict=True)]
                    held[t], count[t] = [], 0
                    for lo_ in range(0, len(chunk[0]), 2 * CHUNK_TOKENS):  # a very long text is several chunks
                        yield t, *[x[lo_ : lo_ + 2 * CHUNK_TOKENS] for x in chunk]
    for t in (True, False):
        if count[t]:
            yield t, *map(np.concatenate, zip(*held[t], strict=True))


def _by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), order[edges[k] : edges[k + 1]]


def _batch(kind: list[int], bucket: list[int], blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())],
        ["kind", "bucket", "blob"],
    )


_PACKED = "kind int, bucket int, blob binary"
#: Kinds of packed rows: by context bucket, by word bucket, sums by document group, backoff sums, numbers of a bucket.
_CONTEXT, _WORD, _PART, _BACKOFF, _STATS = range(5)
#: Sums of a context: unigram mass of seen words, sum of the counts beyond K, number of seen words with counts 1 to K.
_SUMS = 2 + K


def _spread(packed: DataFrame, buckets: int, split) -> DataFrame:
    """Blobs of coarse groups packed anew by bucket, where there are more buckets than groups. ``split(rows)`` packs many unpacked rows (kind, columns)."""
    if buckets <= COARSE:
        return packed

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size: dict[int, int] = {}

        def out(kind: int) -> pa.RecordBatch | None:
            rows = split(kind, held.pop(kind))
            size[kind] = 0
            return _batch(*map(list, zip(*rows, strict=True))) if rows else None

        for b in batches:
            for kind, blob in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                held.setdefault(kind, []).append(blob.as_py())
                size[kind] = size.get(kind, 0) + len(blob.as_buffer())
                if size[kind] >= 16 * CHUNK_TOKENS:  # packed bytes of about a chunk
                    yield from filter(None, [out(kind)])
        for kind in list(held):
            yield from filter(None, [out(kind)])

    return packed.repartition(min(COARSE, 4096), "bucket").mapInArrow(work, _PACKED)


def count_unigrams(docs: DataFrame, buckets: int) -> Unigrams:
    def counted(word: np.ndarray, n: np.ndarray, groups: int) -> list[tuple[int, int, bytes]]:
        return [(_WORD, k, pack(word[at], narrow(n[at]))) for k, at in _by_bucket((mix(word) % U64(buckets)).astype(int) % groups, groups)]

    def again(_: int, blobs: list[bytes]) -> list[tuple[int, int, bytes]]:
        word, n = (np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True))
        return counted(word, n, buckets)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, w, _ in _chunks(batches):
            if t:
                word, n = np.unique(w, return_counts=True)
                yield _batch(*map(list, zip(*counted(word, n, min(buckets, COARSE)), strict=True)))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(x) for x in pdf["blob"]]
        word, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([p[1].astype(float) for p in parts])).astype("i8")
        texts = int(n[word == END].sum())
        low = np.bincount(np.minimum(n, K + 2), minlength=K + 3)[1 : K + 2]
        # twice the bucket's share of the broadcast words; which ones are broadcast changes no result
        top = np.argsort(-n, kind="stable")[: max(KNOWN // buckets * 2, 64)]
        sums = [[int(n.sum()), len(n), texts, *map(int, low)]] + [None] * (len(top) - 1)
        return pd.DataFrame({"sums": sums[: max(1, len(top))], "word": word[top].view("i8"), "n": n[top]})

    # one row a frequent word; the first row of a bucket holds its sums
    got = staged(
        _spread(docs.mapInArrow(emit, _PACKED), buckets, again).groupBy("bucket").applyInPandas(lambda pdf: add(pdf), "sums array<long>, word long, n long"),
        "unigrams",
    )
    nums = got.filter("sums IS NOT NULL").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    sums = np.zeros(4 + K, "i8")
    for r in nums:
        sums[r["i"]] = r["x"]
    top = got.orderBy(F.desc("n"), "word").limit(KNOWN).select("word", "n").toArrow()
    word, n = top["word"].to_numpy().view("u8"), top["n"].to_numpy()
    o = np.argsort(word)
    return Unigrams(int(sums[0]), int(sums[1]), int(sums[2]), sums[3:], word[o], n[o])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: str = "train") -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score (add-half unigrams, log10) and score (log10
    probability of the text). ``docs`` has a boolean column ``train``."""
    sc = docs.sparkSession.sparkContext
    integral = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.col(id_col).cast("long") if integral else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    rows = docs.select(
        F.coalesce(number, F.lit(-(2**63))).alias("doc"),
        F.col(text_col).alias("text"),
        F.coalesce(F.col(train), F.lit(False)).alias("train"),
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, int(size // 6 // BUCKET_TOKENS) + 1)
    coarse = min(buckets, COARSE)
    uni = count_unigrams(rows, buckets)
    # contexts that would fill more than a quarter of a bucket are spread by word
    hot = np.append(uni.known[uni.known_count > uni.total / (4 * buckets)], START)
    shared = sc.broadcast((uni, np.sort(hot)))

    def context_bucket(v: np.ndarray, w: np.ndarray, hot: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
        return (mix(np.where(hot[at] == v, v ^ mix(w), v)) % U64(buckets)).astype(int)

    def contexts(v, w, c, doc, t, hot, known, groups: int = coarse) -> list[tuple[int, int, bytes]]:
        return [(_CONTEXT, k, pack_occurrences(v[at], w[at], c[at], doc[at], t, known)) for k, at in _by_bucket(context_bucket(v, w, hot) % groups, groups)]

    def rare_words(w, v, doc, t, known, groups: int = coarse) -> list[tuple[int, int, bytes]]:
        """Packed with word and context exchanged: the word is the key there."""
        zero = np.zeros(len(w), "u1")
        return [(_WORD, k, pack_occurrences(w[at], v[at], zero[at], doc[at], t, known)) for k, at in _by_bucket((mix(w) % U64(buckets)).astype(int) % groups, groups)]

    def parts(doc: np.ndarray, *sums: np.ndarray, groups: int = coarse) -> list[tuple[int, int, bytes]]:
        """Sums (n_tokens, n_known, base, score, numbers of discounted bigrams) of documents, packed by document group."""
        own = _by_bucket((mix(doc.view("u8")) % U64(buckets)).astype(int) % groups, groups)
        return [(_PART, k, pack(doc[at], *[narrow(s[at]) if s.dtype.kind in "iu" else s[at] for s in sums])) for k, at in own]

    def again(kind: int, blobs: list[bytes]) -> list[tuple[int, int, bytes]]:
        """Blobs of coarse groups packed by bucket."""
        uni, hot = shared.value
        if kind == _PART:
            ids, n, known, base, lin, *by = summed(blobs)
            return parts(ids, n.astype("i8"), known.astype("i8"), base, lin, *[x.astype("i8") for x in by], groups=buckets)
        v, w, c, doc, t = map(np.concatenate, zip(*[unpack_occurrences(x, uni.known) for x in blobs], strict=True))
        out = []
        for flag in (True, False):
            own = np.flatnonzero(t == flag)
            if len(own):
                out += rare_words(v[own], w[own], doc[own], flag, uni.known, buckets) if kind == _WORD else contexts(v[own], w[own], c[own], doc[own], flag, hot, uni.known, buckets)
        return out

    def summed(blobs) -> list[np.ndarray]:
        """Documents and their sums over packed parts."""
        cols = [np.concatenate(x) for x in zip(*[unpack(b) for b in blobs], strict=True)]
        ids, back = np.unique(cols[0], return_inverse=True)
        return [ids, *[np.bincount(back, weights=x.astype(float)) for x in cols[1:]]]

    def base_parts(doc: np.ndarray, c: np.ndarray) -> list[tuple[int, int, bytes]]:
        ids, back = np.unique(doc, return_inverse=True)
        n = np.bincount(back)
        none = [np.zeros(len(ids), "u1")] * K
        return parts(
            ids,
            n,
            np.bincount(back, weights=c > 0).astype("i8"),
            np.bincount(back, weights=np.log10(c + 0.5)),
            np.zeros(len(ids), "f4"),
            *none,
        )

    def emit_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni, _ = shared.value
        for t, v, w, doc in _chunks(batches):
            rare = ~uni.look(w)[0]
            out = rare_words(w[rare], v[rare], doc[rare], t, uni.known)
            if out:
                yield _batch(*map(list, zip(*out, strict=True)))

    def emit_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni, hot = shared.value
        for t, v, w, doc in _chunks(batches):
            ok, c = uni.look(w)
            out = contexts(v[ok], w[ok], c[ok], doc[ok], t, hot, uni.known) + base_parts(doc[ok], c[ok])
            if out:
                yield _batch(*map(list, zip(*out, strict=True)))

    def add_counts(pdf: pd.DataFrame) -> pd.DataFrame:
        uni, hot = shared.value
        w, v, _, doc, t = map(np.concatenate, zip(*[unpack_occurrences(x, uni.known) for x in pdf["blob"]], strict=True))
        _, back = np.unique(w, return_inverse=True)
        c = np.bincount(back, weights=t).astype("i8")[back]
        out = base_parts(doc, c)
        for flag in (True, False):
            own = t == flag
            out += contexts(v[own], w[own], c[own], doc[own], flag, hot, uni.known)
        return pd.DataFrame(out, columns=["kind", "bucket", "blob"])

    # the texts are read once for the rare words and once for the others: cheaper than keeping all occurrences
    more = _spread(rows.mapInArrow(emit_rare, _PACKED), buckets, again).groupBy("bucket").applyInPandas(lambda pdf: add_counts(pdf), _PACKED)
    packed = _spread(rows.mapInArrow(emit_known, _PACKED).unionByName(more), buckets, again)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["kind"].iloc[0] == _PART:
            ids, n, known, base, lin, *by = summed(pdf["blob"])
            return pd.DataFrame(
                parts(ids, n.astype("i8"), known.astype("i8"), base, lin, *[x.astype("i8") for x in by]),
                columns=["kind", "bucket", "blob"],
            )
        uni, hot = shared.value
        v, w, c, doc, t = map(np.concatenate, zip(*[unpack_occurrences(x, uni.known) for x in pdf["blob"]], strict=True))
        o = np.lexsort((w, v))
        v, w, c, doc, t = v[o], w[o], c[o], doc[o], t[o]
        pair = np.ones(len(v), bool)
        pair[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
        at = np.flatnonzero(pair)
        which = np.cumsum(pair) - 1
        n = np.add.reduceat(t.astype("i8"), at)  # training count of each bigram
        pv, pc = v[at], c[at]
        ctx = np.ones(len(at), bool)
        ctx[1:] = pv[1:] != pv[:-1]
        cat = np.flatnonzero(ctx)
        cwhich = np.cumsum(ctx) - 1
        cv = pv[cat]
        total = np.add.reduceat(n, cat)
        is_hot = hot[np.minimum(np.searchsorted(hot, cv), len(hot) - 1)] == cv
        ok, full = uni.look(cv)
        total = np.where(is_hot, np.where(cv == START, uni.texts, full), total)
        # sums of each context: seen types with counts 1..K, the sum of larger counts, the unigram mass of seen words
        low = [np.add.reduceat((n == r).astype("i8"), cat) for r in range(1, K + 1)]
        big = np.add.reduceat(np.where(n > K, n, 0), cat)
        mass = np.add.reduceat(np.where(n > 0, uni.probability(pc), 0.0), cat)

        on, oc = n[which], total[cwhich][which]
        seen = on > 0
        ids, back = np.unique(doc, return_inverse=True)
        # a context with a discounted count frees mass; whether one without any here has some elsewhere is not known yet if it is hot
        some = np.sum(low, axis=0) > 0
        late = (is_hot & ~some)[cwhich][which] & seen
        below = np.where(late, 1.0, oc + np.where(some, 0.0, 1.0)[cwhich][which])
        lin = np.where(seen, np.log10(np.maximum(on, 1) / np.maximum(below, 1.0)), np.log10(uni.probability(c)))
        by = [np.bincount(back, weights=seen & (on == r), minlength=len(ids)).astype("i8") for r in range(1, K + 1)]
        zero = np.zeros(len(ids), "u1")
        out = parts(ids, zero, zero, np.zeros(len(ids), "f4"), np.bincount(back, weights=lin, minlength=len(ids)), *by)
        stats = np.bincount(np.minimum(n, K + 2), minlength=K + 3)[1 : K + 2]
        out.append((_STATS, 0, pack(stats.astype("i8"))))
        # occurrences that back off from a context seen in training (hot ones are seen, if not in this bucket), and those whose divisor is open
        off = np.flatnonzero((~seen & (oc > 0)) | late)
        oct_ = cwhich[which[off]]
        used = np.unique(np.concatenate([oct_, np.flatnonzero(is_hot)]))
        place = np.searchsorted(used, oct_)
        key, kback = np.unique(place * len(ids) + back[off], return_inverse=True)
        n_off, n_late = (np.bincount(kback, weights=x, minlength=len(key)).astype("i8") for x in (~late[off], late[off]))
        out.append((_BACKOFF, 0, pack(cv[used], is_hot[used].astype("u1"), total[used], mass[used], big[used], *[narrow(x[used]) for x in low],
                                      narrow(key // max(1, len(ids))), ids[key % max(1, len(ids))], narrow(n_off), narrow(n_late))))
        return pd.DataFrame(out, columns=["kind", "bucket", "blob"])

    group = F.when(F.col("kind") == _CONTEXT, F.col("bucket")).otherwise(-1 - F.col("bucket")).alias("g")
    counted = staged(packed.select(group, "kind", "bucket", "blob").groupBy("g").applyInPandas(lambda pdf: count(pdf), _PACKED), "counted")

    stats = counted.filter(F.col("kind") == _STATS).mapInArrow(_sum_blobs, "blob binary").toArrow()
    n_r = sum((unpack(x)[0] for x in stats["blob"].to_pylist()), np.zeros(K + 1, "i8"))
    d = discounts(n_r.astype(float))

    # the sums of hot contexts meet from all buckets: at most KNOWN + 1 contexts, as broadcast arrays
    def hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                v, is_hot, _, *sums = unpack(x.as_py())[: 3 + _SUMS]
                at = np.flatnonzero(is_hot)
                columns = [pa.array(q[at].astype(float)) for q in sums]
                yield pa.RecordBatch.from_arrays([pa.array(v[at].view("i8")), *columns], ["v", *[f"s{i}" for i in range(_SUMS)]])

    backoff = counted.filter(F.col("kind") == _BACKOFF).select("blob")
    fields = ", ".join(f"s{i} double" for i in range(_SUMS))
    met = backoff.mapInArrow(hot_sums, f"v long, {fields}").groupBy("v").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(_SUMS)]).toArrow()
    hot_v = met["v"].to_numpy().view("u8")
    o = np.argsort(hot_v)
    resolved = sc.broadcast((d, hot_v[o], np.stack([met[f"s{i}"].to_numpy() for i in range(_SUMS)], axis=1)[o]))

    def back_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, hot_v, hot_sum = resolved.value
        r = np.arange(1, K + 1)
        for b in batches:
            for x in b.column(0):
                v, is_hot, total, *rest = unpack(x.as_py())
                sums, (at, doc, n_off, n_late) = np.stack(rest[:_SUMS], axis=1).astype(float).reshape(-1, _SUMS), rest[_SUMS:]
                own = np.flatnonzero(is_hot)
                sums[own] = hot_sum[np.searchsorted(hot_v, v[own])]
                mass, big, low = sums[:, 0], sums[:, 1], sums[:, 2:]
                below = np.maximum(total + np.where(low.sum(axis=1) > 0, 0.0, 1.0), 1.0)
                kept = (low @ (r * d) + big) / below
                weight = np.log10(np.maximum(1.0 - kept, 1e-300) / np.maximum(1.0 - mass, 1e-300))
                ids, back = np.unique(doc, return_inverse=True)
                zero = np.zeros(len(ids), "u1")
                extra = weight[at] * n_off - np.log10(below)[at] * n_late
                out = parts(ids, zero, zero, np.zeros(len(ids), "f4"), np.bincount(back, weights=extra, minlength=len(ids)), *[zero] * K)
                if out:
                    yield _batch(*map(list, zip(*out, strict=True)))

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        d = resolved.value[0]
        ids, n, known, base, lin, *by = summed(pdf["blob"])
        lin = lin + sum(x * np.log10(d[r]) for r, x in enumerate(by))
        base = base - n * np.log10(uni_total)
        return pd.DataFrame({"doc": ids, "n_tokens": n.astype("i8"), "n_known": known.astype("i8"), "base_score": base, "score": lin})

    uni_total = uni.total + 0.5 * (uni.types + 1)
    every = counted.filter(F.col("kind") == _PART).unionByName(backoff.mapInArrow(back_off, _PACKED))
    out = _spread(every, buckets, again).select("bucket", "blob").groupBy("bucket").applyInPandas(lambda pdf: total(pdf), "doc long, n_tokens long, n_known long, base_score double, score double")
    columns = ["n_tokens", "n_known", F.lit(uni.total).cast("long").alias("train_tokens"), "base_score", "score"]
    if integral:
        kind = docs.schema[id_col].dataType
        return out.select(F.when(F.col("doc") != -(2**63), F.col("doc")).cast(kind).alias(id_col), *columns)
    names = docs.select(F.coalesce(number, F.lit(-(2**63))).alias("doc"), F.col(id_col)).distinct()
    return out.join(names, "doc").select(F.col(id_col), *columns)


def _sum_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(K + 1, "i8")
    for b in batches:
        for x in b.column(2):
            total += unpack(x.as_py())[0]
    yield pa.RecordBatch.from_arrays([pa.array([pack(total)], pa.binary())], ["blob"])
