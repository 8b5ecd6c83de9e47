"""MinHash near-dedup with SuperMinHash signatures, banding, verification on full sets and component grouping.

The set of a document holds the hashes of its distinct word shingles. SuperMinHash gives every element a random permutation of the
signature's places and ranks that grow along it; all elements are processed rank by rank, and a document stops as soon as no later rank
can lower its signature. Signatures are cut into bands; documents that share a band hash are candidates.

No pairs are emitted within a band group. Members with too many elements that no other candidate has can link with nothing and leave.
Each group picks as leader its most central member (the least such elements), and every member is compared with it; links give
components. Documents of groups that still span several components are then compared in ``SWEEPS`` sweeps: those that share two
bands, and so are more alike than most of the group, meet one of them drawn by hash, which connects most documents of one template in
a few pairs a document. What is left is joined across components on its rarest elements, with the prefix and position bounds of exact
set-similarity joins. Pairs of the sweeps and of that join are first held against parities of their sets, which bound the elements that
only one of both has from below; only pairs that this leaves possible are verified. So every two candidates are compared, connected already, or proven to be no link.
Equal sets are merged before banding, verification runs on the whole sets, and links are followed by star steps in Spark.

Chances: the bands are as many as make a pair at the threshold escape all of them with probability ``MISS`` at most.

Cases: a document with fewer words than a shingle has them all as its one shingle; one without words (null, empty) has an empty set, is
linked with nothing and stays; equal texts share a component; ids are integers and taken as unique: rows with
the same id get the same component, the smallest that one of their texts has; rows with a null id are linked with nothing and stay. Other columns pass through ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermoflux.llm.common import NOT_SPACE, U64, lowered, mix, slices, span_hashes, staged, word_hashes, words
from thermoflux.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Values of a signature in one band; chance that a pair at the threshold escapes all bands.
ROWS, MISS = 5, 1e-6
#: Rounds over documents that share two bands, before the exact join.
SWEEPS = 2
#: Bits of a set's parities: bit i tells whether an odd number of elements hashes to i.
PARITY_BITS = 2048
#: Documents in one numpy pass; their number fills the top bits of the sort keys, a 52-bit shingle hash the rest.
_DOCS = 4096
_HASH_BITS = 52


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and their offsets (at most _DOCS documents)."""
    low = lowered(buf)
    s, e, count = words(low, offs, NOT_SPACE)
    wh = word_hashes(low, s, e)
    doc = np.repeat(np.arange(len(count), dtype=np.int64), count)
    at = np.concatenate([[0], np.cumsum(count)])
    first = np.flatnonzero(doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < n))
    start = np.concatenate([first, at[few]])
    end = np.concatenate([first + n, at[few] + count[few]])
    h = span_hashes(wh, start, end) >> U64(64 - _HASH_BITS)
    key = np.unique(doc[start].astype(U64) << U64(_HASH_BITS) | h)
    bounds = np.searchsorted(key >> U64(_HASH_BITS), np.arange(len(count) + 1).astype(U64))
    return key & U64((1 << _HASH_BITS) - 1), bounds


def superminhash(elements: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """Signatures (documents x m) of sets laid end to end; places of empty sets stay at the largest value."""
    n_docs = len(bounds) - 1
    sig = np.full(n_docs * m, np.iinfo(np.uint64).max, dtype=U64)
    doc = np.repeat(np.arange(n_docs), np.diff(bounds))
    el = elements
    perm: np.ndarray | None = None
    for j in range(m):
        g = mix(el + U64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + (((g & U64(0xFFFFFFFF)) * U64(m - j)) >> U64(32)).astype(np.int64)
        if j == 0:
            place, k0 = k, k
        else:
            row = np.arange(len(el))
            place = perm[row, k]
            perm[row, k] = perm[:, j]
            perm[:, j] = place
        value = U64(j) << U64(48) | mix(g) >> U64(16)
        np.minimum.at(sig, doc * m + place, value)
        # the next rank is j + 1: documents whose signature lies below it are done
        open_ = (sig.reshape(n_docs, m) >> U64(48)).max(axis=1) > j if n_docs else np.zeros(0, bool)
        keep = open_[doc]
        if not keep.any():
            break
        if j == 0:
            k0 = k0[keep]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(k0), 1))
            perm[:, 0] = k0
            perm[np.arange(len(k0)), k0] = 0
        else:
            perm = perm[keep]
        el, doc = el[keep], doc[keep]
    return sig.reshape(n_docs, m)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), dtype=U64)
    for b in range(bands):
        h = np.full(len(sig), U64(b + 1), dtype=U64)
        for r in range(rows):
            h = mix(h * U64(0x100000001B3) + sig[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc, n_shingles, digest of the set, band hashes) of documents (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, band = [], [], []
            for lo, hi, buf, offs in slices(b.column(1), max_rows=_DOCS):
                el, bounds = shingle_sets(buf, offs, shingle)
                hashes = band_hashes(superminhash(el, bounds, bands * rows), bands, rows)
                for i in range(hi - lo):
                    own = el[bounds[i] : bounds[i + 1]]
                    n.append(len(own))
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    band.append(hashes[i] if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(band, pa.list_(pa.int64()))],
                ["doc", "n_shingles", "digest", "bands"],
            )

    return docs.mapInArrow(run, "doc long, n_shingles long, digest binary, bands array<bigint>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, _, buf, offs in slices(b.column(1), max_rows=_DOCS):
                el, bounds = shingle_sets(buf, offs, shingle)
                out += [el[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc", "elements"])

    return docs.mapInArrow(run, "doc long, elements binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64)
                both = len(np.intersect1d(p, q, assume_unique=True)) if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            sets = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in part.column(1)]
            doc = np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(doc)], ["element", "doc"])


def _may_link(percent: int) -> Column:
    """Whether two sets could reach the similarity: they share at most the elements that are not one's own alone."""
    most = F.least("s", "os")
    return most * 100 >= percent * (F.col("n") + F.col("on") - most)


def _rare_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can still reach the similarity, found by their rarest common element.

    Elements are ordered by frequency, rare ones first. If the first element that two sets share stands at places i and j, they share
    at most 1 + min(n - i, m - j) elements; a link needs p / (100 + p) of n + m. So only an element among the first few of both makes a pair,
    and every link has one. Elements that one set has alone come first and meet nothing."""
    each = sets.select("doc", "elements").mapInArrow(_elements, "element long, doc long")
    df = each.groupBy("element").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    size = sets.select("doc", (F.length("elements") / 8).cast("long").alias("n"))
    shared = each.join(df, "element")
    place = F.row_number().over(Window.partitionBy("doc").orderBy("df", "element"))
    count = F.count(F.lit(1)).over(Window.partitionBy("doc"))
    p = shared.withColumn("i", place).withColumn("k", count).join(size, "doc").withColumn("i", F.col("n") - F.col("k") + F.col("i"))
    # whatever the other's size, at most n * (100 - p) / 100 elements may be missing
    p = p.filter((F.col("n") - F.col("i") + 1) * 100 >= percent * F.col("n")).join(labels, "doc").select("element", "doc", "c", "n", "i")
    # sizes of linked sets lie in the same or neighbouring classes, so the sets of an element meet only those of like size
    size_class = F.floor(F.log("n") / math.log(100 / percent) + 1e-9) if percent < 100 else F.col("n")
    p = staged(p.withColumn("z", size_class.cast("long")), "rare-elements")
    q = p.toDF("element", "o", "oc", "on", "oi", "oz").withColumn("oz", F.explode(F.array(F.col("oz") - 1, F.col("oz"), F.col("oz") + 1)))
    most = F.least(F.col("n") - F.col("i"), F.col("on") - F.col("oi")) + 1
    found = p.join(
        q,
        (p["element"] == q["element"]) & (p["z"] == q["oz"]) & (F.col("doc") > F.col("o")) & (F.col("c") != F.col("oc")) & (most * (100 + percent) >= percent * (F.col("n") + F.col("on"))),
    )
    return found.select(F.col("doc").alias("a"), F.col("o").alias("b")).distinct()


def _parities(sets: DataFrame) -> DataFrame:
    """(doc, n, parity) of each set: its size and, for each of PARITY_BITS hash values, whether it has an odd number of such elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, parity = [], []
            for x in b.column(1):
                own = np.frombuffer(x.as_buffer(), dtype=U64)
                odd = np.bincount((mix(own) % U64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
                n.append(len(own))
                parity.append(np.packbits(odd.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(parity, pa.binary())], ["doc", "n", "parity"])

    return sets.select("doc", "elements").mapInArrow(run, "doc long, n long, parity binary")


def _possible(pairs: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may reach the similarity: bits in which the parities differ are at most the elements that one of both has
    and the other has not, so (n + m - bits) / 2 elements are shared at most. No link is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            both = b.column(2).to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint64).reshape(b.num_rows, PARITY_BITS // 64) for i in (3, 4))
            bits = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            keep = (both - bits) * (100 + percent) >= 2 * percent * both
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = parities.select(F.col("doc").alias("a"), F.col("n"), F.col("parity").alias("x"))
    right = parities.select(F.col("doc").alias("b"), F.col("n").alias("m"), F.col("parity").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("n") + F.col("m")).alias("both"), "x", "y").mapInArrow(run, "a long, b long")


def _sweep_pairs(live: DataFrame, reps: DataFrame, step: int) -> DataFrame:
    """Pairs (a, b) of different components: of the documents that share a band and the one ``step`` after it, each with one drawn by hash."""
    twice = F.expr(f"transform(bands, (x, i) -> xxhash64(x, bands[(i + {step}) % size(bands)]))")
    each = live.join(reps.select("doc", "bands"), "doc").select("doc", "c", F.explode(twice).alias("g"))
    drawn = F.struct(F.xxhash64("g", "doc"), F.col("doc").alias("o"), F.col("c").alias("oc"))
    lead = each.groupBy("g").agg(F.min(drawn).alias("l"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
    pairs = each.join(lead.select("g", "l.o", "l.oc"), "g").filter("c <> oc")
    return pairs.select(*_ordered(F.col("doc"), F.col("o"))).distinct()


def _live(docs: DataFrame, found: DataFrame, reps: DataFrame) -> DataFrame:
    """(doc, c): current components of those documents that are in a band group with several components. ``found``: (node, component)."""
    labels = docs.join(found, docs["doc"] == found["node"], "left").select("doc", F.coalesce("component", "doc").alias("c"))
    each = staged(labels.join(reps.select("doc", "bands"), "doc").select("doc", "c", F.explode("bands").alias("h")), "labelled")
    split = each.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("h")
    return staged(each.join(split, "h", "left_semi").select("doc", "c").distinct(), "live")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of ``rows`` values after which a pair at the threshold has escaped with probability ``miss`` at most."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - min(similarity, 0.999) ** rows)))


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    bands: int | None = None,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links) and kept (it is that one)."""
    percent = round(similarity * 100)
    bands = bands or bands_for(similarity, rows)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sig = staged(signatures(narrow, shingle, bands, rows), "signatures")
    filled = sig.filter(F.col("digest").isNotNull() & F.col("doc").isNotNull())
    reps = filled.groupBy("digest").agg(F.min(F.struct("doc", "bands")).alias("r")).select("digest", "r.doc", "r.bands")
    reps = staged(reps, "representatives")  # a table of its own, so that the join of many copies below can be split

    # groups of two and more sets with the same band hash
    entries = reps.select("doc", F.explode("bands").alias("h"))
    groups = entries.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi")
    members = staged(entries.join(groups.select("h"), "h").distinct(), "members")
    texts = narrow.join(members.select("doc").distinct(), "doc", "left_semi")
    sets = staged(_sets(texts, shingle).groupBy("doc").agg(F.min("elements").alias("elements")), "sets")

    # a link needs most elements of both: a set with too many elements of its own is linked with nothing
    alone = sets.mapInArrow(_elements, "element long, doc long").groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc")).filter("n = 1")
    own = alone.groupBy("doc").agg(F.count(F.lit(1)).alias("own"))
    weight = sets.select("doc", (F.length("elements") / 8).cast("long").alias("n")).join(own, "doc", "left")
    weight = weight.select("doc", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("s")).filter(F.col("s") * 100 >= percent * F.col("n"))
    open_ = staged(members.join(weight, "doc"), "open-members")

    # first every member against the most central of its group
    lead = open_.groupBy("h").agg(F.min(F.struct(
        -F.col("s") / F.col("n"),
        F.xxhash64("doc"),
        F.col("doc").alias("o"),
        F.col("n").alias("on"),
        F.col("s").alias("os"),
    )).alias("l"))
    pairs = open_.join(lead.select("h", "l.o", "l.on", "l.os"), "h").filter((F.col("doc") != F.col("o")) & _may_link(percent))
    pairs = staged(pairs.select(*_ordered(F.col("doc"), F.col("o"))).distinct(), "pairs")
    links = staged(_linked(pairs, sets, percent), "links")
    joined = components(links)

    # then the documents of groups that still have several components: some likely pairs, and a join on their rarest elements
    live = _live(open_.select("doc").distinct(), joined, reps)
    parities = staged(_parities(sets.join(live, "doc", "left_semi")), "parities")
    for step in range(1, SWEEPS + 1):
        tried = staged(_possible(_sweep_pairs(live, reps, step).join(pairs, ["a", "b"], "left_anti"), parities, percent), "sweep-pairs")
        more = staged(_linked(tried, sets, percent), "sweep-links")
        if more.isEmpty():
            break
        pairs, links = pairs.unionByName(tried), links.unionByName(more)
        joined = components(links)
        live = _live(live.select("doc"), joined, reps)
    rest = _rare_pairs(sets.join(live, "doc"), live, percent).join(pairs, ["a", "b"], "left_anti")
    more = staged(_linked(staged(_possible(rest, parities, percent), "more-pairs"), sets, percent), "more-links")
    if not more.isEmpty():
        joined = components(links.unionByName(more))

    found = filled.select("doc", "digest").join(reps.select("digest", F.col("doc").alias("rep")), "digest")
    found = found.groupBy("doc").agg(F.min("rep").alias("rep"))
    component = found.join(joined, found["rep"] == joined["node"], "left").select("doc", F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("doc", "n_shingles").join(component, "doc", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc"))
    return out.select(F.col("doc").alias(id_col), "n_shingles", "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component (that with the smallest id), with the columns of ``docs``."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.filter("NOT kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
