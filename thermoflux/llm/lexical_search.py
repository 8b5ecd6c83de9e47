"""Ranked lexical search: MaxScore with pair bounds over an inverted index of document segments.

* ``build_index``: documents in segments of some 2 MB of text; a segment is one row with its terms, postings (document, count) and sizes.
* ``impact_lists``: for the terms of a block of items, each segment's postings with their integer impacts and every term's largest
  impact; and, precomputed for pairs of terms, the intersection of their lists with the joint impacts and the largest of them. A term is in
  one pair at most, so all intersections are at most half as long as the postings. Pairs are neighbours by rarity that most items share.
* ``search``: a document that holds both terms of a pair scores at most the pair's largest joint impact on them, any other at most the larger
  of the two maxima. Sums of these bounds are tighter than sums of independent maxima: a segment whose bound is below the tenth best score
  so far is skipped for that item; in others the units with the smallest bounds are non-essential (MaxScore): only documents of the essential
  lists are candidates, and they are completed unit by unit while they can still reach the threshold. Nothing that ties with it is skipped.

Scores are integers: a term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))); its impact is w ((10^9 tf) div (1000 tf + 8 m)) with
m = 10 + (90 n N) div L for a document of n terms, N documents with terms and L terms in all.

Scale: the index is built in one pass without a shuffle and can be kept and searched again; statistics are sums over it. A task keeps k results an item, which is
all that is shuffled. Items go in blocks of at most ``ITEMS`` rows and some ``ITEM_BYTES`` of text, so what is broadcast is bounded; a block reads the index once.
Terms are found by 64-bit hashes within a segment and compared byte by byte with the item's.

Cases: null and empty texts have no terms and are in no result; a null id comes before any other of the same score; repeated rows
are documents (and items) of their own; an item without a term that any document holds has no rows; ids of any type that sorts; other columns, whatever
their names, are not read; empty tables give no rows; a text of many MB is a segment of its own, read in blocks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoflux.llm.common import ALNUM, BLOCK_BYTES, U64, lowered, slices, staged, word_hashes, words

#: Rows and bytes of text of a block of items.
ITEMS, ITEM_BYTES = 1000, 16 << 20
#: Fixed values of the score.
WEIGHT, SCALE, TF, LENGTH, BASE, SLOPE = 1000, 10**9, 1000, 8, 10, 90

#: Bytes of a row group of stored segments, before compression (one row at least). A row has some MB, and Parquet would look at sizes after a hundred
#: rows first, while a task that reads a row group holds all of it several times. Pages as large: bytes of ended pages would count as compressed.
ROW_GROUP = 8 << 20
_WRITER = {"parquet.enable.dictionary": "false", **{f"parquet.{x}.size": str(ROW_GROUP) for x in ("block", "page")}, **{f"parquet.{x}.size.row.check.{y}": "1" for x in ("block", "page") for y in ("min", "max")}}

_INDEX = "n_docs long, n_terms long, sizes binary, hashes binary, words binary, word_ends binary, starts binary, docs binary, counts binary"
_LISTS = "terms binary, starts binary, docs binary, impacts binary, pairs binary, pair_starts binary, pair_docs binary, pair_impacts binary"


def _gather(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The bytes of the runs [s, e), one after the other."""
    size = e - s
    return buf[np.repeat(s - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


def _starts(flags: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(flags), len(flags))


def _changes(x: np.ndarray) -> np.ndarray:
    return np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)


# ---------------------------------------------------------------------------------- index


def _segment(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, dict] | None:
    """(documents with terms, their postings by term) of one slice of lower-cased texts."""
    s, e, n = words(low, offs, ALNUM)
    if not len(s):
        return None
    there = np.flatnonzero(n)
    doc = np.repeat(np.arange(len(there), dtype=np.int32), n[there])
    h = word_hashes(low, s, e)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    term = _changes(h)
    posting = _starts(term | _changes(doc))
    first = order[np.flatnonzero(term)]
    text = _gather(low, s[first], e[first])
    return there, {
        "sizes": n[there].astype(np.int64), "hashes": h[term], "words": text, "word_ends": np.cumsum(e[first] - s[first]), "starts": _starts(term[posting[:-1]]),
        "docs": doc[posting[:-1]], "counts": np.diff(posting),
    }


def _long_segment(low: np.ndarray) -> tuple[np.ndarray, dict] | None:
    """The same of one very long text, whose words are counted block by block."""
    found, texts, total, at = [], {}, 0, 0
    while at < len(low):
        end = min(len(low), at + BLOCK_BYTES)
        while end < len(low) and ALNUM[low[end - 1]]:  # up to the end of a word
            step = ~ALNUM[low[end : end + BLOCK_BYTES]]
            end += int(step.argmax()) + 1 if step.any() else len(step)
        part = _segment(low[at:end], np.array([0, end - at]))
        if part is not None:
            p = part[1]
            ends = p["word_ends"]
            for h, a, b in zip(p["hashes"].tolist(), np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                if h not in texts:
                    texts[h] = p["words"][a:b].tobytes()
            found.append((p["hashes"], p["counts"]))
            total += int(p["sizes"][0])
        at = end
    if not found:
        return None
    h, where = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
    counts = np.zeros(len(h), np.int64)
    np.add.at(counts, where, np.concatenate([x[1] for x in found]))
    own = [texts[x] for x in h.tolist()]
    return np.zeros(1, np.int64), {
        "sizes": np.array([total]), "hashes": h, "words": np.frombuffer(b"".join(own), np.uint8), "word_ends": np.cumsum([len(x) for x in own]), "starts": np.arange(len(h) + 1),
        "docs": np.zeros(len(h), np.int32), "counts": counts,
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: one row a segment (ids array and the columns of ``_INDEX``)."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = T.StructType([T.StructField("ids", T.ArrayType(d.schema["id"].dataType)), *T.StructType.fromDDL(_INDEX).fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        types = {"sizes": np.int64, "hashes": U64, "words": np.uint8, "word_ends": np.int64, "starts": np.int64, "docs": np.int32, "counts": np.int64}
        for b in batches:
            for lo, hi, buf, offs in slices(b.column(1)):
                low = lowered(buf)
                part = _long_segment(low) if hi - lo == 1 and len(buf) > 2 * BLOCK_BYTES else _segment(low, offs)
                if part is None:
                    continue
                there, p = part
                ids = b.column(0).take(pa.array(lo + there)).to_pylist()
                row = [[ids], [len(there)], [int(p["sizes"].sum())], *[[p[c].astype(t).tobytes()] for c, t in types.items()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, schema.field(i).type) for i, x in enumerate(row)], schema=schema)

    return staged(d.mapInArrow(work, kind), "search-index", **_WRITER)


# ---------------------------------------------------------------------------------- items and statistics


class Block:
    """A block of items: vocabulary, pairs of terms, and each item's units (pairs and single terms). Broadcast, so bounded by the block."""

    def __init__(self, texts: list[str | None]):
        found = [list(dict.fromkeys(self._terms(t))) for t in texts]
        vocabulary = sorted({t for f in found for t in f})
        ends = np.cumsum([len(t) for t in vocabulary]).astype(np.int64)
        h = word_hashes(np.frombuffer(b"".join(vocabulary), np.uint8), np.r_[0, ends[:-1]].astype(np.int64), ends) if vocabulary else np.zeros(0, U64)
        order = np.argsort(h)
        self.hashes, self.vocabulary = h[order], [vocabulary[i] for i in order]
        number = {t: i for i, t in enumerate(self.vocabulary)}
        self.terms = [[number[t] for t in f] for f in found]
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    @staticmethod
    def _terms(text: str | None) -> list[bytes]:
        low = lowered(np.frombuffer((text or "").encode(), np.uint8))
        s, e, _ = words(low, np.array([0, len(low)]), ALNUM)
        return [low[a:b].tobytes() for a, b in zip(s, e, strict=True)]

    def weigh(self, n: int, total: int, df: dict[int, int]) -> None:
        """Set the weights, and with them the pairs: neighbours by weight, those that most items share first; a term is in one pair at most."""
        self.n, self.total = n, total
        for t, d in df.items():
            self.weights[t] = math.floor(WEIGHT * math.log((2 * n + 2) / (2 * d + 1)))
        shared: Counter = Counter()
        for f in self.terms:
            f.sort(key=lambda t: (self.weights[t], t))
            live = [t for t in f if t in df]
            shared.update(zip(live, live[1:], strict=False))
        partner: dict[int, int] = {}
        for (a, b), _ in sorted(shared.items(), key=lambda x: (-x[1], x[0])):
            if a not in partner and b not in partner:
                partner[a], partner[b] = b, a
        self.pairs = np.array(sorted((a, b) for a, b in partner.items() if a < b), np.int64).reshape(-1, 2)
        at = {(a, b): i for i, (a, b) in enumerate(self.pairs.tolist())}
        self.units = []  # of each item: numbers of pairs whose terms it has both, then single terms, counted on from the pairs
        for f in self.terms:
            own = set(f)
            both = {at[t, partner[t]] for t in f if partner.get(t, -1) in own and t < partner[t]}
            single = [len(at) + t for t in f if partner.get(t, -1) not in own]
            self.units.append(np.array([*sorted(both), *single], np.int64))
        self.unit_starts = np.r_[0, np.cumsum([len(u) for u in self.units])].astype(np.int64)
        self.all_units = np.concatenate(self.units) if self.units else np.zeros(0, np.int64)


def _array(value, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _known(row: dict, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(terms of the block that the segment has, their numbers there); hashes first, then every byte."""
    h, text, ends = _array(row["hashes"], U64), row["words"].as_buffer(), _array(row["word_ends"], np.int64)
    at = np.minimum(np.searchsorted(h, block.hashes), len(h) - 1)
    terms = np.flatnonzero(h[at] == block.hashes)
    view = memoryview(text).cast("B")
    same = [view[ends[k - 1] if k else 0 : ends[k]] == block.vocabulary[t] for t, k in zip(terms, at[terms], strict=True)]
    terms = terms[np.array(same, bool)]
    return terms, at[terms]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {n: c[i] for n, c in zip(b.schema.names, b.columns, strict=True)}


def document_frequencies(index: DataFrame, block) -> DataFrame:
    """(term int, df long) of the block's terms; ``block`` is a broadcast."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(block.value.vocabulary), np.int64)
        for row in _rows(batches):
            terms, at = _known(row, block.value)
            df[terms] += np.diff(_array(row["starts"], np.int64))[at]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["term", "df"])

    part = index.select("hashes", "words", "word_ends", "starts").mapInArrow(work, "term int, df long")
    return part.groupBy("term").agg(F.sum("df").alias("df"))


# ---------------------------------------------------------------------------------- impact and pair lists


def impacts(weights: np.ndarray, counts: np.ndarray, sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    if len(sizes) and SLOPE * int(sizes.max()) * n >= 1 << 63:
        length = np.array([BASE + SLOPE * int(x) * n // total for x in sizes], np.int64)
    else:
        length = BASE + SLOPE * sizes * n // total
    return weights * (SCALE * counts // (TF * counts + LENGTH * length))


def impact_lists(index: DataFrame, block) -> DataFrame:
    """The stored lists: one row a segment that holds a term of the block (ids and the columns of ``_LISTS``)."""
    kind = T.StructType([index.schema["ids"], *T.StructType.fromDDL(_LISTS).fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, b = to_arrow_schema(kind), block.value
        for row in _rows(batches):
            terms, at = _known(row, b)
            if not len(terms):
                continue
            starts, docs, counts, sizes = _array(row["starts"], np.int64), _array(row["docs"], np.int32), _array(row["counts"], np.int64), _array(row["sizes"], np.int64)
            size = starts[at + 1] - starts[at]
            own = np.repeat(starts[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            docs = docs[own]
            value = impacts(np.repeat(b.weights[terms], size), counts[own], sizes[docs], b.n, b.total)
            begin = np.r_[0, np.cumsum(size)]
            place = np.full(len(b.weights), -1, np.int64)
            place[terms] = np.arange(len(terms))
            pairs = np.flatnonzero((place[b.pairs] >= 0).all(axis=1))
            lists = []
            for p in pairs:
                x, y = place[b.pairs[p]]
                x, y = slice(begin[x], begin[x + 1]), slice(begin[y], begin[y + 1])
                _, i, j = np.intersect1d(docs[x], docs[y], assume_unique=True, return_indices=True)
                lists.append((docs[x][i], value[x][i] + value[y][j]))
            pair_starts = np.r_[0, np.cumsum([len(x[0]) for x in lists])].astype(np.int64)
            blobs = [terms.astype(np.int64), begin.astype(np.int64), docs, value, pairs.astype(np.int64), pair_starts, np.concatenate([np.zeros(0, np.int32), *[x[0] for x in lists]]), np.concatenate([np.zeros(0, np.int64), *[x[1] for x in lists]])]
            yield pa.RecordBatch.from_arrays([pa.array([row["ids"].as_py()], schema.field(0).type), *[pa.array([x.tobytes()], schema.field(i + 1).type) for i, x in enumerate(blobs)]], schema=schema)

    return staged(index.mapInArrow(work, kind), "impact-lists", **_WRITER)


# ---------------------------------------------------------------------------------- search


class Segment:
    """The lists of one segment with the bounds of the block's units."""

    def __init__(self, row: dict, block: Block):
        self.block, self.ids = block, row["ids"]
        self.docs, self.impacts = _array(row["docs"], np.int32), _array(row["impacts"], np.int64)
        terms, self.starts = _array(row["terms"], np.int64), _array(row["starts"], np.int64)
        self.place = np.full(len(block.weights), -1, np.int64)
        self.place[terms] = np.arange(len(terms))
        pairs, starts = _array(row["pairs"], np.int64), _array(row["pair_starts"], np.int64)
        joint = _array(row["pair_impacts"], np.int64)
        #: Largest impact of each term, and bound of each unit: pairs first, then the terms.
        self.most = np.zeros(len(block.weights), np.int64)
        self.most[terms] = np.maximum.reduceat(self.impacts, self.starts[:-1])
        both = self.most[block.pairs].max(axis=1) if len(block.pairs) else np.zeros(0, np.int64)
        some = np.flatnonzero(np.diff(starts))
        if len(some):
            both[pairs[some]] = np.maximum(both[pairs[some]], np.maximum.reduceat(joint, starts[:-1][some]))
        self.bounds = np.concatenate([both, self.most])

    def totals(self) -> np.ndarray:
        """Upper bound of every item's scores in the segment."""
        c = np.r_[0, np.cumsum(self.bounds[self.block.all_units])]
        return c[self.block.unit_starts[1:]] - c[self.block.unit_starts[:-1]]

    def _lists(self, unit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        pairs = len(self.block.pairs)
        for t in self.block.pairs[unit] if unit < pairs else (unit - pairs,):
            k = self.place[t]
            if k >= 0:
                yield self.docs[self.starts[k] : self.starts[k + 1]], self.impacts[self.starts[k] : self.starts[k + 1]]

    def candidates(self, item: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all documents that score ``least`` or more for an item."""
        units = self.block.units[item]
        units = units[np.argsort(self.bounds[units], kind="stable")]
        upto = np.cumsum(self.bounds[units])  # bound of the units up to each
        essential = int(np.searchsorted(upto, least))
        score = np.zeros(len(self.ids), np.int64)
        for u in units[essential:]:
            for docs, value in self._lists(u):
                score[docs] += value
        rest = int(upto[essential - 1]) if essential else 0
        cand = np.flatnonzero((score > 0) & (score + rest >= least))
        score = score[cand]
        for k in range(essential - 1, -1, -1):
            if not len(cand):
                break
            for docs, value in self._lists(units[k]):
                at = np.minimum(np.searchsorted(docs, cand), len(docs) - 1)
                score += np.where(docs[at] == cand, value[at], 0)
            rest = int(upto[k - 1]) if k else 0
            stay = score + rest >= least
            cand, score = cand[stay], score[stay]
        return cand, score


def _best(lists: DataFrame, block, numbers: list[int], k: int) -> DataFrame:
    """(item long, doc, score long): each task's k best documents of every item."""
    kind = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc", lists.schema["ids"].dataType.elementType), T.StructField("score", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        best: list[list] = [[] for _ in numbers]
        least = np.ones(len(numbers), np.int64)  # what a document must score to be among the best so far
        for row in _rows(batches):
            segment = Segment(row, block.value)
            for i in np.flatnonzero(segment.totals() >= least):
                cand, score = segment.candidates(int(i), int(least[i]))
                if len(cand):
                    ids = [segment.ids[int(c)].as_py() for c in cand]
                    best[i] = sorted([*best[i], *[(-s, d is not None, d) for s, d in zip(score.tolist(), ids, strict=True)]], key=lambda x: x[:2] + ((x[2],) if x[1] else ()))[:k]
                    if len(best[i]) == k:
                        least[i] = -best[i][-1][0]
        rows = [(numbers[i], d, -s) for i, own in enumerate(best) for s, _, d in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(j).type) for j, c in enumerate(zip(*rows, strict=True))], schema=schema)

    return lists.mapInArrow(work, kind)


def search(index: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item id, rank int, doc, score long): the k best documents of every item, equal scores by ascending id."""
    spark = index.sparkSession
    q = staged(items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("item")), "items")
    n, size = q.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-n // ITEMS), -(-(size or 0) // ITEM_BYTES))
    docs, terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    found = []
    for b in range(blocks):
        rows = q.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()  # bounded by the block
        block = Block([r["text"] for r in rows])
        if docs and block.vocabulary:
            counted = document_frequencies(index, spark.sparkContext.broadcast(block)).collect()
            block.weigh(docs, terms, {r["term"]: r["df"] for r in counted})
            held = spark.sparkContext.broadcast(block)
            found.append(_best(impact_lists(index, held), held, [r["item"] for r in rows], k))
    if not found:
        return q.limit(0).select("item_id", F.lit(1).alias("rank"), F.lit(None).cast(index.schema["ids"].dataType.elementType).alias("doc"), F.lit(0).cast("long").alias("score"))
    all_ = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc")))
    out = all_.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.join(q.select("item", "item_id"), "item").select("item_id", "rank", "doc", "score")
