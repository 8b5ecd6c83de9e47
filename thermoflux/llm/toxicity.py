"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

A text is read as a stream of bytes: letters lower-cased, ASCII signs left out, words parted by one space, the spaces
within runs of three and more one-character words left out. The kernel of a window of the stream and a landmark sums, over all
their common subsequences of ``ORDER`` bytes with at most ``GAP`` bytes between neighbours, ``DECAY`` to the power of the
lengths they span in both; so ``idixot``, ``idot``, ``id iot``, ``i-d-i-o-t`` and ``i d i o t`` stay close to ``idiot``.

Landmarks are words and word beginnings. A candidate is judged by the documents that hold at least one, two or three
different words with it: log ratio of its shares among toxic and clean ones. Landmarks are taken greedily, each toxic document
weighing half as much for every landmark that it already holds, so every language and every insult gets its own.

A document is its ``RANKS`` largest kernel values with each landmark, over different words, times the inverse root of
the landmarks' own kernel matrix; a hinge-loss model is linear in that. Copies of the telling words with a letter put in or left out or a
space put in join the training. Margins of left-out folds (landmarks chosen anew in each) calibrate the probability.

The fit uses at most ``MAX_LABELLED`` labelled documents and ``MAX_FIT_BYTES`` bytes of them (smallest hash of the id first, each class
half of both bounds at most). Scoring covers every byte of every text.

Cases: null and empty texts have no kernel values and get the model's base score; rows without a label teach nothing; repeated
rows count once in the fit; ties go to the longer, then the smaller candidate; with one class only every score is 0 or 1,
without labels 0.5; an empty table gives an empty table; other columns pass through (score and predicted are replaced).
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermoflux.llm.common import NOT_SPACE, U64, lowered, slices, words
from thermoflux.llm.linear import dual_coordinate_descent, platt, probability

ORDER = 3
#: Bytes that may stand between neighbours of a subsequence.
GAP = 2
DECAY = 0.5
#: A kernel value counts by its excess over each of these, as a share of what is left to 1.
LEVELS = (0.4, 0.65, 0.85)
LEAST = LEVELS[0]
#: Kernel value from which an altered copy joins the training.
TELLING = 0.5
#: Values kept for each landmark.
RANKS = 3
LANDMARKS = 48
LANDMARK_BYTES = 14
#: Bytes that a window is longer than its landmark.
SLACK = 4
#: Bounds on the labelled documents that the fit uses.
MAX_LABELLED = 4000
MAX_FIT_BYTES = 48 << 20
COST = 5.0
#: Bytes that one numpy pass handles (a longer document is a pass of its own).
PASS_BYTES = 1 << 19
#: Bytes by which the pieces of a very long text overlap.
OVERLAP = 1 << 12
THRESHOLD = 0.7
#: Margins beyond these count as these when probabilities are fitted.
MARGINS = (-1.5, 1.5)
#: Least log ratio of a landmark, and the most that two landmarks may be alike.
CLEAR = 2.0
ALIKE = 0.7
#: Share of the largest weight below which a landmark is left out.
USED = 0.05
#: Evidence (in nats) from which a landmark is taken in any case; below, only for so many toxic documents without one.
SURE, NEEDED = 10.0, 1.5
#: Zero bytes after each document of a stream; no window reaches across.
_PAD = LANDMARK_BYTES + SLACK + ORDER * (GAP + 1)
_BLOCK = LANDMARK_BYTES + SLACK


# ---------------------------------------------------------------------------------- stream

_SIGN = np.zeros(256, dtype=bool)
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def stream(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normalised bytes of a slice and the offsets of its documents, each of which starts and ends with a space."""
    keep = ~_SIGN[buf]
    low = lowered(buf[keep])
    offs = np.concatenate([[0], np.cumsum(keep)])[offs]
    capital = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
    low[capital] += 0x20  # capitals of the Latin-1 supplement
    s, e, count = words(low, offs, NOT_SPACE)
    n_docs = len(count)
    doc = np.repeat(np.arange(n_docs), count)
    chars = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
    single = (chars[e] - chars[s] == 1) if len(s) else np.zeros(0, bool)
    joined = np.zeros(len(s), dtype=bool)  # no space before this word
    if len(s) > 2:
        both = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
        pair = np.zeros(len(s) + 1, dtype=bool)  # pair[j]: words j - 1 and j are one-character neighbours
        pair[1:-1] = both
        joined = pair[:-1] & (np.concatenate([[False], pair[:-2]]) | pair[1:])
    # a space before each word that is not joined; a space and the padding after each document
    before = np.cumsum(~joined) + doc * (1 + _PAD)
    size = e - s
    mask = np.zeros(len(low), dtype=bool)
    mask[:] = NOT_SPACE[low]
    out = np.zeros(len(s) - int(joined.sum()) + int(size.sum()) + n_docs * (1 + _PAD), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])
    out[np.arange(int(size.sum())) + np.repeat(before, size)] = low[mask]
    first = at[:-1] + before
    out[first[~joined] - 1] = 0x20
    spaces = np.concatenate([[0], np.cumsum(~joined)])[np.concatenate([[0], np.cumsum(count)])]
    ends = at[np.concatenate([[0], np.cumsum(count)])] + spaces + np.arange(n_docs + 1) * (1 + _PAD)
    out[ends[1:] - 1 - _PAD] = 0x20
    return out, ends


# ---------------------------------------------------------------------------------- kernel


def triples(x: bytes) -> dict[tuple[int, int, int], float]:
    """Subsequences of a landmark and their decayed weights."""
    out: dict[tuple[int, int, int], float] = defaultdict(float)
    for i in range(len(x)):
        for j in range(i + 1, min(i + GAP + 2, len(x))):
            for k in range(j + 1, min(j + GAP + 2, len(x))):
                out[x[i], x[j], x[k]] += DECAY ** (k - i + 1)
    return out


class Landmarks:
    """Landmarks and the table of their subsequences."""

    def __init__(self, marks: list[bytes]):
        self.marks = marks
        every = [triples(m) for m in marks]
        self.own = np.array([max(1e-12, sum(w * w for w in t.values())) for t in every])
        self.width = np.array([len(m) + SLACK for m in marks], dtype=np.int64)
        alphabet = sorted({b for t in every for code in t for b in code})
        self.bits = max(1, int(len(alphabet)).bit_length())
        self.symbol = np.zeros(256, dtype=np.uint32)
        self.symbol[alphabet] = np.arange(1, len(alphabet) + 1)
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, t in enumerate(every):
            for (a, b, c), w in t.items():
                code = (int(self.symbol[a]) << 2 * self.bits) | (int(self.symbol[b]) << self.bits) | int(self.symbol[c])
                lists[code].append((i, w / self.own[i]))
        self.pair = np.zeros(1 << 2 * self.bits, dtype=bool)
        self.entry = np.zeros(1 << 3 * self.bits, dtype=np.int32)
        starts, mark, weight, full = [0, 0], [], [], []
        for n, code in enumerate(sorted(lists), 1):
            self.entry[code] = n
            self.pair[code >> self.bits] = True
            mark += [i for i, _ in lists[code]]
            weight += [w for _, w in lists[code]]
            full += [w * w * self.own[i] for i, w in lists[code]]
            starts.append(len(mark))
        self.starts, self.mark, self.weight, self.full = np.array(starts), np.array(mark, dtype=np.int64), np.array(weight), np.array(full)

    def matches(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry of the table, position, decayed weight) of the common subsequences, by landmark and position, where a window can reach LEAST."""
        n = len(text)
        sym = self.symbol[text]
        item, pos, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for g1 in range(1, GAP + 2):
            two = (sym[: max(0, n - g1)] << np.uint32(self.bits)) | sym[g1:]
            i = np.flatnonzero(self.pair[two])
            two = two[i] << np.uint32(self.bits)
            for g2 in range(1, GAP + 2):
                ok = int(np.searchsorted(i, n - g1 - g2))
                entry = self.entry[two[:ok] | sym[i[:ok] + g1 + g2]]
                hit = np.flatnonzero(entry)
                entry = entry[hit]
                size = self.starts[entry + 1] - self.starts[entry]
                at = np.repeat(self.starts[entry] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                item.append(at)
                pos.append(np.repeat(i[hit], size))
                value.append(self.weight[at] * DECAY ** (g1 + g2 + 1))
        item, pos, value = np.concatenate(item), np.concatenate(pos), np.concatenate(value)
        mark = self.mark[item]
        # a window lies in two neighbouring blocks: where no such pair holds enough, no window does
        blocks = n // _BLOCK + 3
        cell = mark * blocks + pos // _BLOCK + 1
        held = np.bincount(cell, weights=value, minlength=blocks * len(self.marks) + 1)
        pair = held[:-1] + held[1:] >= LEAST
        own = pair[cell]
        own |= pair[cell - 1]
        item, pos, value = item[own], pos[own], value[own]
        order = np.argsort(mark[own] * n + pos, kind="stable")
        return item[order], pos[order], value[order]

    def features(self, text: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Documents x ranks x landmarks: the largest kernel values over different words, 1 at most; below LEAST 0."""
        return self.ranked(len(offs) - 1, *self.hits(text, offs))

    def ranked(self, docs: int, doc: np.ndarray, mark: np.ndarray, name: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The ``RANKS`` largest values of each document and landmark over different names."""
        out = np.zeros((docs, RANKS, len(self.marks)), dtype=np.float32)
        order = np.lexsort((-value, name, mark, doc))
        new = np.ones(len(doc), dtype=bool)
        new[1:] = np.any([np.diff(x[order]) != 0 for x in (doc, mark, name)], axis=0)
        best = order[new]
        doc, mark, value = doc[best], mark[best], value[best]
        order = np.lexsort((-value, mark, doc))
        doc, mark, value = doc[order], mark[order], value[order]
        group = np.ones(len(doc), dtype=bool)
        group[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
        rank = np.arange(len(doc)) - np.flatnonzero(group)[np.cumsum(group) - 1] if len(doc) else np.zeros(0, int)
        own = rank < RANKS
        out[doc[own], rank[own], mark[own]] = value[own]
        return out

    def hits(self, text: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, landmark, word, value) of the best window of each word, where it reaches LEAST."""
        out = tuple(np.zeros(0, t) for t in (np.int64, np.int64, U64, float))
        if not self.marks or not len(text):
            return out
        item, pos, part = self.matches(text)
        mark = self.mark[item]
        key = mark * (len(text) + _PAD) + pos
        total = np.concatenate([[0.0], np.cumsum(part)])
        where = np.concatenate([[0.0], np.cumsum(part * pos)])
        upto = np.searchsorted(key, key + self.width[mark])
        value, where = total[upto] - total[:-1], where[upto] - where[:-1]
        own = np.flatnonzero(value >= LEAST)
        if not len(own):
            return out
        middle = (where[own] / value[own]).astype(np.int64) + 1
        mark, pos, value, upto = mark[own], pos[own], value[own], upto[own]
        doc = np.searchsorted(offs, pos, side="right") - 1
        # one value for each word (the one around which the matches of the window lie)
        space = np.flatnonzero(text == 0x20)
        word = np.searchsorted(space, middle, side="right")
        first = np.where(word > 0, space[np.maximum(word - 1, 0)] + 1, 0)
        grid = text[np.minimum(first[:, None] + np.arange(24), len(text) - 1)].astype(np.uint64)
        grid[np.maximum.accumulate(grid == 0x20, axis=1)] = 0
        mult = np.multiply.accumulate(np.full(24, 0x9E3779B97F4A7C15, dtype=np.uint64))
        name = (grid * mult).sum(axis=1)
        order = np.lexsort((-value, name, mark, doc))
        new = np.ones(len(doc), dtype=bool)
        new[1:] = np.any([np.diff(x[order]) != 0 for x in (doc, mark, name)], axis=0)
        best = order[new]
        doc, mark = doc[best], mark[best]
        # in these windows a subsequence counts no more often than in the landmark
        size = upto[best] - own[best]
        which = np.repeat(np.arange(len(best)), size)
        at = np.repeat(own[best] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        kind, back = np.unique(which * len(self.mark) + item[at], return_inverse=True)
        held = np.minimum(np.bincount(back, weights=part[at]), self.full[kind % len(self.mark)])
        value = np.bincount(kind // len(self.mark), weights=held, minlength=len(best))
        keep = value >= LEAST
        return doc[keep], mark[keep], name[best][keep], value[keep]


def excess(values: np.ndarray) -> np.ndarray:
    """Documents x (levels and ranks) x landmarks."""
    return np.concatenate([np.maximum(values - t, 0) / (1 - t) for t in LEVELS], axis=1)


def kernel(units: list[bytes], marks: list[bytes]) -> np.ndarray:
    """Largest kernel value of each text of ``units`` with each landmark, relative to the landmark's own."""
    text, offs = stream(*_joined(units))
    return Landmarks(marks).features(text, offs)[:, 0]


def _features(table: Landmarks, texts: list[bytes]) -> np.ndarray:
    return np.concatenate([table.features(*stream(buf, offs)) for _, _, buf, offs in slices(pa.array(texts, pa.binary()), PASS_BYTES)])


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


# ---------------------------------------------------------------------------------- landmarks


def _beginnings(word: bytes) -> Iterator[bytes]:
    """The word and its beginnings of three characters and more, led by a space; the whole word also ends in one."""
    if len(word) + 2 <= LANDMARK_BYTES and len(word) > 2:
        yield b" " + word + b" "
    ends = [i for i in range(1, len(word) + 1) if i == len(word) or word[i] & 0xC0 != 0x80]
    for i in ends[2:]:
        if i + 1 > LANDMARK_BYTES:
            return
        yield b" " + word[:i]


@dataclass
class Candidates:
    """Beginnings of words that toxic documents share, and how many different words of each document have them (up to 3)."""

    names: list[bytes]
    doc: np.ndarray
    name: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, words_by_doc: list[list[bytes]], y: np.ndarray) -> Candidates:
        of_word: dict[bytes, list[bytes]] = {}
        shared: Counter = Counter()
        for own, label in zip(words_by_doc, y, strict=True):
            if label:
                for w in own:
                    if w not in of_word:
                        of_word[w] = list(_beginnings(w))
                shared.update({p for w in own for p in of_word[w]})
        least = max(2, int(y.sum()) // 200)
        names = sorted(p for p, n in shared.items() if n >= least)
        place = {p: i for i, p in enumerate(names)}
        ids: dict[bytes, list[int]] = {}
        doc, name, count = [], [], []
        for d, own in enumerate(words_by_doc):
            found: Counter = Counter()
            for w in own:
                if w not in ids:
                    ids[w] = [place[p] for p in _beginnings(w) if p in place]
                found.update(ids[w])
            doc.append(np.full(len(found), d))
            name.append(np.fromiter(found.keys(), np.int64, len(found)))
            count.append(np.minimum(np.fromiter(found.values(), np.int64, len(found)), 3))
        none = [np.zeros(0, np.int64)]
        return cls(names, np.concatenate(none + doc), np.concatenate(none + name), np.concatenate(none + count))


def choose_landmarks(candidates: Candidates, y: np.ndarray, own: np.ndarray, limit: int = LANDMARKS) -> list[tuple[bytes, int]]:
    """Landmarks for the documents ``own``, and how many different words with it make a document telling."""
    here = np.zeros(len(y), dtype=bool)
    here[own] = True
    place = np.cumsum(here & (y > 0)) - 1
    n_toxic, n_clean = int((here & (y > 0)).sum()), int((here & (y == 0)).sum())
    share, least = n_toxic / (n_toxic + n_clean), max(2, n_toxic // 200)
    found: dict[tuple[bytes, int], tuple[float, np.ndarray]] = {}
    for k in (1, 2, 3):
        at = (candidates.count >= k) & here[candidates.doc]
        toxic = at & (y[candidates.doc] > 0)
        n = np.bincount(candidates.name[toxic], minlength=len(candidates.names)).astype(float)
        c = np.bincount(candidates.name[at], minlength=len(candidates.names)) - n
        good = (n >= least) & (np.log((n + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1)) >= CLEAR)
        with np.errstate(all="ignore"):
            evidence = n * np.log(n / ((n + c) * share)) + np.where(c > 0, c * np.log(c / ((n + c) * (1 - share))), 0.0)
        order = np.argsort(candidates.name[toxic], kind="stable")
        name, docs = candidates.name[toxic][order], place[candidates.doc[toxic][order]]
        for i in np.flatnonzero(good):
            lo, hi = np.searchsorted(name, [i, i + 1])
            found[candidates.names[i], k] = float(evidence[i]), docs[lo:hi]
    left = np.ones(n_toxic)

    def worth(p: bytes, k: int) -> float:
        evidence, docs = found[p, k]
        return evidence * float(left[docs].mean())

    heap = [(-worth(p, k), -len(p), p, k) for p, k in found]
    heapq.heapify(heap)
    taken: list[tuple[bytes, int]] = []
    table = Landmarks([])
    while heap and len(taken) < limit:
        was, size, p, k = heapq.heappop(heap)
        now = worth(p, k)
        if heap and -now > heap[0][0] + 1e-12:
            heapq.heappush(heap, (-now, size, p, k))
            continue
        evidence, docs = found[p, k]
        if evidence < SURE and float(left[docs].sum()) < NEEDED:
            continue
        if taken and max(table.features(*stream(*_joined([p])))[:, 0].max(), kernel([m for m, _ in taken], [p]).max()) >= ALIKE:
            continue
        taken.append((p, k))
        table = Landmarks([m for m, _ in taken])
        left[docs] /= 2
    return taken


def altered(word: bytes, rng: np.random.Generator) -> list[bytes]:
    """Copies of a word with a letter put in, left out (long words), or a space put in, at every inner place."""
    out = []
    for i in range(1, len(word)):
        if word[i] & 0xC0 == 0x80:
            continue
        for _ in range(2):
            out.append(word[:i] + bytes([int(rng.integers(97, 123))]) + word[i:])
        out.append(word[:i] + b" " + word[i:])
        if len(word) > 4 and i < len(word) - 1 and word[i] < 0x80:
            out.append(word[:i] + word[i + 1 :])
    return out


# ---------------------------------------------------------------------------------- model


@dataclass
class ToxicityModel:
    landmarks: list[bytes] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((RANKS * len(LEVELS), 0)))  # on the kernel values, the inverse root included
    bias: float = 0.0
    calibration: tuple[float, float] = (0.0, 0.0)
    constant: float | None = 0.5

    def margins(self, text: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Of the documents of a stream."""
        if not hasattr(self, "_table"):
            self._table = Landmarks(self.landmarks)
        return np.einsum("drl,rl->d", excess(self._table.features(text, offs)), self.weights) + self.bias

    def of(self, texts: list[bytes] | pa.Array) -> np.ndarray:
        """Margins of texts."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        out = [np.zeros(0)]
        for _, _, buf, offs in slices(texts, PASS_BYTES):
            out.append(self.margins(*stream(buf, offs)) if len(buf) <= 4 * PASS_BYTES else self._long_margin(buf))
        return np.concatenate(out)

    def _long_margin(self, buf: np.ndarray) -> np.ndarray:
        """The margin of one very long text, read in overlapping pieces that start at a space where there is one."""
        table, found, lo = Landmarks(self.landmarks), [], 0
        while lo < len(buf):
            piece = buf[lo : lo + PASS_BYTES + OVERLAP]
            _, mark, name, value = table.hits(*stream(piece, np.array([0, len(piece)])))
            found.append((np.zeros(len(mark), np.int64), mark, name, value))
            space = np.flatnonzero(~NOT_SPACE[buf[lo + PASS_BYTES - OVERLAP : lo + PASS_BYTES]])
            lo += PASS_BYTES - OVERLAP + (int(space[-1]) if len(space) else 0)
        values = table.ranked(1, *map(np.concatenate, zip(*found, strict=True)))
        return np.einsum("drl,rl->d", excess(values), self.weights) + self.bias

    def probability(self, texts: list[bytes] | pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return probability(np.clip(self.of(texts), *MARGINS), self.calibration)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_table"}


def _fit_margins(texts: list[bytes], y: np.ndarray, own: np.ndarray, candidates: Candidates, seed: int) -> ToxicityModel:
    """Landmarks and hinge-loss weights from the documents ``own``; no calibration."""
    rng = np.random.default_rng(seed)
    chosen = choose_landmarks(candidates, y, own)
    texts, y = [texts[i] for i in own], y[own]
    if not chosen:
        return ToxicityModel([], np.zeros((RANKS * len(LEVELS), 0)), -1.0, (1.0, 0.0), None)
    marks = [m for m, _ in chosen]
    table = Landmarks(marks)
    extra = [v for m, k in chosen if k == 1 and m.endswith(b" ") for v in altered(m.strip(), rng)]
    # a copy that keeps too little of its word teaches nothing
    extra = [v for v, keep in zip(extra, kernel(extra, marks).max(axis=1) >= TELLING, strict=True) if keep] if extra else []
    gram = table.features(*stream(*_joined(marks)))[:, 0].astype(float)
    vals, vecs = np.linalg.eigh((gram + gram.T) / 2)
    root = vecs @ np.diag(1 / np.sqrt(np.maximum(vals, 1e-1))) @ vecs.T
    feats = np.concatenate([_features(table, t) for t in (texts, extra) if t]).astype(float)
    x = (excess(feats) @ root).reshape(len(feats), -1)
    label = np.concatenate([y, np.ones(len(extra))])
    n_toxic = int(y.sum())
    weight = np.concatenate([np.ones(len(y)), np.full(len(extra), 0.5 * n_toxic / max(1, len(extra)))])
    every = np.arange(x.shape[1])
    w, bias = dual_coordinate_descent([(every, r) for r in x], label, x.shape[1], cost=COST, epochs=40, weight=weight, positive=True, balance=False)
    weights = np.einsum("rl,lm->rm", w.reshape(RANKS * len(LEVELS), -1), root)
    # landmarks that tell nothing beside the others are not looked for
    heavy = np.abs(weights).max(axis=0)
    used = np.flatnonzero(heavy >= USED * max(heavy.max(), 1e-12))
    return ToxicityModel([marks[i] for i in used], weights[:, used], bias, (1.0, 0.0), None)


def fit_texts(texts: list[bytes], y: np.ndarray, seed: int = 11, folds: int = 3) -> ToxicityModel:
    """``texts``: labelled documents as normalised streams; ``y``: 1 for toxic."""
    alike = dict.fromkeys(zip(texts, y.tolist(), strict=True))  # copies count once
    texts, y = [t for t, _ in alike], np.array([label for _, label in alike], dtype=int)
    if len(set(y.tolist())) < 2:
        return ToxicityModel(constant=float(y[0] > 0) if len(y) else 0.5)
    fold = np.empty(len(y), dtype=int)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        fold[own] = np.random.default_rng(seed).permutation(len(own)) % folds
    candidates = Candidates.of([sorted(set(t.split())) for t in texts], y)
    margin = np.zeros(len(y))
    for k in range(folds):
        own, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(rest) and len(set(y[own].tolist())) == 2:
            part = _fit_margins(texts, y, own, candidates, seed)
            margin[rest] = part.of([texts[i] for i in rest])
    model = _fit_margins(texts, y, np.arange(len(y)), candidates, seed)
    model.calibration = platt(np.clip(margin, *MARGINS), y.astype(float))
    return model


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, limit: int, max_bytes: int) -> DataFrame:
    """(id, text, y) of at most ``limit`` labelled documents and ``max_bytes`` bytes of text, each class half of both at most."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("_id"), (F.col(label).cast("int") > 0).cast("int").alias("y"))
    chosen = None
    for k in (0, 1):
        part = known.filter(F.col("y") == k).orderBy(F.xxhash64("_id"), "_id").limit(limit // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    # at most ``limit`` labels meet here (more rows only if ids repeat)
    upto = Window.partitionBy("y").orderBy("h", "_id", "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    sized = rows.select(
        F.xxhash64("_id").alias("h"),
        "_id",
        "y",
        F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"),
        F.xxhash64("text").alias("digest"),
    )
    fit_in = sized.distinct().withColumn("sum", F.sum("size").over(upto)).filter(F.col("sum") <= max_bytes // 2)
    return rows.withColumn("digest", F.xxhash64("text")).join(
        F.broadcast(fit_in.select("_id", "y", "digest")),
        ["_id", "y", "digest"],
    ).select(F.xxhash64("_id").alias("id"), "text", "y")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = MAX_LABELLED,
    max_bytes: int = MAX_FIT_BYTES,
) -> ToxicityModel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for _, _, buf, offs in slices(b.column(1)):
                text, at = stream(buf, offs)
                rows += [text[i : j - _PAD].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), b.column(2)], ["id", "text", "y"])

    sample = labelled_texts(docs, labels, label, id_col, text_col, limit, max_bytes)
    got = sample.mapInArrow(run, "id long, text binary, y int").toArrow().sort_by([("id", "ascending"), ("text", "ascending"), ("y", "ascending")])
    return fit_texts(got["text"].to_pylist(), got["y"].to_numpy(zero_copy_only=False).astype(int))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted (1 from ``threshold`` on)."""
    docs = docs.drop(*[c for c in ("score", "predicted") if c != text_col])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            p = m.probability(b.column(at))
            columns = [*b.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, score double, predicted int")
