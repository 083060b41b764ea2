"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Distances are counted in words (ASCII letters folded, signs and white space between words ignored). A random walk
after Chakraborty, Goldenberg and Koucky maps a word sequence to one whose Hamming distance is close to the edit
distance; the walk is taken over item-sized windows of the document and over the items. Windows that agree with an
item at all of a few sampled positions in one of several repetitions are verified first, by exact edit distance.

Agreement under edits falls with their number and kind (a deletion shifts all that follows), so no fixed number of
repetitions has a recall that holds for every item: windows that don't agree are verified too, unless an exact copy
of their item was found. Nothing within the edit limit is lost.

Walks over every window of every text would cost a few hundred steps for each word of the corpus, so
windows are first thinned out without loss: within k edits, a window shares at least n - q + 1 - kq of its
n - q + 1 runs of q words with the item, so only windows that hold as many run hits near each other are left.

The items are the query set: they are read to the driver in blocks of at most ``BLOCK_BYTES`` of text and each
block is sent to the executors with that bound; the documents are scanned once for each block, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import LOWER, Words, chunks, inside_document, mix, rolling
from .shared import frugal, materialize, python_batches, text_or_empty, without_ids

#: Bytes between words: all ASCII signs, white space and controls.
SIGNS = np.ones(256, bool)
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
BLOCK_BYTES = 8 << 20
_U = np.uint64
SCHEMA = "doc_id bigint, item_id bigint, start int, length int, distance int"


def allowed(n: int, rate: float) -> int:
    """Edits within which a passage counts as a copy of an item of n words."""
    return int(rate * n + 1e-9)


def run_length(n: int, k: int) -> tuple[int, int]:
    """(q, hits): the longest run length up to 3 for which within k edits some runs must survive, and how many."""
    for q in (3, 2, 1):
        if n - q + 1 - k * q >= 1 and n >= q:
            return q, n - q + 1 - k * q
    return 1, 1


def walk(h: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """The embedding of each row of word hashes (0 pads): at each step the word under the walker, who then moves or stays by a random bit of (step, word)."""
    rows, width = h.shape
    padded = np.concatenate([h, np.zeros((rows, 1), np.uint64)], 1)
    at, who = np.zeros(rows, np.int64), np.arange(rows)
    out = np.empty((rows, steps), np.uint64)
    for j in range(steps):
        out[:, j] = padded[who, at]
        move = mix(out[:, j] ^ _U((seed * 0x9E3779B97F4A7C15 + j * 0xD1B54A32D192ED03) & (2**64 - 1))) & _U(1)
        at = np.minimum(at + move.astype(np.int64), width)
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, int]:
    """The least number of word edits from a to a prefix of b, and that prefix's length; most + 1 if above ``most``."""
    row = np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (b != x), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > most:
            return most + 1, 0
    best = int(np.argmin(row))
    return int(row[best]), best


def edit_distances(a: np.ndarray, rows: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`edit_distance` of a to each row (words, ``lengths`` of them, padded); most + 1 and 0 where it is above ``most``."""
    steps = np.arange(rows.shape[1] + 1, dtype=np.int32)
    beyond = steps > lengths[:, None]
    row = np.tile(steps, (len(rows), 1))
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, :-1] + (rows != x), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, 1) + steps
    row[beyond] = most + 1
    best = row.argmin(1)
    distance = row[np.arange(len(rows)), best]
    return np.minimum(distance, most + 1), np.where(distance <= most, best, 0)


class Items:
    """A block of benchmark items, ready to be looked for in texts."""

    def __init__(self, rows: list[tuple[int, str]], rate: float, recall: float, sampled: int, seed: int):
        self.rate, self.seed = rate, seed
        texts = pa.array([t for _, t in rows], pa.large_string())
        self.ids, self.words = [], []
        for row, end, data, off in chunks(texts):
            w = Words(data, off, SIGNS)
            h = w.hashes(0, LOWER)
            for d in range(end - row):
                self.ids.append(rows[row + d][0])
                self.words.append(h[w.bound[d] : w.bound[d + 1]])
        # A pair within k edits agrees at a position of the walk with a chance of about 1 - c * k / n.
        agree = max(0.05, 1 - 1.5 * rate)
        self.tables = max(4, math.ceil(math.log(1 - recall) / math.log(1 - agree**sampled)))
        self.sampled = sampled
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.need = [run_length(len(w), allowed(len(w), rate)) for w in self.words]
        for q in (1, 2, 3):
            parts = [(rolling(w, q), i) for i, w in enumerate(self.words) if len(w) and self.need[i][0] == q]
            if parts:
                g = np.concatenate([p for p, _ in parts])
                item = np.concatenate([np.full(len(p), i) for p, i in parts])
                place = np.concatenate([np.arange(len(p)) for p, _ in parts])
                order = np.argsort(g, kind="stable")
                self.runs[q] = (g[order], item[order], place[order])
        self.filters = {}
        for q, (g, _, _) in self.runs.items():
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(g >> _U(44)).astype(np.int64)] = True
            self.filters[q] = bitmap
        self.k = np.array([allowed(len(w), rate) for w in self.words], np.int64)
        self.hits = np.array([n for _, n in self.need], np.int64)
        self.places: dict[tuple[int, int], np.ndarray] = {}
        self.keys = np.zeros((len(self.words), self.tables), np.uint64)
        for width, own in self._by_width([len(w) for w in self.words]).items():
            rows = np.zeros((len(own), width), np.uint64)
            for x, i in enumerate(own):
                rows[x, : len(self.words[i])] = self.words[i]
            self.keys[own] = self._keys(rows, np.array([len(self.words[i]) for i in own]))

    @staticmethod
    def _by_width(lengths) -> dict[int, list[int]]:
        """Positions of sequences by the power of two that holds them; empty ones are left out."""
        out: dict[int, list[int]] = {}
        for i, n in enumerate(lengths):
            if n:
                out.setdefault(1 << (int(n) - 1).bit_length(), []).append(i)
        return out

    def _places(self, n: int, table: int) -> np.ndarray:
        """The positions of the walk that a repetition samples for an item of n words."""
        if (n, table) not in self.places:
            rng = np.random.default_rng([self.seed, n, table])
            self.places[n, table] = rng.integers(0, 2 * n, self.sampled)
        return self.places[n, table]

    def _keys(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """One bucket key for each row (words, padded with zeros) and repetition."""
        out = np.empty((len(rows), self.tables), np.uint64)
        sizes, which = np.unique(lengths, return_inverse=True)
        for r in range(self.tables):
            at = np.stack([self._places(int(n), r) for n in sizes])[which]
            steps = walk(rows, int(at.max()) + 1, self.seed + r)
            out[:, r] = rolling_rows(np.take_along_axis(steps, at, 1))
        return out

    def _regions(self, h: np.ndarray, words: Words) -> Iterator[tuple[int, int, int]]:
        """(document, item, first word of the window) near which enough run hits lie, for all windows that may match."""
        for q, (g, item, place) in self.runs.items():
            seen = rolling(h, q)
            at = np.flatnonzero(inside_document(words, q))
            at = at[self.filters[q][(seen[at] >> _U(44)).astype(np.int64)]]
            low, high = np.searchsorted(g, seen[at], "left"), np.searchsorted(g, seen[at], "right")
            count = high - low
            pick = np.repeat(low, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            pos, it, pl = np.repeat(at, count), item[pick], place[pick]
            if not len(pos):
                continue
            doc = words.doc[pos]
            key = doc * len(self.words) + it
            order = np.lexsort((pos - pl, key))
            key, diagonal, doc, it, pos, pl = key[order], (pos - pl)[order], doc[order], it[order], pos[order], pl[order]
            k, need = self.k[it], self.hits[it]
            # Hits of one alignment lie on diagonals at most k apart from its start: need of them in a band of 2k + 1.
            span = np.int64(1 << 40)
            flat = key * span + diagonal
            upto = np.searchsorted(flat, flat + 2 * k, "right")
            dense = upto - np.arange(len(flat)) >= need
            if dense.any():
                mark = np.zeros(len(flat) + 1, np.int64)
                np.add.at(mark, np.flatnonzero(dense), 1)
                np.add.at(mark, upto[dense], -1)
                live = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                for d, i, s in sorted({(int(doc[x]), int(it[x]), int(diagonal[x])) for x in live}):
                    yield d, i, s

    def windows(self, h: np.ndarray, words: Words, row: int) -> list[tuple[int, int, int, np.ndarray]]:
        """(row of the document, item, first word, words from there on) of each item-sized window that may match."""
        starts: dict[tuple[int, int], set[int]] = {}
        for d, i, s in self._regions(h, words):
            k = int(self.k[i])
            first, last = int(words.bound[d]), int(words.bound[d + 1])
            starts.setdefault((d, i), set()).update(range(max(first, s - k), min(last, s + k + 1)))
        out = []
        for (d, i), places in starts.items():
            first, last, n = int(words.bound[d]), int(words.bound[d + 1]), len(self.words[i]) + int(self.k[i])
            out += [(row + d, i, s - first, h[s : min(last, s + n)]) for s in sorted(places)]
        return out

    def _verify(self, i: int, windows: list[tuple[int, int, int, np.ndarray]], best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
        """Put the nearest passages of item ``i`` among its windows into ``best``."""
        k, lengths = int(self.k[i]), np.array([len(w[3]) for w in windows])
        rows = np.zeros((len(windows), lengths.max()), np.uint64)
        for x, w in enumerate(windows):
            rows[x, : len(w[3])] = w[3]
        distances, sizes = edit_distances(self.words[i], rows, lengths, k)
        for x in np.flatnonzero(distances <= k).tolist():
            row, _, start, _ = windows[x]
            distance = int(distances[x])
            have = best.get((row, i))
            if have is None or (distance, start) < (have[2], have[0]):
                best[row, i] = (start, int(sizes[x]), distance)

    def matches(self, windows: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, words, distance): the nearest verified passage of each item in each document."""
        lengths = [len(self.words[w[1]]) for w in windows]
        agreed = np.zeros(len(windows), np.int64)
        for width, own in self._by_width(lengths).items():
            for at in range(0, len(own), 4096):
                some = own[at : at + 4096]
                rows = np.zeros((len(some), width), np.uint64)
                for x, w in enumerate(some):
                    part = windows[w][3][: lengths[w]]
                    rows[x, : len(part)] = part
                keys = self._keys(rows, np.array([lengths[w] for w in some]))
                agreed[some] = (keys == self.keys[[windows[w][1] for w in some]]).sum(1)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for some in (agreed > 0, agreed == 0):
            by_item: dict[int, list[int]] = {}
            for w in np.flatnonzero(some).tolist():
                row, i, _, _ = windows[w]
                if (row, i) not in best or best[row, i][2]:
                    by_item.setdefault(i, []).append(w)
            for i, own in by_item.items():
                step = max(1, (1 << 20) // (len(self.words[i]) + int(self.k[i])))
                for at in range(0, len(own), step):
                    self._verify(i, [windows[w] for w in own[at : at + step]], best)
        return [(row, i, *found) for (row, i), found in best.items()]


def rolling_rows(x: np.ndarray) -> np.ndarray:
    """One hash for each row."""
    out = np.zeros(len(x), np.uint64)
    for j in range(x.shape[1]):
        out = mix(out * _U(31) + x[:, j])
    return out


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, streamed to the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("bigint"), text_or_empty()).where("item_id is not null").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, recall: float = 0.99, sampled: int = 4, seed: int = 7) -> DataFrame:
    """(doc_id, item_id, start, length, distance): each item of which a document holds a near copy, with its nearest passage.

    start and length count words; distance is at most ``rate`` times the item's words. Null or word-less
    texts and items match nothing; a null doc_id is carried through; rows that repeat in ``docs`` repeat here.
    """
    out = None
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found = python_batches(docs).select(F.col("doc_id").cast("bigint"), text_or_empty()).mapInArrow(_finder(shared, rate, recall, sampled, seed), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def _finder(shared, rate: float, recall: float, sampled: int, seed: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value, rate, recall, sampled, seed)
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def found(ids: pa.Array, hits: list) -> pa.RecordBatch:
            cols = list(zip(*hits, strict=True)) or [[]] * 5
            return pa.record_batch([ids.take(pa.array(cols[0], pa.int64())), pa.array([items.ids[i] for i in cols[1]], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:])], names)

        for b in batches:
            near = []
            for row, _, data, off in chunks(b.column(1)):
                words = Words(data, off, SIGNS)
                near += items.windows(words.hashes(0, LOWER), words, row)
                if len(near) > 1 << 16:
                    # Windows of one document stay together: chunks end between documents.
                    yield found(b.column(0), items.matches(near))
                    near = []
            yield found(b.column(0), items.matches(near))

    return run


def op1(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a near copy of an item; all rows of a doc_id go with one of them."""
    bad = materialize(contaminated(docs.where("doc_id is not null"), benchmark).select(F.col("doc_id").alias("bad_id")).distinct(), "contaminated")
    return without_ids(docs, bad)
