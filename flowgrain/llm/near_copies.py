"""Groups of documents with similar sets of word shingles: SimHash cells propose pairs, exact set similarity decides.

At a Jaccard similarity of 0.8 about 15 % of the bits of two fingerprints differ, so several 64-bit fingerprints (each of
scrambled shingle hashes, ``SALTED`` of them) are taken together, cut into segments of two bits and mapped to the bit
counts of the segments. A table of the grid takes some segments by a fixed choice, and documents with the same
counts there meet in a cell: the sub-vectors' Manhattan distance, a lower bound of the Hamming distance, is zero. There are
as many tables as it takes for the wanted recall at the similarity.

Links are found in two passes. The first is quick: cells that hold many points are cut by further segments, whole fingerprints
are compared in what is left, and of the pairs within the bit limit a lightest spanning forest is verified by the shingles
themselves. Copies and most near copies are then in one verified group. The second pass leaves nothing out: in every
cell, uncut, all points of different verified groups are compared, and all pairs within the bit limit are verified. So the
groups are those that all pairs would give that meet in a cell within the limit and are similar enough, however cells are dealt to
tasks. Pairs within a verified group are not compared again; between groups the second pass takes as many comparisons as
cells have pairs, in units of bounded size. These pairs are never rows: a cell returns a forest that connects its candidates,
what forests connect is a clump, and a clump's sets meet in parts, where all pairs of different groups are verified at once and a
forest of the links comes out. So rows grow with the points; the sets of a clump of over ``PIECE`` travel once for each part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Words, chunks, mix
from .components import connected_components, forest, lightest_forest
from .shared import discard, frugal, materialize, python_batches, salted_totals, sifted, text_or_empty, with_ids, without_ids
from .simhash import SEGMENTS, columns, digests, grouped, pairs_of_units, popcounts, shingle_sets, whole_units, with_fingerprint

#: Fingerprints, segments of a cell, and segments that cut a crowded cell further.
SALTED, TAKEN, FURTHER = 4, 10, 6
#: Points above which a cell is cut before it is dealt to a task, and the share of points that is counted to find such cells.
CROWDED, COUNTED = 4096, 64
#: Points above which a task cuts a cell further, by so many segments at a time, so many times.
DENSE, DEEPER, TIMES = 192, 4, 8
#: Pairs that are verified in one unit, and edges that one unit thins out.
UNIT, FOREST = 512, 1 << 20
#: Shingles of one part of a clump, those that a set counts for besides its own, and rows that are compared with all others at once.
PIECE, EACH, BLOCK = 1 << 18, 64, 512


def expected_bits(similarity: float) -> float:
    """The share of bits that differ between two sets of like size with that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_needed(similarity: float, recall: float) -> int:
    """Tables after which two sets of the similarity met in some cell with a chance of ``recall``."""
    p = expected_bits(similarity)
    same = (1 - p) ** 2 + p * p / 2
    return math.ceil(math.log(1 - recall) / math.log(1 - same**TAKEN))


def bit_limit(similarity: float) -> int:
    """Differing bits of all fingerprints within which a pair is a candidate: four standard deviations above those expected."""
    n, p = 64 * SALTED, expected_bits(similarity)
    return int(n * p + 4 * math.sqrt(n * p * (1 - p)))


def cells(prints: np.ndarray, tables: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each table: the cell of each row of fingerprints, and the key that cuts it further."""
    counts = popcounts(prints)
    rng = np.random.default_rng(9)
    for t in range(tables):
        key = np.full(len(prints), t + 1, np.uint64)
        for i, s in enumerate(rng.permutation(SALTED * SEGMENTS)[: TAKEN + FURTHER]):
            if i == TAKEN:
                cell, key = mix(key), np.zeros(len(prints), np.uint64)
            key = key * np.uint64(4) + ((counts[:, s // SEGMENTS] >> np.uint64(2 * (s % SEGMENTS))) & np.uint64(3))
        yield cell, key


def finer(cell: np.ndarray, prints: np.ndarray, most: int = DENSE) -> np.ndarray:
    """New cells: those of more than ``most`` points are cut by further segments, until they are smaller or ``TIMES`` are over.

    Pairs that this parts are left to :func:`apart`.
    """
    cell = cell.view(np.uint64).copy()
    counts = popcounts(prints)
    segments = np.random.default_rng(77).permutation(SALTED * SEGMENTS)[: DEEPER * TIMES]
    for step in np.split(segments, TIMES):
        _, at, n = np.unique(cell, return_inverse=True, return_counts=True)
        dense = np.flatnonzero(n[at] > most)
        if not len(dense):
            break
        key = cell[dense]
        for s in step:
            key = key * np.uint64(5) + ((counts[dense, s // SEGMENTS] >> np.uint64(2 * (s % SEGMENTS))) & np.uint64(3))
        cell[dense] = mix(key)
    return cell


def proposed(cell: np.ndarray, most: int = DENSE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs to compare: all pairs of a cell (cells are sorted), but of a dense one each row with the next and with the first.

    A cell that is still dense agrees in all segments that it was cut by: its points are almost the same, so both their
    chain and their star connect most of them, with pairs as many as there are points. Other pairs are left to :func:`apart`.
    """
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(cell)])
    head, n = np.repeat(first, size), np.repeat(size, size)
    dense = np.flatnonzero((n > most) & (np.arange(len(cell)) > head))
    yield dense - 1, dense
    yield head[dense], dense
    yield from pairs_of_units(cell, np.flatnonzero(n <= most))


def within(prints: list[np.ndarray], i: np.ndarray, j: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows that differ by at most ``limit`` bits of all fingerprints, with the bits."""
    bits = np.zeros(len(i), np.int32)
    for p in prints:
        bits = bits + np.bitwise_count((p[i] ^ p[j]).view(np.uint64))
        if p is prints[0]:
            continue  # strangers pass the first
        near = np.flatnonzero(bits <= limit)
        i, j, bits = i[near], j[near], bits[near]
        if not len(i):
            break
    return i, j, bits


def prints_of(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(SALTED)], 1)


def candidates(points: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(u, v, d): edges between digests that connect all points which met in a cell within the bit limit."""
    tables, limit, names = tables_needed(similarity, recall), bit_limit(similarity), columns(SALTED)
    fine = np.uint64(4**FURTHER)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = prints_of(b)
            for cell, _ in cells(own, tables):
                yield pa.record_batch([pa.array(cell.view(np.int64))], ["cell"])

    some = points.where(F.pmod(F.xxhash64("digest"), F.lit(COUNTED)) == 0).select(names)
    crowded = some.mapInArrow(count, "cell bigint").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") * COUNTED > CROWDED)
    # A bitmap of fixed size: cells that share a bit with a crowded one are cut further without need, no more.
    bits = crowded.select(F.expr("cell & 1048575").alias("bit")).distinct()
    bitmap = np.zeros(1 << 20, bool)
    bitmap[[r[0] for r in bits.collect()]] = True
    shared = points.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    @frugal
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                part = b.slice(at, 8192)
                for cell, key in cells(prints_of(part), tables):
                    own = np.where(hot[(cell & np.uint64(1048575)).astype(np.int64)], mix(cell * fine + key), cell)
                    yield pa.record_batch([pa.array(own.view(np.int64)), *part.columns], ["cell", *names, "digest"])

    @frugal
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, *prints, digest in whole_units(batches):
            cell = finer(cell, np.stack(prints, 1).view(np.uint64), DENSE)
            order = np.lexsort((digest, prints[0], cell))
            cell, digest, prints = cell[order], digest[order], [p[order] for p in prints]
            u, v, d, held = [digest[:0]], [digest[:0]], [np.zeros(0, np.int32)], 0

            def thin() -> None:
                a, b, w = np.concatenate(u), np.concatenate(v), np.concatenate(d)
                keep = lightest_forest(np.minimum(a, b), np.maximum(a, b), w)
                u[:], v[:], d[:] = [a[keep]], [b[keep]], [w[keep]]

            for i, j in proposed(cell, DENSE):
                i, j, bits = within(prints, i, j, limit)
                u.append(digest[i])
                v.append(digest[j])
                d.append(bits)
                held += len(u[-1])
                if held > 1 << 20:
                    thin()
                    held = len(u[0])
            thin()
            yield pa.record_batch([pa.array(np.minimum(u[0], v[0])), pa.array(np.maximum(u[0], v[0])), pa.array(d[0])], ["u", "v", "d"])

    dealt = points.select(*names, "digest").mapInArrow(spread, "cell bigint, " + ", ".join(f"{n} bigint" for n in [*names, "digest"]))
    found = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(find, "u bigint, v bigint, d int")
    return materialize(found.distinct(), "candidates")


def across(unit: np.ndarray, run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within units of rows of different runs; rows are sorted by unit and run."""
    if not len(unit):
        return
    ends = np.r_[np.flatnonzero(unit[1:] != unit[:-1]) + 1, len(unit)]
    other = np.r_[np.flatnonzero((unit[1:] != unit[:-1]) | (run[1:] != run[:-1])) + 1, len(unit)]
    place = np.arange(len(unit))
    end, at = ends[np.searchsorted(ends, place, "right")], other[np.searchsorted(other, place, "right")]
    live = np.flatnonzero(at < end)
    while len(live):
        yield live, at[live]
        at[live] += 1
        live = live[at[live] < end[live]]


class Crowds:
    """How cells with many points are dealt in parts: ``big`` holds (cell, root, points), ``rest`` (cell, points of all other groups).

    A group of more than ``most`` points in a cell has parts of its own, which never meet each other; all other groups
    share parts, a group being whole in one. Every two other parts are a unit, and so is every shared part with itself.
    """

    def __init__(self, big: list[tuple[int, int, int]], rest: list[tuple[int, int]], most: int):
        self.shared = {c: max(1, -(-n // most)) for c, n in rest}
        self.parts, self.big = dict(self.shared), {}
        for c, r, n in big:
            self.big[c, r] = (self.parts[c], -(-n // most))
            self.parts[c] += -(-n // most)
        self.cells = np.array(sorted(self.parts), np.int64)

    def deal(self, cell: np.ndarray, root: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, unit, run) of every row of the units that the points are in."""
        hot = np.isin(cell, self.cells)
        at = np.flatnonzero(hot)
        if not len(at):
            return np.arange(len(cell)), cell, root
        c, r = cell[at], root[at]
        first, n = np.array([self.big.get(k, (0, 0)) for k in zip(c.tolist(), r.tolist(), strict=True)], np.int64).T
        shared, parts = np.array([(self.shared[x], self.parts[x]) for x in c.tolist()], np.int64).T
        own = np.where(n > 0, first + digest[at] % np.maximum(n, 1), r % shared)
        count = parts - n
        other = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at, own, c, r, first, n = (np.repeat(x, count) for x in (at, own, c, r, first, n))
        other += np.where((n > 0) & (other >= first), n, 0)
        low, high = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
        unit = mix(c.view(np.uint64) + mix((low << np.uint64(32)) + high + np.uint64(1))).view(np.int64)
        # In a unit of two parts only pairs between them count, in a part by itself those between groups.
        run, cold = np.where(own == other, r, own), np.flatnonzero(~hot)
        return np.r_[cold, at], np.r_[cell[cold], unit], np.r_[root[cold], run]


def crowds_of(by_group: DataFrame, most: int) -> Crowds:
    """From (cell, root, n): how cells of more than ``most`` are dealt."""
    crowded = by_group.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    big = by_group.where(F.col("n") > most)
    rest = crowded.join(big.groupBy("cell").agg(F.sum("n").alias("held")), "cell", "left").select("cell", (F.col("n") - F.coalesce("held", F.lit(0))).alias("n"))
    return Crowds([(r.cell, r.root, r.n) for r in big.collect()], [(r.cell, r.n) for r in rest.collect()], most)


def apart(rooted: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(u, v): edges that connect all points of different roots which meet in an uncut cell within the bit limit, fewer than the cells hold points."""
    tables, limit, names = tables_needed(similarity, recall), bit_limit(similarity), columns(SALTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, _ in cells(prints_of(b), tables):
                yield pa.record_batch([pa.array(cell.view(np.int64)), b.column(SALTED)], ["cell", "root"])

    some = rooted.where(F.pmod(F.xxhash64("digest"), F.lit(COUNTED)) == 0).select(*names, "root")
    by_group = materialize(some.mapInArrow(count, "cell bigint, root bigint").groupBy("cell", "root").agg((F.count("*") * COUNTED).alias("n")), "counts")
    # What reaches the driver are cells and groups of over CROWDED points: at most tables / CROWDED of the points' number.
    crowds = crowds_of(by_group, CROWDED)
    shared = rooted.sparkSession.sparkContext.broadcast(crowds)

    @frugal
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(0, b.num_rows, 8192):
                part = b.slice(row, 8192)
                digest, root = (part.column(SALTED + k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for cell, _ in cells(prints_of(part), tables):
                    at, unit, run = shared.value.deal(cell.view(np.int64), root, digest)
                    own = part.select([*names, "digest"]).take(pa.array(at))
                    yield pa.record_batch([pa.array(unit), pa.array(run), *own.columns], ["unit", "run", *names, "digest"])

    @frugal
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, run, *prints, digest in whole_units(batches):
            u, v, held = [digest[:0]], [digest[:0]], 0
            for i, j in across(unit, run):
                i, j, _ = within(prints, i, j, limit)
                u.append(digest[i])
                v.append(digest[j])
                held += len(i)
                if held > 1 << 20:
                    a, b = forest(np.concatenate(u), np.concatenate(v))
                    u, v, held = [a], [b], len(a)
            yield pa.record_batch([pa.array(x) for x in forest(np.concatenate(u), np.concatenate(v))], ["u", "v"])

    dealt = rooted.mapInArrow(spread, "unit bigint, run bigint, " + ", ".join(f"{n} bigint" for n in [*names, "digest"]))
    found = dealt.repartition("unit").sortWithinPartitions("unit", "run").mapInArrow(find, "u bigint, v bigint")
    out = materialize(found.distinct(), "apart")
    discard(by_group)
    return out


def sets_of(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(digest, h): the hashes of the shingles of each digest's text, one of those that have the doc_id ``rep``."""
    may, _ = sifted(docs.select("doc_id", "text"), reps.select("rep"))
    texts = python_batches(may).select(F.col("doc_id").cast("bigint").alias("rep"), text_or_empty().alias("text")).join(reps.hint("merge"), "rep").select("digest", "text")

    @frugal
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, data, off in chunks(b.column(1)):
                doc, h = shingle_sets(Words(data, off), width)
                at = np.searchsorted(doc, np.arange(end - row + 1))
                own = b.column(0).slice(row, end - row)
                # Another text of the same doc_id has another digest.
                mine = pa.array(digests(doc, h, end - row).view(np.int64) == own.to_numpy(zero_copy_only=False))
                yield pa.record_batch([own.filter(mine), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64))).filter(mine)], ["digest", "h"])

    return texts.mapInArrow(sets, "digest bigint, h array<bigint>").dropDuplicates(["digest"])


def whole_sets(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches that are sorted by their first column, put together to whole units of about ``most`` values of the last column, a list."""
    held: list[pa.RecordBatch] = []
    have = 0
    for b in batches:
        held.append(b)
        have += len(b.column(b.num_columns - 1).flatten()) + EACH * b.num_rows
        if have < most:
            continue
        rows = pa.concat_batches(held)
        unit = rows.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(unit, unit[-1], "left"))
        if cut:
            yield rows.slice(0, cut)
        held, have = [rows.slice(cut)], len(rows.slice(cut).column(rows.num_columns - 1).flatten()) + EACH * (len(unit) - cut)
    if held:
        yield pa.concat_batches(held)


def shared_shingles(unit: np.ndarray, row: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix): for blocks of rows, how many of its shingles (row, h) each has in common with every other row of its unit.

    Shingles that few rows have are taken as pairs of these rows, others as columns of a matrix product.
    """
    n = len(unit)
    order = np.lexsort((h, unit[row]))
    row, h = row[order], h[order]
    new = (h[1:] != h[:-1]) | (unit[row[1:]] != unit[row[:-1]])
    first = np.flatnonzero(np.r_[True, new]) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(h)])
    often = np.flatnonzero(count > max(8, n // 32))
    table = np.zeros((n, len(often)), np.float32)
    at = np.repeat(first[often] - np.cumsum(count[often]) + count[often], count[often]) + np.arange(count[often].sum())
    table[row[at], np.repeat(np.arange(len(often)), count[often])] = 1
    seldom = np.repeat((count > 1) & (count <= max(8, n // 32)), count)
    start, many = np.repeat(first, count), np.repeat(count, count)
    for low in range(0, n, BLOCK):
        high = min(n, low + BLOCK)
        both = table[low:high] @ table.T
        own = np.flatnonzero(seldom & (row >= low) & (row < high))
        for part in np.split(own, np.searchsorted(np.cumsum(many[own]), np.arange(1 << 20, many[own].sum(), 1 << 20))):
            m = many[part]
            other = np.repeat(start[part] - np.cumsum(m) + m, m) + np.arange(m.sum())
            np.add.at(both.reshape(-1), np.repeat(row[part] - low, m) * n + row[other], np.float32(1))
        yield low, both


def similar(unit: np.ndarray, run: np.ndarray, row: np.ndarray, h: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j > i) of the pairs within units of different runs whose sets of shingles (row, h) have the Jaccard similarity."""
    size = np.bincount(row, minlength=len(unit))
    for low, both in shared_shingles(unit, row, h):
        i, j = np.nonzero(both >= similarity * (size[low : low + len(both), None] + size - both) - 1e-9)
        i += low
        good = np.flatnonzero((i < j) & (unit[i] == unit[j]) & (run[i] != run[j]))
        yield i[good], j[good]


def linked(docs: DataFrame, rooted: DataFrame, points: DataFrame, clumps: DataFrame, width: int, similarity: float, recall: float) -> DataFrame:
    """(u, v): a forest of the links between points of different roots of one clump (node, root).

    A link is a pair that meets in a cell within the bit limit and has the Jaccard similarity.
    """
    tables, limit, names = tables_needed(similarity, recall), bit_limit(similarity), columns(SALTED)
    own = clumps.select(F.col("node").alias("digest"), F.col("root").alias("cell"))
    members = rooted.join(own, "digest").join(points.select("digest", "rep"), "digest")
    members = materialize(members.select("cell", "root", *names, "digest", "rep"), "members")
    known = materialize(sets_of(docs, members.select("rep", "digest"), width), "sets")
    weights = materialize(
        members.join(known.select("digest", F.size("h").alias("n")), "digest").groupBy("cell", "root").agg(F.sum(F.col("n") + EACH).alias("n")), "counts"
    )
    # What reaches the driver are clumps and groups of over PIECE shingles.
    shared = docs.sparkSession.sparkContext.broadcast(crowds_of(weights, PIECE))

    @frugal
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, root, digest = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2 + SALTED))
            at, unit, run = shared.value.deal(cell, root, digest)
            rows = b.select([*names, "digest"]).take(pa.array(at))
            yield pa.record_batch([pa.array(unit), pa.array(run), *rows.columns], ["unit", "run", *names, "digest"])

    @frugal
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_sets(batches, PIECE):
            unit, run, digest = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2 + SALTED))
            prints = np.stack([b.column(2 + k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(SALTED)], 1)
            sets = b.column(3 + SALTED)
            row = np.repeat(np.arange(len(unit)), sets.value_lengths().to_numpy(zero_copy_only=False))
            u, v = digest[:0], digest[:0]
            for i, j in similar(unit, run, row, sets.flatten().to_numpy(zero_copy_only=False), similarity):
                i, j, _ = within(list(prints.T), i, j, limit)
                met = np.zeros(len(i), bool)
                for cell, _ in cells(prints, tables) if len(i) else ():
                    met |= cell[i] == cell[j]
                u, v = forest(np.r_[u, digest[i[met]]], np.r_[v, digest[j[met]]])
            yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    dealt = members.mapInArrow(spread, "unit bigint, run bigint, " + ", ".join(f"{n} bigint" for n in [*names, "digest"]))
    met = dealt.join(known.hint("merge"), "digest").select("unit", "run", *names, "digest", "h")
    out = materialize(met.repartition("unit").sortWithinPartitions("unit", "run").mapInArrow(link, "u bigint, v bigint"), "linked")
    discard(members, known, weights)
    return out


def units(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v, unit): a lightest spanning forest of the edges of each group, in units of ``UNIT`` of one group."""
    rooted = edges.join(roots.withColumnRenamed("node", "u"), "u").select("root", "u", "v", "d")
    # At most one row for every FOREST edges.
    big = F.broadcast(rooted.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > FOREST))
    part = F.pmod(F.xxhash64("u", "v"), F.coalesce(F.ceil(F.col("n") / F.lit(FOREST)), F.lit(1)))
    dealt = rooted.join(big, "root", "left").select(F.xxhash64("root", part).alias("group"), "u", "v", "d")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, u, v, d in whole_units(batches):
            keep = lightest_forest(u, v, d)
            keep = keep[np.argsort(group[keep], kind="stable")]
            own = group[keep]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
            place = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
            unit = mix(own.view(np.uint64) + (place // UNIT).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.record_batch([pa.array(u[keep]), pa.array(v[keep]), pa.array(unit)], ["u", "v", "unit"])

    return materialize(dealt.repartition("group").sortWithinPartitions("group").mapInArrow(run, "u bigint, v bigint, unit bigint"), "pairs")


def verified(docs: DataFrame, points: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(u, v) of the pairs whose sets of shingles have the Jaccard similarity; every set travels once for each unit that it is in."""
    first = pairs.groupBy("unit", F.col("u").alias("digest")).agg(F.collect_list("v").alias("partners"))
    ends = first.unionByName(pairs.select("unit", F.col("v").alias("digest"), F.array().cast("array<bigint>").alias("partners")))
    ends = ends.groupBy("unit", "digest").agg(F.flatten(F.collect_list("partners")).alias("partners"))
    ends = materialize(ends.join(points.select("digest", "rep"), "digest"), "ends")
    known = sets_of(docs, ends.select("rep", "digest").distinct(), width)
    dealt = ends.join(known.hint("merge"), "digest").select("unit", "digest", "partners", "h")

    @frugal
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, want = None, {}, []

        def close() -> pa.RecordBatch:
            good = []
            for a, partners in want:
                x = held[a]
                for b in partners:
                    y = held.get(b)
                    if y is None or min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                        good.append((a, b))
            u, v = zip(*good, strict=True) if good else ((), ())
            return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in batches:
            lists = b.column(3)
            for i, (own, digest, partners) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if own != unit:
                    yield close()
                    unit, held, want = own, {}, []
                held[digest] = np.array(lists[i].values)
                if partners:
                    want.append((digest, partners))
        yield close()

    out = materialize(dealt.repartition("unit").sortWithinPartitions("unit").mapInArrow(verify, "u bigint, v bigint"), "verified")
    discard(ends)
    return out


def near_copy_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.96) -> DataFrame:
    """(doc_id, t, component_id) of each row, t being a hash of its text: the smallest doc_id of all rows that links reach.

    Documents with the same set of shingles are linked, and candidates of at least ``similarity`` are; ``recall`` is that
    of the cells for a pair of just that similarity, it grows fast above. doc_id must not be null. Null, empty and
    word-less texts have the empty set, so they are copies of each other. Repeated rows repeat; an empty table gives no rows.
    """
    names = columns(SALTED)
    prints = materialize(with_fingerprint(docs, width, SALTED, once=True), "fingerprints")
    points = materialize(salted_totals(prints, ["digest"], ["doc_id"], rep=(F.min, "doc_id"), **{n: (F.min, n) for n in names}), "points")
    edges = candidates(points, similarity, recall)
    roots = materialize(reached(edges), "reached")
    pairs = units(edges, roots)
    links = verified(docs, points, pairs, width, similarity)
    label = materialize(reached(links), "reached")
    rooted = points.join(label, F.col("digest") == F.col("node"), "left").select(*names, "digest", F.coalesce("root", "digest").alias("root"))
    rooted = materialize(rooted, "rooted")
    rest = apart(rooted, similarity, recall)
    among = materialize(reached(rest), "reached")
    more = linked(docs, rooted, points, among, width, similarity, recall)
    out = grouped(prints.select("doc_id", "t", "digest"), points, links.unionByName(more), "digest").select("doc_id", "t", "component_id")
    discard(edges, roots, pairs, links, label, rooted, rest, among, more, points)
    return out


def reached(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, roots included; each task first thins its edges to a forest."""

    @frugal
    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for b in batches:
            u.append(b.column(0).to_numpy(zero_copy_only=False))
            v.append(b.column(1).to_numpy(zero_copy_only=False))
            held += b.num_rows
            if held > FOREST:
                yield pa.record_batch([pa.array(x) for x in forest(np.concatenate(u), np.concatenate(v))], ["u", "v"])
                u, v, held = u[:1], v[:1], 0
        yield pa.record_batch([pa.array(x) for x in forest(np.concatenate(u), np.concatenate(v))], ["u", "v"])

    roots = connected_components(edges.select("u", "v").mapInArrow(thin, "u bigint, v bigint"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def keep_one_of_each_group(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that stand for their group: the one with its smallest doc_id.

    Rows with a null doc_id cannot stand for a group and are kept as they are. Of rows that share that doc_id and are
    in the group one stays, equal rows once.
    """
    groups = materialize(near_copy_groups(docs.where("doc_id is not null"), similarity, width), "groups")
    ids = materialize(groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id")), "ids")
    once = without_ids(docs, ids.where("doc_id <> component_id or n > 1").select("doc_id"))
    many = ids.where("n > 1").select("doc_id")
    stand = groups.where("doc_id = component_id").join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("t").alias("t"))
    shared = with_ids(docs, many).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("t"))
    again = shared.join(stand, ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id"]).select("row.*")
    return once.unionByName(again)
