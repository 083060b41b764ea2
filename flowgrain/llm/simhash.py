"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is cut into 32 segments of two bits. The vector of the segments' bit counts has
a Manhattan distance that is never above the Hamming distance of the fingerprints. The vector is cut
into ``blocks`` sub-vectors; if two fingerprints differ in at most ``blocks * (reach + 1) - 1`` bits,
then in some block their counts differ by at most ``reach``. So each fingerprint is put into the grid
cell of each of its sub-vectors (home) and into those cells around it that lie on the positive side
(probe); two fingerprints whose sub-vectors are that near meet in a cell, one of them at home. There
the Hamming distance is computed exactly.

What keeps it bounded: equal fingerprints are one point; a cell with more than ``CELL`` points is
dealt out as pairs of parts, each of which is a task's unit of bounded size; a unit returns a
spanning forest of its links and never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import LOWER, Words, chunks, inside_document, mix, xxh64
from .components import connected_components, forest
from .shared import discard, frugal, materialize, python_batches, salt, salted_totals, salts_of, text_or_empty

SEED, SEGMENTS = 42, 32
#: Points of a cell that one part holds.
CELL = 4096
_EVEN = np.uint64(0x5555555555555555)


def _shingles(words: Words, width: int) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray]]]:
    """The document of each shingle, in order, and (position, hashes) of runs of them."""
    body, start, stop = words.joined(LOWER)
    if not len(words):
        return np.zeros(0, np.int64), iter(())
    at = np.flatnonzero(inside_document(words, width))
    count = np.diff(words.bound)
    short = np.flatnonzero((count > 0) & (count < width))
    doc = np.concatenate([words.doc[at], short])
    order = np.argsort(doc, kind="stable")
    a = np.concatenate([start[at], start[words.bound[short]]])[order]
    b = np.concatenate([stop[at + width - 1], stop[words.bound[short + 1] - 1]])[order]
    return doc[order], ((i, xxh64(body, a[i : i + (1 << 16)], b[i : i + (1 << 16)], SEED)) for i in range(0, len(doc), 1 << 16))


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each distinct shingle of each document, sorted."""
    doc, runs = _shingles(words, width)
    h = np.concatenate([np.zeros(0, np.uint64), *(x for _, x in runs)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[first], h[first]


def digests(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """One number for each document's set of shingles; documents of one number have the same set."""
    at = np.searchsorted(doc, np.arange(n + 1))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))


def fingerprints(texts: pa.Array, width: int = 4, salts: int = 1, once: bool = False) -> np.ndarray:
    """SimHash of each text: ASCII lower case, shingles of ``width`` words with repeats, XXH64 with seed 42.

    One column for each salt; those after the first are of scrambled shingle hashes, independent of it. ``once``
    takes each shingle of a text once, and puts the digest of their set into a last column.
    """
    out = np.zeros((len(texts), salts + once), np.uint64)
    for row, end, data, off in chunks(texts):
        words = Words(data, off)
        if once:
            doc, distinct = shingle_sets(words, width)
            out[row:end, salts] = digests(doc, distinct, end - row)
            runs = [(i, distinct[i : i + (1 << 16)]) for i in range(0, len(distinct), 1 << 16)]
        else:
            doc, runs = _shingles(words, width)
        if not len(doc):
            continue
        ones = np.zeros((salts, end - row, 64), np.int64)
        for i, h in runs:
            d = doc[i : i + (1 << 16)]
            first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            for s in range(salts):
                g = h if not s else mix(h + np.uint64(s * 0x9E3779B97F4A7C15 & (2**64 - 1)))
                bits = np.unpackbits(g.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                for x, y in zip(first, np.r_[first[1:], len(d)], strict=True):
                    ones[s, d[x]] += bits[x:y].sum(0, dtype=np.int32)
        total = np.bincount(doc, minlength=end - row)
        for s in range(salts):
            out[row:end, s] = np.packbits(2 * ones[s] > total[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def columns(salts: int) -> list[str]:
    """Names of the fingerprint columns."""
    return ["fp", *(f"fp{s}" for s in range(1, salts))]


def with_fingerprint(docs: DataFrame, width: int = 4, salts: int = 1, once: bool = False) -> DataFrame:
    """(doc_id, t, fp, …) of every row, t being a hash of the text, with ``once`` also its ``digest``; a null text has no words and the fingerprint zero."""
    names = columns(salts) + ["digest"] * once

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = fingerprints(b.column(2), width, salts, once).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(p)) for p in prints.T)], ["doc_id", "t", *names])

    own = python_batches(docs).select(F.col("doc_id").cast("bigint"), F.xxhash64(text_or_empty()).alias("t"), text_or_empty().alias("text"))
    return own.mapInArrow(run, "doc_id bigint, t bigint, " + ", ".join(f"{n} bigint" for n in names))


def grid_cells(fp: np.ndarray, blocks: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, position in ``fp``, is home): the home cell of each block and the positive side of those around it."""
    fp, place = fp.view(np.uint64), np.arange(len(fp))
    counts = popcounts(fp)
    cells, points, home = [], [], []

    def put(cell: np.ndarray, who: np.ndarray, is_home: bool) -> None:
        cells.append(cell)
        points.append(who)
        home.append(np.full(len(who), is_home))

    for block, segments in enumerate(np.array_split(np.arange(SEGMENTS), blocks)):
        digit = [((counts >> np.uint64(2 * s)) & np.uint64(3)).astype(np.int8) for s in segments]
        unit = [np.int64(1) << (2 * i) for i in range(len(segments))]
        own = sum(d.astype(np.int64) * u for d, u in zip(digit, unit, strict=True)) | (np.int64(block) << 58)
        put(own, place, True)
        for i, d in enumerate(digit):
            for step in range(1, reach + 1):
                ok = d + step <= 2
                put(own[ok] + step * unit[i], place[ok], False)
            if reach == 2:
                for j in range(i + 1, len(segments)):
                    for sign, near in ((1, digit[j] < 2), (-1, digit[j] > 0)):
                        ok = (d < 2) & near
                        put(own[ok] + unit[i] + sign * unit[j], place[ok], False)
    return np.concatenate(cells), np.concatenate(points), np.concatenate(home)


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 segments of each fingerprint, two bits each."""
    low, high = fp & _EVEN, (fp >> np.uint64(1)) & _EVEN
    return (low ^ high) | ((low & high) << np.uint64(1))


def pairs_of_units(unit: np.ndarray, live: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j > i) of all pairs within units (sorted) of which the first is live, one distance apart at a time."""
    size = np.diff(np.r_[np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]), len(unit)]) if len(unit) else np.zeros(0, int)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(unit)) - 1
    live, d = live[left[live] > 0], 0
    while len(live):
        d += 1
        live = live[left[live] >= d]
        yield live, live + d


def links_of_units(unit: np.ndarray, home: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (at most ``most`` differing bits) within units of rows of which one is at home."""
    order = np.lexsort((~home, unit))
    unit, home, fp = unit[order], home[order], fp[order]
    u, v, held = [], [], 0
    for i, j in pairs_of_units(unit, np.flatnonzero(home)):
        # Counts are of unsigned values: of a signed one numpy counts the magnitude.
        near = (np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= most) & (fp[i] != fp[j])
        if near.any():
            u.append(fp[i[near]])
            v.append(fp[j[near]])
            held += len(u[-1])
            if held > 1 << 19:
                a, b = forest(np.concatenate(u), np.concatenate(v))
                u, v, held = [a], [b], len(a)
    return forest(np.concatenate(u), np.concatenate(v)) if u else (fp[:0], fp[:0])


def whole_units(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[list[np.ndarray]]:
    """The columns of batches that are sorted by their first column, in runs of about ``rows`` rows that end with a unit."""
    held: list[list[np.ndarray]] = []
    have = 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        have += b.num_rows
        if have < rows:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if cut:
            yield [x[:cut] for x in cols]
            cols = [x[cut:] for x in cols]
        held, have = [cols], len(cols[0])
    if have:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def fingerprint_links(points: DataFrame, most: int = 4, blocks: int = 3, reach: int = 1) -> DataFrame:
    """Edges (u, v) between fingerprints that connect all points linked within ``most`` bits.

    The grid finds every pair that differs by at most ``blocks * (reach + 1) - 1`` bits; ``most`` must not be above it.
    """
    if blocks * (reach + 1) - 1 < most or reach not in (0, 1, 2):
        raise ValueError(f"{blocks} blocks of reach {reach} do not cover {most} bits")

    @frugal
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                fp = b.column(0).slice(at, 8192).to_numpy(zero_copy_only=False)
                cell, who, home = grid_cells(fp, blocks, reach)
                yield pa.record_batch([pa.array(cell), pa.array(home), pa.array(fp[who])], ["cell", "home", "fp"])

    # Made twice, as it is cheap to make and many times the size of the points.
    spread = points.select("fp").mapInArrow(cells, "cell bigint, home boolean, fp bigint")
    crowded = spread.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    parts = F.coalesce(F.ceil(F.col("n") / F.lit(CELL)), F.lit(1)).cast("int")
    dealt = (
        spread.join(crowded, "cell", "left")
        .select("cell", "home", "fp", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("b"))
        .select(F.xxhash64("cell", F.least("a", "b"), F.greatest("a", "b")).alias("unit"), "home", "fp")
    )

    @frugal
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, home, fp in whole_units(batches):
            yield pa.record_batch([pa.array(x) for x in links_of_units(unit, home, fp, most)], ["u", "v"])

    found = dealt.repartition("unit").sortWithinPartitions("unit").mapInArrow(find, "u bigint, v bigint")
    return materialize(found, "links")


def grouped(prints: DataFrame, points: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """``prints`` with component_id: the smallest doc_id (``rep``) of all points (``node``, mask of salts, rep) that the links connect with the row's."""
    roots = connected_components(links)
    rooted = points.join(roots, F.col(node) == F.col("node"), "left").select(node, "mask", "rep", F.coalesce("root", F.col(node)).alias("root"))
    rooted = materialize(rooted, "rooted")
    least = salted_totals(rooted, ["root"], [node], component_id=(F.min, "rep"))
    named = rooted.withColumn("salt", salt(node)).join(least.select("root", "component_id", salts_of("mask").alias("salt")), ["root", "salt"])
    named = materialize(named.select(node, "component_id", salts_of("mask").alias("salt")), "groups")
    discard(rooted)
    return prints.withColumn("salt", salt("doc_id")).join(named, [node, "salt"]).drop("salt")


def near_duplicate_groups(docs: DataFrame, most: int = 4, width: int = 4, blocks: int = 3, reach: int = 1) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text; other columns are left out).

    component_id: the smallest doc_id among all rows that links reach. Rows with a null doc_id take part
    and get the group's smallest id that is not null, or null. Null, empty and word-less texts have the fingerprint
    zero and form links like any others. Repeated rows come out as often as they come in; an empty table gives no rows.
    """
    prints = materialize(with_fingerprint(docs, width), "fingerprints")
    points = materialize(salted_totals(prints, ["fp"], ["doc_id"], rep=(F.min, "doc_id")), "points")
    links = fingerprint_links(points, most, blocks, reach)
    out = grouped(prints, points, links, "fp")
    discard(points, links)
    return out.select("doc_id", "fp", "component_id")


def op3(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    return near_duplicate_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
