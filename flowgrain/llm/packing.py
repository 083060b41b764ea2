"""Best-fit packing of token pieces into sequences, with lower bounds that certify the number of sequences.

Pieces are dealt out to partitions of bounded size, each of which runs best-fit decreasing and compares
its bins with lower bounds from dual-feasible functions of its lengths. A partition whose count meets the
bound is certified and releases only its emptiest bin; one with a gap releases its emptiest bins, more
of them the larger the gap. Released bins are exchanged: they meet in fewer partitions, as whole bins, so a
repacking that is no better falls back to them. Rounds end when one partition holds all that was released.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import spans
from .shared import discard, frugal, materialize, python_batches, text_or_empty
from .tokens import encoder, ragged

CAPACITY, END = 4096, 1
#: Pieces that one partition packs, about.
PART = 1 << 16
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The token pieces of every document: its ids and END, cut where longer than ``capacity``. A null text is empty.

    ``vocabulary`` is the file's path on every executor.
    """
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for b in batches:
            for row, end in spans(b.column(1)):
                own, bound = encode(b.column(1).slice(row, end - row))
                bound = bound + np.arange(end - row + 1)
                ids = np.full(bound[-1], END, "<u4")
                inner = np.ones(len(ids), bool)
                inner[bound[1:] - 1] = False
                ids[inner] = own
                total = np.diff(bound)
                count = -(-total // capacity)
                doc = np.repeat(np.arange(end - row), count)
                piece = ragged(np.zeros(len(count), np.int64), count)
                first = bound[doc] + piece * capacity
                length = np.minimum(total[doc] - piece * capacity, capacity)
                stop, raw = first + length, memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(first.tolist(), stop.tolist(), strict=True)]
                cols = [b.column(0).slice(row, end - row).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[first, len(ids)].astype(np.int32)), pa.array(ids.view(np.int32))))
                yield pa.record_batch(cols, names)

    return python_batches(docs).select(F.col("doc_id").cast("bigint"), text_or_empty()).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing: a bin number for each item. Ties go to the item that comes first and to the newest bin."""
    out = np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = some >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        left = room - n
        if not free[left]:
            some |= 1 << left
        free[left].append(b)
        out[i] = b
    return out


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest of several dual-feasible-function bounds on the number of bins."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    # Items above capacity - t count as whole bins, those below t not at all, others by their size.
    mass, items = np.cumsum(count * size), np.cumsum(count)
    t = np.arange(1, capacity // 2 + 1)
    whole = items[-1] - items[capacity - t]
    middle = mass[capacity - t] - mass[t - 1]
    best = max(best, int((whole + -(-middle // capacity)).max(initial=0)))
    for k in range(1, 33):  # x if (k + 1) x is whole, else floor((k + 1) x) / k
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def pack_part(lengths: np.ndarray, old: np.ndarray | None, last: bool, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin of each item, whether its bin is released, lower bound); ``old``: the bins that they came in."""
    bins = best_fit(lengths, capacity)
    if old is not None:
        back = np.unique(old, return_inverse=True)[1]
        if back.max(initial=-1) <= bins.max(initial=-1):
            bins = back
    n = int(bins.max(initial=-1)) + 1
    bound = lower_bound(lengths, capacity)
    release = np.zeros(n, bool)
    if not last and n:
        fill = np.bincount(bins, lengths, n)
        release[np.argsort(fill, kind="stable")[: 1 + 8 * (n - bound)]] = True
    return bins, release[bins], bound


def offsets(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each item begins in its bin, the items of a bin one after the other."""
    order = np.argsort(bins, kind="stable")
    total = np.cumsum(lengths[order]) - lengths[order]
    first = np.r_[True, bins[order][1:] != bins[order][:-1]] if len(bins) else np.zeros(0, bool)
    out = np.zeros(len(bins), np.int64)
    out[order] = total - np.repeat(total[first], np.diff(np.r_[np.flatnonzero(first), len(bins)]))
    return out


def _packer(last: bool, round_: int, capacity: int):
    """The function that packs one partition of a round; 24 bits of a bin's number are its place in the partition, 24 the partition."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        lengths = pdf["length"].to_numpy(np.int64)
        bins, released, _ = pack_part(lengths, pdf["bin"].to_numpy(np.int64) if round_ else None, last, capacity)
        where = (round_ << 48) + (int(pdf["part"].iloc[0]) << 24) + bins
        return pd.DataFrame({"uid": pdf["uid"].to_numpy(), "length": lengths.astype(np.int32), "bin": where, "offset": offsets(bins, lengths), "released": released})

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, part_items: int = PART) -> DataFrame:
    """Adds sequence_id and offset to a stored table with ``length`` (1 to capacity) and a unique bigint ``uid``."""
    full = items.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    todo = items.where(F.col("length") < capacity).select("uid", F.col("length").cast("int").alias("length"), F.lit(None).cast("bigint").alias("bin"))
    total = todo.count()
    done, round_, dealt = full, 0, None
    while total:
        parts = max(1, -(-total // part_items)) if round_ == 0 else max(1, min(parts - 1, -(-total // part_items)))
        last = parts == 1
        key = F.xxhash64("uid") if round_ == 0 else F.xxhash64("bin")
        dealt = materialize(
            todo.withColumn("part", F.pmod(key, F.lit(parts)).cast("int")).groupBy("part").applyInPandas(_packer(last, round_, capacity), "uid bigint, length int, bin bigint, offset bigint, released boolean"), "packed"
        )
        done = done.unionByName(dealt.where("not released").select("uid", F.col("bin").alias("sequence_id"), "offset"))
        todo = dealt.where("released").select("uid", "length", "bin")
        total = 0 if last else todo.count()
        round_ += 1
    return items.join(done, "uid").drop("uid")


def op8(docs: DataFrame, vocabulary: str, part_items: int = PART) -> DataFrame:
    """Every piece of every document with its place: sequence_id, and offset within the sequence.

    Null texts give one piece of the end id alone; repeated rows are packed each for itself; an empty table
    gives no rows.
    """
    cut = materialize(pieces(docs, vocabulary).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pack(cut, part_items=part_items).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
