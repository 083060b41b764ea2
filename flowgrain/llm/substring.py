"""Substring de-duplication against a log-structured index of window fingerprints.

A window is ``width`` consecutive words. Its fingerprint is the smallest hash of the ``GRAM``-word runs
inside it (a minimizer), so equal windows have equal fingerprints, and neighbours mostly share one: about
one fingerprint for each 18 words is kept instead of one for each window. The index holds immutable runs, each of two
tables: ``heads``, bucketed and sorted by fingerprint, with one row for each of them, and ``rows``, bucketed and sorted
by (fingerprint, salt of the document), with one for each document that holds it. The heads of a new batch are
merge-joined with those of every run, bucket by bucket: neither side is shuffled. Only windows whose fingerprint another
document has are looked up again in the texts; they are equal if the SHA-256 digests of their words are.
The batch's own fingerprints become a new run; ``fan`` runs of a level are merged into one of the next (compaction).

Of equal windows the one in the document of the lowest rank is first: rank is (batch, doc_id). Whole
documents with the same word sequence are resolved by its SHA-256 digest, without their windows.

An index under a ``root`` keeps its texts and a manifest there and can be opened again by another job.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import Words, chunks, inside_document, rolling
from .shared import bucketed, discard, frugal, materialize, open_bucketed, python_batches, salt, salted_totals, salts_of, shared_dir, sifted, text_or_empty

WIDTH, GRAM = 50, 16
#: Runs of one level that are merged into one of the next, and batches into which a whole table is cut.
FAN, BATCHES = 2, 3
HEADS = "print bigint, mask bigint, many boolean"
ROWS = "print bigint, salt int, rank int, doc_id bigint"


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive values, in linear time."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def window_fingerprints(words: Words, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(word positions at which a window starts, its fingerprint), for the windows within documents."""
    gram = min(GRAM, width)
    low = sliding_minimum(rolling(h, gram, 2), width - gram + 1)
    at = np.flatnonzero(inside_document(words, width))
    return at, low[at]


def sha_pairs(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the SHA-256 of each byte string, as two numbers."""
    both = np.frombuffer(b"".join([hashlib.sha256(t).digest()[:16] for t in texts]), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _text(words: Words, keep: np.ndarray | None = None) -> list[bytes]:
    """The (kept) words of each document, joined by one space."""
    body, start, end = words.joined()
    if keep is None:
        bounds = words.bound
        return [body[start[a] : end[b - 1]].tobytes() if b > a else b"" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    mask = np.repeat(keep, end - start + 1)
    rest = body[mask]
    size = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(np.where(keep, end - start + 1, 0), out=size[1:])
    cut = size[words.bound]
    return [rest[a : b - 1].tobytes() if b > a else b"" for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, t, text) with a hash t of the text, which tells rows of one doc_id apart."""
    return python_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("t"), text_or_empty().alias("text"))


def profiles(keyed: DataFrame, width: int = WIDTH) -> DataFrame:
    """For each row: doc_id, t, n_words, two numbers and the whole of the SHA-256 of its word sequence, distinct fingerprints."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, data, off in chunks(b.column(2)):
                words = Words(data, off)
                at, low = window_fingerprints(words, words.hashes(0), width)
                doc = words.doc[at]
                new = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])]) if len(at) else at
                order = new[np.lexsort((low[new], doc[new]))]
                if len(order):
                    order = order[np.r_[True, (low[order][1:] != low[order][:-1]) | (doc[order][1:] != doc[order][:-1])]]
                prints = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(end - row + 1)).astype(np.int32)), pa.array(low[order].view(np.int64)))
                texts = _text(words)
                d0, d1 = sha_pairs(texts)
                yield pa.record_batch(
                    [*(b.column(i).slice(row, end - row) for i in range(2)), pa.array(np.diff(words.bound).astype(np.int64)), pa.array(d0), pa.array(d1), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), prints],
                    ["doc_id", "t", "n_words", "d0", "d1", "sha", "prints"],
                )

    return keyed.mapInArrow(run, "doc_id bigint, t bigint, n_words bigint, d0 bigint, d1 bigint, sha string, prints array<bigint>")


def _matching_windows(texts: DataFrame, width: int) -> DataFrame:
    """(w0, w1, rank, doc_id, t, pos) of each window whose fingerprint is in the row's list ``prints``; w0, w1: digest of its words."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4)
            for row, end, data, off in chunks(b.column(3)):
                words = Words(data, off)
                at, low = window_fingerprints(words, words.hashes(0), width)
                if not len(at):
                    continue
                doc = words.doc[at]
                edge = np.searchsorted(doc, np.arange(end - row + 1))
                hit = np.zeros(len(at), bool)
                for d in range(end - row):
                    if edge[d + 1] > edge[d]:
                        hit[edge[d] : edge[d + 1]] = np.isin(low[edge[d] : edge[d + 1]], np.asarray(lists[row + d].values).view(np.uint64))
                at, doc = at[hit], doc[hit]
                body, start, stop = words.joined()
                raw = memoryview(body)
                w0, w1 = sha_pairs(raw[x:y] for x, y in zip(start[at].tolist(), stop[at + width - 1].tolist(), strict=True))
                own = pa.array(doc)
                yield pa.record_batch([pa.array(w0), pa.array(w1), *(b.column(i).slice(row, end - row).take(own) for i in range(3)), pa.array((at - words.bound[doc]).astype(np.int32))], ["w0", "w1", "rank", "doc_id", "t", "pos"])

    return texts.select("rank", "doc_id", "t", "text", "prints").mapInArrow(run, "w0 bigint, w1 bigint, rank int, doc_id bigint, t bigint, pos int")


def _cut(texts: DataFrame, width: int, with_text: bool) -> DataFrame:
    """(doc_id, t, n_removed, sha[, kept_text]) after the words of the windows at ``starts`` are taken out."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, data, off in chunks(b.column(2)):
                words = Words(data, off)
                step = np.zeros(len(words) + 1, np.int64)
                for d in range(end - row):
                    starts = np.asarray(b.column(3)[row + d].values) + words.bound[d]
                    np.add.at(step, starts, 1)
                    np.add.at(step, starts + width, -1)
                keep = np.cumsum(step)[:-1] == 0
                kept = _text(words, keep)
                gone = np.bincount(words.doc[~keep], minlength=end - row)
                cols = [b.column(0).slice(row, end - row), b.column(1).slice(row, end - row), pa.array(gone.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                names = ["doc_id", "t", "cut", "cut_sha"]
                if with_text:
                    cols, names = [*cols, pa.array([x.decode() for x in kept])], [*names, "kept_text"]
                yield pa.record_batch(cols, names)

    return texts.select("doc_id", "t", "text", "starts").mapInArrow(run, "doc_id bigint, t bigint, cut bigint, cut_sha string" + ", kept_text string" * with_text)


@dataclass
class Run:
    """An immutable run: its level, one row for each fingerprint, and one for each document that holds it."""

    level: int
    heads: DataFrame
    rows: DataFrame


class FingerprintIndex:
    """Historical windows: levels of sorted runs, the digests of whole documents, and where the texts are.

    ``buckets``: of every run, by default the session's shuffle partitions. With a ``root`` (a folder that all executors
    share) texts are kept there too, and :meth:`open` finds the index again; without one its files lie in the shared
    folder, texts are read from the frames that were added, and :meth:`close` deletes the files.
    """

    def __init__(self, spark: SparkSession, width: int = WIDTH, fan: int = FAN, buckets: int | None = None, root: str | None = None):
        self.spark, self.width, self.fan = spark, width, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.keeps = root is not None
        self.root = root or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        self.runs: list[Run] = []
        self.wholes: list[DataFrame] = []
        self.texts: list[DataFrame] = []
        self.batches = 0

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        path = self._path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._flowgrain_path = path
        return out

    def _run(self, level: int, rows: DataFrame) -> Run:
        """Write a run from (print, rank, doc_id) without repeats."""
        own = rows.select("print", salt("rank", "doc_id").alias("salt"), "rank", "doc_id").repartition(self.buckets, "print", "salt")
        held = bucketed(own, self._path("rows"), self.buckets, "print", "salt")
        heads = held.groupBy("print").agg(F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask"), (F.count("*") > 1).alias("many"))
        return Run(level, bucketed(heads, self._path("heads"), self.buckets, "print"), held)

    def _compact(self) -> None:
        """Merge ``fan`` runs of a level into one run of the next."""
        level = 0
        while sum(r.level == level for r in self.runs) >= self.fan:
            merged = [r for r in self.runs if r.level == level]
            rows = merged[0].rows.drop("salt")
            for r in merged[1:]:
                rows = rows.unionByName(r.rows.drop("salt"))
            self.runs = [r for r in self.runs if r.level != level] + [self._run(level + 1, rows)]
            if not self.keeps:
                for r in merged:
                    discard(r.heads, r.rows)
            level += 1

    def _wanted(self, run: Run) -> DataFrame:
        """(rank, doc_id, print) of the documents, old and new, that hold a fingerprint of the new run which another one also has."""
        hits, out = run.heads.where("many").select("print", "mask"), None
        for old in self.runs:
            met = run.heads.select("print", F.col("mask").alias("own")).join(old.heads.select("print", "mask").hint("merge"), "print")
            theirs = met.select("print", salts_of("mask").alias("salt")).hint("merge")
            found = old.rows.join(theirs, ["print", "salt"]).select("rank", "doc_id", "print")
            out = found if out is None else out.unionByName(found)
            hits = hits.unionByName(met.select("print", F.col("own").alias("mask")))
        mine = hits.distinct().select("print", salts_of("mask").alias("salt")).hint("merge")
        found = run.rows.join(mine, ["print", "salt"]).select("rank", "doc_id", "print")
        return found if out is None else out.unionByName(found)

    def add(self, docs: DataFrame, with_text: bool = False) -> DataFrame:
        """Take in a batch and return its rows' doc_id, t (a hash of the text), n_words, n_removed, kept_sha256[, kept_text or null].

        A word goes if a window over it is also in a document of an earlier batch, or of this batch with a
        smaller doc_id. ``kept_text`` is null where no word went. A null text has no words. Rows with a null doc_id are
        neither compared nor indexed; nothing is removed from them. Rows that share a doc_id do not remove words of each
        other. An empty batch gives an empty result.
        """
        rank = self.batches
        self.batches += 1
        keyed = _keyed(docs)
        if self.keeps:
            keyed = self._stored(keyed, "texts")
        seen = materialize(profiles(keyed, self.width), "profiles")
        named = seen.where("doc_id is not null")
        classes = salted_totals(named, ["d0", "d1"], ["doc_id"], first_id=(F.min, "doc_id"))
        known = F.lit(False)
        if self.wholes:
            old = self.wholes[0]
            for w in self.wholes[1:]:
                old = old.unionByName(w)
            classes, known = classes.join(old.withColumn("known", F.lit(True)), ["d0", "d1"], "left"), F.coalesce("known", F.lit(False))
        classes = materialize(classes.select("d0", "d1", "mask", "first_id", known.alias("known")), "classes")
        # Rows of an earlier text class are done; of the others the first of its class is looked at window by window.
        spread = classes.select("d0", "d1", "first_id", "known", salts_of("mask").alias("salt"))
        marked = named.withColumn("salt", salt("doc_id")).join(spread.hint("merge"), ["d0", "d1", "salt"]).withColumn("again", F.col("known") | (F.col("doc_id") > F.col("first_id")))
        marked = materialize(marked.drop("salt", "known", "first_id"), "marked")
        fresh = marked.where("not again")
        run = self._run(0, fresh.select(F.explode("prints").alias("print"), F.lit(rank).alias("rank"), "doc_id").distinct())
        wanted = materialize(self._wanted(run).groupBy("rank", "doc_id").agg(F.collect_set("print").alias("prints")), "wanted")
        texts = None
        for k, source in enumerate([*self.texts, keyed]):
            mine = wanted.where(F.col("rank") == k)
            may, _ = sifted(source, mine.select("doc_id"))
            part = may.join(mine.hint("merge"), "doc_id").select("rank", "doc_id", "t", "text", "prints")
            texts = part if texts is None else texts.unionByName(part)
        texts = materialize(texts, "texts")
        windows = materialize(_matching_windows(texts, self.width).withColumn("salt", salt("rank", "doc_id")), "windows")
        order = F.struct("rank", "doc_id")
        equal = salted_totals(windows, ["w0", "w1"], ["rank", "doc_id"], low=(F.min, order), high=(F.max, order))
        equal = equal.where((F.col("low") < F.col("high")) & (F.col("high.rank") == rank)).select("w0", "w1", "low", salts_of("mask").alias("salt"))
        late = windows.where(F.col("rank") == rank).join(equal.hint("merge"), ["w0", "w1", "salt"]).where(F.col("low") < order)
        starts = late.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("starts"))
        affected = fresh.select("doc_id", "t").distinct().join(starts, ["doc_id", "t"])
        cut = materialize(_cut(texts.where(F.col("rank") == rank).dropDuplicates(["doc_id", "t"]).join(affected, ["doc_id", "t"]), self.width, with_text), "cut")
        discard(texts, windows, wanted, classes)
        self.wholes.append(self._stored(classes_of(marked), "wholes"))
        self.texts.append(keyed)
        self.runs.append(run)
        self._compact()
        if self.keeps:
            self._write_manifest()
        empty = hashlib.sha256(b"").hexdigest()
        all_gone = F.col("again") & (F.col("n_words") >= self.width)
        done = marked.where("again").select("doc_id", "t", "n_words", F.when(all_gone, F.col("n_words")).otherwise(0).alias("n_removed"), F.when(all_gone, F.lit(empty)).otherwise(F.col("sha")).alias("kept_sha256"), F.when(all_gone, F.lit("")).alias("kept_text"))
        changed = cut if with_text else cut.withColumn("kept_text", F.lit(None).cast("string"))
        rest = fresh.join(changed, ["doc_id", "t"], "left").select("doc_id", "t", "n_words", F.coalesce("cut", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"), "kept_text")
        nameless = seen.where("doc_id is null").select("doc_id", "t", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
        out = done.unionByName(rest).unionByName(nameless)
        return out if with_text else out.drop("kept_text")

    def close(self) -> None:
        """Forget the runs; delete their files unless the index has a root of its own. Results that were returned stay readable."""
        if not self.keeps:
            for r in self.runs:
                discard(r.heads, r.rows)
            discard(*self.wholes)
        self.runs, self.wholes, self.texts = [], [], []

    def _write_manifest(self) -> None:
        """One JSON line for each state; the one of most batches is the index."""
        state = {
            "width": self.width,
            "fan": self.fan,
            "buckets": self.buckets,
            "batches": self.batches,
            "runs": [[r.level, r.heads._flowgrain_path, r.rows._flowgrain_path] for r in self.runs],
            "wholes": [w._flowgrain_path for w in self.wholes],
            "texts": [x._flowgrain_path for x in self.texts],
        }
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.root}/manifest/{self.batches:08d}")

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> FingerprintIndex:
        """The index under ``root`` as its last finished batch left it."""
        states = [json.loads(r[0]) for r in spark.read.text(f"{root}/manifest/*").collect()]
        state = max(states, key=lambda x: x["batches"])
        out = cls(spark, state["width"], state["fan"], state["buckets"], root)
        out.batches = state["batches"]
        for level, heads, rows in state["runs"]:
            out.runs.append(Run(level, open_bucketed(spark, HEADS, heads, out.buckets, "print"), open_bucketed(spark, ROWS, rows, out.buckets, "print", "salt")))
        for name, kept in (("wholes", out.wholes), ("texts", out.texts)):
            for path in state[name]:
                df = spark.read.parquet(path)
                df._flowgrain_path = path
                kept.append(df)
        return out


def classes_of(marked: DataFrame) -> DataFrame:
    """(d0, d1) of the text classes that are new with this batch."""
    return marked.where("not again").select("d0", "d1").distinct()


def in_batches(docs: DataFrame, batches: int = BATCHES, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """Feed a whole table to a new index in ``batches`` ranges of doc_id, smallest first; all rows' results.

    As ranks then follow doc_id, a word goes exactly if a window over it is also in a document with a
    smaller doc_id. Rows with a null doc_id come with the first batch.
    """
    index, out = FingerprintIndex(docs.sparkSession, width), None
    cuts = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    key = F.col("doc_id").cast("bigint")
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = docs
        if low is not None:
            part = part.where(key > low)
        if high is not None:
            part = part.where((key <= high) | (key.isNull() if low is None else F.lit(False)))
        done = index.add(part, with_text)
        out = done if out is None else out.unionByName(done)
    index.close()
    return out


def op6(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document; see :meth:`FingerprintIndex.add`."""
    return in_batches(docs, batches).select("doc_id", "n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text`` (their words then joined by one space).

    Documents of which nothing is left go; all others stay, unchanged where no word went. An ``n_chars``
    column follows the text. Rows with a null doc_id stay unchanged.
    """
    done = materialize(in_batches(docs, batches, with_text=True).where("n_removed > 0").select("doc_id", "t", "kept_text", "n_words", "n_removed").distinct(), "repeats")
    may, surely = sifted(docs, done.select("doc_id"))
    own = may.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("t"))
    joined = own.join(done.hint("merge"), ["doc_id", "t"], "left").where("kept_text is null or n_removed < n_words")
    new = {"text": F.coalesce("kept_text", "row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(F.char_length("kept_text").cast(docs.schema["n_chars"].dataType))
    return surely.unionByName(joined.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns)))
