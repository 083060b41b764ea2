"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The symbols are the UTF-16 code units of a text, as they are, with runs of white space as one space and a word that
repeats the word before it as one symbol: every script has its own letters, and an n-gram of four symbols is one 64-bit number, its context and its lower orders are shifts of it. The counts of
all trusted documents are Spark tables, dealt by n-gram, that grow with the text; lower orders are aggregated from
higher ones, and nothing of a model is brought to one place but the four counts of counts of each order.

Documents are read in blocks of about ``BLOCK`` bytes. Each block gives its distinct n-grams; the distinct n-grams of all blocks are
joined with the count tables order by order, which gives each its probability, and every block gets back those of its
own. So what is shuffled are a block's distinct n-grams, not a document's. The threshold of a language is a quantile
of the perplexity of its trusted documents.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import SPACE, Words, chunks
from .shared import bucketed, discard, frugal, give_back, materialize, python_batches, shared_dir, text_or_empty, with_ids, without_ids

ORDER, UNIT, AGAIN = 4, 1 << 16, 0x1A
#: Bytes of text in one block.
BLOCK = 16 << 20


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code units of a chunk of documents and their bounds; white space runs are one space, none at a document's ends.

    A word that repeats the word before it is the one symbol ``AGAIN``: no four symbols could show the repetition.
    """
    words = Words(data, off)
    h = words.hashes(0)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[words.bound[:-1][words.bound[:-1] < len(h)]] = False
    if again.any():
        step = np.zeros(len(data) + 1, np.int64)
        np.add.at(step, words.start[again] + 1, 1)
        np.add.at(step, words.end[again], -1)
        # The white space before it goes, too: a run of repetitions is a run of this symbol.
        np.add.at(step, words.end[:-1][again[1:]], 1)
        np.add.at(step, words.start[again], -1)
        stays = np.cumsum(step)[:-1] == 0
        data = data.copy()
        data[words.start[again]] = AGAIN
        off = np.r_[0, np.cumsum(stays)][off]
        data = data[stays]
    units = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-16-le", "surrogatepass"), "<u2")
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data & 0xC0) != 0x80).astype(np.int64) + (data >= 0xF0), out=count[1:])
    bound = count[off]
    space = (units < 256) & SPACE[units & 0xFF]
    before = np.ones(len(units), bool)
    before[1:] = space[:-1]
    before[bound[:-1][bound[:-1] < len(units)]] = True
    keep = ~(space & before)
    # A last run of white space goes as well.
    total = np.zeros(len(units) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    last = bound[1:][np.diff(bound) > 0] - 1
    ends = last[space[last]]
    kept = np.flatnonzero(keep)
    final = kept[np.maximum(total[ends + 1] - 1, 0)]
    firsts = bound[np.searchsorted(bound, ends, "right") - 1]
    keep[final[(final >= firsts) & space[final]]] = False
    np.cumsum(keep, out=total[1:])
    out = units[keep].copy()
    out[space[keep]] = 32
    return out, total[bound]


def ngrams(stream: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, its document) for each symbol of a document and its end, with spaces before its beginning; an empty one has none."""
    size = np.diff(bounds)
    n = len(size)
    wide = np.where(size > 0, size + ORDER, 0)
    start = np.cumsum(wide) - wide
    padded = np.full(int(wide.sum()), 32, np.uint64)
    doc = np.repeat(np.arange(n), size)
    padded[np.arange(len(stream)) + (start - bounds[:-1] + ORDER - 1)[doc]] = stream
    if not len(padded):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.zeros(len(padded) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        key = (key << np.uint64(16)) | padded[i : len(padded) - ORDER + 1 + i]
    own = np.repeat(np.arange(n), wide)[: len(key)]
    inside = np.arange(len(key)) + ORDER <= (start + wide)[own]
    return key[inside].view(np.int64), own[inside]


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(key, n) of all documents: each batch counts what it reads, Spark sums by n-gram."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [ngrams(*symbols(data, off))[0] for _, _, data, off in chunks(b.column(0))]
            code, key = pd.factorize(np.concatenate([np.zeros(0, np.int64), *found]))
            yield pa.record_batch([pa.array(key), pa.array(np.bincount(code, minlength=len(key)))], ["key", "n"])

    return python_batches(docs).select(text_or_empty()).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def discounts(counts: dict[int, int]) -> list[float]:
    """The three discounts of modified Kneser-Ney from the numbers of n-grams that occur 1, 2, 3 and 4 times; the first is zero."""
    n = [counts.get(i, 0) for i in range(1, 5)]
    if min(n) == 0:
        return [0.0, 0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [0.0, *(min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3))]


def suffix(key: str | Column, order: int) -> Column:
    """The last order - 1 symbols of an n-gram."""
    return F.expr(f"{key} & {(1 << 16 * (order - 1)) - 1}L")


class KneserNey:
    """Count tables of all orders: of the highest how often an n-gram occurs, of the lower ones after how many different symbols."""

    def __init__(self, trusted: DataFrame):
        self.counts = {ORDER: materialize(count_ngrams(trusted), "counts")}
        for k in range(ORDER - 1, 0, -1):
            self.counts[k] = materialize(self.counts[k + 1].select(suffix("key", k + 1).alias("key")).groupBy("key").agg(F.count("*").alias("n")), "counts")
        self.cut = {}
        for k, c in self.counts.items():
            self.cut[k] = discounts({r[0]: r[1] for r in c.where("n < 5").groupBy("n").count().collect()})

    def _discount(self, k: int) -> Column:
        d = self.cut[k]
        return F.when(F.col("n") >= 3, d[3]).when(F.col("n") == 2, d[2]).otherwise(d[1])

    def probabilities(self, wanted: DataFrame, k: int = ORDER) -> DataFrame:
        """(key, p) of each distinct n-gram of ``wanted`` (key): p of its last symbol after the others."""
        d = self._discount(k)
        if k == 1:
            whole = self.counts[1].agg(F.sum("n").alias("total"), F.sum(d).alias("gap")).first()
            if not whole.total:
                return wanted.select("key", F.lit(1.0 / UNIT).alias("p"))
            share = (F.col("n") - d) / F.lit(float(whole.total))
            return wanted.join(self.counts[1], "key", "left").select("key", (F.coalesce(share, F.lit(0.0)) + F.lit(whole.gap / whole.total / UNIT)).alias("p"))
        lower = self.probabilities(wanted.select(suffix("key", k).alias("key")).distinct(), k - 1).select(F.col("key").alias("low"), F.col("p").alias("below"))
        contexts = self.counts[k].groupBy(F.expr("shiftrightunsigned(key, 16)").alias("context")).agg(F.sum("n").alias("total"), F.sum(d).alias("gap"))
        all_of = wanted.select("key", F.expr("shiftrightunsigned(key, 16)").alias("context"), suffix("key", k).alias("low"))
        joined = all_of.join(self.counts[k], "key", "left").join(contexts, "context", "left").join(lower, "low")
        share = F.coalesce((F.col("n") - d) / F.col("total"), F.lit(0.0))
        return joined.select("key", (share + F.coalesce(F.col("gap") / F.col("total"), F.lit(1.0)) * F.col("below")).alias("p"))

    def close(self) -> None:
        discard(*self.counts.values())


def blocks(docs: DataFrame) -> DataFrame:
    """(block, body, keys): documents in blocks, compressed as they are, and the distinct n-grams of each block."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, keys, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for x in held:
                    w.write_batch(x)
            distinct = pd.unique(np.concatenate(keys))
            return pa.record_batch([pa.array([(part << 32) | number]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([distinct], pa.list_(pa.int64()))], ["block", "body", "keys"])

        for b in batches:
            held.append(b)
            for _, _, data, off in chunks(b.column(2)):
                keys.append(pd.unique(ngrams(*symbols(data, off))[0]))
                size += len(data)
            if size >= BLOCK:
                yield close()
                number, held, keys, size = number + 1, [], [], 0
        if held:
            yield close()

    rows = python_batches(docs).select(F.col("doc_id").cast("bigint"), F.coalesce("lang", F.lit("")).alias("lang"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "block bigint, body binary, keys array<bigint>")


def score(docs: DataFrame, model: KneserNey) -> DataFrame:
    """(doc_id, lang, bits): mean bits for each symbol; the perplexity is 2 ** bits. A text without symbols has null."""
    spark = docs.sparkSession
    # Bucketed, so that the texts stay where they are and only the answers come to them.
    held = bucketed(blocks(docs), f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
    asked = held.select("block", F.explode("keys").alias("key"))
    known = materialize(model.probabilities(asked.select("key").distinct()).select("key", (-F.log2("p")).cast("float").alias("bits")), "probabilities")
    answers = asked.join(known, "key").select(F.col("block").alias("of"), "key", "bits")

    def run(body: pa.Table, own: pa.Table) -> pa.Table:
        index = pd.Index(own.column("key").to_numpy())
        bits = own.column("bits").to_numpy()
        out = []
        for raw in body.column("body"):
            for b in pa.ipc.open_stream(raw.as_buffer()):
                for row, end, data, off in chunks(b.column(2)):
                    key, doc = ngrams(*symbols(data, off))
                    n = np.bincount(doc, minlength=end - row)
                    total = np.bincount(doc, bits[index.get_indexer(key)] if len(key) else None, end - row)
                    out.append(pa.record_batch([b.column(0).slice(row, end - row), b.column(1).slice(row, end - row), pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0)], ["doc_id", "lang", "bits"]))
        give_back()
        return pa.Table.from_batches(out)

    schema = "doc_id bigint, lang string, bits double"
    scored = materialize(held.select("block", "body").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(run, schema), "scored")
    discard(held, known)
    return scored


@dataclass(frozen=True)
class Rule:
    """A document is rejected above ``margin`` times the bits at ``quantile`` of its language's trusted ones.

    Languages with fewer than ``least`` trusted documents take the threshold of all languages.
    """

    quantile: float = 0.99
    margin: float = 1.1
    least: int = 50


def thresholds(trusted_scores: DataFrame, rule: Rule) -> DataFrame:
    """(lang, threshold in bits); lang null is for all others. Exact quantiles over bits rounded up to 0.001."""
    steps = trusted_scores.where("bits is not null").groupBy("lang", F.ceil(F.col("bits") * 1000).alias("step")).agg(F.count("*").alias("n"))
    both = steps.unionByName(steps.groupBy("step").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string")))
    w = Window.partitionBy("lang")
    below = both.withColumn("upto", F.sum("n").over(w.orderBy("step"))).withColumn("all", F.sum("n").over(w))
    return below.where((F.col("upto") >= F.col("all") * rule.quantile) & ((F.col("all") >= rule.least) | F.col("lang").isNull())).groupBy("lang").agg((F.min("step") / 1000 * rule.margin).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) of every row of ``docs``.

    Trusted are the documents whose labels hold quality 1 and none other. A null or word-less text has a
    null perplexity and is kept, as are all where no trusted text exists. A null language is the empty one. A long text is
    scored whole; repeated rows repeat; an empty table gives no rows.
    """
    trusted_ids = labels.groupBy(F.col("doc_id").cast("bigint").alias("trusted_id")).agg(F.min("quality").alias("q")).where("q = 1").select("trusted_id")
    trusted_ids = materialize(trusted_ids, "trusted")
    trusted = with_ids(docs.select("doc_id", "text"), trusted_ids)
    model = KneserNey(trusted)
    scored = score(docs, model)
    model.close()
    limits = thresholds(scored.join(trusted_ids, F.col("doc_id") == F.col("trusted_id"), "left_semi"), rule)
    general = limits.where("lang is null").select(F.col("threshold").alias("general"))
    own = limits.where("lang is not null").select(F.col("lang").alias("lang_"), "threshold")
    first = general.first()
    limit = F.coalesce("threshold", F.lit(first.general if first else math.inf))
    joined = scored.join(own, F.col("lang") == F.col("lang_"), "left")
    return joined.select("doc_id", "lang", F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), limit).alias("threshold"), F.coalesce(F.col("bits") <= limit, F.lit(True)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps; all rows of a doc_id go with its worst row."""
    bad = materialize(classify(docs, labels, rule).where("not keep").select(F.col("doc_id").alias("bad_id")).distinct(), "rejected")
    return without_ids(docs, bad)
