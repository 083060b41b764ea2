"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard gets a score from the hash of (key, shard): -weight / ln(u), u being the hash as a number
between 0 and 1. The shard with the largest score takes the record. A new shard changes nothing in the
scores of the old ones, so a record either stays or moves into the new shard; a shard's share is its
weight's share. Expressions only, no shuffle; the slots within a shard need one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialize, text_or_empty

#: Rows for which one task numbers the slots, about.
SLOT_ROWS = 1 << 16


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """A record's score for one shard: positive, larger for larger weights."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(shard), key), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.lit(-float(weight)) / F.log(unit)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a record; a weight of zero or less leaves a shard empty."""
    scores = [F.struct(score(key, i, w).alias("s"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("no shard has a weight")
    return (scores[0] if len(scores) == 1 else F.greatest(*scores))["shard"]


def slots(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Number the rows of each ``group`` from 0 without gaps as ``slot``, without one task for a group.

    Equal rows are counted first, then numbered in buckets by hash whose offsets come from bucket counts.
    """
    held = materialize(rows.groupBy(*rows.columns).agg(F.count("*").alias("n__")), "slots")
    buckets = max(1, held.count() // SLOT_ROWS)
    held = held.withColumn("b__", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = held.groupBy(group, "b__").agg(F.sum("n__").alias("in__"))
    base = sizes.select(group, "b__", (F.sum("in__").over(Window.partitionBy(group).orderBy("b__")) - F.col("in__")).alias("base__"))
    within = Window.partitionBy(group, "b__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = held.withColumn("before__", F.coalesce(F.sum("n__").over(within), F.lit(0))).join(base, [group, "b__"])
    return numbered.select(*rows.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n__") - 1)).alias("k__"), "before__", "base__").select(
        *rows.columns, (F.col("base__") + F.col("before__") + F.col("k__")).alias("slot")
    )


def op10(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard, slot and the shard of one more shard for every document.

    A null text has no bytes (size 1, checksum 0); all rows with a null doc_id have one shard; rows of one
    doc_id share a shard whatever else they hold; repeated rows get slots of their own.
    """
    key = F.col("doc_id").cast("bigint")
    body = F.encode(text_or_empty(), "UTF-8")
    placed = docs.select(
        key.alias("doc_id"),
        (F.octet_length(body).cast("bigint") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        rendezvous(key, [1.0] * shards).alias("shard"),
        rendezvous(key, [1.0] * (shards + 1)).alias("grown_shard"),
    )
    done = slots(placed, "shard", ["doc_id", "size", "text_crc32"])
    return done.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
