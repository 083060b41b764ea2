import zlib
from collections import Counter

from pyspark.sql import functions as F

from flowgrain.llm import sharding


def test_records_move_only_into_the_new_shard(spark):
    texts = [None, "", "é", "x" * 50_000, *[f"t{i % 7}" for i in range(3000)]]
    rows = [(None if i == 9 else i % 2500, t, "k") for i, t in enumerate(texts)] + [(77, "same", "k")] * 400
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    got = sharding.op10(df).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    shard = {}
    for r in got:
        assert shard.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16) and r.law == "key"
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    share = Counter(s for s, _ in shard.values())
    assert 80 < min(share.values()) and max(share.values()) < 240
    assert 80 < sum(g == 16 for _, g in shard.values()) < 220
    assert sharding.op10(df.limit(0)).count() == 0


def test_shares_follow_the_weights(spark):
    ids = spark.range(40_000)
    got = {r["s"]: r["n"] for r in ids.groupBy(sharding.rendezvous(F.col("id"), [1, 2, 0, 5]).alias("s")).agg(F.count("*").alias("n")).collect()}
    assert set(got) == {0, 1, 3} and abs(got[3] - 25_000) < 800 and abs(got[1] - 10_000) < 600


def test_slots_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 100)
    rows = spark.range(5000).selectExpr("id as doc_id", "id % 3 as shard").union(spark.range(300).selectExpr("5L as doc_id", "2L as shard"))
    got = sharding.slots(rows, "shard", ["doc_id"]).collect()
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len(got) == 5300
