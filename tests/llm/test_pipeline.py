import gc
import random

from test_decontam import brute as brute_decontam
from test_near_copies import representatives
from test_substring import brute as brute_substring

from flowgrain.llm import packing, pipeline, quality, shared
from flowgrain.llm.tokens import encoder, vocabulary


def brute_groups(rows):
    """doc_id kept of each group that pairs of similarity 0.8 connect, over all pairs (five-word shingles)."""
    return representatives([(d, (t or "").lower().split()) for d, t in rows])


def test_every_stage_equals_brute_force(spark, tmp_path):
    rng = random.Random(21)
    syllables = ["tion", "er", "an", "the", "ou", "re", "in", "st", "ly", "ed"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    passage, item = prose(70), prose(25)
    rows = []
    for i in range(160):
        w = prose(rng.randint(5, 150))
        if i % 5 == 0:
            w[3:3] = passage
        if i % 11 == 0:
            w[2:2] = item
        if i % 13 == 0:
            w = [x + "$$%" for x in w]
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(200 + i, rows[i][1], "en", "s", 0) for i in range(30)] + [(300, None, None, None, None), (301, "", "en", "s", 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 13 != 0), 0) for i in range(0, 160, 2)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append((before, docs))
        if name != "best-fit packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before, after = seen[0]
    assert set(texts(after)) == {d for d in before if (d if d < 200 else d - 200) % 13 or d >= 300}
    before, after = seen[1]
    assert set(texts(after)) == brute_groups(list(before.items()))
    before, after = seen[2]
    want = {d: (n, gone, sha) for d, n, gone, sha in brute_substring(list(before.items()), 50)}
    got = texts(after)
    assert set(got) == {d for d, (n, gone, _) in want.items() if not gone or gone < n}
    import hashlib

    assert all(hashlib.sha256(" ".join((t or "").split()).encode()).hexdigest() == want[d][2] for d, t in got.items())
    before, after = seen[3]
    assert set(texts(after)) == set(before) - {d for d, _ in brute_decontam(list(before.items()), [(1, " ".join(item))])}
    before, after = seen[4]
    ids = {d: len(encoder(vocabulary()).full.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in before.items()}
    total = {}
    for r in after.collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == ids
    whole = pipeline.run(spark, str(tmp_path))
    strip = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert strip(whole) == strip(after)
    assert quality.ORDER == 4 and packing.CAPACITY == 4096


def test_nulls_repeats_other_columns_and_empty_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, salt int"
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "s", 9, "a", 1), (1, text, "en", "s", 9, "a", 1), (None, text, None, None, None, None, None), (2, None, "en", "s", 0, "b", 2), (3, "", None, "s", 0, "c", 3), (4, "own words " + text, "en", "s", 9, "d", 4)]
    for name, data in (("some", rows), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] if data else [], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "quite another item of the benchmark with words")] if data else [], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        got = sorted((r.doc_id or 0, r.piece) for r in pipeline.run(spark, d).collect())
        # The repeated row and the second empty text are copies; the row without an id passes.
        assert got == ([(0, 0), (1, 0), (2, 0)] if data else [])


def test_stages_begin_with_small_heaps(spark):
    """In local mode the executor's heap is the driver's; what a stage left behind is gone when the next one begins."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    docs = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    spark.range(2_000_000).selectExpr("sum(length(repeat(cast(id as string), 50)))").collect()
    used, before = heap.totalMemory() - heap.freeMemory(), beans()
    pipeline.best_fit_packing(spark, docs, "").count()
    assert beans() > before
    pipeline.shrink_heaps(spark)
    assert heap.totalMemory() - heap.freeMemory() < used
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "best-fit packing"]


def test_stages_return_the_drivers_free_memory(spark, monkeypatch):
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    spark.sparkContext._gateway.new_array(spark._jvm.long, 60 << 20)
    gc.collect()
    grown = runtime.totalMemory()
    trimmed = []
    monkeypatch.setattr(shared, "manage", lambda s, bean, operation, *args, f=shared.manage: (trimmed.append(operation), f(s, bean, operation, *args))[1])
    asked = pipeline.stage(lambda s, docs, sf_dir: runtime.totalMemory())(spark, None, "")
    assert asked < grown and "systemTrimNativeHeap" in trimmed
    assert shared.manage(spark, "HotSpotDiagnostic", "getVMOption", "MaxHeapFreeRatio").get("value") == "70"
    before = len(trimmed)
    shared.tidy_driver(spark)
    assert len(trimmed) == before
