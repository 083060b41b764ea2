import random
import zlib
from itertools import product

import numpy as np
import pytest

from flowgrain.llm import packing
from flowgrain.llm.tokens import encoder

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def fewest(lengths, capacity):
    """The least number of bins, by trying all placements of a few items."""
    best = len(lengths)
    for place in product(range(len(lengths)), repeat=len(lengths)):
        fill = np.bincount(place, lengths)
        if fill.max() <= capacity:
            best = min(best, len(set(place)))
    return best


def test_bound_never_exceeds_the_best_packing():
    rng = random.Random(2)
    for _ in range(25):
        lengths = np.array([rng.randint(1, 20) for _ in range(rng.randint(1, 5))])
        bins = packing.best_fit(lengths, 20)
        assert np.bincount(bins, lengths).max() <= 20
        assert packing.lower_bound(lengths, 20) <= fewest(lengths, 20) <= bins.max() + 1


def test_encoder_equals_the_library():
    full, e = encoder(PATH).full, encoder(PATH)
    rng = random.Random(4)
    texts = ["", " ", "Don't STOP we've'll 12345 a1b2", "É Å ñ ΟΔΟΣ İ", "日本語 한국어", "a\x1cb", "<|endoftext|> x", "\x85 a", "😀 ...,,!!a--b", "ﬁ ª"]
    texts += ["".join(chr(rng.choice([rng.randint(0, 127), rng.randint(0, 0x24F), rng.randint(0, 0x3000)])) for _ in range(50)) for _ in range(300)]
    assert e.fast
    assert e.encode_batch(texts) == [full.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_piece_has_its_own_place(spark):
    rng = random.Random(6)
    texts = [None, "", "word " * 9000, *[" ".join(rng.choice(["the", "theory", "of", "x1!"]) for _ in range(rng.randint(1, 3000))) for _ in range(60)], "same text", "same text"]
    rows = [(i % 62, t, 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length int")
    got = packing.op8(df, PATH, part_items=8).collect()
    want = []
    for d, t, _ in rows:
        ids = [*encoder(PATH).full.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    place = {}
    for r in got:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in place.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and sum(p[-1]) <= 4096
    lengths = np.array([w[3] for w in want])
    assert len(place) <= packing.best_fit(lengths).max() + 4  # partitions of 8 pieces only
    assert packing.op8(df.limit(0), PATH).count() == 0
