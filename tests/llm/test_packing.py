import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing


def best_fit_decreasing(lengths, capacity):
    free = []
    for x in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= x]
        if fits:
            free[free.index(min(fits))] -= x
        else:
            free.append(capacity - x)
    return len(free), sorted(free)


def test_plan_equals_best_fit_by_piece():
    rng = random.Random(3)
    for capacity in (7, 20, 100):
        for _ in range(60):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 120))]
            runs = packing.plan(dict(Counter(lengths)), capacity)
            bins, used = defaultdict(list), Counter()
            for length, a, b, each, first, base in runs:
                assert used[length] == a
                used[length] = b
                for i in range(b - a):
                    bins[first + i // each].append((base + i % each * length, length))
            assert dict(used) == dict(Counter(lengths))
            for places in bins.values():
                at = 0
                for offset, length in sorted(places):
                    assert offset == at
                    at += length
                assert at <= capacity
            assert best_fit_decreasing(lengths, capacity) == (len(bins), sorted(capacity - sum(x for _, x in b) for b in bins.values()))


def test_pack_matches_the_library(spark):
    lib = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = ["", None, "Hello, World!  don't <|endoftext|> x<|startoftext|>y", "a\x1cb\x1d c", "İSTANBUL Σας ΣΑΣ ẞ é é", "word " * 5000, "x" * 9000, "中文 字", "same", "same", "tab\tnl\n\nend "] + [f"w{i} " * (i * 7 % 400) for i in range(200)]
    df = spark.createDataFrame([(i if i % 50 else 0, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    got = packing.pack(df).collect()
    want = []
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((i if i % 50 else 0, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == best_fit_decreasing([w[3] for w in want], 2048)[0]
    assert packing.pack(df.limit(0)).count() == 0
