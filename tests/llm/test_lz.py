import base64
import hashlib
import struct

import numpy as np
import xxhash

from tessera.llm import lz


def brute_phrases(text):
    seen, out, i = set(), [], 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in seen:
            j += 1
        if j > len(text):
            break
        seen.add(text[i:j])
        out.append(text[i:j])
        i = j
    return out


def brute_signature(phrases):
    """The least hash of each of 128 bins, told by its leading 7 bits, in 16 bits; 0 where
    there is none."""
    bins = {}
    for h in (xxhash.xxh64(p.encode()).intdigest() for p in phrases):
        bins[h >> 57] = min(h, bins.get(h >> 57, h))
    return [1 + (bins[b] * 0x9E3779B97F4A7C15 % 2**64 >> 48) % 65535 if b in bins else 0 for b in range(128)]


def brute_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def test_parse_matches_brute_force():
    for t in ["", "a", "aaaaaaa", "abracadabra abracadabra", "日本語日本語 日本", "x" * 1000]:
        assert lz.parse(t)[0] == brute_phrases(t)
        half = len(t) - len(t) // 2
        f = lz.Fingerprint(t)
        assert np.array_equal(f.sig, brute_signature(brute_phrases(t)))
        edited, sig = f.edited("other text for the tail")
        assert edited == t[:half] + "other text for the tail"[: len(t) // 2]
        assert np.array_equal(sig, brute_signature(brute_phrases(edited)))


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.3, 0.7, 1.0):
        a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        b = np.concatenate((a[: int(4000 * share)], rng.integers(0, 1 << 63, 4000 - int(4000 * share), dtype=np.uint64)))
        want = share / (2 - share)
        assert abs(lz.likeness(lz.signature(a), lz.signature(b)) - want) < 0.15


def test_next_document_and_edits(spark):
    texts = ["the quick brown fox " * 5, "jumps over the lazy dog " * 9, None, "", "é" * 7, "same same", "same same", "z"] * 6
    rows = [((i * 7) % 101 if i % 17 else 5, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    ordered = sorted([(-(1 << 63) if i is None else i, t is not None, t or "") for i, t, _ in rows])
    want = []
    for k, (i, _, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][2]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = (brute_signature(brute_phrases(x)) for x in (t, edited, nxt))
        text = lambda sig: base64.b64encode(struct.pack("<128H", *sig)).decode()
        want.append((None if i == -(1 << 63) else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), brute_likeness(a, b), brute_likeness(a, c)))
    for parts in ("1", "4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = [tuple(r) for r in lz.compare_with_next(df).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert lz.compare_with_next(df.limit(0)).count() == 0
    one = lz.compare_with_next(spark.createDataFrame([(3, "abcd", 1)], "doc_id long, text string, x int")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(3, 1.0)]
