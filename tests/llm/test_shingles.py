import random

import numpy as np
import pytest

from tessera.llm import shingles, simhash


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return not (a or b) or 10 * len(a & b) >= 8 * len(a | b)


def brute(rows):
    """The smallest doc_id reachable over pairs of similarity 0.8 or more."""
    sets, label = [brute_set(t) for _, t in rows], [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and similar(sets[i], sets[j]):
                    lo, hi = sorted((label[i], label[j]))
                    label = [lo if x == hi else x for x in label]
                    changed = True
    return {i: c for (i, _), c in zip(rows, label)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 120, 200, 300]))) for _ in range(40)]
    for t in list(texts):  # from one changed word, which links, to many, which do not
        for changes in (1, 2, 3, 5, 9):
            w = t.split()
            for _ in range(changes):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(vocab) for _ in range(100)) for _ in range(30)]
    long = " ".join(rng.choice(vocab) for _ in range(300)).split()
    texts += [" ".join(long[k : k + 200]) for k in range(0, 100, 10)]  # a chain of near copies
    texts += [None, "", " \n", texts[0], texts[0].upper(), "a b", "A  b"]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def test_components_match_brute_force_jaccard(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, cls string")
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in shingles.near_copies(docs).collect()} == want
    assert len(set(want.values())) < len(rows) - 60
    kept = shingles.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_pipeline_stage_links_at_080(spark, rows):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()} == set(brute(rows).values())
    sets, fps = {i: brute_set(t) for i, t in rows}, {i: simhash.fingerprint((t or "").encode()) for i, t in rows}
    ids = [i for i, _ in rows]
    assert any(similar(sets[i], sets[j]) and (fps[i] ^ fps[j]).bit_count() > 4 for i in ids for j in ids)


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert shingles.keep_first(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b"), (None, "a b"), (7, "a b"), (5, "a b"), (5, "a b"), (5, "q r s"), (None, "t u"), (None, "t u"), (None, None), (8, "")]
    got = shingles.keep_first(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == [(-1, "t u"), (5, "a b"), (5, "q r s"), (8, "")]
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in shingles.near_copies(spark.createDataFrame(rows, schema)).collect()) == [
        (-1, -1), (-1, -1), (-1, 5), (-1, 5), (-1, 8), (5, 5), (5, 5), (5, 5), (7, 5), (8, 8)
    ]


def test_large_groups_go_by_tiles(spark, rows, monkeypatch):
    monkeypatch.setattr(shingles, "TILE", 6)
    monkeypatch.setattr(shingles, "TILE_HASHES", 900)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in shingles.near_copies(docs).collect()} == brute(rows)


def test_parity_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (0, 1, 60, 64, 65, 500, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: len(a) * 9 // 10], rng.integers(0, 1 << 63, n // 8).astype(np.uint64))))
        x, y = (np.frombuffer(shingles.parity(s), np.uint64)[None, :] for s in (a, b))
        while x.shape[1] != y.shape[1]:
            x, y = (shingles._folded(x), y) if x.shape[1] > y.shape[1] else (x, shingles._folded(y))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_a_cluster_about_the_threshold(spark):
    """Copies of one text with so many changes that about half of the pairs are linked."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(900)]
    base, rows = [rng.choice(vocab) for _ in range(250)], []
    for i in range(120):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    sets = [brute_set(t) for _, t in rows]
    linked = sum(similar(sets[i], sets[j]) for i in range(120) for j in range(i))
    assert 500 < linked < 6600
    got = shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == brute(rows)
