import numpy as np
import xxhash

from tessera.llm import simhash


def brute_fingerprint(text, width=4):
    words, cur = [], ""
    for ch in text or "":
        if ch == " " or "\t" <= ch <= "\r":
            words, cur = (words + [cur] if cur else words), ""
        else:
            cur += ch.lower() if "A" <= ch <= "Z" else ch
    words += [cur] if cur else []
    if not words:
        return 0
    runs = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, ids, radius):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= radius and label[i] != label[j]:
                    lo, hi = sorted((label[i], label[j]))
                    label = [lo if x == hi else x for x in label]
                    changed = True
    return [min(ids[k] for k in range(len(ids)) if label[k] == label[i]) for i in range(len(ids))]


def test_fingerprint_matches_brute_force():
    for t in [None, "", "  \n", "One", "a b c", "a b c d", "A b\tc  D\x0be a b c d", "é È x y z é È x", "w " * 300, "x y z"]:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_link_node_matches_brute_force():
    rng = np.random.default_rng(1)
    for n, spread in ((1, 3), (2, 2), (40, 3), (300, 3), (400, 1)):
        base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
        fps = {int(base[rng.integers(5)]) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, spread * 2))) for _ in range(n)}
        gray = lambda x: x ^ gray(x >> 1) if x else 0
        fps = sorted(fps, key=gray)
        roots = simhash.link_node(np.array(fps, np.uint64), 4)
        assert [fps[r] for r in roots] == [fps[i] for i in brute_components(fps, list(range(len(fps))), 4)]


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(vocab, 120)) for _ in range(30)]
    for t in list(texts[:15]):
        for _ in range(4):
            w = t.split()
            w[rng.integers(len(w))] = "zz"
            texts.append(" ".join(w))
    texts += [None, "", "\n", texts[0], texts[0], "short", "short"]
    rows = [(i * 3, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    want_fp = [brute_fingerprint(t) for t in texts]
    want = brute_components(want_fp, [r[0] for r in rows], 4)
    for node_rows in (200_000, 3):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs, node_rows=node_rows).collect()}
        assert got == {r[0]: (f"{fp:016x}", c) for r, fp, c in zip(rows, want_fp, want)}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_more_bands_link_the_same(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 20)
    fps = sorted({int(base[i % 20]) ^ (1 << int(rng.integers(63))) for i in range(100)})
    reps = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    few, many = (len(simhash.node_masks(n, 4)) for n in (1000, 10**9))
    assert few == 5 and many > 5
    import unittest.mock as mock

    results = []
    for n in (1000, 10**9):
        masks = simhash.node_masks(n, 4)
        with mock.patch.object(simhash, "node_masks", lambda *_: masks):
            cc = simhash.connected_components(simhash.links(reps, 4))
            results.append(sorted(map(tuple, cc.collect())))
    assert results[0] == results[1] != []


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.simhash_components(spark.createDataFrame([], schema)).count() == 0
    got = simhash.simhash_components(spark.createDataFrame([(None, "a b"), (None, "q r s"), (5, "a b"), (5, "a b")], schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 5), (5, 5), (5, 5)]
