import numpy as np

from tessera.llm import embeddings


def brute(rows, t=0.98):
    ok = []
    for i, (v, e, lab) in enumerate(rows):
        good = v is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)
        ok.append(bool(good))
    vec = [np.float32(e).astype(np.float64) if g else None for (_, e, _), g in zip(rows, ok)]
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(vec[i]) == len(vec[j]):
                if vec[i] @ vec[j] / np.sqrt((vec[i] @ vec[i]) * (vec[j] @ vec[j])) >= t:
                    links[i].add(j), links[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k), todo.append(k)
        ids = [rows[k][0] for k in seen]
        comp = min(ids) if ids[0] is not None else None
        out.append((rows[i][0], len(links[i]), comp, rows[i][0] is not None and rows[i][0] == comp))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, vid = [], 0
    for c in range(25):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            v = base + rng.normal(size=16) * 0.15
            rows.append((vid, [float(x) for x in np.float32(v)], int(c % 3)))
            vid += 1
    rows += [(vid + k, rows[0][1], rows[0][2]) for k in range(5)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [None] + [1.0] * 15, 1), (905, [float("inf")] * 16, 1)]
    rows += [(906, rows[0][1], None), (None, rows[0][1], rows[0][2]), (907, [1.0, 2.0], 1), (908, [1.0, 2.0], 1), (909, [-1.0, -2.0], 1)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    for tile_rows in (8192, 7):
        got = sorted((tuple(r) for r in embeddings.near_duplicates(df, tile_rows=tile_rows).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
        assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(df).count() == 0


def test_blocks_and_bounds_lose_nothing():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 20))
    x[350:] = x[:350] + rng.normal(size=(350, 20)) * 0.1
    axes = embeddings.principal_axes(x)
    got = {(int(a), int(b)) for i, j in embeddings.compare(x, x, axes, 0.98, True, 64) for a, b in zip(i, j)}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.98)) if i < j}
    assert got == want
