import math

import numpy as np
import pytest

from tessera.functions import kernels

F = kernels.F


def numbers(seed):
    s = seed
    while True:
        s = (s * 1664525 + 1013904223) & 0xFFFFFFFF
        yield float(np.float32((s & 0xFFFFFF) / 0xFFFFFF * 2 - 1))


def vectors(gen, n, dim):
    return [[next(gen) for _ in range(dim)] for _ in range(n)]


def measured(spark, pairs):
    df = spark.createDataFrame([(i, [float(x) for x in a], [float(x) for x in b]) for i, (a, b) in enumerate(pairs)], "i int, a array<float>, b array<float>")
    a, b = df.a, df.b
    rows = df.select("i", kernels.dot(a, b).alias("dot"), kernels.cosine_distance(a, b).alias("cosine"), kernels.l2_distance(a, b).alias("l2")).collect()
    return [tuple(r)[1:] for r in sorted(rows)]


def reference(a, b):
    a, b = (np.array(x, np.float32).astype(np.float64) for x in (a, b))
    na, nb = a @ a, b @ b
    cosine = 1.0 if na < 1e-10 or nb < 1e-10 else 1 - max(-1.0, min(1.0, a @ b / math.sqrt(na * nb)))
    return a @ b, cosine, math.sqrt(((a - b) ** 2).sum())


def test_random_pairs_and_odd_dimensions(spark):
    gen = numbers(0xABCD1234)
    pairs = [tuple(vectors(gen, 2, d)) for d in [384] * 60 + [1, 7, 17, 127, 255, 333]]
    for got, (a, b) in zip(measured(spark, pairs), pairs):
        assert got == pytest.approx(reference(a, b), abs=1e-9)


def test_symmetry_identity_and_determinism(spark):
    gen = numbers(0xBEEF)
    pairs = [tuple(vectors(gen, 2, 16)) for _ in range(100)]
    there = measured(spark, pairs)
    assert there == measured(spark, pairs)
    assert there == measured(spark, [(b, a) for a, b in pairs])
    same = measured(spark, [(a, a) for a, _ in pairs])
    assert all(c < 1e-9 and l == 0 for _, c, l in same)


def test_edges(spark):
    nan = float("nan")
    got = measured(spark, [([1, 0, 0, 0], [0, 1, 0, 0]), ([0] * 4, [3, 4, 0, 0]), ([3, 4, 0, 0], [0] * 4), ([0] * 4, [0] * 4), ([1.0, 2], [-1.0, -2]), ([9.9e-6], [1.0]), ([1.1e-5], [1.0]), ([nan, 1], [1.0, 1]), ([nan], [0.0])])
    assert got[0] == (0, 1, pytest.approx(math.sqrt(2)))
    assert [g[1] for g in got[1:4]] == [1, 1, 1] and [g[2] for g in got[1:4]] == [5, 5, 0]
    assert got[4][1] == pytest.approx(2) and got[5][1] == 1 and got[6][1] == pytest.approx(0, abs=1e-6)
    assert all(math.isnan(x) for x in got[7]) and got[8][1] == 1


def test_normalize_and_quantize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [list(r[0]) for r in df.select(kernels.normalize(df.v)).collect()] == [[pytest.approx(0.6), pytest.approx(0.8)], [0, 0]]
    q = spark.createDataFrame([([1.0, -1.0, 0.5, 2.0],)], "v array<float>").select(kernels.quantize_int8(F.col("v")).alias("q"))
    assert list(q.head()[0]) == [127, -127, 64, 127]
    assert q.select(kernels.dequantize_int8(F.col("q"))).head()[0][0] == 1.0
