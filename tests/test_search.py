import numpy as np
import pytest

from tessera.errors import VectorError
from tessera.operators import ann, embed, search


@pytest.fixture(scope="module")
def rows(spark):
    v = np.random.default_rng(1).normal(size=(300, 12)).astype("float32")
    v[:3] = 0
    return spark.createDataFrame([(i, [float(y) for y in x], i % 3) for i, x in enumerate(v)], "id long, vector array<float>, label int").repartition(3), v


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_one_and_many_queries_match_numpy(rows, metric):
    df, v = rows
    scores = np.round(search.score_matrix(metric, v[5:9], v), 6)
    for q in range(4):
        order = np.lexsort((np.arange(300), scores[q] if metric == "l2" else -scores[q]))
        assert [r.id for r in search.knn(df, v[5 + q], 7, metric).collect()] == order[:7].tolist()
        some = [i for i in order if i % 3 == 1][:7]
        assert [r.id for r in search.knn(df, v[5 + q], 7, metric, "label = 1").collect()] == some
    got = search.knn_batch(df, df.where("id between 5 and 8").withColumnRenamed("id", "qid"), 7, metric).collect()
    for q in range(4):
        order = np.lexsort((np.arange(300), scores[q] if metric == "l2" else -scores[q]))
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == 5 + q] == order[:7].tolist()


def test_edges(rows, spark):
    df, v = rows
    with pytest.raises(VectorError, match="DIM_TOO_SMALL"):
        search.knn(df, [])
    assert search.knn(df, [1.0, 2.0]).count() == 0 and search.knn(df.limit(0), v[4]).count() == 0
    assert search.knn_batch(df, df.limit(0).withColumnRenamed("id", "qid")).count() == 0
    assert {r.id for r in search.range_search(df, v[9], 0.0, "l2").collect()} == {9}
    plan = search.knn(df, v[4], 3)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Cartesian" not in plan


def test_ann_recall(rows):
    df, v = rows
    df = df.where("id > 2")
    for metric, found in (("l2", ann.IvfIndex.build(df, 8).search(v[50], 10, "l2", 8)), ("cosine", ann.LshIndex.build(df, 12).search(v[50], 10)), ("l2", ann.PqIndex.build(df, 4).search(v[50], 10))):
        assert ann.recall(search.knn(df, v[50], 10, metric), found).head()["recall"] >= 0.9


def test_ivf_saved_by_cell(rows, tmp_path):
    df, v = rows
    index = ann.IvfIndex.build(df, 4)
    index.save(str(tmp_path / "ivf"))
    assert index.search(v[20], 1, "l2", 1).head()["id"] == 20


def test_text(spark):
    df = spark.createDataFrame([(1, "spark streams and tables"), (2, "cats and dogs"), (3, None)], "id long, text string")
    e = embed.hashing_embedder(64)
    assert embed.text_search(embed.embed_table(df, "text", e), "cats dogs", e, 1).head()["id"] == 2
    long = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(25))), (2, ""), (3, "one")], "id long, text string")
    got = [(r.id, r.chunk, r.text.split()[0], len(r.text.split())) for r in embed.chunks(long, "id", "text", 10, 2).orderBy("id", "chunk").collect()]
    assert got == [(1, 0, "w0", 10), (1, 1, "w8", 10), (1, 2, "w16", 9), (3, 0, "one", 1)]
    assert embed.retrieve(df, "dogs", "id", "text", e, 1).head()["id"] == 2


def test_models_and_latency(spark, rows):
    df, v = rows
    models = embed.Models()
    assert models.load("hashing-128") is models.load("hashing-128")
    assert {r.name: r.loaded for r in models.list(spark).collect()} == {"hashing-128": True, "hashing-384": False}
    models.unload("hashing-128")
    for f, name in ((models.unload, "hashing-128"), (models.load, "no-such-model"), (models.pull, "no-such-model")):
        with pytest.raises(VectorError, match="NOT_FOUND"):
            f(name)
    hits, latency_us = search.timed(search.knn(df, v[5], 3))
    assert hits[0].id == 5 and latency_us > 0


def test_hashing_embedder_by_hand(spark):
    import hashlib
    import re

    texts = ["Spark streams, and tables and streams", "", None, "Ünïcode 中文 12 a_b", "one"]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", embed.hashing_embedder(16)(embed.F.col("text")).alias("v")).orderBy("id").collect()
    for r, t in zip(got, texts):
        want = np.zeros(16)
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            want[(h >> 1) % 16] += -1 if h % 2 else 1
        n = np.sqrt((want**2).sum())
        assert np.allclose(r.v, want / n if n else want, atol=1e-7)
