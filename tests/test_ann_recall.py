import numpy as np
import pytest

from tessera.operators import ann, search
from tessera.plans import registry


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(20, 64))[rng.integers(20, size=3000)] + 0.3 * rng.normal(size=(3000, 64))).astype("float32")
    where = tmp_path_factory.mktemp("ann")
    table = spark.createDataFrame([(i, [float(y) for y in x], 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    table.repartition(3).write.parquet(str(where / "embeddings.parquet"))
    return registry.vectors(spark, str(where)), str(where)


def test_batches_find_what_single_searches_find(rows):
    df, _ = rows
    asked = registry._asked(df.where("id < 60"))
    lsh, pq = ann.LshIndex.build(df, 64), ann.PqIndex.build(df)
    for many, one in ((lsh.search_batch(asked, 10, "cosine"), lambda q: lsh.search(q, 10)), (pq.search_batch(asked, 10), lambda q: pq.search(q, 10))):
        got = many.collect()
        for qid in (0, 20, 40):
            assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == qid] == [r.id for r in one(registry.vector_of(df, qid)).collect()]


def test_mean_recall_of_all_queries(rows, spark):
    df, where = rows
    index = ann.IvfIndex.build(df, 16)
    index.probes = 4
    found = index.search_batch(registry._asked(df), 10, "l2")
    assert found.select("qid").distinct().count() == 150
    assert ann.mean_recall(search.knn_batch(df, registry._asked(df), 10, "l2"), found).head()["recall"] >= 0.9
    assert {r.n for r in index.scanned(registry._asked(df)).collect()} < set(range(3000))
    for name in ("ann_ivf_recall", "ann_lsh", "ann_pq"):
        got = registry.queries()[name](spark, where).head()
        assert got["recall_from_090"] and got["scanned_to_020"] and got["k"] == 10, (name, got)


def test_mean_recall_by_hand(spark):
    exact = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "qid long, id long")
    found = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 9)], "qid long, id long")
    assert tuple(ann.mean_recall(exact, found).head()) == (0.75, 2)
