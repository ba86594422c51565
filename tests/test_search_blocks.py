import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators import search

METRICS = ["cosine", "dot"]


@pytest.fixture(scope="module")
def rows(spark):
    v = np.random.default_rng(3).normal(size=(400, 8)).astype("float32")
    return spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, vector array<float>").repartition(3), v


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_batch_goes_through_queries_in_blocks(rows, monkeypatch, metric):
    df, v = rows
    monkeypatch.setattr(search, "MOST_QUERIES", 6)
    asked = list(range(0, 400, 20))
    got = search.knn_batch(df, df.where("id % 20 = 0").withColumnRenamed("id", "qid"), 5, metric).collect()
    scores = np.round(search.score_matrix(metric, v[asked], v), 6)
    want = {q: np.lexsort((np.arange(400), s if kernels.ascending(metric) else -s))[:5].tolist() for q, s in zip(asked, scores)}
    assert {q: [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == q] for q in asked} == want and len(got) == 100


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_pairwise_keeps_every_row_of_the_left_side(rows, monkeypatch, metric):
    df, v = rows
    monkeypatch.setattr(search, "MOST_BYTES", 100)
    got = {(r.a_id, r.b_id): r["value"] for r in search.pairwise(df.where("id % 20 = 0"), df, metric).collect()}
    asked = list(range(0, 400, 20))
    want = search.score_matrix(metric, v[asked], v)
    want = 1 - want if metric == "cosine" else want
    assert len(got) == 20 * 400
    assert max(abs(got[q, j] - want[i, j]) for i, q in enumerate(asked) for j in range(400)) < 2e-6


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_pairwise_odd_vectors_and_blocks_without_row_functions(spark, metric):
    nan, inf = float("nan"), float("inf")
    odd = [[1.0, 2.0], [0.0, 0.0], [1e-6, 0.0], [None, 1.0], [nan, 1.0], [inf, 1.0], [-1.0, -2.0], None, [], [1.0], [3.0, 4.0, 0.0], [0.0, -0.0]]
    df = spark.createDataFrame([(f"v{i}" if i else None, v) for i, v in enumerate(odd)], "id string, vector array<double>")
    got = search.pairwise(df, df, metric)
    plan = got._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "lambda" not in plan  # pairs are scored in blocks, not one row at a time
    kernel = {"dot": kernels.dot, "cosine": kernels.cosine_distance, "l2": kernels.l2_distance}[metric]
    both = df.alias("a").join(df.alias("b"), F.size("a.vector") == F.size("b.vector"))
    want = both.select("a.id", "b.id", F.round(kernel(F.col("a.vector"), F.col("b.vector")), 6))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert got.schema["a_id"].dataType == df.schema["id"].dataType and search.pairwise(df.limit(0), df, metric).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_pairwise_query_gives_what_its_sql_does(spark, tmp_path, metric):
    import duckdb

    from tessera.plans import registry

    # Products such as 0.2584565, a tie in decimals: SQL rounds the product with a million.
    v = np.random.default_rng(8).normal(size=(150, 3))
    v[20:80] = [[0.2584565, 0.0, 0.0], [0.5175945, 0.0, 0.0], [4.1269065, 0.0, 0.0]] * 20
    v[0], v[40], v[100] = [1.0, 0.0, 0.0], [1.0, 0.0, 0.0], 0
    spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        want = sorted(con.execute(registry.oracle_sql()[f"pairwise_{metric}"]).fetchall())
    assert sorted(map(tuple, registry.queries()[f"pairwise_{metric}"](spark, str(tmp_path)).collect())) == want and len(want) == 8 * 150


def _by_hand(metric, a, b, digits=6):
    """Rounded values of the columns of a and b, in SQL's order of summing."""
    with np.errstate(all="ignore"):
        total = sum((x[:, None] * y for x, y in zip(a, b)), np.zeros((a.shape[1], b.shape[1])))
        if metric == "cosine":
            n_a, n_b = (sum((x * x for x in v), np.zeros(v.shape[1])) for v in (a, b))
            total = 1 - np.clip(total / np.sqrt(n_a[:, None] * n_b), -1, 1)
            total[(n_a[:, None] < 1e-10) | (n_b < 1e-10)] = 1.0
        return search._rounded(total, digits)


def _values_of(metric, a, b, digits=6):
    """The same by the function that the tasks run."""
    held = [search._by_dimension(pa.array(range(v.shape[1])), pa.array(v.T.tolist())) for v in (a, b)]
    batch = pa.record_batch([pa.array(range(b.shape[1])), pa.array(b.T.tolist())], names=["b_id", "vec"])
    lines = [x for out in search._against(held[0], metric, digits)(iter([batch])) for x in out.to_pylist()]
    found = {(x["a_id"], i): y for x in lines for i, y in zip(x["b_ids"], x["line"], strict=True)}
    assert len(found) == sum(len(x["line"]) for x in lines) == a.shape[1] * b.shape[1]
    return np.array([[found[i, j] for j in range(b.shape[1])] for i in range(a.shape[1])])


@pytest.mark.parametrize("metric", METRICS)
def test_pairs_are_matrix_products_and_not_summed_one_component_at_a_time(monkeypatch, metric):
    a, b = (np.random.default_rng(n).normal(size=(64, n)) for n in (70, 1100))
    want, summed = _by_hand(metric, a, b), []
    monkeypatch.setattr(search, "_summed", lambda *x: summed.append(x))
    assert np.array_equal(_values_of(metric, a, b), want) and not summed


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("metric", METRICS)
def test_values_close_to_half_a_step_are_summed_in_the_order_of_sql(metric, few):
    rng = np.random.default_rng(5)
    if metric == "dot":  # products are multiples of 0.005, so half of the sums are ties at two digits
        a, b, digits = rng.integers(-9, 10, (33, 40)) * 0.05, rng.integers(-9, 10, (33, 300)) * 0.1, 2
    else:  # signs times a length: cosines are sixteenths, and 0.25 or 0.75 are ties at one digit
        a, b = (rng.choice([-1, 1], (16, n)) * rng.random(n) for n in (40, 300))
        digits = 1
    if few:
        a[:, 4:], b[:, 60:] = rng.normal(size=a[:, 4:].shape), rng.normal(size=b[:, 60:].shape)
    want, other = _by_hand(metric, a, b, digits), _by_hand(metric, a[::-1], b[::-1], digits)
    assert (want != other).any()  # the order matters here
    assert np.array_equal(_values_of(metric, a, b, digits), want)


@pytest.mark.parametrize("metric", METRICS)
def test_odd_norms_among_others(metric):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(7, 70)), rng.normal(size=(7, 300))
    for v in (a, b):
        for i, x in enumerate((np.nan, np.inf, -np.inf, 1e200, 1e155, 1e12, 0.0, 1e-6, 1e-170)):
            v[:, 3 * i] = 0
            v[i % 7, 3 * i] = x
    assert np.array_equal(_values_of(metric, a, b), _by_hand(metric, a, b), equal_nan=True)
