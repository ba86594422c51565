"""Exact nearest-neighbour search, with metadata filters before the cut to k.

One query is a literal: the plan is a filtered scan, a projection and
TakeOrderedAndProject, which keeps k rows a task. Many queries are scored in one pass
over the vectors: each Arrow batch is multiplied with the queries' matrix and gives
its k best per query, so that at most k rows per query and batch are shuffled.
Scores are rounded before they are ranked, and equal scores rank by id.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import validate
from tessera.errors import VectorError
from tessera.functions import filters, kernels
from tessera.plans.scratch import scratch

#: Queries that one pass takes at most, about; their matrix goes to every task.
MOST_QUERIES = 10_000
#: Bytes of vectors that are broadcast at most.
MOST_BYTES = 32 << 20
#: Rows of either side whose pairs are scored at once; a tile stays in the processor's cache.
LINES, WIDTH = 64, 1024


def _order(metric: str, id_col: str) -> list[Column]:
    return [F.asc("score") if kernels.ascending(metric) else F.desc("score"), F.asc(id_col)]


def scored(vectors: DataFrame, query: Sequence[float], metric: str = "cosine", where: str | None = None, vector_col: str = "vector", digits: int = 6) -> DataFrame:
    """vectors with their score for the query; rows of another dimension are left out."""
    metric = validate.metric(metric)
    if not len(query):
        raise VectorError("DIM_TOO_SMALL", "the query is empty")
    rows = filters.apply(vectors, where).where(F.size(vector_col) == len(query))
    return rows.withColumn("score", F.round(kernels.score(metric, F.col(vector_col), kernels.vector_literal(query)), digits))


def knn(vectors: DataFrame, query: Sequence[float], k: int = 10, metric: str = "cosine", where: str | None = None, id_col: str = "id", vector_col: str = "vector", digits: int = 6) -> DataFrame:
    """The k nearest vectors, nearest first; other columns are carried along."""
    return scored(vectors, query, metric, where, vector_col, digits).drop(vector_col).orderBy(*_order(validate.metric(metric), id_col)).limit(k)


def timed(found: DataFrame) -> tuple[list[Row], int]:
    """The rows of a search and its latency in microseconds."""
    began = time.perf_counter_ns()
    return found.collect(), (time.perf_counter_ns() - began) // 1000


def range_search(vectors: DataFrame, query: Sequence[float], reach: float, metric: str = "l2", where: str | None = None, vector_col: str = "vector", digits: int = 6) -> DataFrame:
    """Vectors at least as close as reach: distances up to it, or scores from it."""
    rows = scored(vectors, query, metric, where, vector_col, digits).drop(vector_col)
    return rows.where(F.col("score") <= reach if kernels.ascending(validate.metric(metric)) else F.col("score") >= reach)


def score_matrix(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Scores of each query with each vector, in double precision."""
    q, v = np.asarray(q, np.float64), np.asarray(v, np.float64)
    if metric == "l2":
        out = np.empty((len(q), len(v)))
        for i in range(len(q)):  # differences, not the expanded square, which cancels
            d = v - q[i]
            out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
        return out
    product = q @ v.T
    if metric == "dot":
        return product
    n_q, n_v = np.einsum("ij,ij->i", q, q)[:, None], np.einsum("ij,ij->i", v, v)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.clip(product / np.sqrt(n_q * n_v), -1, 1)
    return np.where((n_q < kernels.ZERO_NORM2) | (n_v < kernels.ZERO_NORM2), 0.0, c)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", where: str | None = None, id_col: str = "id", query_id_col: str = "qid", vector_col: str = "vector", digits: int = 6) -> DataFrame:
    """(qid, id, score, rank) of the k nearest vectors of each query; the queries must
    be of one dimension. More than MOST_QUERIES go in blocks, one pass over the vectors
    each, whose results are written to scratch space."""
    metric = validate.metric(metric)
    asked = queries.select(F.col(query_id_col).cast("long").alias("qid"), F.col(vector_col).alias("q"))
    rows = filters.apply(vectors, where)

    def one(got: list) -> DataFrame:
        mine = rows.where(F.size(vector_col) == len(got[0][1])).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
        return _nearest(mine, got, k, metric, digits)

    return by_blocks(asked, one)


def by_blocks(asked: DataFrame, one: Callable[[list], DataFrame]) -> DataFrame:
    """What one makes, as (qid, id, score, rank), of (qid, q) queries of one dimension."""
    spark = asked.sparkSession
    said = asked.agg(F.count("*").alias("n"), F.min(F.size("q")).alias("least"), F.max(F.size("q")).alias("most")).head()
    if said["least"] != said["most"]:
        raise VectorError("DIM_MISMATCH", "queries differ in dimension")
    if not said["n"]:
        return spark.createDataFrame([], "qid long, id long, score double, rank long")
    blocks = max(-(-said["n"] // MOST_QUERIES), -(-said["n"] * said["most"] * 8 // MOST_BYTES))
    if blocks == 1:
        return one(asked.collect())
    out = scratch(spark, "knn-batch")
    for i in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).collect()
        if got:
            one(got).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def ranked(found: DataFrame, k: int, metric: str) -> DataFrame:
    """The k best (qid, id, score) of each query, with their rank."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*_order(metric, "id"))).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _nearest(rows: DataFrame, got: list, k: int, metric: str, digits: int) -> DataFrame:
    """One pass over (id, vector) rows for a block of (qid, q) queries."""
    schema = "qid long, id long, score double"
    qids, matrix = np.array([r[0] for r in got]), np.array([r[1] for r in got], np.float64)
    closer = 1.0 if kernels.ascending(metric) else -1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            if not len(ids):
                continue
            v = np.asarray(batch.column("vector").flatten()).reshape(len(ids), -1)
            for a in range(0, len(qids), 256):
                s = np.round(score_matrix(metric, matrix[a : a + 256], v), digits)
                best = np.stack([np.lexsort((ids, closer * row))[:k] for row in s])
                yield pa.record_batch([np.repeat(qids[a : a + 256], best.shape[1]), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel()], names=["qid", "id", "score"])

    return ranked(rows.mapInArrow(run, schema), k, metric)


def pairwise(a: DataFrame, b: DataFrame, metric: str, a_id: str = "id", b_id: str = "id", vector_col: str = "vector", digits: int = 6) -> DataFrame:
    """(a_id, b_id, value) of all rows of a against all rows of b of their dimension:
    the distance for cosine and l2, the product for dot, as functions.kernels gives
    them, rounded as DuckDB's round does. The rows of a are read at once and go to
    the tasks in blocks of at most MOST_BYTES, one pass over b each, so the driver must
    hold them; b is dealt evenly, as the work grows with both sides. Python gives
    a row of a with the values for up to WIDTH rows of b, which Spark takes apart. A
    null component makes the value null, but for the cosine with a zero vector; null
    vectors have no dimension."""
    metric = validate.metric(metric)
    spark = b.sparkSession
    left = a.select(F.col(a_id).alias("a_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    right = b.select(F.col(b_id).alias("b_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    a_type, b_type = left.schema[0].dataType, right.schema[0].dataType
    held = left.where("vec IS NOT NULL").toArrow().combine_chunks()
    if not held.num_rows:
        return spark.createDataFrame([], T.StructType([T.StructField("a_id", a_type), T.StructField("b_id", b_type), T.StructField("value", T.DoubleType())]))
    sizes = np.cumsum(16 + 8 * np.asarray(pc.list_value_length(held.column("vec"))).astype(np.int64))
    cuts = (np.flatnonzero(np.diff((sizes - 1) // MOST_BYTES)) + 1).tolist()
    parts = max(right.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism)
    right = right.where("vec IS NOT NULL").repartition(parts)
    blocks = [held.slice(i, j - i) for i, j in zip([0, *cuts], [*cuts, held.num_rows])]
    line = T.StructType([T.StructField("a_id", a_type), T.StructField("b_ids", T.ArrayType(b_type)), T.StructField("line", T.ArrayType(T.DoubleType()))])
    lines = reduce(DataFrame.unionAll, [right.mapInArrow(_against(_by_dimension(x["a_id"], x["vec"]), metric, digits), line) for x in blocks])
    return lines.select("a_id", "b_ids", F.posexplode("line").alias("at", "value")).select("a_id", F.get("b_ids", "at").alias("b_id"), "value")


class _Side(NamedTuple):
    """Vectors of one dimension, one a column, with their ids and squared norms. Those
    that hold a null component are marked, and have NaN there."""

    ids: pa.Array
    vectors: np.ndarray
    lacks: np.ndarray
    norms2: np.ndarray

    def part(self, i: int, n: int) -> _Side:
        return _Side(self.ids[i : i + n], self.vectors[:, i : i + n], self.lacks[i : i + n], self.norms2[i : i + n])


def _by_dimension(ids: pa.ChunkedArray | pa.Array, lists: pa.ChunkedArray | pa.Array) -> dict[int, _Side]:
    ids, lists = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, lists))
    sizes, out = np.asarray(pc.list_value_length(lists)), {}
    for n in np.unique(sizes).tolist():
        at = pa.array(np.flatnonzero(sizes == n))
        flat = lists.take(at).flatten()
        lacks = np.asarray(flat.is_null().to_numpy(zero_copy_only=False)).reshape(len(at), n).any(axis=1)
        values = np.ascontiguousarray(np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(at), n).T)
        with np.errstate(all="ignore"):
            out[n] = _Side(ids.take(at), values, lacks, _dots(values, values))
    return out


def _against(left: dict[int, _Side], metric: str, digits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: (b_id, vec) rows in, (a_id, b_ids, line) out."""

    def listed(values: pa.Array, lines: int) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(lines + 1, dtype=np.int32) * (len(values) // lines)), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {n: [(x := a.part(i, LINES), _scaled(metric, x)) for i in range(0, len(a.ids), LINES)] for n, a in left.items()}
        for batch in batches:
            for n, all_b in _by_dimension(batch.column("b_id"), batch.column("vec")).items() if batch.num_rows else ():
                for j in range(0, len(all_b.ids) if n in parts else 0, WIDTH):
                    b = all_b.part(j, WIDTH)
                    b_scaled, b_ids = _scaled(metric, b), listed(pa.concat_arrays([b.ids] * LINES), LINES)
                    for a, a_scaled in parts[n]:
                        values, lacks = _values(metric, a, b, a_scaled, b_scaled, digits), a.lacks[:, None] | b.lacks
                        if metric == "cosine":  # a zero vector decides alone
                            lacks &= values != 1.0
                        flat = pa.array(values.ravel(), mask=lacks.ravel() if lacks.any() else None)
                        yield pa.record_batch([a.ids, b_ids.slice(0, len(values)), listed(flat, len(values))], names=["a_id", "b_ids", "line"])

    return run


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of each column of a with that of b at its place, summed as in _summed."""
    out = np.zeros(a.shape[1])
    for x, y in zip(a, b):
        out += x * y
    return out


def _summed(a: np.ndarray, b: np.ndarray, differ: bool = False) -> np.ndarray:
    """Products, or squared differences, of the columns of a with those of b, summed in
    the order of the components, as functions.kernels and SQL do."""
    out = np.zeros((a.shape[1], b.shape[1]))
    one = np.empty_like(out)
    for x, y in zip(a, b):
        if differ:
            np.subtract(x[:, None], y, out=one)
            np.multiply(one, one, out=one)
        else:
            np.multiply(x[:, None], y, out=one)
        out += one
    return out


def _scaled(metric: str, side: _Side) -> np.ndarray:
    """Vectors whose matrix product is close to the value for dot, the cosine for cosine."""
    if metric != "cosine":
        return side.vectors
    with np.errstate(all="ignore"):
        return side.vectors * np.where(side.norms2 < kernels.ZERO_NORM2, 0.0, 1 / np.sqrt(side.norms2))


def _values(metric: str, a: _Side, b: _Side, a_scaled: np.ndarray, b_scaled: np.ndarray, digits: int) -> np.ndarray:
    """Rounded values of all pairs of a column of a and one of b. Dot and cosine come of
    a matrix product, which sums in another order than SQL. Where that order can make
    another rounded value, that is, close to half a step, and where a norm isn't finite,
    they are summed again in SQL's."""
    with np.errstate(all="ignore"):
        if metric == "l2":
            return _rounded(np.sqrt(_summed(a.vectors, b.vectors, differ=True)), digits)
        step = 10.0**digits
        # Either sum is off by n / 2 eps of the norms' product at most; twice that, and some for the few other steps.
        slack = (2 * len(a.vectors) + 32) * np.finfo(np.float64).eps * step
        odd_a, odd_b = ~np.isfinite(a.norms2), ~np.isfinite(b.norms2)
        if metric == "dot":
            slack = slack * np.sqrt(a.norms2)[:, None] * np.sqrt(b.norms2[~odd_b].max(initial=0.0))
        out = a_scaled.T @ b_scaled
        if metric == "cosine":
            np.subtract(1.0, out, out=out)
        out *= step
        whole = np.rint(out)
        out -= whole
        np.abs(out, out=out)
        whole /= step
        whole += 0.0
        if out.max() < 0.5 - np.max(slack) and not odd_a.any() and not odd_b.any():
            return whole
        i, j = np.nonzero(~(out < 0.5 - slack) | odd_a[:, None] | odd_b)
        if len(i) > out.size // 32:
            return _finished(metric, _summed(a.vectors, b.vectors), a.norms2[:, None], b.norms2, digits)
        whole[i, j] = _finished(metric, _dots(a.vectors[:, i], b.vectors[:, j]), a.norms2[i], b.norms2[j], digits)
        return whole


def _finished(metric: str, product: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, digits: int) -> np.ndarray:
    """Rounded values from products and squared norms summed in SQL's order."""
    if metric == "dot":
        return _rounded(product, digits)
    distance = 1 - np.clip(product / np.sqrt(n_a * n_b), -1, 1)
    return _rounded(np.where((n_a < kernels.ZERO_NORM2) | (n_b < kernels.ZERO_NORM2), 1.0, distance), digits)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, on the product with the power of ten; what this takes
    beyond the finite numbers stays as it is, and zero has no sign."""
    scaled = np.abs(x) * 10.0**digits
    whole = np.trunc(scaled)
    whole += scaled - whole >= 0.5
    out = np.copysign(whole / 10.0**digits, x) + 0.0
    return np.where(np.isfinite(out), out, x)
