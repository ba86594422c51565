"""Approximate search with measured recall: IVF cells, random-projection LSH,
product quantization and int8 scalar quantization.

Graph indexes that follow pointers one by one do not suit a distributed engine; IVF
and LSH stand in for them. Models are fitted on a bounded sample (FIT_ROWS), and
every row is indexed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import validate
from tessera.functions import kernels
from tessera.operators import search

_FOUND = "qid long, id long, score double"

#: Rows that centroids and codebooks are fitted on at most; those of least hash.
FIT_ROWS = 50_000


def _sample(vectors: DataFrame, id_col: str, vector_col: str, rows: int = FIT_ROWS) -> np.ndarray:
    got = vectors.orderBy(F.xxhash64(id_col), id_col).limit(rows).select(vector_col).collect()
    return np.array([r[0] for r in got], np.float64)


def lloyd(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """k-means centroids of a sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        for j in range(len(c)):
            own = x[near == j]
            c[j] = own.mean(0) if len(own) else x[rng.integers(len(x))]
    return c


def _asked(queries: DataFrame, query_id_col: str, vector_col: str) -> DataFrame:
    return queries.select(F.col(query_id_col).cast("long").alias("qid"), F.col(vector_col).alias("q"))


def _masked(table: DataFrame, id_col: str, vector_col: str, code: str, got: list, k: int, metric: str, may: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(qid, id, score, rank) of the k best of each (qid, q) query among the rows that
    may allows: of a slice of the queries' numbers and a batch's codes it makes a
    matrix of booleans."""
    qids, matrix = np.array([r[0] for r in got]), np.array([r[1] for r in got], np.float64)
    closer = 1.0 if kernels.ascending(metric) else -1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            if not len(ids):
                continue
            v = np.asarray(batch.column("vector").flatten()).reshape(len(ids), -1)
            codes = _matrix(batch.column("code"), len(ids))
            for a in range(0, len(qids), 256):
                allowed = may(np.arange(a, min(a + 256, len(qids))), codes)
                for i in range(len(allowed)):
                    own = np.flatnonzero(allowed[i])
                    if not len(own):
                        continue
                    s = np.round(search.score_matrix(metric, matrix[a + i : a + i + 1], v[own])[0], 6)
                    best = np.lexsort((ids[own], closer * s))[:k]
                    yield pa.record_batch([np.full(len(best), qids[a + i]), ids[own][best], s[best]], names=["qid", "id", "score"])

    rows = table.where(F.size(vector_col) == matrix.shape[1]).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col(code).alias("code"))
    return search.ranked(rows.mapInArrow(run, _FOUND), k, metric)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(n, -1) if n else np.zeros((0, 1), np.int32)


def with_codes(vectors: DataFrame, vector_col: str, name: str, code: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """vectors with a column of what code makes of each Arrow batch's matrix: an array of
    ints a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.asarray(batch.column(vector_col).flatten()).astype(np.float64).reshape(batch.num_rows, -1)
                out = code(v).astype(np.int32)
                yield pa.record_batch([*batch.columns, pa.array(list(out), pa.list_(pa.int32()))], names=[*batch.schema.names, name])

    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centroid."""
    return np.argmin((centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T, axis=1)


@dataclass
class Codes:
    """Product quantization: each of the parts of a vector becomes the number of its
    nearest codeword; a query's distance to a code is a sum of table look-ups."""

    books: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, parts: int, codes: int) -> Codes:
        return cls([lloyd(sample[:, c], codes) for c in np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1]))])

    def _cuts(self) -> list[slice]:
        ends = np.cumsum([b.shape[1] for b in self.books])
        return [slice(e - b.shape[1], e) for b, e in zip(self.books, ends)]

    def of(self, v: np.ndarray) -> np.ndarray:
        return np.stack([nearest(v[:, c], b) for c, b in zip(self._cuts(), self.books)], axis=1)

    def gaps(self, q: np.ndarray) -> list[np.ndarray]:
        """Of each part the squared distances of a query to the codewords."""
        return [((b - q[c]) ** 2).sum(1) for c, b in zip(self._cuts(), self.books)]

    def rough(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return sum(g[codes[:, j]] for j, g in enumerate(self.gaps(q)))

    def reach(self, queries: np.ndarray, sample: np.ndarray, share: float) -> np.ndarray:
        """Of each query the rough distance within which a share of the sample lies."""
        own = self.of(sample)
        return np.array([np.quantile(self.rough(q, own), share) for q in queries])


class _Batch:
    """What the indexes share: searches for many queries at once, and how many rows each
    scores exactly. ``_may`` gives the name of the column of codes and a function as in
    _masked."""

    table: DataFrame
    id_col: str
    vector_col: str

    def _may(self, got: list) -> tuple[str, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
        raise NotImplementedError

    def search_batch(self, queries: DataFrame, k: int = 10, metric: str = "l2", query_id_col: str = "qid") -> DataFrame:
        """(qid, id, score, rank) of each query."""
        metric = validate.metric(metric)

        def one(got: list) -> DataFrame:
            column, may = self._may(got)
            return _masked(self.table, self.id_col, self.vector_col, column, got, k, metric, may)

        return search.by_blocks(_asked(queries, query_id_col, self.vector_col), one)

    def scanned(self, queries: DataFrame, query_id_col: str = "qid") -> DataFrame:
        """(qid, n): how many rows a search of each query scores exactly."""
        got = _asked(queries, query_id_col, self.vector_col).collect()
        column, may = self._may(got)
        qids = np.array([r[0] for r in got])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = _matrix(batch.column("code"), batch.num_rows)
                if batch.num_rows:
                    yield pa.record_batch([qids, may(np.arange(len(qids)), codes).sum(axis=1).astype(np.int64)], names=["qid", "n"])

        return self.table.select(F.col(column).alias("code")).mapInArrow(run, "qid long, n long").groupBy("qid").agg(F.sum("n").alias("n"))


@dataclass
class IvfIndex(_Batch):
    """Inverted lists: vectors by their nearest centroid. Written with
    ``partitionBy("cell")``, a search reads its probed cells only. Searches of many
    queries also compare codes and score exactly the share of rows closest by them."""

    table: DataFrame
    centroids: np.ndarray
    codes: Codes
    sample: np.ndarray
    id_col: str
    vector_col: str
    probes: int = 12
    share: float = 0.15

    @classmethod
    def build(cls, vectors: DataFrame, cells: int = 16, parts: int = 16, codes: int = 64, id_col: str = "id", vector_col: str = "vector") -> IvfIndex:
        sample = _sample(vectors, id_col, vector_col)
        centroids, books = lloyd(sample, cells), Codes.fit(sample[:10_000], parts, codes)
        table = with_codes(vectors, vector_col, "codes", lambda v: np.concatenate((nearest(v, centroids)[:, None], books.of(v)), axis=1))
        return cls(table.withColumn("cell", F.get("codes", F.lit(0))), centroids, books, sample[:10_000], id_col, vector_col)

    def save(self, path: str) -> None:
        self.table.repartition("cell").write.partitionBy("cell").mode("overwrite").parquet(path)
        self.table = self.table.sparkSession.read.parquet(path)

    def _near_cells(self, q: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(((self.centroids - q) ** 2).sum(1), kind="stable")[:probes]

    def search(self, query: Sequence[float], k: int = 10, metric: str = "l2", probes: int = 4, where: str | None = None) -> DataFrame:
        cells = [int(c) for c in self._near_cells(np.asarray(query, np.float64), probes)]
        return search.knn(self.table.where(F.col("cell").isin(cells)), query, k, metric, where, self.id_col, self.vector_col).drop("cell", "codes")

    def _may(self, got: list) -> tuple[str, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
        q, books = np.array([r[1] for r in got], np.float64), self.codes
        probed = np.zeros((len(q), len(self.centroids)), bool)
        for i, x in enumerate(q):
            probed[i, self._near_cells(x, self.probes)] = True
        reach = books.reach(q, self.sample, self.share)
        return "codes", lambda at, codes: probed[at][:, codes[:, 0]] & np.stack([books.rough(q[i], codes[:, 1:]) <= reach[i] for i in at])


@dataclass
class LshIndex(_Batch):
    """Random hyperplanes for cosine: the signs of a vector are its signature, in words of
    30 bits. Candidates are those whose signature differs from the query's in few bits:
    in no more than all but a share of a sample do."""

    table: DataFrame
    planes: np.ndarray
    sample: np.ndarray
    id_col: str
    vector_col: str
    share: float = 0.15

    @classmethod
    def build(cls, vectors: DataFrame, dim: int, bits: int = 480, seed: int = 7, id_col: str = "id", vector_col: str = "vector") -> LshIndex:
        planes = np.random.default_rng(seed).normal(size=(bits, dim))
        table = with_codes(vectors, vector_col, "signature", lambda v: _signatures(v, planes))
        return cls(table, planes, _signatures(_sample(vectors, id_col, vector_col, 10_000), planes), id_col, vector_col)

    def _radius(self, own: np.ndarray) -> int:
        return int(np.quantile(np.bitwise_count(self.sample ^ own).sum(1), self.share))

    def search(self, query: Sequence[float], k: int = 10, metric: str = "cosine") -> DataFrame:
        own = _signatures(np.asarray(query, np.float64)[None, :], self.planes)[0]
        words = F.array(*[F.lit(int(x)) for x in own])
        differ = F.aggregate(F.zip_with("signature", words, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
        return search.knn(self.table.where(differ <= self._radius(own)), query, k, metric, None, self.id_col, self.vector_col).drop("signature")

    def _may(self, got: list) -> tuple[str, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
        own = _signatures(np.array([r[1] for r in got], np.float64), self.planes)
        radius = [self._radius(x) for x in own]
        return "signature", lambda at, codes: np.stack([np.bitwise_count(codes ^ own[i]).sum(1) <= radius[i] for i in at])


def _signatures(v: np.ndarray, planes: np.ndarray) -> np.ndarray:
    signs = (v @ planes.T > 0).reshape(len(v), -1, 30)
    return (signs @ (1 << np.arange(30))).astype(np.int32)


@dataclass
class PqIndex(_Batch):
    """Codes of all rows are compared with a query, and the share closest by them (a
    quantile of a sample) is scored exactly where the vectors are kept."""

    table: DataFrame
    codes: Codes
    sample: np.ndarray
    id_col: str
    vector_col: str
    share: float = 0.1

    @classmethod
    def build(cls, vectors: DataFrame, parts: int = 16, codes: int = 64, id_col: str = "id", vector_col: str = "vector") -> PqIndex:
        sample = _sample(vectors, id_col, vector_col, 10_000)
        books = Codes.fit(sample, parts, codes)
        return cls(with_codes(vectors, vector_col, "codes", books.of), books, sample, id_col, vector_col)

    def search(self, query: Sequence[float], k: int = 10) -> DataFrame:
        """Nearest by l2."""
        q = np.asarray(query, np.float64)
        tables = [F.get(F.array(*[F.lit(float(x)) for x in g]), F.get("codes", F.lit(j))) for j, g in enumerate(self.codes.gaps(q))]
        near = self.table.where(sum(tables[1:], tables[0]) <= float(self.codes.reach(q[None, :], self.sample, self.share)[0]))
        return search.knn(near, query, k, "l2", None, self.id_col, self.vector_col).drop("codes")

    def _may(self, got: list) -> tuple[str, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
        q, books = np.array([r[1] for r in got], np.float64), self.codes
        reach = books.reach(q, self.sample, self.share)
        return "codes", lambda at, codes: np.stack([books.rough(q[i], codes) <= reach[i] for i in at])


def int8_knn(vectors: DataFrame, query: Sequence[float], k: int = 10, metric: str = "dot", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Search over vectors kept as bytes; the query is quantized alike."""
    metric = validate.metric(metric)
    small = vectors.withColumn(vector_col, kernels.quantize_int8(F.col(vector_col)))
    q = [float(np.clip(np.floor(abs(x) * 127 + 0.5) * np.sign(x), -127, 127)) for x in query]
    scale = 127.0 * 127.0 if metric == "dot" else 127.0 if metric == "l2" else 1.0
    rows = search.scored(small, q, metric, None, vector_col, 9).withColumn("score", F.round(F.col("score") / scale, 6)).drop(vector_col)
    return rows.orderBy(F.asc("score") if metric == "l2" else F.desc("score"), F.asc(id_col)).limit(k)


def recall(exact: DataFrame, approximate: DataFrame, id_col: str = "id") -> DataFrame:
    """(recall, k): how much of the exact result the approximate one has."""
    found = approximate.select(id_col, F.lit(1).alias("hit")).distinct()
    counted = exact.select(id_col).join(found, id_col, "left").agg(F.count("hit").alias("hits"), F.count("*").alias("k"))
    return counted.select(F.when(F.col("k") > 0, F.col("hits") / F.col("k")).alias("recall"), "k")


def mean_recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """(recall, k): how much of the exact result of each query the approximate one has,
    on average over the queries that have any; k is the most rows of one."""
    found = approximate.select("qid", "id", F.lit(1).alias("hit")).distinct()
    counted = exact.select("qid", "id").join(found, ["qid", "id"], "left").groupBy("qid").agg(F.count("hit").alias("hits"), F.count("*").alias("k"))
    return counted.agg(F.round(F.avg(F.col("hits") / F.col("k")), 6).alias("recall"), F.max("k").alias("k"))
