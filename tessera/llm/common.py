"""What the operators of this subpackage share: tables, scratch space, union-find."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
BITMAP_BITS = 1 << 23


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew to as many partitions as there are cores, where its files give fewer;
    larger tables stay as they are read. For rows that much work follows on."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset
    and all tasks run in this process, as in tests, a temporary one of this application;
    on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        atexit.register(_remove, _OWN_DIRS[app])
    return _OWN_DIRS[app]


def _remove(url: str) -> None:
    import shutil

    shutil.rmtree(url.removeprefix("file://"), ignore_errors=True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: this cuts the
    lineage, and what is read survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for held in _SCOPES:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What is written while a scratch is open, for each one that is.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Tables materialized inside go at the end, but for those whose tag is in keep;
    nothing made from the others may be read later."""
    held: list[str] = []
    _SCOPES.append(held)
    try:
        yield
    finally:
        _SCOPES.pop()  # scratches are nested, so this is held
        for path in held:
            if path.rsplit("/", 1)[1].rsplit("-", 1)[0] in keep:
                continue
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ordinal(doc_id: Column) -> Column:
    """doc_id as a long, nulls first."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def row_keys(*others: Column) -> list[Column]:
    """(ord, rk): what tells rows of documents apart, with or without a doc_id of their
    own: doc_id as a long, nulls first, and a hash of doc_id, text and others. Rows
    equal in all of these are one row twice."""
    return [ordinal(F.col("doc_id")).alias("ord"), F.xxhash64("doc_id", "text", *others).alias("rk")]


def in_bitmap(rows: DataFrame, value: Column, members: DataFrame, member: Column, keep: bool = True) -> DataFrame:
    """Rows whose value may be among the members, or with keep false the others:
    those that surely are not. The members' hashes are a bitmap of 1 MiB,
    whatever their number, and that is what is broadcast."""
    bit = lambda v: F.pmod(F.xxhash64(v), F.lit(BITMAP_BITS)) + 1
    bits = members.select(bit(member).alias("bit"))
    maps = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    held = rows.withColumn("bit", bit(value)).withColumn("bucket", F.bitmap_bucket_number("bit")).join(F.broadcast(maps), "bucket", "left")
    at = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return held.where(there if keep else ~there).select(rows.columns)


def batches_of(batches: Iterator, column: str, most_bytes: int) -> Iterator:
    """Cut Arrow batches so that none holds much over most_bytes of column."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most_bytes)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            if b > a:
                yield batch.slice(a, b - a)


class Forest:
    """Union-find over 0..n-1 whose unions come in numpy arrays; the root of a set
    is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while a.size:
            ra, rb = p[a], p[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = p[p]
                if np.array_equal(up, p):
                    break
                p[:] = up

    def roots(self) -> np.ndarray:
        return self.parent


def connected_components(edges: DataFrame, tag: str = "cc", most_rounds: int = 60) -> DataFrame:
    """Components of a graph: (u, v) long pairs in, one (node, component) row per
    node out, component being its smallest node.

    Alternates the large-star and small-star steps (Kiveris et al., 2014), which
    end in one star per component. Every round is written to the shared folder;
    nothing is gathered on the driver but a count and a checksum. Rows with a null
    end and loops are ignored.
    """
    spark = edges.sparkSession
    cur = edges.select("u", "v").where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur, seen = materialize(cur, tag), None
    for _ in range(most_rounds):
        state = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).head()
        if state["n"] == 0 or (state["n"], state["s"]) == seen:
            break
        seen = (state["n"], state["s"])
        # Large star: each node hands its least neighbour to its larger neighbours.
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large.distinct(), tag)
        # Small star: each node ties its smaller neighbours, and itself, to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        cur = materialize(small.where("u <> v").distinct(), tag)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    leaves = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
