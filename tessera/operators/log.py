"""Mutation logs: last write wins, grouping, upserts and compaction.

A log has one row per mutation: key columns, an op (INSERT or DELETE) and an order
column that is unique per key. The state of a key is its last mutation unless that is a
delete, by one aggregation that combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, DELETE = 1, 2


def decode_op(code: Column) -> Column:
    """"insert" or "delete"; any other code raises."""
    bad = F.raise_error(F.concat(F.lit("CORRUPTED_SEGMENT: opcode "), F.coalesce(code.cast("string"), F.lit("null"))))
    return F.when(code == INSERT, F.lit("insert")).when(code == DELETE, F.lit("delete")).otherwise(bad)


def last_writes(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last mutation of each key, deletes included."""
    rest = [c for c in log.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return log.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def replay(log: DataFrame, keys: Sequence[str], order: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """The rows that are left after all mutations."""
    gone = F.col("op") == DELETE if deleted is None else deleted
    return last_writes(log, keys, order).where(~gone)


def tombstones(log: DataFrame, keys: Sequence[str], order: Sequence[str], deleted: Column | None = None) -> DataFrame:
    gone = F.col("op") == DELETE if deleted is None else deleted
    return last_writes(log, keys, order).where(gone)


def group_counts(log: DataFrame, key: str) -> DataFrame:
    return log.groupBy(key).agg(F.count("*").alias("n"))


def upsert_flags(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The log with created: whether a mutation is the first of its key."""
    first = log.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(F.struct(*order)).alias("__first"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return log.join(first, same).withColumn("created", F.struct(*order) == F.col("__first")).select(*log.columns, "created")


def compacted(log: DataFrame, keys: Sequence[str], order: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """What is left, sorted by key within range partitions, ready to be written as
    one segment; sorted keys let scans skip row groups."""
    return replay(log, keys, order, deleted).repartitionByRange(*keys).sortWithinPartitions(*keys)
