"""A mutation log as a Structured Streaming source.

``replay_stream`` keeps the last write per key as state; tombstones stay in it, since a
late insert must not bring a deleted key back. ``merge_into`` keeps the state in a
snapshot table instead, for logs whose keys outgrow a state store: each micro-batch is
reduced to its last writes and merged, and a batch that is run again changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.operators import log as logs
from tessera.sources.files import Store


def read_log_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def replay_stream(log: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Streaming last writes, deletes included, for output mode complete or update."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("last")).select(*keys, "last.*")


def windowed_counts(log: DataFrame, time_col: str, key: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Mutations per key and tumbling window; rows later than the watermark are left out."""
    return log.withWatermark(time_col, late).groupBy(F.window(time_col, length), key).agg(F.count("*").alias("n"))


class Snapshot:
    """The last write per key, in PARTS parts by the key's hash. A micro-batch rewrites the
    parts that it touches; one small file names the current folder of each part and is
    replaced in one step."""

    PARTS = 64

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str]):
        self.spark, self.store, self.keys, self.order = spark, Store(spark, root), list(keys), list(order)

    def _current(self) -> dict:
        return json.loads(self.store.read("current")) if self.store.exists("current") else {"epoch": -1, "parts": {}}

    def merge(self, batch: DataFrame, epoch: int) -> None:
        now = self._current()
        if now["epoch"] >= epoch:
            return
        part = F.pmod(F.xxhash64(*self.keys), F.lit(self.PARTS)).cast("int")
        last = logs.last_writes(batch, self.keys, self.order).withColumn("__part", part).persist()
        touched = [str(r[0]) for r in last.select("__part").distinct().collect()]  # PARTS at most
        held = [self.store.path(now["parts"][p]) for p in touched if p in now["parts"]]
        rows = last.drop("__part")
        if held:
            rows = logs.last_writes(self.spark.read.schema(rows.schema).parquet(*held).unionByName(rows), self.keys, self.order)
        rows.withColumn("__part", part).write.partitionBy("__part").mode("overwrite").parquet(self.store.path(f"state-{epoch}"))
        last.unpersist()
        old = [now["parts"].get(p) for p in touched]
        now["parts"] |= {p: f"state-{epoch}/__part={p}" for p in touched}
        self.store.write("current", json.dumps({"epoch": epoch, "parts": now["parts"], "schema": rows.schema.jsonValue()}))
        for folder in filter(None, old):
            self.store.delete(folder)

    def state(self, deleted: Column) -> DataFrame:
        now = self._current()
        schema = StructType.fromJson(now["schema"])
        return self.spark.read.schema(schema).parquet(*[self.store.path(f) for f in now["parts"].values()]).where(~deleted)


def merge_into(log: DataFrame, snapshot: Snapshot, checkpoint: str, then: Callable[[int], None] | None = None) -> StreamingQuery:
    """Merge what is there now into the snapshot, then stop."""

    def each(batch: DataFrame, epoch: int) -> None:
        snapshot.merge(batch, epoch)
        if then:
            then(epoch)

    return log.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
