"""Named collections of vectors in a folder of any store that Spark reaches.

A collection's manifest is one JSON file: dimension, metric, model, a generation that
is new with every create, and the lists of published log and segment folders. Writers
put Parquet files down first and then replace the manifest; readers trust the manifest
alone, so a write that failed half-way is never seen. There is one writer at a time.

Every mutation goes to the log with the number of its batch and a place in it, which
no two mutations share. The state is the last write per id over segments and log, so
folders may be merged in any order. A log of ROTATE_BYTES or of compact_after batches
becomes a segment; merge_after segments are merged by tiers, small ones first, so that a
row is rewritten a few times only, however many batches come.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import validate
from tessera.errors import VectorError
from tessera.operators import log as logs
from tessera.operators import search as searches
from tessera.sources.files import Store

ROW = "id string, vector array<float>, metadata string"
ENTRY = "batch long, place long, op int, id string, vector array<float>, metadata string, created_at timestamp"


#: Bytes of a log's folders from which it becomes a segment.
ROTATE_BYTES = 64 << 20
#: Segments up to so many times the size of the smaller ones together are merged with them.
TIER = 4


class Catalog:
    def __init__(self, spark: SparkSession, root: str, compact_after: int = 32, rotate_bytes: int = ROTATE_BYTES, merge_after: int = 32):
        self.spark, self.store = spark, Store(spark, root)
        self.compact_after, self.rotate_bytes, self.merge_after = compact_after, rotate_bytes, merge_after

    # Collections

    def _manifest(self, name: str) -> dict:
        if not self.store.exists(f"catalog/{name}.json"):
            raise VectorError("NOT_FOUND", name)
        try:
            return json.loads(self.store.read(f"catalog/{name}.json"))
        except ValueError as e:
            raise VectorError("SERIALIZE_ERROR", name) from e

    def _publish(self, manifest: dict) -> None:
        self.store.write(f"catalog/{manifest['name']}.json", json.dumps(manifest))

    def create(self, name: str, dim: int, metric: str | int = "cosine", model: str | None = None) -> None:
        validate.collection_name(name)
        validate.dimension(dim)
        metric = validate.metric(metric)
        if self.store.exists(f"catalog/{name}.json"):
            raise VectorError("ALREADY_EXISTS", name)
        self._publish({"version": 1, "name": name, "dim": dim, "metric": metric, "model": model or None, "generation": uuid.uuid4().hex, "next_batch": 0, "segments": [], "log": []})

    def names(self) -> list[str]:
        return [n.removesuffix(".json") for n in self.store.names("catalog", ".json")]

    def drop(self, name: str) -> None:
        manifest = self._manifest(name)
        self.store.delete(f"catalog/{name}.json")
        for folder in manifest["segments"] + manifest["log"]:
            self.store.delete(folder)
        self.store.delete(f"data/{name}/{manifest['generation']}")

    def stats(self, name: str) -> dict:
        """vector_count, dim, metric, model, storage_bytes and index of a collection."""
        return self._figures(self._manifest(name), self.state(name).count())

    def _figures(self, m: dict, count: int) -> dict:
        return {
            "name": m["name"], "vector_count": count, "dim": m["dim"], "metric": m["metric"], "model": m["model"],
            "storage_bytes": sum(self.store.size(f) for f in m["segments"] + m["log"]), "index": "brute",
        }

    def describe(self) -> DataFrame:
        """One row of figures per collection, by name; one job counts all."""
        manifests = [self._manifest(n) for n in self.names()]
        paths = [self.store.path(p) for m in manifests for p in m["segments"] + m["log"]]
        counts = {}
        if paths:
            file = F.col("_metadata.file_path")
            name = F.coalesce(F.nullif(F.regexp_extract(file, r"/collection=([^/]+)/", 1), F.lit("")), F.regexp_extract(file, r"/data/([^/]+)/", 1))
            rows = self.spark.read.schema(ENTRY).parquet(*paths).select(name.alias("name"), "batch", "place", "op", "id")
            counts = dict(logs.replay(rows, ["name", "id"], ["batch", "place"]).groupBy("name").count().collect())
        rows = [tuple(self._figures(m, counts.get(m["name"], 0)).values()) for m in manifests]
        return self.spark.createDataFrame(rows, "name string, vector_count long, dim int, metric string, model string, storage_bytes long, index string").orderBy("name")

    # Rows

    def _written(self, name: str, rows: DataFrame, op: int) -> tuple[dict, str]:
        """A log folder of rows that no manifest names yet, and the manifest."""
        m = self._manifest(name)
        folder = f"data/{name}/{m['generation']}/log-{uuid.uuid4().hex}"
        entry = rows.select(
            F.lit(m["next_batch"]).cast("long").alias("batch"), F.monotonically_increasing_id().alias("place"), F.lit(op).alias("op"),
            "id", "vector", "metadata", F.current_timestamp().alias("created_at"),
        )
        entry.write.parquet(self.store.path(folder))
        return m, folder

    def _add(self, m: dict, folder: str, may_compact: bool = True) -> None:
        m["next_batch"] += 1
        m["log"].append(folder)
        self._publish(m)
        if may_compact and (len(m["log"]) >= self.compact_after or sum(map(self.store.size, m["log"])) >= self.rotate_bytes):
            self.rotate(m["name"])

    def _insert(self, name: str, rows: DataFrame, strict: bool = False, may_compact: bool = True) -> tuple[int, str]:
        """Write, check what was written, and publish it only if all of it is fit; rows
        are computed once."""
        dim = self._manifest(name)["dim"]
        rows = rows if "metadata" in rows.columns else rows.withColumn("metadata", F.lit(None).cast("string"))
        rows = rows.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.col("metadata").cast("string").alias("metadata"))
        m, folder = self._written(name, rows, logs.INSERT)
        written = self.spark.read.schema(ENTRY).parquet(self.store.path(folder))
        bad = F.coalesce(validate.vector_error(F.col("vector"), dim), F.when(~validate.id_is_valid(F.col("id")), F.lit("INVALID_NAME")))
        said = written.agg(F.count("*").alias("n"), F.min(bad).alias("bad")).head()
        kind = said["bad"] or ("ALREADY_EXISTS" if strict and written.join(self.state(name), "id", "left_semi").head(1) else None)
        if kind:
            self.store.delete(folder)
            raise VectorError(kind, name)
        self._add(m, folder, may_compact)
        return said["n"], folder

    def insert_batch(self, name: str, rows: DataFrame, strict: bool = False) -> int:
        """Insert (id, vector, metadata) rows, all or none; an id that is there is
        replaced, or with strict refused. Of one id twice in a batch, one row wins."""
        return self._insert(name, rows, strict)[0]

    def upsert_batch(self, name: str, rows: DataFrame) -> DataFrame:
        """As insert_batch; returns (id, created), which is read from the files published
        before and holds until the next compaction."""
        known = self.state(name).select("id", F.lit(False).alias("created"))
        _, folder = self._insert(name, rows, may_compact=False)
        ids = self.spark.read.schema(ENTRY).parquet(self.store.path(folder)).select("id").distinct()
        return ids.join(known, "id", "left").select("id", F.coalesce("created", F.lit(True)).alias("created"))

    def insert(self, name: str, id_: str, vector: Sequence[float], metadata: str | None = None, strict: bool = False) -> None:
        if not len(vector or ()):
            raise VectorError("DIM_TOO_SMALL", id_)
        self.insert_batch(name, self.spark.createDataFrame([(id_, [float(x) for x in vector], metadata)], ROW), strict)

    def insert_text(self, name: str, rows: DataFrame, embedder, text_col: str = "text") -> int:
        """Embed the text of (id, text) rows and insert them."""
        return self.insert_batch(name, rows.withColumn("vector", embedder(F.col(text_col))))

    def delete(self, name: str, ids: Iterable[str] | DataFrame) -> None:
        """Tombstones for ids; those that are not there do no harm."""
        rows = ids.select("id") if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        gone = rows.select("id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("metadata"))
        self._add(*self._written(name, gone, logs.DELETE))

    def log(self, name: str) -> DataFrame:
        """Every published mutation of the collection, segments included."""
        m = self._manifest(name)
        paths = [self.store.path(p) for p in m["segments"] + m["log"]]
        return self.spark.read.schema(ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRY)

    def state(self, name: str, ids: Sequence[str] | None = None) -> DataFrame:
        """(id, vector, metadata, created_at) as it is now; a list of ids reaches the
        Parquet scan as a filter."""
        rows = self.log(name)
        rows = rows if ids is None else rows.where(F.col("id").isin(list(ids)))
        return logs.replay(rows, ["id"], ["batch", "place"]).select("id", "vector", "metadata", "created_at")

    def get(self, name: str, id_: str) -> list[float]:
        got = self.state(name, [id_]).select("vector").head(1)
        if not got:
            raise VectorError("NOT_FOUND", f"{name}/{id_}")
        return got[0]["vector"]

    def search(self, name: str, query: Sequence[float], k: int = 10, where: str | None = None) -> DataFrame:
        """The k nearest by the collection's metric; where filters the metadata's JSON
        keys, before the cut to k."""
        from tessera.functions import filters

        m = self._manifest(name)
        if len(query) != m["dim"]:
            raise VectorError("DIM_MISMATCH", name)
        rows = filters.apply(self.state(name), where, filters.json_of("metadata"))
        return searches.knn(rows, query, k, m["metric"])

    def _merge(self, m: dict, old: list[str]) -> None:
        """One segment, sorted by id, in place of some folders. Deletes go only where no
        other folder is left in which they might still be needed. The new manifest is
        published before the old files go."""
        folder = f"data/{m['name']}/{m['generation']}/seg-{uuid.uuid4().hex}"
        rows = self.spark.read.schema(ENTRY).parquet(*[self.store.path(p) for p in old])
        whole = len(old) == len(m["segments"]) + len(m["log"])
        kept = logs.compacted(rows, ["id"], ["batch", "place"], None if whole else F.lit(False))
        kept.select("batch", "place", "op", "id", "vector", "metadata", "created_at").write.parquet(self.store.path(folder))
        m["segments"] = [p for p in m["segments"] if p not in old] + [folder]
        m["log"] = [p for p in m["log"] if p not in old]
        self._publish(m)
        for p in old:
            self.store.delete(p)

    def rotate(self, name: str) -> None:
        """Make the log a segment; of merge_after segments merge the lowest tier: the
        smallest, and each next that is no larger than TIER times those before it."""
        m = self._manifest(name)
        if m["log"]:
            self._merge(m, m["log"])
        if len(m["segments"]) >= self.merge_after:
            sizes = sorted((self.store.size(p), p) for p in m["segments"])
            some, total = [sizes[0][1]], sizes[0][0]
            for size, p in sizes[1:]:
                if size > TIER * total:
                    break
                some.append(p)
                total += size
            if len(some) > 1:
                self._merge(m, some)

    def compact(self, name: str) -> None:
        """Rewrite segments and log as one segment of what is left, sorted by id."""
        m = self._manifest(name)
        if m["segments"] or m["log"]:
            self._merge(m, m["segments"] + m["log"])

    def import_log(self, rows: DataFrame) -> dict[str, int]:
        """Apply records of sources.binary.read_log to the collections that exist;
        returns how many ids each was given. Other collections' records are left. All
        collections are written in one pass; none is published if any record is unfit."""
        manifests = {n: self._manifest(n) for n in self.names()}
        if not manifests:
            return {}
        folder = f"imported/{uuid.uuid4().hex}"
        known = self.spark.createDataFrame([(n, m["dim"], m["next_batch"]) for n, m in manifests.items()], "collection string, dim int, batch long")
        own = rows.join(known, "collection")
        last = logs.last_writes(own.select("collection", "dim", "batch", "id", "seq", "op", "vector", "metadata"), ["collection", "id"], ["seq"])
        live = F.col("op") == logs.INSERT
        bad = F.coalesce(F.when(live, validate.vector_error(F.col("vector"), F.col("dim"))), F.when(~validate.id_is_valid(F.col("id")), F.lit("INVALID_NAME")))
        entry = last.select(
            "collection", "batch", F.monotonically_increasing_id().alias("place"), F.col("op").cast("int").alias("op"), "id", F.when(live, F.col("vector")).alias("vector"),
            F.when(live, F.col("metadata")).alias("metadata"), F.current_timestamp().alias("created_at"), bad.alias("bad"),
        )
        entry.write.partitionBy("collection").parquet(self.store.path(folder))
        written = self.spark.read.schema(f"collection string, {ENTRY}, bad string").parquet(self.store.path(folder))
        said = {r["collection"]: r for r in written.groupBy("collection").agg(F.count_if(live).alias("n"), F.min("bad").alias("bad")).collect()}
        wrong = next((r["bad"] for r in said.values() if r["bad"]), None)
        if wrong:
            self.store.delete(folder)
            raise VectorError(wrong, folder)
        for name in said:
            self._add(manifests[name], f"{folder}/collection={name}")
        return {n: said[n]["n"] if n in said else 0 for n in manifests}
