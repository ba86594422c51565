"""Named queries over the standard tables, and the same in DuckDB's SQL.

Scores are rounded to six digits on both sides and ranked by that; ids break ties.
Vectors are compared as DOUBLE[] in SQL, and come out as (id, pos, value) rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import validate
from tessera.errors import CODES, VectorError
from tessera.functions import filters, kernels
from tessera.operators import ann, embed, log, search
from tessera.plans.scratch import scratch
from tessera.sources import binary
from tessera.sources.catalog import Catalog
from tessera.streaming import log_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_of(df: DataFrame, id_: int) -> list[float]:
    return df.where(F.col("id") == id_).select("vector").head()["vector"]


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the metadata of the document of the same number, where there is one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return vectors(spark, sf_dir).join(docs, "id", "left").join(labels, "id", "left")


# Distance kernels

_E = "e.embedding::DOUBLE[]"
_Q = "q.embedding::DOUBLE[]"
_N2 = "list_dot_product({0}, {0})"
_COSINE_SIMILARITY = f"CASE WHEN {_N2.format(_E)} < 1e-10 OR {_N2.format(_Q)} < 1e-10 THEN 0e0 ELSE greatest(-1e0, least(1e0, list_dot_product({_E}, {_Q}) / sqrt({_N2.format(_E)} * {_N2.format(_Q)}))) END"
_SCORE = {"cosine": _COSINE_SIMILARITY, "dot": f"list_dot_product({_E}, {_Q})", "l2": f"list_distance({_E}, {_Q})"}
_DIRECTION = {"cosine": "DESC", "dot": "DESC", "l2": "ASC"}
_PAIR = {"cosine": f"1e0 - ({_COSINE_SIMILARITY})", "dot": _SCORE["dot"], "l2": _SCORE["l2"]}


def _top(metric: str, where: str = "true", source: str = "embeddings e", k: int = 10) -> str:
    return f"""
SELECT e.vec_id, round({_SCORE[metric]}, 6) AS score FROM {source}, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
WHERE {where} ORDER BY score {_DIRECTION[metric]}, e.vec_id LIMIT {k}"""


def _knn(metric: str, where: str | None = None, source=vectors, k: int = 10) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = source(spark, sf_dir)
        return search.knn(rows, vector_of(vectors(spark, sf_dir), 0), k, metric, where).select(F.col("id").alias("vec_id"), "score")

    return run


def _pairs(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vectors(spark, sf_dir)
        return search.pairwise(rows.where("id % 20 = 0"), rows, metric).withColumn("value", F.col("value") + 0.0)

    return run


def _batch(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vectors(spark, sf_dir)
        return search.knn_batch(rows, _asked(rows), 10, metric).select("qid", F.col("id").alias("vec_id"), "score", "rank")

    return run


for _m in ("cosine", "dot", "l2"):
    query(f"knn_{_m}_top10", _top(_m))(_knn(_m))
    query(
        f"pairwise_{_m}",
        f"SELECT q.vec_id AS a_id, e.vec_id AS b_id, round({_PAIR[_m]}, 6) + 0e0 AS value FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0",
    )(_pairs(_m))
    query(
        f"knn_batch_top10_{_m}",
        f"""SELECT qid, vec_id, score, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score {_DIRECTION[_m]}, vec_id) AS rank FROM (
    SELECT q.vec_id AS qid, e.vec_id, round({_SCORE[_m]}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= 10""",
    )(_batch(_m))


@query("squared_norms", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm2 FROM embeddings")
def squared_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round(kernels.squared_norm(F.col("vector")), 6).alias("norm2"))


@query(
    "normalize_l2",
    """SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(x / sqrt(n2), 6) + 0e0 AS value FROM (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding::DOUBLE[]) AS x, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n2 FROM embeddings)""",
)
def normalize_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), F.posexplode(kernels.normalize(F.col("vector"))).alias("pos", "x"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + 0.0).alias("value"))


_CASES = (("orthogonal", [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]), ("zero_first", [0.0] * 4, [3.0, 4.0, 0.0, 0.0]), ("zero_second", [3.0, 4.0, 0.0, 0.0], [0.0] * 4), ("both_zero", [0.0] * 4, [0.0] * 4), ("same", [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ("opposite", [1.0, 2.0], [-1.0, -2.0]), ("tiny", [1e-6, 0.0], [1.0, 0.0]), ("small", [1e-4, 0.0], [1.0, 0.0]))


@query(
    "kernel_edge_cases",
    """SELECT "case", dot, cosine, l2 FROM (VALUES ('orthogonal', 0e0, 1e0, 1.414214e0), ('zero_first', 0e0, 1e0, 5e0), ('zero_second', 0e0, 1e0, 5e0),
  ('both_zero', 0e0, 1e0, 0e0), ('same', 14e0, 0e0, 0e0), ('opposite', -5e0, 2e0, 4.472136e0), ('tiny', 1e-6, 1e0, 0.999999e0), ('small', 1e-4, 0e0, 0.9999e0)) t("case", dot, cosine, l2)""",
)
def kernel_edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(_CASES), "case string, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    return rows.select("case", *[(F.round(f(a, b), 6) + 0.0).alias(n) for n, f in (("dot", kernels.dot), ("cosine", kernels.cosine_distance), ("l2", kernels.l2_distance))])


# Point reads and the catalog


@query("get_by_id", "SELECT CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos, unnest(embedding::DOUBLE[]) AS value FROM embeddings WHERE vec_id = 7")
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = vectors(spark, sf_dir).where("id = 7").select(F.posexplode("vector").alias("pos", "value"))
    return got.select(F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))


@query("get_missing", "SELECT vec_id, label FROM embeddings WHERE vec_id = -1")
def get_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("id = -1").select(F.col("id").alias("vec_id"), "label")


@query("list_collections", "SELECT 'label_' || label AS name, CAST(count(*) AS BIGINT) AS vector_count FROM embeddings GROUP BY label ORDER BY name")
def list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).groupBy(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("name"))
    return rows.agg(F.count("*").alias("vector_count")).orderBy("name")


@query("collection_stats", "SELECT label, CAST(count(*) AS BIGINT) AS vector_count, CAST(min(len(embedding)) AS BIGINT) AS min_dim, CAST(max(len(embedding)) AS BIGINT) AS max_dim, CAST(sum(len(embedding)) * 4 AS BIGINT) AS vector_bytes FROM embeddings GROUP BY label")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("vector").cast("long")
    return vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("vector_count"), F.min(n).alias("min_dim"), F.max(n).alias("max_dim"), (F.sum(n) * 4).alias("vector_bytes"))


@query("dim_validation", "SELECT CASE WHEN embedding IS NULL OR len(embedding) < 1 THEN 'DIM_TOO_SMALL' WHEN len(embedding) <> 64 THEN 'DIM_MISMATCH' ELSE 'OK' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM embeddings GROUP BY 1")
def dim_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.coalesce(validate.vector_error(F.col("vector"), 64), F.lit("OK"))
    return vectors(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


_NAMES = ("docs", "docs123", "my-collection", "my_collection", "a" * 64, "a" * 65, "", "-abc", "_abc", ".abc", "my collection", "col@name", "col#name", "docs\n", "é")
_NAME_ROWS = ", ".join("('" + n.replace("\n", "' || chr(10) || '") + "')" for n in _NAMES)


@query("name_validation", f"SELECT name, regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9_-]{{0,63}}') AS valid FROM (VALUES {_NAME_ROWS}) t(name)")
def name_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in _NAMES], "name string").select("name", validate.name_is_valid(F.col("name")).alias("valid"))


@query("metric_codes", "SELECT name, CAST(code AS INTEGER) AS code FROM (VALUES ('l2', 0), ('cosine', 1), ('dot', 2), ('euclidean', NULL), ('L2', NULL)) t(name, code)")
def metric_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(n,) for n in ("l2", "cosine", "dot", "euclidean", "L2")], "name string")
    return rows.select("name", validate.metric_code(F.col("name")).alias("code"))


# Mutation logs: events, keyed by user, an error standing for a delete


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


_LAST = "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


@query("wal_replay_lww", f"SELECT user_id, event_id, event_type, value FROM ({_LAST}) WHERE event_type <> 'error'")
def wal_replay_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = log.replay(_events(spark, sf_dir).select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"], F.col("event_type") == "error")
    return kept.select("user_id", "event_id", "event_type", "value")


@query("wal_replay_deletes", f"SELECT user_id, event_id FROM ({_LAST}) WHERE event_type = 'error'")
def wal_replay_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.tombstones(_events(spark, sf_dir).select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type") == "error").select("user_id", "event_id")


@query("wal_group_by_collection", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def wal_group_by_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.group_counts(_events(spark, sf_dir), "event_type")


@query("upsert_created_updated", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS created FROM events")
def upsert_created_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.upsert_flags(_events(spark, sf_dir), ["user_id"], ["event_id"]).select("event_id", "created")


@query("compaction_sorted", f"SELECT user_id, event_id FROM ({_LAST}) WHERE event_type <> 'error' ORDER BY user_id")
def compaction_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.compacted(_events(spark, sf_dir).select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type") == "error").select("user_id", "event_id")


@query("opcode_decode", "SELECT CASE WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END AS op, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def opcode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_type") == "error", log.DELETE).otherwise(log.INSERT)
    return _events(spark, sf_dir).select(log.decode_op(code).alias("op")).groupBy("op").agg(F.count("*").alias("n"))


@query("strict_insert_conflicts", "SELECT e.vec_id FROM embeddings e WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.vec_id)")
def strict_insert_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ids of a batch a collection already holds."""
    batch = vectors(spark, sf_dir).select(F.col("id").alias("vec_id"))
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    return batch.join(held, "vec_id", "left_semi")


# Metadata filters

_DESCRIBED = "(SELECT e.*, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = e.vec_id) e"
_FILTERS = {
    "eq": "label = 3", "neq": "quality != 1", "range": "n_chars >= 500 AND n_chars < 2000", "in": "lang IN ('de', 'fr')", "not_in": "label NOT IN (1, 2, 3)",
    "between": "label BETWEEN 2 AND 5", "not": "NOT (quality = 1)", "and_or": "label = 1 OR label = 2 AND lang = 'en'", "nested": "(label = 1 OR label = 2) AND NOT (lang = 'en' OR quality = 0)",
    "null": "quality = null", "not_null": "quality != null AND lang = 'es'", "text": "source = 'src1'", "precedence": "NOT label = 1 AND lang = 'de' OR toxic = 1",
}


def _filter(text: str) -> Query:
    return lambda spark, sf_dir: filters.apply(described(spark, sf_dir), text).select(F.col("id").alias("vec_id"))


for _name, _text in _FILTERS.items():
    _as_sql = _text.replace("quality = null", "quality IS NULL").replace("quality != null", "quality IS NOT NULL")
    query(f"filter_{_name}", f"SELECT vec_id FROM {_DESCRIBED} WHERE {_as_sql}")(_filter(_text))


@query("filter_json_props", "SELECT event_id FROM events WHERE CAST(props->>'k' AS BIGINT) BETWEEN 10 AND 20")
def filter_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply(_events(spark, sf_dir), "k BETWEEN 10 AND 20", filters.json_of("props")).select("event_id")


query("knn_filtered_cosine", _top("cosine", "e.label = 3"))(_knn("cosine", "label = 3"))
query("knn_filtered_metadata", _top("l2", "e.lang = 'en' AND e.n_chars > 500", _DESCRIBED))(_knn("l2", "lang = 'en' AND n_chars > 500", described))


@query("range_search_l2", f"SELECT e.vec_id, round({_SCORE['l2']}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE round({_SCORE['l2']}, 6) <= 1.2e0")
def range_search_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return search.range_search(rows, vector_of(rows, 0), 1.2, "l2").select(F.col("id").alias("vec_id"), "score")


@query(
    "metadata_lookup_hits",
    f"SELECT t.vec_id, t.score, d.lang, d.n_chars FROM ({_top('cosine')}) t LEFT JOIN documents d ON d.doc_id = t.vec_id",
)
def metadata_lookup_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _knn("cosine")(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "n_chars")
    return hits.join(docs, "vec_id", "left").select("vec_id", "score", "lang", "n_chars")


# Quantization and approximate search

_I8 = "[greatest(-127e0, least(127e0, round(x * 127e0))) FOR x IN {0}]"


@query(
    "int8_quantize_knn",
    f"""SELECT e.vec_id, round(list_dot_product({_I8.format(_E)}, {_I8.format(_Q)}) / 16129e0, 6) AS score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, e.vec_id LIMIT 10""",
)
def int8_quantize_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return ann.int8_knn(rows, vector_of(rows, 0), 10, "dot").select(F.col("id").alias("vec_id"), "score")


def _asked(rows: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 20, as queries."""
    return rows.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")


def _recalled(index, rows: DataFrame, metric: str, name: str) -> DataFrame:
    """Whether the mean recall of all queries against the exact search is 0.9 or more, and
    whether no more than a fifth of all rows is scored exactly for it."""
    exact, asked = search.knn_batch(rows, _asked(rows), 10, metric), _asked(rows)
    found = ann.mean_recall(exact, index.search_batch(asked, 10, metric))
    share = (index.scanned(asked).agg(F.avg("n")).head()[0] or 0) / max(rows.count(), 1)
    return found.select(F.lit(name).alias("index"), (F.col("recall") >= 0.9).alias("recall_from_090"), F.lit(share <= 0.2).alias("scanned_to_020"), "k")


def _recall_sql(name: str) -> str:
    """What is promised: the figures themselves depend on the index."""
    return f"SELECT '{name}' AS index, true AS recall_from_090, true AS scanned_to_020, CAST(least(10, count(*)) AS BIGINT) AS k FROM embeddings"


@query("ann_ivf_recall", _recall_sql("ivf"))
def ann_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _recalled(ann.IvfIndex.build(rows), rows, "l2", "ivf")


@query("ann_lsh", _recall_sql("lsh"))
def ann_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _recalled(ann.LshIndex.build(rows, len(vector_of(rows, 0))), rows, "cosine", "lsh")


@query("ann_pq", _recall_sql("pq"))
def ann_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _recalled(ann.PqIndex.build(rows), rows, "l2", "pq")


# Text


def _hashed(texts: str, ids: str, dim: int) -> str:
    """SQL for embed.hashing_embedder(dim): (ids, place, x) of (ids, text) rows, as single
    precision numbers."""
    return f"""SELECT {ids}, place, CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY {ids})) AS FLOAT) AS DOUBLE) AS x FROM (
      SELECT {ids}, (h // 2) % {dim} AS place, CAST(sum(CASE WHEN h % 2 = 1 THEN -1 ELSE 1 END) AS DOUBLE) AS x FROM (
        SELECT {ids}, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS h FROM (SELECT {ids}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM {texts}))
      GROUP BY {ids}, place) WHERE x <> 0"""


_FIRST_ITEM = "(SELECT 0 AS one, text FROM benchmark ORDER BY item_id LIMIT 1)"


def _nearest_text(texts: str, ids: str, dim: int) -> str:
    key = ids.replace(", ", ", t.")
    return f"""WITH texts AS ({texts}), t AS ({_hashed("texts", ids, dim)}), q AS ({_hashed(_FIRST_ITEM, "one", dim)})
SELECT {ids}, round(coalesce(score, 0e0), 6) AS score FROM texts LEFT JOIN (
  SELECT t.{key}, sum(t.x * q.x) / sqrt(any_value(n2) * (SELECT sum(x * x) FROM q)) AS score
  FROM t JOIN q USING (place) JOIN (SELECT {ids}, sum(x * x) AS n2 FROM t GROUP BY {ids}) n USING ({ids}) GROUP BY t.{key}) USING ({ids})
ORDER BY score DESC, {ids} LIMIT 5"""


@query("text_search", _nearest_text("SELECT item_id, text FROM benchmark", "item_id", 128))
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages by text."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    asked = items.orderBy("id").head()["text"]
    embedder = embed.Models().load("hashing-128")
    return embed.text_search(embed.embed_table(items, "text", embedder), asked, embedder, 5).select(F.col("id").alias("item_id"), "score")


@query(
    "rag_retrieve",
    _nearest_text(
        """SELECT conv_id, turn, chunk, array_to_string(list_slice(w, chunk * 50 + 1, chunk * 50 + 60), ' ') AS text FROM (
    SELECT conv_id, turn, w, unnest(generate_series(0, CAST(greatest(0, ceil((len(w) - 60) / 50e0)) AS BIGINT))) AS chunk
    FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM conversations) WHERE len(w) > 0)""",
        "conv_id, turn, chunk", 64,
    ),
)
def rag_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five chunks of conversations nearest to a passage."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    asked = table(spark, sf_dir, "benchmark").orderBy("item_id").head()["text"]
    found = embed.retrieve(turns, asked, ["conv_id", "turn"], "text", embed.hashing_embedder(64), 5, 60, 10)
    return found.select("conv_id", "turn", F.col("chunk").cast("long").alias("chunk"), "score")


@query("embedding_models", "SELECT * FROM (VALUES ('hashing-128', 128, 'any', true, true), ('hashing-384', 384, 'any', true, false)) t(name, dim, language, bundled, loaded)")
def embedding_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after both were loaded and one was unloaded."""
    models = embed.Models()
    for name in ("hashing-128", "hashing-384"):
        models.load(name)
    models.unload("hashing-384")
    return models.list(spark)


# Streams


@query("stream_lww", _SQL["wal_replay_lww"])
def stream_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay of wal_replay_lww as a stream over the same file, run to its end."""
    where, columns = scratch(spark, "stream-lww"), ["user_id", "event_id", "event_type", "value"]
    stream = _event_stream(spark, sf_dir)
    snapshot = log_stream.Snapshot(spark, f"{where}/state", ["user_id"], ["event_id"])
    log_stream.merge_into(stream.select(*columns), snapshot, f"{where}/checkpoint").awaitTermination()
    return snapshot.state(F.col("event_type") == "error").select(*columns)


def _run_stream(counted: DataFrame, where: str) -> DataFrame:
    """The last complete result of a streaming aggregation, run to its end."""
    spark = counted.sparkSession
    each = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{where}/result")
    counted.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{where}/result")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_stream.read_log_stream(spark, sf_dir, _events(spark, sf_dir).schema, glob="events.parquet")


@query("replay_stream", _SQL["wal_replay_lww"])
def replay_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the last writes as state of the stream."""
    last = log_stream.replay_stream(_event_stream(spark, sf_dir), ["user_id"], ["event_id"], ["event_id", "event_type", "value"])
    return _run_stream(last, scratch(spark, "replay-stream")).where("event_type <> 'error'")


@query("windowed_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _event_stream(spark, sf_dir)
    kind = stream.schema["ts"].dataType  # a watermark wants a time with a zone
    counts = log_stream.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return _run_stream(counts, scratch(spark, "windowed-counts")).select(F.col("window.start").cast(kind).alias("window_start"), "event_type", "n")


# Binary files: written from a table to scratch space and read back


@query("raw_vectors_scan", "SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS ordinal, embedding[1]::DOUBLE AS first, round(list_sum(embedding::DOUBLE[]), 6) + 0e0 AS total FROM embeddings")
def raw_vectors_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw file of the vectors of each label, by id."""
    where, rows = scratch(spark, "raw"), vectors(spark, sf_dir)
    for (label,) in rows.select("label").distinct().collect():
        binary.write_raw(spark, where, f"{label}.f32", rows.where(F.col("label") == label).orderBy("id").select("vector"))
    got = binary.raw_vectors(spark, where, dim=64)
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    label = F.regexp_extract("path", r"([0-9]+)\.f32$", 1).cast(rows.schema["label"].dataType)
    return got.select(label.alias("label"), "ordinal", F.get("vector", F.lit(0)).cast("double").alias("first"), (F.round(total, 6) + 0.0).alias("total"))


@query("wal_file_replay", f"SELECT CAST(user_id AS VARCHAR) AS id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value, CAST(props->>'k' AS BIGINT) AS k FROM ({_LAST}) WHERE event_type <> 'error'")
def wal_file_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of rotated log files, read back and replayed."""
    where = scratch(spark, "wal")
    op = F.when(F.col("event_type") == "error", log.DELETE).otherwise(log.INSERT)
    records = _events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), op.alias("op"), F.lit("events").alias("collection"), F.col("user_id").cast("string").alias("id"),
        F.array(F.col("value").cast("float")).alias("vector"), F.col("props").alias("metadata"),
    )
    binary.write_log(spark, where, records, rotate_bytes=256 << 10)
    left = log.replay(binary.read_log(spark, where), ["collection", "id"], ["seq"])
    return left.select("id", F.get("vector", F.lit(0)).cast("double").alias("value"), F.get_json_object("metadata", "$.k").cast("long").alias("k"))


def _segment(spark: SparkSession, sf_dir: str) -> str:
    """A segment of all vectors, by id."""
    where = scratch(spark, "segment")
    rows = vectors(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"), "vector", F.col("id").alias("created_at"), (F.col("label") == 1).alias("deleted"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("custom")
    )
    binary.write_segment(spark, f"{where}/one", rows, 64, order="created_at")
    return where


@query("segment_scan", "SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS ordinal, CAST(vec_id AS VARCHAR) AS id, vec_id AS created_at, label = 1 AS deleted, 'label ' || label AS custom, embedding[64]::DOUBLE AS last FROM embeddings")
def segment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = binary.read_segments(spark, f"{_segment(spark, sf_dir)}/*")
    return got.select("ordinal", "id", "created_at", "deleted", "custom", F.get("vector", F.lit(63)).cast("double").alias("last"))


@query("segment_point_read", "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos, unnest(embedding::DOUBLE[]) AS value FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1 OFFSET 7)")
def segment_point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eighth entry, by four short reads."""
    vector, meta = binary.read_point(spark, f"{_segment(spark, sf_dir)}/one", 7)
    return spark.createDataFrame([(meta["id"], i, float(x)) for i, x in enumerate(vector)], "id string, pos long, value double")


# The catalog


def _catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, scratch(spark, "catalog"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "vector", F.to_json(F.struct("label")).alias("metadata"), "label")


@query("catalog_roundtrip", "SELECT 'emb' AS name, CAST(count(*) AS BIGINT) AS vector_count, CAST(64 AS INTEGER) AS dim, 'cosine' AS metric FROM embeddings WHERE label <> 3")
def catalog_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection made, filled, partly deleted, compacted and described."""
    catalog, rows = _catalog(spark), _rows(spark, sf_dir)
    catalog.create("emb", 64)
    catalog.insert_batch("emb", rows.drop("label"))
    catalog.delete("emb", rows.where("label = 3"))
    catalog.compact("emb")
    return catalog.describe().select("name", "vector_count", "dim", "metric")


@query("catalog_get", _SQL["get_by_id"])
def catalog_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector read from a collection, after another value of it was replaced."""
    catalog, rows = _catalog(spark), _rows(spark, sf_dir).drop("label")
    catalog.create("emb", 64)
    catalog.insert("emb", "7", [0.0] * 64)
    catalog.insert_batch("emb", rows)
    return spark.createDataFrame(list(enumerate(map(float, catalog.get("emb", "7")))), "pos long, value double")


@query("catalog_drop_recreate", "SELECT 'emb' AS name, CAST(count(*) AS BIGINT) AS vector_count, 'l2' AS metric FROM embeddings WHERE label = 3")
def catalog_drop_recreate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that is dropped and made again holds nothing of what it held."""
    catalog, rows = _catalog(spark), _rows(spark, sf_dir)
    catalog.create("emb", 64)
    catalog.insert_batch("emb", rows.drop("label"))
    catalog.drop("emb")
    catalog.create("emb", 64, "l2")
    catalog.insert_batch("emb", rows.where("label = 3").drop("label"))
    return catalog.describe().select("name", "vector_count", "metric")


@query("catalog_strict_insert", "SELECT * FROM (VALUES ('some are there', 'ALREADY_EXISTS'), ('none is there', 'OK')) t(batch, outcome), (SELECT CAST(count(*) AS BIGINT) AS vector_count FROM embeddings)")
def catalog_strict_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, rows = _catalog(spark), _rows(spark, sf_dir)
    catalog.create("emb", 64)
    catalog.insert_batch("emb", rows.where("label < 5").drop("label"))
    said = []
    for batch, some in (("some are there", rows), ("none is there", rows.where("label >= 5"))):
        try:
            catalog.insert_batch("emb", some.drop("label"), strict=True)
            said.append((batch, "OK"))
        except VectorError as e:
            said.append((batch, e.kind))
    return spark.createDataFrame([(*x, catalog.stats("emb")["vector_count"]) for x in said], "batch string, outcome string, vector_count long")


@query("catalog_search_filtered", f"SELECT CAST(vec_id AS VARCHAR) AS id, score FROM ({_top('cosine', 'e.label = 3')})")
def catalog_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, rows = _catalog(spark), _rows(spark, sf_dir)
    catalog.create("emb", 64)
    catalog.insert_batch("emb", rows.drop("label"))
    return catalog.search("emb", vector_of(vectors(spark, sf_dir), 0), 10, "label = 3").select("id", "score")


@query("catalog_tiers", "SELECT CAST(count(*) AS BIGINT) AS vector_count, true AS fewer_folders FROM embeddings WHERE label <> 3")
def catalog_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection filled by many batches, whose logs and segments are merged by tiers."""
    catalog, rows = Catalog(spark, scratch(spark, "catalog"), compact_after=2, merge_after=3), _rows(spark, sf_dir)
    catalog.create("emb", 64)
    labels = sorted(r[0] for r in rows.select("label").distinct().collect())
    for label in labels:
        catalog.insert_batch("emb", rows.where(F.col("label") == label).drop("label"))
    catalog.delete("emb", rows.where("label = 3"))
    m = catalog._manifest("emb")
    return spark.createDataFrame([(catalog.stats("emb")["vector_count"], len(m["segments"] + m["log"]) < len(labels))], "vector_count long, fewer_folders boolean")


@query("import_log_state", "SELECT 'label_' || label AS name, CAST(count(*) AS BIGINT) AS vector_count FROM embeddings WHERE label < 5 AND vec_id >= 50 GROUP BY label")
def import_log_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log file of inserts, then deletes of the lower ids, applied to the collections
    that exist."""
    where, catalog, rows = scratch(spark, "wal"), _catalog(spark), _rows(spark, sf_dir)
    name = F.concat(F.lit("label_"), F.col("label").cast("string"))
    n = F.col("id").cast("long")
    put = rows.select(n.alias("seq"), F.lit(log.INSERT).alias("op"), name.alias("collection"), "id", "vector", "metadata")
    gone = rows.where(n < 50).select((n + (1 << 40)).alias("seq"), F.lit(log.DELETE).alias("op"), name.alias("collection"), "id", F.array().cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("metadata"))
    binary.write_log(spark, where, put.unionByName(gone))
    for label in range(5):
        catalog.create(f"label_{label}", 64)
    catalog.import_log(binary.read_log(spark, where))
    return catalog.describe().where("vector_count > 0").select("name", "vector_count")


@query("error_codes", """SELECT kind, CAST(code AS INTEGER) AS code FROM (VALUES ('OK', 0), ('NOT_FOUND', 1), ('ALREADY_EXISTS', 2), ('DIM_MISMATCH', 3), ('DIM_TOO_LARGE', 4), ('DIM_TOO_SMALL', 5),
  ('INVALID_NAME', 6), ('IO_ERROR', 7), ('SERIALIZE_ERROR', 8), ('CORRUPTED_SEGMENT', 9), ('INTERNAL_ERROR', 10), ('INVALID_METRIC', 11)) t(kind, code)""")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(CODES.items()), "kind string, code int")


@query("kernels_odd_dims", f"SELECT e.vec_id, d AS dim, round(list_dot_product(({_E})[1:d], ({_Q})[1:d]), 6) + 0e0 AS dot, round(list_distance(({_E})[1:d], ({_Q})[1:d]), 6) + 0e0 AS l2 FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q, (VALUES (1), (7), (17), (63)) v(d)")
def kernels_odd_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernels over leading parts of vectors, of odd dimension."""
    rows = vectors(spark, sf_dir)
    q = kernels.vector_literal(vector_of(rows, 0))
    part = lambda v: F.slice(v, F.lit(1), F.col("dim"))
    cut = rows.withColumn("dim", F.explode(F.array(*[F.lit(d) for d in (1, 7, 17, 63)])))
    values = [(F.round(f(part(F.col("vector")), part(q)), 6) + 0.0).alias(n) for n, f in (("dot", kernels.dot), ("l2", kernels.l2_distance))]
    return cut.select(F.col("id").alias("vec_id"), "dim", *values)
