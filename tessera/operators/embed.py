"""Text to vectors, text search, and chunking for retrieval.

The embedder is pluggable: any function from a string column to array<float>. The one
given here needs no model: signed feature hashing of words, at length one, in built-in
functions only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import VectorError
from tessera.functions import kernels
from tessera.operators import search

Embedder = Callable[[Column], Column]


def hashing_embedder(dim: int = 384) -> Embedder:
    """Words, in lower case, are hashed to a place and a sign, counted, and scaled to
    length one; a null text and one without words give the zero vector. The first 32
    bits of a word's MD5 are 2 * place (modulo dim) + sign."""

    def embed(text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

        def code(word: Column) -> Column:
            h = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long")
            return F.struct((F.shiftright(h, 1) % dim).cast("int").alias("place"), F.when(h % 2 == 1, -1).otherwise(1).alias("sign"))

        # Codes in order are folded into one (place, sum) entry for each run of a place.
        start = F.struct(F.array().cast("array<struct<place:int,sum:int>>").alias("done"), F.lit(-1).alias("place"), F.lit(0).alias("sum"))
        entry = lambda s: F.concat(s["done"], F.array(F.struct(s["place"].alias("place"), s["sum"].alias("sum"))))

        def step(s: Column, c: Column) -> Column:
            same = s["place"] == c["place"]
            return F.struct(
                F.when(same, s["done"]).otherwise(entry(s)).alias("done"), c["place"].alias("place"), F.when(same, s["sum"] + c["sign"]).otherwise(c["sign"]).alias("sum")
            )

        sums = F.aggregate(F.array_sort(F.transform(words, code)), start, step, lambda s: F.map_from_entries(entry(s)))
        dense = _let(sums, lambda m: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0)).cast("double")))
        scaled = _let(dense, lambda v: _let(F.sqrt(kernels.squared_norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))
        return scaled.cast("array<float>")

    return embed


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A value worked out once for a body that uses it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def embed_table(df: DataFrame, text_col: str, embedder: Embedder, vector_col: str = "vector") -> DataFrame:
    return df.withColumn(vector_col, embedder(F.col(text_col)))


def embed_query(df: DataFrame, text: str, embedder: Embedder) -> list[float]:
    return df.sparkSession.range(1).select(embedder(F.lit(text)).alias("v")).head()["v"]


def text_search(vectors: DataFrame, text: str, embedder: Embedder, k: int = 10, metric: str = "cosine", where: str | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Embeds the text, then searches as for a vector."""
    return search.knn(vectors, embed_query(vectors, text, embedder), k, metric, where, id_col, vector_col)


def chunks(df: DataFrame, id_col: str | Sequence[str], text_col: str, words: int = 120, overlap: int = 20) -> DataFrame:
    """(ids, chunk, text): runs of words that overlap, over whole texts."""
    if not 0 <= overlap < words:
        raise ValueError("0 <= overlap < words")
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    step = words - overlap
    split = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda w: w != "")
    rows = df.select(*ids, split.alias("__words")).where(F.size("__words") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("__words") - words) / step)).cast("int")
    starts = rows.select(*ids, "__words", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return starts.select(*ids, "chunk", F.array_join(F.slice("__words", F.col("chunk") * step + 1, F.lit(words)), " ").alias("text"))


def retrieve(df: DataFrame, question: str, id_col: str | Sequence[str], text_col: str, embedder: Embedder, k: int = 5, words: int = 120, overlap: int = 20) -> DataFrame:
    """Chunk, embed, and give the k chunks nearest to a question: ids, chunk, text, score."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    parts = embed_table(chunks(df, ids, text_col, words, overlap), "text", embedder)
    ranked = search.scored(parts, embed_query(df, question, embedder), "cosine").drop("vector")
    return ranked.orderBy(F.desc("score"), *ids, "chunk").limit(k)


class Models:
    """The embedders of this process by name. Those listed in BUNDLED need no file, and
    nothing is ever downloaded: to pull another name fails."""

    #: name -> dimension
    BUNDLED = {"hashing-128": 128, "hashing-384": 384}

    def __init__(self) -> None:
        self._loaded: dict[str, Embedder] = {}

    def pull(self, name: str) -> int:
        """The dimension of a model that is there."""
        if name not in self.BUNDLED:
            raise VectorError("NOT_FOUND", name)
        return self.BUNDLED[name]

    def load(self, name: str) -> Embedder:
        if name not in self._loaded:
            self._loaded[name] = hashing_embedder(self.pull(name))
        return self._loaded[name]

    def unload(self, name: str) -> None:
        if self._loaded.pop(name, None) is None:
            raise VectorError("NOT_FOUND", name)

    def list(self, spark: SparkSession) -> DataFrame:
        rows = [(n, d, "any", True, n in self._loaded) for n, d in sorted(self.BUNDLED.items())]
        return spark.createDataFrame(rows, "name string, dim int, language string, bundled boolean, loaded boolean")
