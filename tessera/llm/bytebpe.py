"""Byte-level BPE from a rank file: ranked merges are folded over the bytes of distinct
words, and documents are put together from their words' ids.

Two forms do the same. ``digests`` and ``encoded`` fold in Python workers, which keep
the words they have seen over all their tasks. ``encoded_by_spark`` folds with
Spark's higher-order functions; there each partition encodes its distinct words anew,
which costs more than the limits allow (README), so the query does not use it.

For Spark the rank map is one literal value, an array of small maps by CRC-32 of the bytes, so
a look-up is an index and a few comparisons. ``encode_words`` starts from a word's
single bytes and folds: the state holds the pieces and the rank of each joined pair
of neighbours; a step joins the leftmost pair of least rank and looks up the two
pairs it changed. It stops changing when no pair has a rank.

A partition of documents runs through one stage without a shuffle: words are split
off and numbered as they first occur, Spark encodes the new ones, and the documents'
word numbers are replaced by ids. Decoding concatenates the binary pieces of ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import ChunkMemo
from tessera.llm.common import batches_of, read_table, spread

RANKS = "byte_bpe_50k.tiktoken"
BUCKETS = 1 << 16
#: Distinct words that a partition numbers before it starts anew; memory only.
MOST_WORDS = 1_500_000
_NO_RANK = 1 << 40


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def rank_map(spark: SparkSession, path: str) -> Column:
    """The rank map as one value: array<map<binary, int>>, by CRC-32 modulo BUCKETS."""
    buckets: list[list[tuple[bytes, int]]] = [[] for _ in range(BUCKETS)]
    for token, rank in read_ranks(path).items():
        buckets[zlib.crc32(token) % BUCKETS].append((token, rank))
    one = spark.createDataFrame([(buckets,)], "t array<array<struct<k:binary,v:int>>>")
    return one.select(F.transform("t", lambda b: F.map_from_entries(b)).alias("t")).scalar()


def _rank(ranks: Column, token: Column) -> Column:
    return F.try_element_at(F.element_at(ranks, (F.crc32(token) % BUCKETS).cast("int") + 1), token)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def encode_words(words: Column, ranks: Column) -> Column:
    """array<array<int>>: the ids of each of an array of binary words."""

    def pair_rank(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), _rank(ranks, F.concat(a, b)))

    def join_at(s: Column, at: Column) -> Column:
        """The state with pieces at - 1 and at (from 0) joined; at is 1 or more."""
        p, r = s["p"], s["r"]

        def joined(new: Column) -> Column:
            left = F.when(at >= 2, F.array(pair_rank(F.get(p, at - 2), new))).otherwise(F.array().cast("array<int>"))
            right = F.when(at + 1 < F.size(p), F.array(pair_rank(new, F.get(p, at + 1)))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(p, F.lit(1), at - 1), F.array(new), F.slice(p, at + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(r))).alias("r"),
            )

        return _let(F.concat(F.get(p, at - 1), F.get(p, at)), joined)

    def step(s: Column, _: Column) -> Column:
        at = F.array_position(s["r"], F.array_min(s["r"])).cast("int")
        return _let(at, lambda a: F.when(a.isNull(), s).otherwise(join_at(s, a)))

    def fold(word: Column) -> Column:
        single = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))

        def start(p: Column) -> Column:
            r = F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x, i: pair_rank(x, F.get(p, i + 1)))
            return F.struct(p.alias("p"), r.alias("r"))

        steps = F.sequence(F.lit(2), F.length(word))
        return F.aggregate(steps, _let(single, start), step, lambda s: F.transform(s["p"], lambda x: _rank(ranks, x)))

    def encode(word: Column) -> Column:
        whole = _rank(ranks, word)
        return F.when(F.length(word) == 0, F.array().cast("array<int>")).when(whole.isNotNull(), F.array(whole)).otherwise(fold(word))

    return F.transform(words, encode)


def _split_stream(pattern: str):
    """mapInArrow function: documents in; per batch, doc_ids, how many words each has,
    their numbers, and the words that are new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        numbers: dict[str, int] = {}
        new: list[str] = []

        def number(word: str) -> int:
            n = numbers.get(word)
            if n is None:
                n = numbers[word] = len(numbers)
                new.append(word)
            return n

        def fresh() -> ChunkMemo:
            return ChunkMemo(lambda chunk: np.array([number(w) for w in find(chunk)], "<u4").tobytes())

        memo, starts = fresh(), True
        for batch in batches_of(batches, "text", 4 << 20):
            if len(numbers) > MOST_WORDS:
                numbers.clear()
                memo, starts = fresh(), True
            refs = [b"".join(memo(t)) if t else b"" for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([[len(r) // 4 for r in refs]], pa.list_(pa.int64())),
                    pa.array([b"".join(refs)], pa.binary()),
                    pa.array([[w.encode() for w in new]], pa.list_(pa.binary())),
                    pa.array([starts]),
                ],
                names=["doc_ids", "sizes", "refs", "words", "starts"],
            )
            new.clear()
            starts = False

    return run


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Batches of encoded documents: doc_ids, sizes (words of each), refs (their
    words' numbers, unsigned 32-bit), words, starts, ids. Word numbers count on over
    the rows of a partition, from the last row with starts true."""
    spark = docs.sparkSession
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _split_stream(pattern), "doc_ids array<long>, sizes array<long>, refs binary, words array<binary>, starts boolean"
    )
    held = split.withColumn("ranks", rank_map(spark, path))
    return held.select("doc_ids", "sizes", "refs", "words", "starts", encode_words(F.col("words"), F.col("ranks")).alias("ids"))


def _assemble(batches: Iterator[pa.RecordBatch], known: list, per_word) -> Iterator[tuple[int, list]]:
    """(doc_id, per_word of each of its words' ids) of every document."""
    for batch in batches:
        for row in batch.to_pylist():
            if row["starts"]:
                known.clear()
            known += [per_word(ids) for ids in row["ids"]]
            refs, at = np.frombuffer(row["refs"], "<u4").tolist(), 0
            for doc_id, n in zip(row["doc_ids"], row["sizes"]):
                yield doc_id, list(map(known.__getitem__, refs[at : at + n]))
                at += n


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the leftmost pair of least rank is joined until no pair
    has a rank. A heap holds the pairs, so long words take n log n steps."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    if n <= 48:
        parts = [word[i : i + 1] for i in range(n)]
        pairs = [ranks.get(word[i : i + 2], _NO_RANK) for i in range(n - 1)]
        while pairs and (least := min(pairs)) < _NO_RANK:
            i = pairs.index(least)
            new = parts[i] + parts[i + 1]
            parts[i : i + 2] = [new]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + new, _NO_RANK)
            if i < len(pairs):
                pairs[i] = ranks.get(new + parts[i + 1], _NO_RANK)
        return [ranks[x] for x in parts]
    # end[i]: where the piece that starts at i ends, 0 if none starts there.
    end, start = [i + 1 for i in range(n)] + [0], [0, *range(n)]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop or mid == stop:
            continue
        end[i], end[mid], start[stop] = stop, 0, i
        if i and (r := ranks.get(word[start[i] : stop])) is not None:
            heapq.heappush(heap, (r, start[i], stop))
        if stop < n and (r := ranks.get(word[i : end[stop]])) is not None:
            heapq.heappush(heap, (r, i, end[stop]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class TextEncoder:
    """What joined makes of per_word of the ids of a chunk's words, for each chunk of a
    text; memos of words and of chunks bound the memory, not the result."""

    def __init__(self, path: str, pattern: str, per_word, joined, most: int = 400_000):
        import regex

        self.ranks, self.find, self.per_word, self.joined, self.most = read_ranks(path), regex.compile(pattern).findall, per_word, joined, most
        self.words: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.chunks = ChunkMemo(self.chunk, most, twice=True)

    def chunk(self, chunk: str):
        words = list(map(self.word, self.find(chunk)))
        return words[0] if len(words) == 1 else self.joined(words)

    def word(self, word: str):
        known = self.words.get(word)
        if known is None:
            known = self.old.get(word)
            if known is None:
                known = self.per_word(merged(word.encode(), self.ranks))
            if len(word) <= 64:
                if len(self.words) >= self.most:  # kept beside the next one, as ChunkMemo does
                    self.old, self.words = self.words, {}
                self.words[word] = known
        return known

    def __call__(self, text: str) -> list:
        return self.chunks(text)


def _digest(pieces: dict[int, bytes], ids: list[int]) -> tuple[int, str, bytes]:
    return len(ids), " ".join(map(str, ids)), b"".join(map(pieces.__getitem__, ids))


def _joined_digests(words: list[tuple[int, str, bytes]]) -> tuple[int, str, bytes]:
    return sum(w[0] for w in words), " ".join(w[1] for w in words), b"".join(w[2] for w in words)


@lru_cache(maxsize=4)
def text_encoder(path: str, pattern: str, kind: str) -> TextEncoder:
    """One encoder a worker; kind "ids" keeps ids, "digest" their number, decimals and
    the concatenated pieces that they decode to."""
    if kind == "ids":
        return TextEncoder(path, pattern, list, lambda words: list(chain.from_iterable(words)))
    return TextEncoder(path, pattern, partial(_digest, {i: t for t, i in read_ranks(path).items()}), _joined_digests)


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row; null texts give no ids."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(path, pattern, "ids")
        for batch in batches_of(batches, "text", 4 << 20):
            ids = [list(chain.from_iterable(encode(t or ""))) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def encoded_by_spark(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row, words encoded by encode_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, words in _assemble(batches, [], list):
            yield pa.record_batch([pa.array([doc_id], pa.int64()), pa.array([[i for w in words for i in w]], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return encode_documents(docs, path, pattern).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(encoded_docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, bytes binary): the concatenated pieces of (doc_id, ids)."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = {i: t for t, i in read_ranks(path).items()}.__getitem__
        for batch in batches:
            out = [b"".join(map(piece, ids or ())) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded_docs.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256 (of the decimal ids, one
    space between), decoded_sha256 (of the pieces of the ids, concatenated).

    Null texts are empty and give no ids; rows that repeat are each encoded; other
    columns are ignored; an empty table gives an empty result.
    """
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(path, pattern, "digest")
        for batch in batches_of(batches, "text", 8 << 20):
            rows = []
            for text in batch.column("text").to_pylist():
                chunks = encode(text) if text else ()
                counts, decimal, data = zip(*chunks) if chunks else ((), (), ())
                rows.append((sum(counts), sha(" ".join(filter(None, decimal)).encode()), sha(b"".join(data))))
            cols = list(zip(*rows))
            yield pa.record_batch([batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
