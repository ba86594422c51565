"""Best-fit packing planned over a histogram of lengths.

Documents are tokenized and cut into pieces. How many pieces of each length there
are, at most ``capacity`` numbers, is all that the plan needs: best-fit decreasing
runs over counts, moving whole groups of equal sequences at a time. The plan is
a list of runs, (length, ranks) -> (sequences, offset), whose number depends on
the capacity and not on the number of documents. Each piece then takes its slot
by joining on its rank within its length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import WHITE, chunks_of
from tessera.llm.common import batches_of, materialize, read_table, spread

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
#: Parts into which the pieces of one length are dealt to be ranked.
RANK_PARTS = 1024
_PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _library(path: str):
    """The tokenizer, and of each id whether it ends a pre-token. Some 40 MB that a
    worker keeps, whatever it encodes."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return library, np.array([(library.id_to_token(i) or "").endswith("</w>") for i in range(library.get_vocab_size())])


class WordEncoder:
    """Ids of whole texts as the tokenizers library gives them, for a tokenizer that
    drops white space and case and parts letters, digits and signs: a text is encoded
    by its pre-tokens, each distinct one once as long as it is remembered. Ids are
    little-endian unsigned 32-bit. The memo is bounded, holds short pre-tokens only and
    lives as long as the task that made the encoder."""

    def __init__(self, path: str, memo: int = 250_000):
        self._encode, self._ends = _library(path)
        self._known: dict[str, bytes] = {}
        self._most = memo

    def _one_by_one(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(chunks), 1024):  # the library's results are large
            got = self._encode.encode_batch_fast(chunks[i : i + 1024], add_special_tokens=False)
            out += [array("I", e.ids).tobytes() for e in got]
        return out

    def _encoded(self, tokens: list[str]) -> list[bytes]:
        """The ids of plain pre-tokens, many at a time with blanks between."""
        out: list[bytes] = []
        for i in range(0, len(tokens), 512):
            part = tokens[i : i + 512]
            (got,) = self._encode.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            ends = (np.flatnonzero(self._ends[ids]) + 1) * 4
            if len(ends) != len(part):
                out += self._one_by_one(part)
                continue
            data, at = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(data[at:end])
                at = end
        return out

    def _tokens(self, text: str) -> tuple[list[str], list[str]]:
        """The keys whose ids make up the text, and those of them that are no plain
        pre-tokens but chunks between white space."""
        if not _ODD(text) and "<|" not in text:
            return _PRE_TOKENS(text.lower()), []
        out, other = [], []
        for chunk in chunks_of(text):
            if _ODD(chunk) or "<|" in chunk:
                key = "\0" + chunk  # no plain pre-token begins so
                out.append(key)
                other.append(key)
            else:
                out += _PRE_TOKENS(chunk.lower())
        return out, other

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text in turn; work and memory go by SLICE characters."""
        for group in _groups(texts):
            done = iter(self._ids([part for parts in group for part in parts]))
            for parts in group:
                yield b"".join(islice(done, len(parts)))

    def _ids(self, parts: list[str]) -> list[bytes]:
        split, other = [], []
        for part in parts:
            tokens, chunks = self._tokens(part)
            split.append(tokens)
            other += chunks
        known, seen = self._known, set().union(*split)
        new = seen.difference(known)
        if len(known) + len(new) > self._most:  # what is in use now is kept
            self._known = known = {w: known[w] for w in seen.difference(new)}
        chunks = list(new.intersection(other))
        plain = list(new.difference(chunks))
        known.update(zip(plain, self._encoded(plain)))
        known.update(zip(chunks, self._one_by_one([c[1:] for c in chunks])))
        out = [b"".join(map(known.__getitem__, tokens)) for tokens in split]
        for w in new:
            if len(w) > 64:
                del known[w]
        return out


#: Characters of a text that are taken at once; longer texts are cut at white space.
SLICE = 1 << 18
_CUT = re.compile(f"[{WHITE}]").search
#: What is not surely plain: all but printable ASCII, plain blanks and Latin letters,
#: none of which composes with another.
_ODD = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]").search
#: The tokenizer's pre-tokens of a plain text in lower case.
_PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\t-\r 0-9a-zà-öø-ÿß]+").findall


def _slices(text: str) -> list[str]:
    """The text in parts that begin with white space; no pre-token spans two."""
    out, at = [], 0
    while len(text) - at > SLICE and (cut := _CUT(text, at + SLICE)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def _groups(texts: list[str]) -> Iterator[list[list[str]]]:
    """The texts in groups, each text as its parts; groups end behind SLICE characters."""
    held, size = [], 0
    for text in texts:
        held.append(_slices(text))
        size += len(text)
        if size > SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the pieces of each document: its
    ids and then end_id, cut only where longer than capacity."""
    path = path or public_tokenizers.path(VOCABULARY)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = WordEncoder(path)
        for batch in batches_of(batches, "text", 2 << 20):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    rows.append((doc_id, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, _PIECE_SCHEMA)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Runs (length, first rank, rank behind the
    last, pieces a sequence, first sequence, offset of the first piece): the i-th
    piece of a run goes to sequence first + i // n at offset + (i % n) * length.

    Sequences are handled in groups of neighbours with equal room. A piece goes
    where the least room is that holds it, and so do its equals until that
    sequence can take no more, just as piece by piece.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    out, opened = [], 0
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0

        def place(first: int, n: int, each: int, free: int) -> None:
            nonlocal left, rank
            out.append((length, rank, rank + n * each, each, first, capacity - free))
            room[free - each * length].append((first, n))
            rank, left = rank + n * each, left - n * each

        for free in range(length, capacity + 1):
            while left and room[free]:
                first, n = room[free].pop()
                each = free // length
                whole = min(n, left // each)
                if whole:
                    place(first, whole, each, free)
                if whole < n:
                    rest = n - whole
                    if left and left < each:
                        tail = left
                        place(first + whole, 1, tail, free)
                        whole, rest = whole + 1, rest - 1
                    if rest:
                        room[free].append((first + whole, rest))
                        if not left:
                            break
            if not left:
                break
        if left:
            each = capacity // length
            whole, tail = divmod(left, each)
            if whole:
                place(opened, whole, each, capacity)
            if tail:
                place(opened + whole, 1, tail, capacity)
            opened += whole + bool(tail)
    return out


def ranked(parts: DataFrame) -> DataFrame:
    """Adds rank, from 0 within each length. No task gets a whole length: pieces are
    ranked within small parts, and the parts' sizes are summed up."""
    key = parts.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_PARTS)).cast("int"))
    sizes = key.groupBy("length", "part").count()
    before = sizes.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32"))
    return key.withColumn("own", own).join(before, ["length", "part"]).withColumn("rank", F.col("own") - 1 + F.col("before")).drop("part", "own", "before")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None) -> DataFrame:
    """One row per piece of docs: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    Null and empty texts give the end id alone. Rows that repeat, or share or lack a
    doc_id, are packed each on their own. Pieces of full length have a sequence to
    themselves. Other columns are ignored; an empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    parts = materialize(pieces(docs, capacity, end_id, path), "pack-pieces")
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    runs = plan(histogram, capacity)
    schema = "run_length long, first_rank long, behind long, each long, first_sequence long, base long"
    slots = spark.createDataFrame(runs, schema)
    if len(runs) <= 200_000:  # 6 longs each
        slots = F.broadcast(slots)
    at = F.col("rank") - F.col("first_rank")
    return (
        ranked(parts)
        .join(slots, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("behind")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("first_sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("base") + at % F.col("each") * F.col("length")).alias("offset"),
        )
    )


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
