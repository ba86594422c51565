"""Exact token counts of every prefix of a text, by prefix dynamic programming.

The tables of single words come from bpe.PrefixBpe.table. A text is parted at its
white space into chunks, which its pre-tokenizer never joins, so the count of a
prefix is the count of the whole chunks before it plus an entry of one chunk's
table. Counts of texts are last entries of these tables, budgets are read off them;
no text, and no part of one, is encoded again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.bpe import WHITE, ChunkMemo, byte_alphabet, chunks_of, load
from tessera.llm.common import batches_of, read_table, spread

VOCABULARY = "byte_bpe_50k.json"
#: Letters of Latin-1 behind a blank or nothing, and punctuation without an apostrophe.
_PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?)]*)").fullmatch


class PrefixCounter:
    """Counts as the tokenizers library gives them for a byte-level vocabulary,
    without added special tokens; the strings of special tokens inside a text count
    as one token each, the library's default."""

    def __init__(self, path: str, memo: int = 400_000):
        from tokenizers import Tokenizer

        self.model, special = load(path)
        # The library's own pre-tokenizer: letters and digits by its Unicode tables.
        self._split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.special = sorted(special, key=len, reverse=True)
        self._bytes = byte_alphabet()
        self._symbols = {c: "".join(self._bytes[x] for x in chr(c).encode()) for c in range(0x100)}
        self._tables: dict[str, bytes] = {}
        self._most = memo
        self.counts = ChunkMemo(self.count_chunk, memo, twice=True)

    def _table(self, symbols: str) -> bytes | list[int]:
        """The number of tokens of every prefix of one pre-token, by symbols; those of
        short ones are kept, a byte each."""
        known = self._tables.get(symbols)
        if known is None:
            known = self.model.table(symbols)[1]
            if len(symbols) <= 64:
                if len(self._tables) >= self._most:
                    self._tables.clear()
                known = self._tables[symbols] = bytes(known)
        return known

    def _segments(self, chunk: str) -> list[tuple[str, bool]]:
        """The chunk parted at special tokens, leftmost first."""
        out, at = [], 0
        while at < len(chunk):
            found = [(i, s) for s in self.special if (i := chunk.find(s, at)) >= 0]
            if not found:
                break
            i, s = min(found, key=lambda x: x[0])
            out += [(chunk[at:i], False)] * (i > at) + [(s, True)]
            at = i + len(s)
        return out + [(chunk[at:], False)] * (at < len(chunk))

    def count_chunk(self, chunk: str) -> int:
        plain = _PLAIN(chunk)
        if plain:  # a word and its punctuation, which the library parts there too
            word, marks = plain.groups()
            total = self._table(word.translate(self._symbols))[-1]
            return total + self._table(marks)[-1] if marks else total
        total = 0
        for part, special in self._segments(chunk) if "<" in chunk else ((chunk, False),):
            total += 1 if special else sum(self._table(symbols)[-1] for symbols, _ in self._split(part))
        return total

    def count(self, text: str) -> int:
        return sum(self.counts(text))

    def chunk_table(self, chunk: str) -> list[int]:
        """The number of tokens of every prefix of a chunk, by code points."""
        if any(s in chunk for s in self.special):  # a part of a special token is plain text
            return [self.count_chunk(chunk[:j]) for j in range(len(chunk) + 1)]
        out, done = [0], 0
        for symbols, (a, b) in self._split(chunk):
            source = chunk[a:b]
            if source[0] in _WHITE_SET and not source.strip(WHITE_CHARS):
                # A run that ends the prefix is one pre-token, though its last
                # character may part from it before further text.
                run = len(chunk) - len(chunk.lstrip(WHITE_CHARS))
                if a == 0:
                    whole = "".join(self._bytes[x] for x in chunk[:run].encode())
                    out += self._by_code_points(whole, chunk[:run])
                done += self._table(symbols)[-1]
                continue
            table = self._by_code_points(symbols, source)
            if source in ("'re", "'ve", "'ll"):  # cut short, these are no contractions
                table[1] = self.count_chunk(source[:2])
            out += [done + x for x in table[max(0, len(out) - 1 - a) :]]
            done += self._table(symbols)[-1]
        return out

    def _by_code_points(self, symbols: str, source: str) -> list[int]:
        counts = self._table(symbols)
        at, out = 0, []
        for ch in source:
            at += len(ch.encode())
            out.append(counts[at])
        return out

    def prefix_table(self, text: str) -> list[int]:
        """Entry j: the tokens of the first j code points, encoded on their own."""
        out, done = [0], 0
        for chunk in chunks_of(text):
            out += [done + x for x in self.chunk_table(chunk)[1:]]
            done += self.counts.plain[chunk]
        return out

    def fitting(self, text: str, limit: int, counts: list[int] | None = None) -> int:
        """Code points of the longest prefix of at most limit tokens."""
        counts = self.counts(text) if counts is None else counts
        before = np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))
        if before[-1] <= limit:
            return len(text)
        k = int(np.searchsorted(before, limit, side="right")) - 1
        chunks = chunks_of(text)
        table = np.array(self.chunk_table(chunks[k]))
        return sum(map(len, chunks[:k])) + int(np.flatnonzero(table + before[k] <= limit)[-1])


WHITE_CHARS = "".join(chr(c) for c in range(0x3001) if chunks_of("a" + chr(c) + "a") != ["a" + chr(c) + "a"])
_WHITE_SET = frozenset(WHITE_CHARS)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, limit: int = 1024, path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit
    (n_tokens > limit) and fit_chars, the code points of the longest prefix that
    encodes to at most limit tokens. Null texts are empty; other columns are
    ignored; rows that repeat are counted each."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches_of(batches, "text", 8 << 20):
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                counts = own.counts(text)
                n = sum(counts)
                rows.append((len(text.encode()), n, n > limit, own.fitting(text, limit, counts) if n > limit else len(text)))
            cols = list(zip(*rows))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)


def prefix_tables(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, counts): counts[j] is the exact number of tokens of the first j code
    points of the text, for every j; [0] for null and empty texts."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches_of(batches, "text", 1 << 20):
            tables = [own.prefix_table(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(tables, pa.list_(pa.int32()))], names=["doc_id", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, counts array<int>")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), limit=1024)
