"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases from left to right: the shortest run of
code points that is no phrase yet becomes one (LZ78). Texts that would compress well
together share phrases, so the Jaccard similarity of phrase sets stands for
compression-like similarity (Raff and Nicholas, 2017). The set is hashed and kept
as a minimum-hash signature: hashes are dealt to BINS bins by their leading bits and
each bin keeps 16 bits of its least hash, one-permutation hashing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batches_of, read_table

BINS = 128
EMPTY = 0


def parse(text: str, known: set[str] | None = None, open_phrase: str = "") -> tuple[list[str], str]:
    """New phrases of the text, in order, after those known, which it adds to; and
    the run that is still open at the end."""
    known = set() if known is None else known
    phrases, add = [], known.add
    new = phrases.append
    run = open_phrase
    for ch in text:
        run += ch
        if run not in known:
            add(run)
            new(run)
            run = ""
    return phrases, run


def hashes(phrases: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, phrases), np.uint64, len(phrases))


def signature(phrase_hashes: np.ndarray) -> np.ndarray:
    """BINS 16-bit values; EMPTY where no phrase fell in the bin."""
    out = np.full(BINS, EMPTY, np.uint16)
    if len(phrase_hashes):
        order = np.sort(phrase_hashes)
        which = (order >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        first = np.concatenate(([True], which[1:] != which[:-1]))
        out[which[first]] = 1 + (order[first] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)) % np.uint64(65535)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal bins among those that either fills; 1 if neither does."""
    either = (a != EMPTY) | (b != EMPTY)
    n = int(either.sum())
    return float(((a == b) & either).sum() / n) if n else 1.0


def encoded(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype("<u2").tobytes()).decode()


class Fingerprint:
    """A text's parse, with what is needed to replace its second half."""

    def __init__(self, text: str):
        self.text = text
        half = len(text) - len(text) // 2
        known: set[str] = set()
        self.head, self.open = parse(text[:half], known)
        tail, _ = parse(text[half:], known, self.open)
        self.head_hashes = hashes(self.head)
        self.sig = signature(np.concatenate((self.head_hashes, hashes(tail))))

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """The text with its last half replaced by the first as many code points of
        the other, and its signature; the common head is not parsed again."""
        half = len(self.text) // 2
        new = other[:half]
        tail, _ = parse(new, set(self.head), self.open)
        return self.text[: len(self.text) - half] + new, signature(np.concatenate((self.head_hashes, hashes(tail))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text", 4 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([encoded(Fingerprint(t).sig) for t in texts])],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, ahead): the rows of docs in ascending doc_id, over partitions;
    behind each partition's own rows come, with ahead true, those that follow its
    last: the first of the next partition, and after the last the first of all.

    Nulls come first; rows of one doc_id stand by text. Texts are shuffled once.
    Limits between partitions are approximate quantiles of doc_id, and steer only
    how even the partitions are.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(order.alias("ord"))
    cuts = ids.agg(F.percentile_approx("ord", [i / parts for i in range(1, parts)], 100 * parts)).head()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("ord"))) if cuts else F.lit(0)
    # At most one row a partition, whatever the input.
    firsts = sorted((r["part"], r["least"]) for r in ids.select(part.alias("part"), "ord").groupBy("part").agg(F.min("ord").alias("least")).collect())
    before = {least: firsts[i - 1][0] for i, (_, least) in enumerate(firsts)}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", order.alias("ord")).withColumn("part", part)
    if not before:
        return rows.select("doc_id", "text", F.lit(False).alias("ahead")).limit(0)
    lead = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("ord"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("ahead"))
    copy = F.struct(lead.alias("part"), F.lit(True).alias("ahead"))
    dealt = rows.withColumn("to", F.explode(F.when(F.col("ord").isin(list(before)), F.array(own, copy)).otherwise(F.array(own))))
    return (
        dealt.select("doc_id", "text", "ord", "to.part", "to.ahead")
        .repartitionById(len(cuts) + 1, F.col("part"))
        .sortWithinPartitions("part", "ahead", "ord", "text")
        .select("doc_id", "text", "ahead")
    )


def compare_with_next(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars (code points), edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points
    replaced by the first as many, or all, of the next document's by ascending
    doc_id; after the last comes the first, so a single row is its own next. Null
    texts are empty; an empty text has no phrase, and two such are alike (1). Rows
    with a null doc_id come first; rows of one doc_id follow each other by text.
    Other columns are ignored.
    """
    import hashlib

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, done = None, [], False

        def out():
            cols = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for batch in batches:
            for doc_id, text, ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ahead"))):
                if done:
                    continue
                now = Fingerprint(text or "")
                if held is not None:
                    last_id, last = held
                    edited, sig = last.edited(now.text)
                    rows.append(
                        (last_id, len(last.text), hashlib.sha256(edited.encode()).hexdigest(), encoded(last.sig), encoded(sig), likeness(last.sig, sig), likeness(last.sig, now.sig))
                    )
                held, done = (doc_id, now), ahead
                if len(rows) >= 2000:
                    yield out()
                    rows.clear()
        if rows:
            yield out()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, parts).mapInArrow(run, schema)


def op7_lz_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(read_table(spark, sf_dir, "documents"))
