"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are 64-bit majority hashes of word shingles. Those that differ in at
most ``radius`` bits are linked, exactly. The index has two parts:

* Upper nodes by masked bit patterns. The 64 bits are cut into ``bands`` bands; of
  any two linked fingerprints at least ``bands - radius`` bands agree, so each
  fingerprint goes once under every choice of that many bands, its node being the
  masked pattern. The number of bands follows the number of fingerprints, so nodes
  stay small; a node that is still large is split once more by the bits its mask
  leaves free, by the same argument.
* Within a node, fingerprints stand in Gray order and groups of 16 are summed up,
  level on level, as (mask of common bits, pattern). The self-join goes down pairs
  of groups and drops a pair once the bits known to differ exceed the radius; a
  group or pair of groups that can't exceed it is linked at once, unopened.

Only links that join two parts of a node leave it, at most one per member, so a
group of n near copies yields n links a node and not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Forest, batches_of, connected_components, materialize, scratch, spread

SEED = 42
#: Parts into which the rows of one fingerprint are dealt for the join with its class.
SALTS = 16
#: How often nodes are split at most; each time, the masks become radius + 1 times as many.
MOST_SPLITS = 3
FAN = 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each run of width words, A-Z lower-cased; bytes.split() parts at
    exactly 0x09-0x0D and 0x20."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of each bit, highest first, in how many of the hashes it is set."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)].astype(">u8")).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None, width: int = 4) -> int:
    hashes = np.array(shingle_hashes(text or b"", width), np.uint64)
    if not len(hashes):
        return 0
    return int.from_bytes(np.packbits(majority(hashes) * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp long) for every row of docs; null texts are empty, and texts
    without words get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text", 4 << 20):
            out = [fingerprint(t, width) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))).mapInArrow(run, "doc_id long, fp long")


def spans(bits: list[int], parts: int) -> list[int]:
    """Masks of parts runs that share out the given bits."""
    cuts = [round(len(bits) * i / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def node_masks(n: int, radius: int) -> list[int]:
    """The masks of the upper nodes for n fingerprints: the number of bands with
    the least rows to deal out plus pairs to expect, weighed."""

    def cost(bands: int) -> float:
        same = bands - radius
        return comb(bands, same) * (n + 0.02 * n * n / 2 ** (64 * same / bands))

    bands = min(range(radius + 1, 2 * radius + 1), key=cost) if radius else 1
    parts = spans(list(range(64)), bands)
    return [sum(c) for c in combinations(parts, bands - radius)]


def gray_rank(fp) -> F.Column:
    """Where a word stands in the reflected Gray sequence, as an ordered long."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask of common bits, pattern) of the groups on each level, leaves first."""
    mask, pattern = np.full(len(fps), ALL), fps
    out = [(mask, pattern)]
    while len(mask) > 1:
        at = np.arange(0, len(mask), FAN)
        ones = np.bitwise_and.reduceat(pattern, at)
        zeros = np.bitwise_and.reduceat(mask & ~pattern, at)
        mask, pattern = ones | zeros, ones
        out.append((mask, pattern))
    return out


def link_node(fps: np.ndarray, radius: int, most_pairs: int = 1 << 18) -> np.ndarray:
    """For distinct fingerprints in Gray order: the index of the first member of
    each one's group, groups being linked by radius or fewer differing bits."""
    forest, tree = Forest(len(fps)), levels(fps)

    def accept(level: int, a: np.ndarray, b: np.ndarray) -> None:
        """All below a and b is linked: a star from a's first leaf."""
        size = FAN**level
        if level == 0:
            forest.union(a, b)
            return
        for x, y in zip(a.tolist(), b.tolist()):
            for g in {x, y}:
                leaves = np.arange(g * size, min((g + 1) * size, len(fps)))
                forest.union(np.full(len(leaves), x * size), leaves)

    stack = [(len(tree) - 1, np.array([0]), np.array([0]))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > most_pairs:
            stack += [(level, a[i : i + most_pairs], b[i : i + most_pairs]) for i in range(0, len(a), most_pairs)]
            continue
        mask, pattern = tree[level]
        common = mask[a] & mask[b]
        differing = np.bitwise_count((pattern[a] ^ pattern[b]) & common).astype(np.int64)
        near = differing <= radius
        sure = near & (differing + np.bitwise_count(~common) <= radius)
        accept(level, a[sure], b[sure])
        a, b = a[near & ~sure], b[near & ~sure]
        if level == 0 or not len(a):
            continue
        below = len(tree[level - 1][0])
        grid = np.arange(FAN * FAN)
        x = (a[:, None] * FAN + grid // FAN).ravel()
        y = (b[:, None] * FAN + grid % FAN).ravel()
        ok = (x <= y) & (y < below) & (x < below)
        if level == 1:
            ok &= x < y
        x, y = x[ok], y[ok]
        if level == 1 and len(x):  # what one set holds already needs no look
            roots = forest.roots()
            apart = roots[x] != roots[y]
            x, y = x[apart], y[apart]
        if len(x):
            stack.append((level - 1, x, y))
    return forest.roots()


def _link_stream(radius: int):
    """mapInArrow function: rows sorted by node and Gray rank in; per node, each
    member with the first of its group, unless it is itself."""

    def flush(fps: list, reps: list):
        f, r = np.concatenate(fps).view(np.uint64), np.concatenate(reps)
        roots = link_node(f, radius)
        moved = np.flatnonzero(roots != np.arange(len(f)))
        return r[moved], r[roots[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fps, reps = None, [], []
        us, vs, n = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, rep = (np.asarray(batch.column(c)) for c in ("key", "fp", "rep"))
            starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if key[a] != held:
                    if sum(map(len, fps)) > 1:
                        u, v = flush(fps, reps)
                        us.append(u), vs.append(v)
                        n += len(u)
                    held, fps, reps = key[a], [], []
                fps.append(fp[a:b])
                reps.append(rep[a:b])
            if n > 50_000:
                yield pa.record_batch([np.concatenate(us), np.concatenate(vs)], names=["u", "v"])
                us, vs, n = [], [], 0
        if sum(map(len, fps)) > 1:
            u, v = flush(fps, reps)
            us.append(u), vs.append(v)
        if us:
            yield pa.record_batch([np.concatenate(us), np.concatenate(vs)], names=["u", "v"])

    return run


def links(reps: DataFrame, radius: int = 4, node_rows: int = 200_000) -> DataFrame:
    """Links (u, v) between the rep of distinct fingerprints, (fp, rep) in, that
    join every group whose members are linked by at most radius differing bits;
    a spanning subset of all links, at most one per member and node."""
    masks = node_masks(reps.count(), radius)
    keyed = reps.select(
        "fp", "rep",
        F.posexplode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(signed(m)))) for t, m in enumerate(masks)])).alias("t", "key"),
    )
    done = None
    for _ in range(MOST_SPLITS):
        large = materialize(keyed.groupBy("key").count().where(F.col("count") > node_rows).select("key"), "simhash-nodes")
        if large.isEmpty():
            break
        rest = keyed.join(large, "key", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        parts = [spans([b for b in range(64) if not m >> b & 1], radius + 1) for m in masks]
        table = F.array(*[F.array(*[F.lit(signed(p)) for p in own]) for own in parts])
        each = F.posexplode(F.transform(table[F.col("t")], lambda p, j: F.xxhash64("key", j, F.col("fp").bitwiseAND(p))))
        split = keyed.join(large, "key", "left_semi").select("fp", "rep", F.col("t").alias("above"), each.alias("j", "key"))
        keyed = split.select("fp", "rep", (F.col("above") * (radius + 1) + F.col("j")).alias("t"), "key")
        masks = [m | p for m, own in zip(masks, parts) for p in own]
    keyed = keyed if done is None else done.unionByName(keyed)
    dealt = keyed.select("key", "fp", "rep").repartition("key").sortWithinPartitions("key", gray_rank(F.col("fp")))
    return dealt.mapInArrow(_link_stream(radius), "u long, v long")


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4, node_rows: int = 200_000) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id,
    the smallest doc_id reachable over links.

    Null, empty and wordless texts have fingerprint zero and are linked like any
    other. Rows with equal fingerprints, copies included, form one class before
    any search. Rows with a null doc_id keep their fingerprint's component; where
    every doc_id of a fingerprint is null, so is the component. Other columns
    are ignored; an empty table gives an empty result.
    """
    fp = materialize(fingerprints(docs, width), "simhash-fp")
    with scratch(docs.sparkSession, "simhash-classes"):
        reps = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
        found = connected_components(links(reps.where("rep is not null"), radius, node_rows), "simhash-cc")
        classes = reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
        classes = materialize(classes, "simhash-classes")
    # A fingerprint may be a third of all rows': both sides are salted, the rows by doc_id.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    spread = classes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return fp.withColumn("salt", salt).join(spread, ["fp", "salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; columns as
    they are. Rows with a null doc_id stay. Rows that repeat the kept doc_id stay
    with it when their component says so."""
    kept = simhash_components(docs.select("doc_id", "text"), width, radius).where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is null").unionByName(docs.join(kept.hint("merge"), "doc_id", "left_semi").select(docs.columns))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read_table

    return simhash_components(read_table(spark, sf_dir, "documents"), width=4, radius=4)
