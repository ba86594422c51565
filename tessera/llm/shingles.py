"""Near copies by the similarity of their shingle sets: SimHash first, then exactly.

Texts are sets of the hashes of their five-word shingles; two are near copies if the
Jaccard similarity of their sets is 0.8 or more. Candidates come from three searches:

* SimHash fingerprints of the sets, linked over the Gray-order index (simhash.links).
  At 0.8 two fingerprints differ in some 9 of 64 bits, in more by chance, so this finds
  the closest copies cheaply and can't find all.
* Prefixes: with all sets in the order of the hashes, two sets that similar share one of
  the least n - ceil(0.8 n) + 1 hashes of each. Of the sets that share one, stars first:
  each with the first of about its size.
* The same groups again, now all pairs that the links so found leave in different
  components. Only members of such pairs go on, with their sets, and of each group a
  forest of links comes back: no pairs leave a task but links, at most one per member.

Pairs that share a prefix hash are compared where a parity sketch allows it: as many bits
as the set has hashes, each flipped by the hashes that fall on it. Two sets differ in at
least as many hashes as their sketches in bits. The sets themselves then decide.

Equal sets are one class before any search. Large groups are dealt to tiles, and pairs
of tiles to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import batches_of, connected_components, in_bitmap, materialize, row_keys, scratch, spread
from tessera.llm.simhash import shingle_hashes

WIDTH = 5
BLOCK = 256
#: Sets, and hashes of sets, that a tile of a group holds at most, about.
TILE = 4096
TILE_HASHES = 1 << 20
NO_ID = (1 << 63) - 1


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(np.array(shingle_hashes(text or b"", width), np.uint64))


def _class(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.tobytes(), 7)


def parity(hashes: np.ndarray, finer: int = 1) -> bytes:
    """The sketch of a set: a power of two of bits, 64 or more and no fewer than the set
    has hashes, times finer; bit h mod their number is flipped by each hash h."""
    bits = finer * max(64, 1 << (max(len(hashes), 1) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _keys() -> list[Column]:
    """common.row_keys, rows without a doc_id last."""
    ord_, rk = row_keys()
    return [F.when(F.col("doc_id").isNull(), F.lit(NO_ID)).otherwise(ord_).alias("ord"), rk]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*_keys(), F.col("text").cast("binary").alias("text"))


def _signed(values: list) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sketched(docs: DataFrame) -> DataFrame:
    """(ord, rk, cls, n, fp, sketch, prefix) of each row of docs; the last three only
    where a task sees a class for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches_of(batches, "text", 4 << 20):
            cls, n, fp, sketch, prefix = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_set(text)
                cls.append(_class(hashes))
                n.append(len(hashes))
                first = cls[-1] not in seen
                seen.add(cls[-1])
                bits = np.packbits(simhash.majority(hashes) * 2 > len(hashes)).tobytes() if first else b""
                fp.append(int.from_bytes(bits, "big", signed=True) if first else None)
                sketch.append(parity(hashes) if first else None)
                prefix.append(hashes[: len(hashes) - -(-4 * len(hashes) // 5) + 1].view(np.int64) if first else None)
            columns = [batch.column("ord"), batch.column("rk"), _signed(cls), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(sketch, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["ord", "rk", "cls", "n", "fp", "sketch", "prefix"])

    return spread(_texts(docs)).mapInArrow(run, "ord long, rk long, cls long, n int, fp long, sketch binary, prefix array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(cls, hashes) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text", 4 << 20):
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([_signed([_class(s) for s in sets]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["cls", "hashes"])

    return _texts(docs).select("text").mapInArrow(run, "cls long, hashes array<long>")


def _folded(sketches: np.ndarray) -> np.ndarray:
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def _may(n: np.ndarray, sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows may be 0.8 similar: sets that are differ in at most a ninth
    of their hashes."""
    out, step = np.zeros(len(i), bool), max(64, (1 << 20) // sketches.shape[1])
    for k in range(0, len(i), step):
        p, q = i[k : k + step], j[k : k + step]
        differ = np.bitwise_count(sketches[p] ^ sketches[q]).sum(axis=1, dtype=np.int64)
        out[k : k + step] = 9 * differ <= n[p] + n[q]
    return out


def group_pairs(n: np.ndarray, sketch: list[bytes], component: np.ndarray, tile: np.ndarray | None, stars: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) in a group that shares a hash, sorted by n, whose sets may be
    similar enough and lie in different components, and in different tiles where tiles
    are given; with stars only those of the first member of about the size."""
    us, vs = [], []
    size = np.fromiter(map(len, sketch), np.int64, len(sketch))
    reach = np.searchsorted(4 * n, 5 * n, "right")
    heads = []
    if stars:
        a = 0
        while a < len(n):
            heads.append(a)
            a = int(reach[a])
    for width in np.unique(size).tolist():
        # Sketches of one width, and those twice as wide, folded: no pair's widths differ by more.
        own, wider = np.flatnonzero(size == width), np.flatnonzero(size == 2 * width)
        rows = np.frombuffer(b"".join(sketch[x] for x in own), np.uint64).reshape(len(own), -1)
        if len(wider):
            rows = np.concatenate((rows, _folded(np.frombuffer(b"".join(sketch[x] for x in wider), np.uint64).reshape(len(wider), -1))))
        at = np.concatenate((own, wider))
        starts = [int(np.searchsorted(own, h)) for h in heads if size[h] == width] if stars else range(0, len(own), BLOCK)
        for a in starts:
            z = a + 1 if stars else min(a + BLOCK, len(own))
            end = int(np.searchsorted(at, reach[own[z - 1]]))
            for b in range(a, end, 16 * BLOCK):
                y = min(b + 16 * BLOCK, end)
                left, right = at[a:z, None], at[None, b:y]
                ok = (left < right) & (right < reach[left]) & (component[left] != component[right])
                if tile is not None:
                    ok &= tile[left] != tile[right]
                i, j = np.nonzero(ok)
                i, j = i + a, j + b
                may = _may(n[at], rows, i, j)
                us.append(at[i[may]]), vs.append(at[j[may]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], listed: str) -> Iterator[tuple[tuple, list[np.ndarray], list]]:
    """((token, a, b), arrays of the columns, values of the listed column) of each group of
    rows sorted by token, a, b; groups of one row are left out."""
    held, parts = None, []

    def whole():
        return held, [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(len(columns))], [x for p in parts for x in p[-1]]

    for batch in batches:
        if not batch.num_rows:
            continue
        token, a, b = (np.asarray(batch.column(c)) for c in ("token", "a", "b"))
        arrays, values = [np.asarray(batch.column(c)) for c in columns], batch.column(listed)
        new = np.flatnonzero((np.diff(token) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
        starts = [0, *new.tolist(), len(token)]
        for x, y in zip(starts, starts[1:]):
            key = (int(token[x]), int(a[x]), int(b[x]))
            if key != held:
                if sum(len(p[0]) for p in parts) > 1:
                    yield whole()
                held, parts = key, []
            part = values.slice(x, y - x)
            parts.append([*(c[x:y] for c in arrays), part.to_pylist() if listed == "sketch" else [np.asarray(v.values) for v in part]])
    if sum(len(p[0]) for p in parts) > 1:
        yield whole()


def _gathered(found: Iterator[np.ndarray], names: list[str], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Rows of integers in batches, those of one batch once each."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        rows = np.unique(np.concatenate(held), axis=0)
        return pa.record_batch([np.ascontiguousarray(c) for c in rows.T], names=names)

    for rows in found:
        held.append(rows)
        n += len(rows)
        if n > most:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _star_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and n in, candidate pairs of classes with the first of
    about their size out."""

    def pairs() -> Iterator[np.ndarray]:
        for _, (cls, n, component, _), sketch in _grouped(batches, ("cls", "n", "component", "tile"), "sketch"):
            u, v = group_pairs(n, sketch, component, None, True)
            yield np.stack((np.minimum(cls[u], cls[v]), np.maximum(cls[u], cls[v])), axis=1)

    yield from _gathered(pairs(), ["u", "v"])


def _member_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and n in, those that may be similar to one of another
    component out."""

    def members() -> Iterator[np.ndarray]:
        for key, (cls, n, component, tile), sketch in _grouped(batches, ("cls", "n", "component", "tile"), "sketch"):
            some = np.unique(np.concatenate(group_pairs(n, sketch, component, None if key[1] == key[2] else tile, False)))
            yield np.stack((np.full(len(some), key[0]), cls[some], n[some], component[some]), axis=1)

    yield from _gathered(members(), ["token", "cls", "n", "component"])


def _link_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their sets, sorted by group and n, in; out of each group links that join
    what any of its links join."""

    def links() -> Iterator[np.ndarray]:
        for key, (cls, n, component, tile), hashes in _grouped(batches, ("cls", "n", "component", "tile"), "hashes"):
            _, own = np.unique(component, return_inverse=True)
            root, own = list(range(int(own.max()) + 1)), own.tolist()
            u, v = group_pairs(n, [parity(h.view(np.uint64), 16) for h in hashes], component, None if key[1] == key[2] else tile, False)
            kept = []
            for i, j in zip(u.tolist(), v.tolist()):
                x, y = _find(root, own[i]), _find(root, own[j])
                if x != y and 9 * len(np.intersect1d(hashes[i], hashes[j], True)) >= 4 * (n[i] + n[j]):
                    root[max(x, y)] = min(x, y)
                    kept.append((cls[i], cls[j]))
            if kept:
                yield np.array(kept, np.int64)

    yield from _gathered(links(), ["u", "v"])


def _find(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, hashes) of the wanted classes."""
    reps = classes.join(wanted.hint("merge"), "cls", "left_semi").select(F.xxhash64("rep.ord", "rep.rk").alias("key"))
    some = in_bitmap(docs, F.xxhash64(*_keys()), reps, F.col("key"))
    sets = _sets(some).join(wanted.hint("merge"), "cls", "left_semi").groupBy("cls").agg(F.first("hashes").alias("hashes"))
    return materialize(sets, "shingle-sets")


def _similar(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets have a similarity of 0.8 or more."""
    sets = _sets_of(docs, classes, materialize(pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct(), "shingle-wanted"))
    side = lambda s: sets.select(F.col("cls").alias(s), F.col("hashes").alias(f"{s}_set")).hint("merge")
    both = F.size(F.array_intersect("u_set", "v_set"))
    return pairs.join(side("u"), "u").join(side("v"), "v").where(9 * both >= 4 * (F.size("u_set") + F.size("v_set"))).select("u", "v")


def _tiled(rows: DataFrame, tiles: Column, stars: bool = False) -> DataFrame:
    """rows dealt to (a, b): with stars each to its own tile of its group, else to every
    pair of tiles that its own is in."""
    dealt = rows.withColumn("tiles", tiles.cast("int")).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    if stars:
        return dealt.withColumns({"a": F.col("tile"), "b": F.col("tile")})
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least("tile", k).alias("a"), F.greatest("tile", k).alias("b")))
    return dealt.withColumn("m", F.explode(meets)).withColumns({"a": F.col("m.a"), "b": F.col("m.b")})


def _by_group(dealt: DataFrame, more: DataFrame, column: str) -> DataFrame:
    full = dealt.join(more.hint("merge"), "cls").select("token", "a", "b", "cls", "n", "component", "tile", column)
    return full.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b", "n", "cls")


def near_copies(docs: DataFrame) -> DataFrame:
    """(ord, rk, doc_id, component_id, first) for every row of docs: what tells rows apart,
    the smallest doc_id reachable over near copies, and whether the row is the least of
    its component by (ord, rk).

    Rows without a doc_id are compared as any other and come last; where a component has
    no other, its component_id is null. Texts of up to five words are one shingle; null, empty
    and wordless texts are equal. Sets are told apart by a 64-bit hash. Other columns
    are ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    rows = materialize(_sketched(docs), "shingle-rows")
    with scratch(docs.sparkSession, "shingle-grouped"):
        classes = rows.groupBy("cls").agg(F.min(F.struct("ord", "rk")).alias("rep"), F.max("n").alias("n"), F.max("fp").alias("fp"), F.max("sketch").alias("sketch"))
        classes = materialize(classes, "shingle-classes")
        tokens = rows.where("prefix is not null").select("cls", "n", F.explode("prefix").alias("token")).repartition("token").dropDuplicates(["token", "cls"])
        shared = tokens.withColumn("size", F.count("*").over(Window.partitionBy("token"))).where("size > 1").select("token", "cls", "n", "size")
        shared = materialize(shared, "shingle-shared")
        sketches, tiles = classes.select("cls", "sketch"), F.ceil(F.col("size") / TILE)

        by_fp = classes.groupBy("fp").agg(F.min("cls").alias("rep"))
        by_fp = materialize(by_fp, "shingle-fp")
        same_fp = classes.select("cls", "fp").join(by_fp, "fp").where("cls <> rep").select(F.col("rep").alias("u"), F.col("cls").alias("v"))
        near_fp = simhash.links(by_fp)
        stars = _by_group(_tiled(shared.withColumn("component", F.col("cls")), tiles, True), sketches, "sketch").mapInArrow(_star_stream, "u long, v long")
        pairs = same_fp.unionByName(near_fp).unionByName(stars).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        links = materialize(_similar(docs, classes, materialize(pairs, "shingle-pairs")), "shingle-links")

        found = materialize(connected_components(links, "shingle-cc"), "shingle-found")
        group = Window.partitionBy("token")
        keyed = shared.join(found.hint("merge"), F.col("cls") == F.col("node"), "left").select("token", "cls", "n", "size", F.coalesce("component", "cls").alias("component"))
        keyed = keyed.withColumn("lo", F.min("component").over(group)).withColumn("hi", F.max("component").over(group)).where("lo <> hi")
        met = _by_group(_tiled(keyed, tiles), sketches, "sketch").mapInArrow(_member_stream, "token long, cls long, n long, component long")
        members = materialize(met.distinct(), "shingle-members")
        sets = _sets_of(docs, classes, materialize(members.select("cls").distinct(), "shingle-wanted"))
        sizes = members.groupBy("token").agg(F.ceil(F.sum("n") / TILE_HASHES).alias("size"))
        rest = _by_group(_tiled(members.join(sizes, "token"), F.greatest("size", F.lit(1))), sets, "hashes").mapInArrow(_link_stream, "u long, v long")
        links = links.unionByName(materialize(rest, "shingle-links"))

        found = connected_components(links, "shingle-cc")
        grouped = classes.select("cls", "rep").join(found.hint("merge"), F.col("cls") == F.col("node"), "left")
        grouped = materialize(grouped.select("cls", "rep", F.coalesce("component", "cls").alias("component")), "shingle-grouped")
    least = grouped.groupBy("component").agg(F.min("rep").alias("least"))
    of_class = grouped.join(least.hint("merge"), "component").select("cls", "least")
    doc_id = lambda c: F.when(c != NO_ID, c)
    return rows.select("ord", "rk", "cls").join(of_class.hint("merge"), "cls").select(
        "ord", "rk", doc_id(F.col("ord")).alias("doc_id"), doc_id(F.col("least.ord")).alias("component_id"), (F.struct("ord", "rk") == F.col("least")).alias("first")
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, columns as they are: the least by doc_id,
    rows without one last. Of rows equal in doc_id and text one stays."""
    kept = materialize(near_copies(docs).where("first").groupBy("ord", "rk").agg(F.count("*").alias("times")), "shingle-kept")
    ord_, rk = _keys()
    keyed = docs.withColumns({"__ord": ord_, "__rk": rk})
    out = keyed.join(kept.select(F.col("ord").alias("__ord"), F.col("rk").alias("__rk"), "times").hint("merge"), ["__ord", "__rk"])
    repeated = out.where("times > 1").dropDuplicates(["__ord", "__rk"])
    return out.where("times = 1").unionByName(repeated).select(docs.columns)
