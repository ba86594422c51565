"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the axes of a PCA, an orthogonal
change of basis that keeps every cosine. Unit vectors with cosine >= t lie within
r = sqrt(2 - 2t), so they differ by at most r along every axis: vectors are dealt to
cells of width r on the leading CELL_AXES, and a cell meets only itself and its neighbours.
Cells are cut into tiles of bounded size, and pairs of tiles are compared in
blocks: the products of the leading dimensions are summed first, what the rest
can add is bounded by the product of the suffix norms, and a pair stops once the
bound falls short of t. Pairs that pass all dimensions are settled by the cosine of
the original components in double precision.

Equal vectors of one label are one class with a weight, so copies cost nothing.
A pair of tiles returns, per class, the sum of its partners' weights and one link
into its local component; links themselves are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Forest, connected_components, materialize, scratch

#: Rows from which the axes are found; they steer pruning only, never the result.
PCA_SAMPLE = 4096
STEP = 8
#: Leading axes that cells are cut on, and parts into which the rows of a cell or the
#: copies of a vector are dealt for joins.
CELL_AXES = 2
SALTS = 16
#: Components that a tile holds at most, about.
TILE_VALUES = 1 << 21


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns, by falling variance about the origin."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    values, axes = np.linalg.eigh(unit.T @ unit)
    return axes[:, np.argsort(-values)]


def compare(x: np.ndarray, y: np.ndarray, axes: np.ndarray | None, t: float, same: bool, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with cosine(x[i], y[j]) >= t, block by block; where x and
    y are the same rows, only i < j."""

    def turned(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        u = u if axes is None else u @ axes
        left = np.sqrt(np.maximum(0, np.cumsum((u * u)[:, ::-1], axis=1)[:, ::-1]))
        return u, np.concatenate([left, np.zeros((len(u), 1))], axis=1)

    (u, su), (w, sw) = turned(x), turned(y)
    squares = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    dim, least = u.shape[1], t - 1e-9
    for a in range(0, len(u), block):
        for b in range(a // block * block if same else 0, len(w), 4 * block):
            to = min(STEP, dim)
            part = u[a : a + block, :to] @ w[b : b + 4 * block, :to].T
            i, j = np.nonzero(part + su[a : a + block, to, None] * sw[None, b : b + 4 * block, to] >= least)
            done = part[i, j]
            i, j = i + a, j + b
            if same:
                ahead = i < j
                i, j, done = i[ahead], j[ahead], done[ahead]
            while to < dim and len(i):
                nxt = min(to + STEP, dim)
                done = done + np.einsum("ij,ij->i", u[i, to:nxt], w[j, to:nxt])
                to = nxt
                open_ = done + su[i, to] * sw[j, to] >= least
                i, j, done = i[open_], j[open_], done[open_]
            if len(i):
                exact = np.einsum("ij,ij->i", x[i], y[j]) / np.sqrt(squares[0][i] * squares[1][j])
                yield i[exact >= t], j[exact >= t]


def _tile_pair(axes_by_dim: dict[int, np.ndarray], t: float):
    """applyInArrow function: the rows of one or two tiles in; (rep, linked, root)
    out for each class with a partner."""

    def run(table: pa.Table) -> pa.Table:
        rep, weight, side = (np.asarray(table.column(c)) for c in ("rep", "weight", "side"))
        flat = table.column("embedding").combine_chunks()
        v = np.asarray(flat.flatten()).astype(np.float64).reshape(len(rep), -1)
        order = np.argsort(side, kind="stable")
        rep, weight, side, v = rep[order], weight[order], side[order], v[order]
        cut, same = int((side == 0).sum()), not (side == 1).any()
        forest, linked = Forest(len(rep)), np.zeros(len(rep), np.int64)
        pairs = compare(v[:cut], v if same else v[cut:], axes_by_dim.get(v.shape[1]), t, same) if cut else ()
        for i, j in pairs:
            j = j if same else j + cut
            np.add.at(linked, i, weight[j])
            np.add.at(linked, j, weight[i])
            forest.union(i, j)
        out = np.flatnonzero(linked)
        return pa.table({"rep": rep[out], "linked": linked[out], "root": rep[forest.roots()[out]]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile_rows: int = 32_768) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links,
    component_id, kept.

    Vectors are compared only where labels are equal and not null and lengths are
    equal. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do rows with a null vec_id: n_links 0, component_id
    their own vec_id, kept true where vec_id is not null. Rows that repeat a vec_id
    count as vectors of their own. Other columns are ignored.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e, "label").withColumn("usable", usable)
    keys = [F.xxhash64(e).alias("h1"), F.xxhash64(F.lit("2"), e).alias("h2"), F.size(e).alias("dim")]
    good = rows.where("usable").select("vec_id", "label", *keys, "embedding")
    classes = good.groupBy("label", "dim", "h1", "h2", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = materialize(classes, "vec-classes")

    sample = classes.orderBy(F.xxhash64("rep", "h1")).limit(PCA_SAMPLE).select("dim", "embedding").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r["embedding"])
    axes = {d: principal_axes(np.array(v, np.float64)) for d, v in by_dim.items() if len(v) > 1 and d <= 4096}

    # The leading coordinates, by built-in functions; other lengths stay in one cell.
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    base = 2 * int(np.ceil(1 / width)) + 5  # more than there are cells along an axis
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    cell = F.lit(0).cast("long")
    for d, a in axes.items():
        own = F.lit(0).cast("long")
        for k in range(min(CELL_AXES, d)):
            axis = F.array(*[F.lit(float(x)) for x in a[:, k]])
            along = F.aggregate(F.zip_with(e, axis, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x) / norm
            own = own + F.floor(along / width).cast("long") * base**k
        cell = F.when(F.col("dim") == d, own).otherwise(cell)
    celled = classes.select("label", "dim", "rep", "weight", "embedding", cell.alias("cell"))
    group = ["label", "dim", "cell"]
    tiles = materialize(celled.groupBy(*group).count().select(*group, F.ceil(F.col("count") / F.least(F.lit(tile_rows), F.greatest(F.lit(1), F.floor(TILE_VALUES / F.col("dim"))))).cast("int").alias("tiles")), "vec-tiles")
    # Of each cell the tiles of its neighbours, by how far their numbers lie apart.
    steps = sorted(sum(o * base**k for k, o in enumerate(c)) for c in product((-1, 0, 1), repeat=CELL_AXES))
    ahead = [x for x in steps if x > 0]
    around = tiles.select("label", "dim", "cell", "tiles", F.explode(F.array(*[F.lit(x).cast("long") for x in steps])).alias("step"))
    around = around.select("label", "dim", (F.col("cell") - F.col("step")).alias("cell"), F.struct("step", "tiles").alias("one"))
    around = around.groupBy(*group).agg(F.map_from_entries(F.collect_list("one")).alias("around"))
    # A cell may hold a third of all rows: both sides are salted, the vectors by rep.
    spread = tiles.join(around, group).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    placed = celled.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS))).join(spread, [*group, "salt"])
    placed = placed.withColumn("tile", F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("tiles")).cast("int"))

    def pair(cell_, i, j, step, side):
        return F.struct(cell_.alias("pc"), F.lit(step).cast("long").alias("step"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.alias("side"))

    c, tile = F.col("cell"), F.col("tile")
    none = F.array().cast("array<int>")

    def of(step: int):
        """The tiles of a neighbouring cell."""
        n = F.coalesce(F.try_element_at("around", F.lit(step).cast("long")), F.lit(0))
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)

    met = [F.transform(of(0), lambda k: pair(c, F.least(tile, k), F.greatest(tile, k), 0, F.when(k < tile, 1).otherwise(0)))]

    def meet(x: int) -> list:
        """The tiles met in the cell ahead by x, and in the one behind."""
        return [F.transform(of(x), lambda k: pair(c, tile, k, x, F.lit(0))), F.transform(of(-x), lambda k: pair(c - x, k, tile, x, F.lit(1)))]

    met += [tiles_met for x in ahead for tiles_met in meet(x)]
    dealt = placed.select("label", "dim", "rep", "weight", "embedding", F.explode(F.concat(*met)).alias("m")).select(
        "label", "dim", "m.pc", "m.step", "m.i", "m.j", "m.side", "rep", "weight", "embedding"
    )
    found = dealt.groupBy("label", "dim", "pc", "step", "i", "j").applyInArrow(_tile_pair(axes, threshold), "rep long, linked long, root long")
    found = materialize(found, "vec-links")

    with scratch(spark, "vec-settled"):
        comps = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), "vec-cc")
        linked = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
        settled = (
            classes.select("label", "dim", "h1", "h2", "rep", "weight")
            .join(linked, "rep", "left")
            .join(comps, F.col("rep") == F.col("node"), "left")
            .select("label", "dim", "h1", "h2", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
        )
        settled = materialize(settled, "vec-settled")
    # So may the copies of a vector be.
    spread = settled.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    done = good.select("vec_id", "label", "dim", "h1", "h2").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).join(spread, ["label", "dim", "h1", "h2", "salt"])
    rest = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.select("vec_id", "n_links", "component_id").unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")) & F.col("vec_id").isNotNull())


def op10_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read_table

    return near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.98)
