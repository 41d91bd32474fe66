"""Embedding near copies: spherical k-means cells, cosines by blocks within cells, one representative per group.

Every vector has a home cell, the centroid nearest in angle. A vector y whose angle to x is at most a lies in cell c
rather than in x's home h only if y.(c - h) >= 0, for which x.(c - h) / |c - h| >= -sin a must hold; so x is sent as a
guest to every such cell, and no link is lost. A pair with two homes meets in the cell of the smaller number alone.
Cells are cut into blocks, and a task takes one pair of blocks: products in single precision find candidates within
a margin, and double precision decides. Equal vectors are compared once.

How many guests there are depends on the vectors: next to none where they lie in clusters, most cells where they are
spread evenly, and the comparison is that of all pairs then.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import Links, components
from tickloom.session import saved

SAMPLE = 8_192             # vectors the centroids are fitted on, at most
SAMPLE_NUMBERS = 1 << 22   # components of them in all, at most
CELL = 16_384              # vectors per cell to aim for
CELLS = (16, 1_024)        # cells, at least and at most
BLOCK = 16_384             # vectors of a block
TILE = 2_048               # vectors per side of one product
ROUNDS = 10
MARGIN = 1e-4              # far above the error of a product in single precision
DOUBLES = 1 << 22          # numbers gathered at once for the exact check


def usable(vector: Column) -> Column:
    """Vectors that can link: not null, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        home = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    return np.unique(c, axis=0)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of one length as double precision."""
    flat = np.asarray(vectors.flatten(), np.float64)
    return flat.reshape(len(vectors), -1)


def cells_of(centroids: np.ndarray, least: float):
    """A function for `arrow_udf`: struct(home, guests) per vector. Vectors of other lengths than the centroids' have
    a cell of their own per length, without guests: -1 - length."""
    reach = -math.sin(math.acos(least)) - 1e-6
    width = centroids.shape[1] if len(centroids) else -1
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0)) if len(centroids) else None

    def run(vectors: pa.Array) -> pa.Array:
        homes, guests = [], []
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        if (sizes == width).all() and len(sizes):
            for at in range(0, len(sizes), 1_024):
                x = unit(matrix(vectors.slice(at, 1_024)))
                near = x @ centroids.T
                home = near.argmax(axis=1)
                lead = near - near[np.arange(len(x)), home][:, None]
                goes = lead >= reach * apart[home]
                goes &= np.arange(len(centroids)) < home[:, None]       # the smaller cell compares
                homes.extend(home.tolist())
                guests.extend(np.flatnonzero(g).tolist() for g in goes)
        else:
            for i, size in enumerate(sizes.tolist()):
                if size == width:
                    one = run(vectors.slice(i, 1)).to_pylist()[0]
                    homes.append(one["home"])
                    guests.append(one["guests"])
                else:
                    homes.append(-1 - size)
                    guests.append([])
        return pa.StructArray.from_arrays([pa.array(homes, pa.int32()), pa.array(guests, pa.list_(pa.int32()))], ["home", "guests"])
    return run


def compare(least: float):
    """A function for `applyInArrow` over one pair of blocks: (node, other, n) rows. With `other` null, n is a number
    of vectors that node links to; else node and other belong to one component."""
    def pairs(x, y, same):
        x32, y32 = x.astype(np.float32), y.astype(np.float32)
        for i in range(0, len(x), TILE):
            for j in range(i if same else 0, len(y), TILE):
                a, b = np.nonzero(x32[i:i + TILE] @ y32[j:j + TILE].T >= least - MARGIN)
                a, b = a + i, b + j
                if same:
                    a, b = a[a < b], b[a < b]
                step = max(1, DOUBLES // x.shape[1])
                for at in range(0, len(a), step):
                    p, q = a[at:at + step], b[at:at + step]
                    ok = np.einsum("ij,ij->i", x[p], y[q]) >= least
                    yield p[ok], q[ok]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, copies = (np.asarray(table.column(c)) for c in ("node", "copies"))
        left = np.asarray(table.column("left"))
        x = unit(matrix(table.column("vector").combine_chunks()))
        same = bool(left.all())
        ours, theirs = np.flatnonzero(left), np.flatnonzero(left if same else ~left)
        found, links = np.zeros(len(node), np.int64), Links()
        for p, q in pairs(x[ours], x[theirs], same):
            p, q = ours[p], theirs[q]
            found += np.bincount(p, copies[q], len(node)).astype(np.int64)
            found += np.bincount(q, copies[p], len(node)).astype(np.int64)
            links.add(node[p], node[q])
        u, v = links.tree()
        some = np.flatnonzero(found)
        return pa.table({"node": pa.array(np.concatenate([node[some], u]), pa.int64()),
                         "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(v, pa.int64())]),
                         "n": pa.array(np.concatenate([found[some], np.zeros(len(u), np.int64)]), pa.int64())})
    return run


def meetings(points: DataFrame, sizes: list) -> DataFrame:
    """A row per point and pair of blocks it takes part in: cell, a, b (the pair), left, node, copies, vector."""
    blocks = {(r["cell"], r["guest"]): max(1, math.ceil(r["n"] / BLOCK)) for r in sizes}

    def number(guest: bool) -> Column:
        known = [x for (cell, g), n in sorted(blocks.items()) if g == guest for x in (F.lit(cell), F.lit(n))]
        return F.coalesce(F.get(F.array(F.create_map(*known)[F.col("cell")]), F.lit(0)), F.lit(0)) if known else F.lit(0)

    own, visiting = number(False), number(True)
    points = points.withColumn("own", own).withColumn("visiting", visiting)
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("guest"), F.col("visiting")).otherwise(F.col("own"))).cast("int")
    pair = lambda a, b, left: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(left).alias("left"))

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    # guests' blocks are numbered from -1 downwards
    as_home = F.concat(
        F.transform(F.filter(upto(F.col("own")), lambda j: j >= F.col("mine")), lambda j: pair(F.col("mine"), j, True)),
        F.transform(F.filter(upto(F.col("own")), lambda j: j < F.col("mine")), lambda j: pair(j, F.col("mine"), False)),
        F.transform(upto(F.col("visiting")), lambda j: pair(F.col("mine"), -1 - j, True)))
    as_guest = F.transform(upto(F.col("own")), lambda j: pair(j, -1 - F.col("mine"), False))
    return (points.withColumn("mine", mine).withColumn("pair", F.explode(F.when(F.col("guest"), as_guest).otherwise(as_home)))
            .select("cell", "pair.a", "pair.b", "pair.left", "node", "copies", "vector"))


def vector_groups(df: DataFrame, id: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) per row: links to vectors with a cosine of at least `least` (double precision).

    n_links counts other rows linked directly, component_id is the smallest id that links lead to, itself included,
    and kept marks the row whose id that is. Null vectors, zero vectors, vectors with a null or non-finite component
    and rows with a null id link with nothing; a null id has no component_id and is kept. Vectors of different
    lengths do not link. Equal rows link with each other. Other columns are not used.
    """
    named = df.select(F.col(id).alias("id"), F.col(vector).alias("vector")).withColumn(
        "ok", usable(F.col("vector")) & F.col("id").isNotNull())
    good = named.where("ok")
    points = saved(good.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
                   .withColumn("node", F.xxhash64("vector")).withColumn("width", F.size("vector")))
    widths = points.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    centroids = np.empty((0, 0))
    if widths:
        width, n = widths[0]
        most = max(1, min(SAMPLE, SAMPLE_NUMBERS // width))
        sample = points.where(F.col("width") == width).orderBy("node").limit(most).select("vector").collect()
        wanted = min(max(math.ceil(n / CELL), CELLS[0]), CELLS[1])
        centroids = spherical_kmeans(unit(np.array([r[0] for r in sample], np.float64)), wanted)
    cells = F.arrow_udf(cells_of(centroids, least), "struct<home: int, guests: array<int>>")
    placed = saved(points.select("node", "copies", "vector", cells("vector").alias("c")).select("node", "copies", "vector", "c.home", "c.guests"))
    at = F.explode(F.concat(F.array(F.struct(F.col("home").alias("cell"), F.lit(False).alias("guest"))),
                            F.transform("guests", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("guest")))))
    in_cells = placed.select("node", "copies", "vector", at.alias("at")).select("at.cell", "at.guest", "node", "copies", "vector")
    # one row per cell: bounded by the number of cells and of lengths
    sizes = placed.select(at.alias("at")).groupBy("at.cell", "at.guest").agg(F.count("*").alias("n")).collect()
    found = saved(meetings(in_cells, sizes).groupBy("cell", "a", "b").applyInArrow(compare(least), "node bigint, other bigint, n bigint"))
    degree = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    joined = (points.select("node", "rep", "copies").join(degree, "node", "left").join(roots, "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    smallest = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    answer = joined.join(smallest, "root").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = (named.select("id", F.when(F.col("ok"), F.xxhash64("vector")).alias("node")).join(answer, "node", "left"))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
