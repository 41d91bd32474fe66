"""SimHash near copies: fingerprints, and all links between them within a number of bits; near copies by exact resemblance
among the candidates that wider fingerprints give.

A fingerprint is seen as a point: one coordinate per two-bit segment, the segment's count of ones. The Manhattan
distance of two points never exceeds the number of differing bits, so fingerprints within `distance` bits lie
within `distance` there. The segments are dealt into `distance + 3` blocks; of two points that near, at least three
blocks have no difference at all. Every choice of three blocks is a grid whose cells hold the points that agree on
them; within a cell, points are range-joined along the sum of their coordinates (points further apart in it than
`distance` are further apart in Manhattan distance, too), and the differing bits of what remains are counted.

The join is exact. Per distinct fingerprint it costs one row per choice of blocks, and the compared pairs are a
fixed small share of all pairs. A cell beyond `CELL` points is dealt out to pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import Links, components, forest
from tickloom.session import saved

SEED = 42
CELL = 65_536          # points of a cell that one task compares; larger cells are split, never cut
MOST = 8_192           # nodes, and bytes of shingle sets, of a cell whose pairs one task compares exactly; larger ones are split, too
ROOM = 32 << 20
VOTES = 1 << 17        # shingles whose bits are counted at once
EVEN = 0x5555555555555555


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the `width`-word shingles of a lower-cased text; of the whole sequence if it has fewer words."""
    words = text.lower().split()         # on bytes: A-Z, and the six white-space characters of ASCII
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:len(words) - width + 1].tolist()
    stops = (ends[width - 1:] - 1).tolist()
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), VOTES):
        bits = hashes[at:at + VOTES].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Further 64 hash bits from the first (a multiplicative finaliser)."""
    x = hashes ^ (hashes >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return x * np.uint64(0xC4CEB9FE1A85EC53)


def fingerprint(text: Column, width: int = 5) -> Column:
    """Column of fingerprints (bigint); null and empty texts have fingerprint zero."""
    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([majority(shingle_hashes(t.as_buffer().to_pybytes(), width)) for t in texts], pa.int64())
    return run(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(distance: int) -> list[int]:
    """For each choice of three of `distance + 3` blocks of two-bit segments: the bits of those blocks."""
    cuts = [round(32 * i / (distance + 3)) for i in range(distance + 4)]
    blocks = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [signed(a | b | c) for a, b, c in combinations(blocks, 3)]


def segment_counts(fp: Column) -> Column:
    """The count of ones of each two-bit segment, in the segment's place."""
    next_ = F.shiftrightunsigned(fp, 1)
    both = fp.bitwiseAND(next_).bitwiseAND(F.lit(EVEN))
    one = fp.bitwiseXOR(next_).bitwiseAND(F.lit(EVEN))
    return F.shiftleft(both, 1).bitwiseOR(one)


def node_numbers(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for 128 fingerprint bits."""
    return (remixed(first.view(np.uint64)) ^ remixed(second.view(np.uint64) + np.uint64(SEED))).view(np.int64)


def near_in_cells(distance: int, wide: bool):
    """A function for `mapInArrow` over rows sorted by cell: a spanning forest of the links in these cells."""
    def compare(cell: np.ndarray, first: np.ndarray, second: np.ndarray | None, links: Links) -> None:
        total = np.bitwise_count(first.view(np.uint64)).astype(np.int64)
        order = np.lexsort((total, cell))
        cell, first, total = cell[order], first[order], total[order]
        node = first
        if second is not None:
            second = second[order]
            node = node_numbers(first, second)
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(cell))))
        place = number * 256 + total                       # sorted; a cell's points lie within 64 of each other
        reach = np.searchsorted(place, place + distance, side="right")
        at, step = np.arange(len(cell)), 0
        while True:
            step += 1
            at = at[at + step < reach[at]]
            if not len(at):
                return
            to = at + step
            bits = np.bitwise_count((first[at] ^ first[to]).view(np.uint64))
            hit = bits <= distance
            if second is not None and hit.any():
                a, b, bits = at[hit], to[hit], bits[hit].astype(np.int64)
                more = np.bitwise_count((second[a] ^ second[b]).view(np.uint64))
                ok = bits + more <= 2 * distance
                links.add(node[a[ok]], node[b[ok]])
            else:
                links.add(node[at[hit]], node[to[hit]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, held = Links(), None

        def columns(batch):
            return [np.asarray(batch.column(i)) for i in range(2 + wide)]

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = columns(batch)
            if held is not None:
                rows = [np.concatenate(pair) for pair in zip(held, rows, strict=True)]
            cell = rows[0]
            cut = np.searchsorted(cell, cell[-1])          # the last cell may go on in the next batch
            if cut:
                compare(*[x[:cut] for x in rows], *([] if wide else [None]), links)
            held = [x[cut:] for x in rows]
        if held is not None:
            compare(*held, *([] if wide else [None]), links)
        a, b = links.tree()
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at:at + 100_000], pa.int64()),
                                              pa.array(b[at:at + 100_000], pa.int64())], ["u", "v"])
    return run


def near_links(points: DataFrame, distance: int, cell: int = CELL) -> DataFrame:
    """Edges (u, v) that connect just what links within `distance` bits connect.

    `points`: distinct `first` (bigint), and `second` if 128 bits are compared: then a link has at most `distance`
    differing bits among the first 64 and twice that in all. Nodes are `first`, or `node_numbers` of both.
    """
    wide = "second" in points.columns
    bits = ["first", "second"] if wide else ["first"]
    masks = F.array(*[F.lit(m) for m in block_masks(distance)])
    rows = (points.withColumn("counts", segment_counts(F.col("first")))
            .select(*bits, "counts", F.posexplode(masks).alias("choice", "mask"))
            .select(F.xxhash64("choice", F.col("counts").bitwiseAND(F.col("mask"))).alias("cell"), *bits))
    sized = rows.withColumn("n", F.count("*").over(Window.partitionBy("cell")))
    find = near_in_cells(distance, wide)
    # rows arrive sorted by cell: the window has just done so
    usual = sized.where(f"n between 2 and {cell}").select("cell", *bits).mapInArrow(find, "u bigint, v bigint")
    chunks = F.ceil(2 * F.col("n") / cell).cast("int")
    split = (sized.where(f"n > {cell}").withColumn("chunks", chunks)
             .withColumn("chunk", F.pmod(F.xxhash64(*bits), F.col("chunks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select(F.xxhash64("cell", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"), *bits)
             .repartition("cell").sortWithinPartitions("cell").mapInArrow(find, "u bigint, v bigint"))
    return usual.union(split)


def simhash_groups(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, distance: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) per row: component_id is the smallest id that links lead to, itself included.

    Two texts link if their 64-bit fingerprints differ in at most `distance` bits. Null, empty and white texts have
    fingerprint zero and link like any other. Repeated rows each get their row. A null id stays null and counts for
    no component_id, which is null only where a component has no id at all. Other columns of `df` are not used.
    """
    fps = saved(df.select(F.col(id).alias("id"), fingerprint(F.col(text), width).alias("first")))
    points = saved(fps.groupBy("first").agg(F.min("id").alias("rep")))
    roots = components(near_links(points.select("first"), distance))
    placed = points.join(roots, points["first"] == roots["node"], "left").select(
        "first", "rep", F.coalesce("root", "first").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    member = placed.select("first", "root").join(smallest, "root").select("first", "component_id")
    return fps.join(member, "first").select(
        F.col("id").alias(id), hex_digits(F.col("first")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def set_number(shingles: np.ndarray) -> int:
    """One number for a set of shingles, as a signed 64-bit integer."""
    return signed(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))


def as_bytes(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def grid_masks(cuts: int = 12, per_grid: int = 9, seed: int = 7) -> list[tuple[int, int]]:
    """Grids over 128 fingerprint bits: the 64 two-bit segments dealt out `cuts` times into groups of `per_grid`, each as the bits
    it has of either half. Of texts of resemblance 0.8, whose segments agree with a chance of 0.73, all but a few in a hundred
    meet in one of 84 such grids."""
    found = []
    for order in (np.random.RandomState(seed + i).permutation(64) for i in range(cuts)):
        for at in range(0, 64 - per_grid + 1, per_grid):
            bits = sum(3 << 2 * int(s) for s in order[at:at + per_grid])
            found.append((signed(bits & (1 << 64) - 1), signed(bits >> 64)))
    return found


def partners_in_cells(radius: int):
    """A function for `mapInArrow` over rows (cell, node, first, second) sorted by cell: for each node of a cell that has others
    within `radius` bits, the least of them and the nearest."""
    def compare(cell, node, first, second) -> list[np.ndarray]:
        total = np.bitwise_count(first.view(np.uint64)).astype(np.int64) + np.bitwise_count(second.view(np.uint64))
        order = np.lexsort((total, cell))
        cell, node, first, second, total = (x[order] for x in (cell, node, first, second, total))
        number = np.concatenate([[0], np.cumsum(cell[1:] != cell[:-1])])
        place = number * 512 + total                       # sorted; points beyond `radius` in the sum are so in bits, too
        reach = np.searchsorted(place, place + radius, side="right")
        least = np.full(len(cell), np.iinfo(np.int64).max)
        near = least.copy()
        at, step = np.arange(len(cell)), 0
        while True:
            step += 1
            at = at[at + step < reach[at]]
            if not len(at):
                break
            to = at + step
            bits = np.bitwise_count((first[at] ^ first[to]).view(np.uint64)).astype(np.int64)
            bits += np.bitwise_count((second[at] ^ second[to]).view(np.uint64))
            hit = bits <= radius
            a, b, bits = at[hit], to[hit], bits[hit] << 40
            for x, y in ((a, b), (b, a)):                  # each once per step, so plain indexing does
                least[x] = np.minimum(least[x], node[y])
                near[x] = np.minimum(near[x], bits + y)
        found = np.flatnonzero(near < np.iinfo(np.int64).max)
        return [node[found], least[found], near[found] >> 40, node[near[found] & (1 << 40) - 1]]

    names = ["v", "least", "bits", "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.asarray(c) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(pair) for pair in zip(held, rows, strict=True)]
            cut = np.searchsorted(rows[0], rows[0][-1])    # the last cell may go on in the next batch
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in compare(*(x[:cut] for x in rows))], names)
            held = [x[cut:] for x in rows]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in compare(*held)], names)
    return run


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches sorted by `cell`, none of whose cells goes on in the next table."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        cell = rows.column("cell").to_numpy()
        cut = int(np.searchsorted(cell, cell[-1]))
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut)
    if held is not None:
        yield held


def open_pairs(rows: pa.Table, radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of a cell within `radius` bits whose roots differ and whose sizes allow the similarity. Rows with a
    column `grid` give a pair in the first grid only where it meets."""
    cell, first, second, root, size = (rows.column(c).to_numpy() for c in ("cell", "first", "second", "root", "size"))
    grid = rows.column("grid").to_numpy() if "grid" in rows.column_names else None
    total = np.bitwise_count(first.view(np.uint64)).astype(np.int64) + np.bitwise_count(second.view(np.uint64))
    order = np.lexsort((total, cell))
    cell, first, second, root, size, total = (x[order] for x in (cell, first, second, root, size, total))
    if grid is not None:
        grid, x, y, masks = grid[order], counts_of(first), counts_of(second), np.array(grid_masks(), np.int64).view(np.uint64)
    number = np.concatenate([[0], np.cumsum(cell[1:] != cell[:-1])])
    place = number * 512 + total
    reach = np.searchsorted(place, place + radius, side="right")
    at, step = np.arange(len(cell)), 0
    while True:
        step += 1
        at = at[at + step < reach[at]]
        if not len(at):
            return
        to = at + step
        apart = root[at] != root[to]
        a, b = at[apart], to[apart]
        bits = np.bitwise_count((first[a] ^ first[b]).view(np.uint64)).astype(np.int64)
        bits += np.bitwise_count((second[a] ^ second[b]).view(np.uint64))
        hit = (bits <= radius) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]))
        a, b = a[hit], b[hit]
        if grid is not None and len(a):
            new, dx, dy = grid[a] == grid[b], x[a] ^ x[b], y[a] ^ y[b]
            for g, (m, n) in enumerate(masks[:grid[a].max()]):
                new &= (grid[a] <= g) | ((dx & m) | (dy & n) != 0)
            a, b = a[new], b[new]
        if len(a):
            yield order[a], order[b]


def counts_of(fp: np.ndarray) -> np.ndarray:
    """`segment_counts` of an array, unsigned."""
    fp, even = fp.view(np.uint64), np.uint64(EVEN)
    next_ = fp >> np.uint64(1)
    return ((fp & next_ & even) << np.uint64(1)) | ((fp ^ next_) & even)


def open_pairs_in_cells(radius: int, similarity: float):
    """A function for `mapInArrow` over rows (cell, node, first, second, root, size) sorted by cell: its `open_pairs`, the
    smaller node first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches):
            node = rows.column("node").to_numpy()
            for a, b in open_pairs(rows, radius, similarity):
                u, v = node[a], node[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])
    return run


def open_nodes_in_cells(radius: int, similarity: float):
    """A function for `mapInArrow` over rows (cell, grid, node, first, second, root, size) sorted by cell: the rows of nodes that
    have an open pair there, however many the pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches):
            open_ = np.zeros(rows.num_rows, bool)
            for a, b in open_pairs(rows, radius, similarity):
                open_[a] = open_[b] = True
            yield from rows.filter(pa.array(open_)).combine_chunks().to_batches()
    return run


def odd_places(shingles: np.ndarray) -> np.ndarray:
    """512 bits, each set if an odd number of the shingles fall on it: two sets differ in at least as many shingles as bits."""
    odd = np.bincount((shingles & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def alike(x: np.ndarray, y: np.ndarray) -> float:
    """The Jaccard resemblance of two shingle sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def open_links_in_cells(radius: int, similarity: float, block: int = 4_096):
    """A function for `mapInArrow` over rows as for `open_nodes_in_cells` with each node's shingle `set`: open pairs are compared
    exactly where they meet, unless links found before have joined them; a spanning forest of the roots goes out."""
    least = similarity - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        for rows in whole_cells(batches):
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("set")]
            size, odd = rows.column("size").to_numpy(), np.stack([odd_places(s) for s in sets])
            roots, own = np.unique(rows.column("root").to_numpy(), return_inverse=True)
            joined = np.arange(len(roots))
            for left, right in open_pairs(rows, radius, similarity):
                for at in range(0, len(left), block):
                    a, b = left[at:at + block], right[at:at + block]
                    apart = np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64)
                    may = (joined[own[a]] != joined[own[b]]) & (apart * (1 + least) <= (size[a] + size[b]) * (1 - least) + 1e-6)
                    hit = np.array([alike(sets[i], sets[j]) >= least for i, j in zip(a[may], b[may], strict=True)], bool)
                    a, b = own[a[may][hit]], own[b[may][hit]]
                    if len(a):
                        links.add(roots[a], roots[b])
                        child, top = forest(joined[a], joined[b])
                        moved = np.arange(len(roots))
                        moved[child] = top
                        joined = moved[joined]
        a, b = links.tree()
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(b[at:at + 100_000], pa.int64()), pa.array(a[at:at + 100_000], pa.int64())], ["u", "v"])
    return run


def in_grid_cells(points: DataFrame, own: list[str], find, kind: str, cell: int = CELL) -> DataFrame:
    """`find` over rows (cell, *own), sorted by cell, of all grids' cells that hold several points; those beyond `cell` points are
    split into pairs of chunks. `points`: distinct node, first, second and whatever else `own` names, but for the number `grid`."""
    masks = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in grid_masks()])
    rows = (points.select(*[c for c in own if c != "grid"], segment_counts(F.col("first")).alias("x"), segment_counts(F.col("second")).alias("y"),
                          F.posexplode(masks).alias("grid", "mask"))
            .select(F.xxhash64("grid", F.col("x").bitwiseAND(F.col("mask.a")), F.col("y").bitwiseAND(F.col("mask.b"))).alias("cell"), *own))
    sized = rows.withColumn("n", F.count("*").over(Window.partitionBy("cell")))
    usual = sized.where(f"n between 2 and {cell}").select("cell", *own).mapInArrow(find, kind)     # sorted by cell by the window
    split = (sized.where(f"n > {cell}").withColumn("chunks", F.ceil(2 * F.col("n") / cell).cast("int"))
             .withColumn("chunk", F.pmod(F.xxhash64("node", "first", "second"), F.col("chunks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select(F.xxhash64("cell", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"), *own)
             .repartition("cell").sortWithinPartitions("cell").mapInArrow(find, kind))
    return usual.union(split)


def open_links(points: DataFrame, radius: int, similarity: float, cell: int = CELL) -> DataFrame:
    """(u, v) with u < v: every pair of nodes that meet within `radius` bits and that no link has put under one root yet.

    `points`: distinct node, with first, second, root and size (bigint). Their number may grow with the square of a group;
    `joining_links` decides the same pairs without writing them out.
    """
    own = ["node", "first", "second", "root", "size"]
    return in_grid_cells(points, own, open_pairs_in_cells(radius, similarity), "u bigint, v bigint", cell).where("u < v").distinct()


def joining_links(points: DataFrame, sets_of, radius: int, similarity: float, cell: int = CELL, most: int = MOST, room: int = ROOM) -> DataFrame:
    """(u, v): links between roots that join all that the pairs of `open_links` of this resemblance join.

    The exact way for all that `candidate_links` leaves out: inside a component no pair can change anything, and none across
    components is left out. `sets_of` gives (node, set) for rows with a node. Nodes with open pairs go with their sets to the
    cells where they meet, one row for each of at most 84 grids, and pairs exist within tasks only. A cell beyond `most` nodes
    or `room` bytes of sets is dealt out to pairs of chunks.
    """
    own = ["grid", "node", "first", "second", "root", "size"]
    kind = "cell bigint, grid int, node bigint, first bigint, second bigint, root bigint, size bigint"
    met = saved(in_grid_cells(points, own, open_nodes_in_cells(radius, similarity), kind, cell))
    each = Window.partitionBy("cell")
    share = F.greatest(F.count("*").over(each) / most, F.sum("size").over(each) * 8 / room)
    chunks = F.when(share <= 1, 1).otherwise(F.ceil(2 * share)).cast("int")
    dealt = (met.withColumn("chunks", chunks)
             .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .withColumn("cell", F.xxhash64("cell", F.least("chunk", "other"), F.greatest("chunk", "other"))))
    rows = dealt.join(sets_of(met.select("node").distinct()), "node").select("cell", *own, "set")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(open_links_in_cells(radius, similarity), "u bigint, v bigint")


def candidate_links(points: DataFrame, radius: int, cell: int = CELL) -> DataFrame:
    """(u, v) with u < v: for each node, the least and the nearest of the nodes within `radius` bits of 128 that it meets.

    `points`: distinct node, with first and second (bigint). Points are embedded as the counts of ones of their two-bit segments,
    whose Manhattan distance never exceeds the differing bits; grids are cells of points with equal counts in some segments,
    range-joined along the sum of all. At most two links per node are kept, whatever the size of its group; `joining_links` finds the rest.
    """
    found = in_grid_cells(points, ["node", "first", "second"], partners_in_cells(radius), "v bigint, least bigint, bits bigint, near bigint", cell)
    best = found.groupBy("v").agg(F.min("least").alias("least"), F.min(F.struct("bits", "near")).alias("nearest"))
    return (best.select("v", F.explode(F.array("least", "nearest.near")).alias("u"))
            .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())


def resemblance(a: Column, b: Column) -> Column:
    """The Jaccard resemblance of two packed shingle sets."""
    @F.arrow_udf("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        sets = ((np.frombuffer(s.as_buffer(), np.uint64) for s in pair) for pair in zip(left, right, strict=True))
        return pa.array([alike(*pair) for pair in sets], pa.float64())
    return run(a, b)


def radius_at(similarity: float, bits: int = 128, deviations: float = 2.2) -> int:
    """Differing bits within which nearly all pairs of this resemblance lie: the expected ones (shingle sets of resemblance J are
    acos(2J / (1 + J)) apart) and some standard deviations."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return round(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)


def near_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one document per group of near copies: the one with the smallest id (null ids last, then by text).

    Fingerprints of 128 bits give the candidates: first at most two for each distinct text (`candidate_links`), then every
    other pair that meets and is not yet in one group (`joining_links`), so none is left out; two texts link if the Jaccard
    resemblance of their sets of `width`-word shingles, counted exactly, is `similarity` or more.
    Rows without text or words form one group. Rows that are equal throughout are one row then; of rows equal in id and text
    the one stays whose other columns have the least hash. All columns return.
    """
    @F.arrow_udf("struct<node: bigint, first: bigint, second: bigint, size: int>")
    def marks(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            h = shingle_set(t.as_buffer().to_pybytes(), width)
            rows.append((set_number(h), majority(h), majority(remixed(h)), len(h)))
        node, first, second, size = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.StructArray.from_arrays([pa.array(node, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                                           pa.array(size, pa.int32())], ["node", "first", "second", "size"])

    @F.arrow_udf("binary")
    def shingles(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_buffer().to_pybytes(), width).tobytes() for t in texts], pa.binary())

    def keyed(*rest):
        return docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("_key"), F.col(id).isNull().alias("_none"),
                           F.xxhash64(F.col(text)).alias("_tie"), *rest)

    key = ["_key", "_none", "_tie"]
    best = F.min(F.struct("_none", "_id", "_tie", "_key")).alias("best")
    points = saved(keyed(F.col(id).alias("_id"), marks(as_bytes(F.col(text))).alias("m")).select("*", "m.*").groupBy("node")
                   .agg(best, F.first("first").alias("first"), F.first("second").alias("second"), F.first("size").alias("size")))
    a, b = (points.select(F.col("node").alias(n), F.col("size").alias(f"{n}_size")) for n in ("u", "v"))
    x, y = F.col("u_size"), F.col("v_size")
    wide = radius_at(similarity)

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = nodes.join(points, "node").select("node", *[f"best.{c}" for c in key])
        return saved(keyed(as_bytes(F.col(text)).alias("_text")).join(wanted, key).dropDuplicates(["node"]).select("node", shingles("_text").alias("set")))

    def verified(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
        a, b = (sets.select(F.col("node").alias(n), F.col("set").alias(f"{n}_set")) for n in ("u", "v"))
        return saved(pairs.join(a, "u").join(b, "v").where(resemblance(F.col("u_set"), F.col("v_set")) >= similarity - 1e-9).select("u", "v"))

    def placed_by(links: DataFrame) -> DataFrame:
        return points.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))

    pairs = saved(candidate_links(points, wide).join(a, "u").join(b, "v")
                  .where(F.least(x, y) / F.greatest(x, y) >= similarity).select("u", "v"))
    links = verified(pairs)
    first = saved(placed_by(links).select("node", "first", "second", "root", F.col("size").cast("bigint").alias("size")))
    placed = placed_by(links.union(saved(joining_links(first, sets_of, wide, similarity))))
    kept = placed.groupBy("root").agg(F.min("best").alias("best")).select(*[f"best.{c}" for c in key])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    mine = keyed(row).join(kept, key, "left_semi")
    return mine.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(hash_of(docs)))).where("_n = 1").select("_row.*")


def hash_of(docs: DataFrame) -> Column:
    """A hash of all columns of `_row`; maps, which have none, as text."""
    return F.xxhash64(*[F.col("_row")[c].cast("string") if "map<" in docs.schema[c].dataType.simpleString() else F.col("_row")[c] for c in docs.columns])
