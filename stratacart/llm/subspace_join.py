"""Near duplicates among vectors by a subspace pigeonhole join.

Unit vectors are rotated at random and cut into blocks of few dimensions. Two vectors with
cosine t or more have a squared distance of at most 2 - 2t, so in one block at least it is no
more than that block's share of it, in proportion to its dimensions. Each block is joined by
range: its first dimensions are laid on a grid as wide as the block's distance, so partners
lie in the same or a neighbouring cell, where the distance in the whole block decides on
candidates. A candidate is verified by the cosine of the whole vectors, in the first block
alone in which it comes up.

Equal vectors are one node. A cell's vectors are split into chunks of a bounded size, and
chunks meet pairwise, so no task holds a whole cell, however many vectors it has. Within a
task, vectors that are close in the block form tiles, and tiles whose boxes are further apart than
the block's distance are not compared; the others are by a product of the block in single
precision, and what may be near is then decided in double precision. Tasks return how many
links each vector has and one link to the smallest vector of its group, and keep no pairs.

Results per row:

* null, empty or zero vectors and those with null or non-finite components link with nothing
  and are components by themselves; so do vectors without an id, whose component is null;
* vectors of different lengths are not compared;
* rows with equal vectors are linked with each other; each counts as a vector;
* rows that share an id but not the vector are one node: links are counted for both;
* an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacart.llm.common import Steps, on_workers, stored
from stratacart.llm.components import components

#: Dimensions of a block, and those of them that the grid covers.
BLOCK_DIMS = 16
GRID_DIMS = 2
#: Vectors that a task holds, and that it meets one batch after another, at most (on average
#: over hashes). A vector is shuffled once for every so many that it meets. Of vectors with more
#: than ``USUAL_DIMS`` dimensions a task holds as many fewer.
HELD = 32_768
MET = 131_072
USUAL_DIMS = 128
_TILE = 1_024
#: Vectors of a tile, which has a box; tiles that are compared at once; pairs checked at once.
_CLOSE = 256
_WIDE = 8
_PAIRS = 1 << 14
_SLACK = 1e-9


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int) -> list[slice]:
    return [slice(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]


def budgets(dims: int, threshold: float) -> np.ndarray:
    """Each block's share of the squared distance."""
    sizes = np.array([s.stop - s.start for s in blocks(dims)])
    return (2 - 2 * threshold + _SLACK) * sizes / dims


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def rotated(units: np.ndarray) -> np.ndarray:
    """Row by row the same sums in the same order, whatever rows stand beside."""
    return np.einsum("ij,jk->ik", units, rotation(units.shape[1]))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _side_by_side(points: np.ndarray) -> np.ndarray:
    """An order in which every ``_CLOSE`` rows in turn are near each other: halved at the
    coordinate that spreads most, again and again."""
    order = np.arange(len(points))
    parts = [(0, len(points))]
    while parts:
        start, stop = parts.pop()
        tiles = -(-(stop - start) // _CLOSE)
        if tiles < 2:
            continue
        part = order[start:stop]
        rows = points[part]
        widest = rows[:, np.argmax(rows.max(axis=0) - rows.min(axis=0))]
        half = tiles // 2 * _CLOSE
        order[start:stop] = part[np.argpartition(widest, half)]
        parts += [(start, start + half), (start + half, stop)]
    return order


class Side:
    """Vectors of one group, in an order that suits one block, with what comparisons there
    need of them."""

    def __init__(
        self, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, block: int
    ) -> None:
        units = unit(vectors)
        dims = units.shape[1]
        flat = (units @ rotation(dims)[:, blocks(dims)[block]]).astype(np.float32)
        order = _side_by_side(flat)
        self.ids, self.counts, self.units = ids[order], counts[order], units[order]
        flat = flat[order]
        tiles = np.arange(0, len(flat), _CLOSE)
        self.low = np.minimum.reduceat(flat, tiles)
        self.high = np.maximum.reduceat(flat, tiles)
        # Of one side's ``left`` and another's ``right`` the product is the squared distance.
        norms, ones = np.einsum("ij,ij->i", flat, flat), np.ones(len(flat), dtype=np.float32)
        self.left = np.column_stack((-2 * flat, norms, ones))
        self.right = np.vstack((flat.T, ones, norms))
        self._turned = np.empty_like(self.units)
        self._known = np.zeros(len(flat), dtype=bool)

    def turned(self, at: np.ndarray) -> np.ndarray:
        """The rotated vectors at these positions, each rotated when first asked for."""
        new = np.unique(at[~self._known[at]])
        if len(new):
            self._turned[new] = rotated(self.units[new])
            self._known[new] = True
        return self._turned[at]


def _runs(tiles: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and stop of runs of consecutive numbers, at most ``_WIDE`` each."""
    for run in np.split(tiles, np.flatnonzero(np.diff(tiles) > 1) + 1):
        for at in range(0, len(run), _WIDE):
            yield int(run[at]), int(run[at : at + _WIDE][-1]) + 1


def _near_in_block(a: Side, b: Side, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs whose squared distance in the sides' block is at most ``limit``,
    and of some beyond by the rounding of single precision. Tiles whose boxes are further
    apart are not compared."""
    # 18 products and sums of numbers that add up to 4 at most, and the rounding of their terms.
    limit = np.float32(limit + 8 * (len(a.left[0]) + 2) * np.finfo(np.float32).eps)
    for tile in range(len(a.low)):
        gaps = np.maximum(b.low - a.high[tile], a.low[tile] - b.high).clip(min=0)
        near = np.einsum("ij,ij->i", gaps, gaps) <= limit
        if a is b:
            near[:tile] = False
        top = tile * _CLOSE
        left = a.left[top : top + _CLOSE]
        for start, stop in _runs(np.flatnonzero(near)):
            hits = left @ b.right[:, start * _CLOSE : stop * _CLOSE] <= limit
            some = np.flatnonzero(hits.any(axis=1))
            i, j = np.nonzero(hits[some])
            i, j = some[i] + top, j + start * _CLOSE
            if a is b:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), _PAIRS):
                yield i[at : at + _PAIRS], j[at : at + _PAIRS]


def linked(
    a: Side, b: Side, block: int, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the linked pairs whose first fitting block is ``block``, some at a time."""
    dims = a.units.shape[1]
    shares = budgets(dims, threshold)
    starts = [s.start for s in blocks(dims)]
    for p, q in _near_in_block(a, b, shares[block]):
        fits = np.add.reduceat((a.turned(p) - b.turned(q)) ** 2, starts, axis=1) <= shares
        first = fits[:, block] & ~fits[:, :block].any(axis=1)
        p, q = p[first], q[first]
        close = np.einsum("ij,ij->i", a.units[p], b.units[q]) >= threshold
        if close.any():
            yield p[close], q[close]


def _merged(group: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Groups, each named by a position in it, after the pairs (p, q) are joined."""
    p, q = group[p], group[q]
    p, q = p[p != q], q[p != q]
    if not len(p):
        return group
    label = np.arange(len(group))
    while True:
        x, y = label[p], label[q]
        low = np.minimum(x, y)
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label[group]
        label = new


def _summary(a: Side, b: Side, block: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """How many links each vector has and the smallest of its group; no pairs are kept."""
    if a is b:
        ids, counts, shift = a.ids, a.counts, 0
    else:
        ids, counts = np.concatenate((a.ids, b.ids)), np.concatenate((a.counts, b.counts))
        shift = len(a.ids)
    links = np.zeros(len(ids), dtype=np.int64)
    group = np.arange(len(ids))
    for p, q in linked(a, b, block, threshold):
        q = q + shift
        np.add.at(links, p, counts[q])
        np.add.at(links, q, counts[p])
        group = _merged(group, p, q)
    some = np.flatnonzero(links)
    if len(some):
        smallest = ids.copy()
        np.minimum.at(smallest, group, ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[some]) for x in (ids, links, smallest[group])],
            names=["node", "links", "other"],
        )


def _usable(column: str) -> str:
    return (
        f"size({column}) > 0 AND forall({column}, x -> x IS NOT NULL AND NOT isnan(x) AND"
        f" abs(x) < double('Infinity')) AND exists({column}, x -> x <> 0)"
    )


def _placed(nodes: DataFrame, threshold: float) -> DataFrame:
    """Each node with its cell in every block: dims, block, and the cell's coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch["dims"])
            for own in np.unique(dims):
                part = batch.filter(pa.array(dims == own))
                for start in range(0, part.num_rows, _TILE):
                    rows = part.slice(start, _TILE)
                    turned = rotated(unit(_matrix(rows["vector"])))
                    for block, (where, share) in enumerate(
                        zip(blocks(int(own)), budgets(int(own), threshold), strict=True)
                    ):
                        grid = turned[:, where][:, :GRID_DIMS]
                        cells = np.floor(grid / np.sqrt(share)).astype(np.int32)
                        cells = np.pad(cells, ((0, 0), (0, GRID_DIMS - cells.shape[1])))
                        yield pa.RecordBatch.from_arrays(
                            [
                                *rows.columns,
                                pa.array(np.full(rows.num_rows, block, dtype=np.int32)),
                                pa.array(cells[:, 0]),
                                pa.array(cells[:, 1]),
                            ],
                            names=[*rows.schema.names, "block", "x", "y"],
                        )

    kind = nodes.schema["vector"].dataType.simpleString()
    return nodes.mapInArrow(
        run,
        f"node long, n long, vector {kind}, dims int, block int, x int, y int",
    )


def _meetings(placed: DataFrame) -> DataFrame:
    """Rows for the tasks: a group (dims, block, x, y, held, met) has the vectors it holds
    (visit = 0) and those that meet them (visit = 1)."""
    cell = ["dims", "block", "x", "y"]
    sizes = placed.groupBy(cell).agg(F.count("*").alias("size"))
    # As many cells as the grid has on the unit ball in each block, whatever the input.
    around = sizes.select(
        *cell,
        "size",
        F.explode(F.expr("array((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))")).alias("step"),
    ).select(
        "dims",
        "block",
        (F.col("x") - F.col("step.col1")).alias("x"),
        (F.col("y") - F.col("step.col2")).alias("y"),
        "size",
    )
    chunks = (
        around.groupBy(cell)
        .agg(F.sum("size").alias("meets"))
        .join(F.broadcast(sizes), cell)
        .select(
            *cell,
            F.ceil(F.col("size") * F.greatest("dims", F.lit(USUAL_DIMS)) / (HELD * USUAL_DIMS))
            .cast("int")
            .alias("n_held"),
            F.ceil(F.col("meets") / MET).cast("int").alias("n_met"),
        )
    )
    own = placed.join(F.broadcast(chunks), cell).withColumn(
        "chunk", F.expr("CAST(pmod(xxhash64(node), n_held) AS INT)")
    )
    payload = ["node", "n", "vector"]
    holds = own.select(
        *cell,
        F.col("chunk").alias("held"),
        F.explode(F.expr("sequence(0, n_met - 1)")).alias("met"),
        F.lit(0).alias("visit"),
        *payload,
    )
    met = F.expr("CAST(pmod(xxhash64(node, 1), n_met) AS INT)").alias("met")
    within = own.where("chunk > 0").select(
        *cell,
        F.explode(F.expr("sequence(0, chunk - 1)")).alias("held"),
        met,
        F.lit(1).alias("visit"),
        *payload,
    )
    steps = F.explode(F.expr("array((0, 1), (1, -1), (1, 0), (1, 1))")).alias("step")
    across = (
        placed.select("*", steps)
        .withColumns({"x": F.col("x") - F.col("step.col1"), "y": F.col("y") - F.col("step.col2")})
        .join(F.broadcast(chunks), cell)
        .select(
            *cell,
            F.explode(F.expr("sequence(0, n_held - 1)")).alias("held"),
            met,
            F.lit(1).alias("visit"),
            *payload,
        )
    )
    return holds.union(within).union(across)


def _links(meetings: DataFrame, threshold: float) -> DataFrame:
    """node, links (a part of its number of links), other (the smallest of a group it is in)."""
    key = ["dims", "block", "x", "y", "held", "met"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        holding: list[pa.RecordBatch] = []
        held: Side | None = None

        def side(rows: list[pa.RecordBatch]) -> Side:
            whole = pa.Table.from_batches(rows)
            return Side(
                whole["node"].to_numpy(),
                whole["n"].to_numpy(),
                _matrix(whole["vector"]),
                group[1],
            )

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal held, holding
            if held is None and holding:
                held, holding = side(holding), []
                if group[-1] == 0:  # the held meet each other once
                    yield from _summary(held, held, group[1], threshold)

        for batch in batches:
            keys = np.stack([np.asarray(batch[c]) for c in [*key, "visit"]], axis=1)
            turns = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *turns], [*turns, len(keys)], strict=True):
                if start == stop:
                    continue
                *own, visit = keys[start].tolist()
                if tuple(own) != group:
                    yield from settle()
                    group, held, holding = tuple(own), None, []
                rows = batch.slice(start, stop - start)
                if not visit:
                    holding.append(rows)
                    continue
                yield from settle()
                if held is None:
                    continue
                for at in range(0, rows.num_rows, 4 * _TILE):
                    guests = side([rows.slice(at, 4 * _TILE)])
                    yield from _summary(held, guests, group[1], threshold)
        yield from settle()

    return (
        meetings.repartition(*key)
        .sortWithinPartitions(*key, "visit")
        .mapInArrow(run, "node long, links long, other long")
    )


def near_vectors(
    vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Key, n_links, component_id (the smallest key of the group) and kept of each row."""
    on_workers(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    rows = rows.withColumn("linkable", F.expr(f"id IS NOT NULL AND {_usable('vector')}"))
    nodes = stored(
        rows.where("linkable")
        .groupBy("vector")
        .agg(F.min("id").alias("node"), F.count("*").alias("n"))
        .select("node", "n", "vector", F.size("vector").alias("dims")),
        "nodes",
    )
    with Steps(vectors.sparkSession) as steps:
        placed = steps.store(_placed(nodes, threshold), "placed")
        found = stored(_links(_meetings(placed), threshold), "links")
    groups = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    # By a hash first: sorting long arrays by their values is slow.
    digest = F.xxhash64("vector").alias("digest")
    named = (
        nodes.join(totals, "node", "left")
        .join(groups, "node", "left")
        .select(
            digest,
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    linkable = (
        rows.where("linkable")
        .select("id", digest, "vector")
        .join(named, ["digest", "vector"])
        .select("id", "n_links", "component_id")
    )
    alone = rows.where("NOT coalesce(linkable, false)").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return linkable.union(alone).select(
        F.col("id").alias(key),
        "n_links",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
