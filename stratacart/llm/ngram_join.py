"""Near duplicates by the Jaccard similarity of word n-grams, with rare-first prefixes.

N-grams are ordered from rare to frequent. Two sets that are similar enough share an n-gram
among the first few of each (the prefix), so candidates are joined on prefix n-grams, kept
apart by length and position, and verified once per pair on their whole texts, where a
suffix filter settles most of the unlike ones.

Texts with equal sets are one node. Nodes meet first at the n-grams that most of them share,
in chunks of a bounded size, where each is compared with groups it is not in yet. Of the pairs
left, only those between nodes of different components can still join anything, and all of
these follow. So a group of copies never has all its pairs built, and no link between two
components is lost.

Frequencies are counted over all texts in ``BINS`` counters, a fixed size that is also what
is broadcast; the counters decide the order alone, never a result.

Results per row:

* a null or empty text, or one of white space alone, has no n-grams and links with nothing;
* a text with fewer words than an n-gram has its word sequence as its one n-gram;
* a null id has its count of n-grams and no component, and joins nothing; rows that share an
  id are one document with the links of all its rows;
* an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacart.llm.common import (
    Steps,
    on_workers,
    slices,
    small_batches,
    stored,
    thrifty,
)
from stratacart.llm.components import components
from stratacart.llm.shingles import shingle_sets

BINS = 1 << 20
_BLOCKS = 16
#: Nodes that are compared with each other in one place before pairs are built.
CHUNK = 128
#: Bytes of text whose shingles are made together: some 30 bytes of memory for each.
BLOCK_BYTES = 512 << 10


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def frequency_order(docs: DataFrame, width: int) -> np.ndarray:
    """For each bin of n-gram hashes a 16-bit number that grows with its count over all texts."""

    names = ["block", "counts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                sets = shingle_sets(_texts(part["text"]), width)
                bins = np.concatenate(sets) & np.uint64(BINS - 1)
                total += np.bincount(bins.astype(np.int64), minlength=BINS)
        blocks = total.astype("<u4" if total.max() < 1 << 32 else "<u8").reshape(_BLOCKS, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(_BLOCKS), pa.int32()), pa.array([b.tobytes() for b in blocks])],
            names=names,
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(*(batch[c].to_pylist() for c in names), strict=True):
                numbers = np.frombuffer(counts, f"<u{len(counts) * _BLOCKS // BINS}")
                totals[block] = totals.get(block, 0) + numbers.astype(np.int64)
        if totals:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(totals, pa.int32()),
                    pa.array([x.astype("<u8").tobytes() for x in totals.values()]),
                ],
                names=names,
            )

    kind = "block int, counts binary"
    counted = docs.select("text").mapInArrow(thrifty(count), kind)
    total = np.zeros((_BLOCKS, BINS // _BLOCKS), dtype=np.uint64)
    with small_batches(docs.sparkSession):
        added = counted.repartition("block").mapInArrow(add, kind).collect()
    for row in added:  # _BLOCKS rows of a fixed size
        total[row["block"]] = np.frombuffer(row["counts"], "<u8")
    return np.round(256 * np.log2(1.0 + total.ravel())).astype(np.uint16)


def prefixes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, digest of the set (null if empty), n (its size) and the prefix's hashes in
    rare-first order."""
    order = docs.sparkSession.sparkContext.broadcast(frequency_order(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                sets = shingle_sets(_texts(part["text"]), width)
                kept = []
                for own in sets:
                    n = len(own)
                    length = n - (percent * n + 99) // 100 + 1 if n else 0
                    by_rank = np.argsort(rank[own & np.uint64(BINS - 1)], kind="stable")
                    kept.append(own[by_rank[:length]])
                ends = np.cumsum([0, *map(len, kept)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array(
                            [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets],
                            pa.binary(),
                        ),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(ends, pa.int32()),
                            pa.array(np.concatenate(kept).view(np.int64)),
                        ),
                    ],
                    names=["doc_id", "digest", "n", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        thrifty(run), "doc_id long, digest binary, n long, prefix array<long>"
    )


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for ascending distinct hashes."""
    n = len(a) + len(b)
    needed = -(-percent * n // (100 + percent))
    if min(len(a), len(b)) < needed or _apart(a, b, 3) > n - 2 * needed:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return 100 * shared >= percent * (n - shared)


def _apart(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    """Suffix filter: a lower bound on how many elements are in one set only, from how many
    fall on either side of a middle element, halved again ``depth`` times."""
    if not depth or not len(a) or not len(b):
        return abs(len(a) - len(b))
    middle = a[len(a) // 2]
    i, j = len(a) // 2, int(np.searchsorted(b, middle))
    return _apart(a[:i], b[:j], depth - 1) + _apart(a[i:], b[j:], depth - 1)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_b", BLOCK_BYTES):
                table = pa.Table.from_batches([part]).combine_chunks()
                unique = [
                    pc.dictionary_encode(table[c].combine_chunks()).cast(
                        pa.dictionary(pa.int32(), pa.string())
                    )
                    for c in ("text_a", "text_b")
                ]
                sets = [
                    [
                        x
                        for some in slices(
                            pa.RecordBatch.from_arrays([u.dictionary], names=["text"]),
                            "text",
                            BLOCK_BYTES,
                        )
                        for x in shingle_sets(_texts(some["text"]), width)
                    ]
                    for u in unique
                ]
                codes = [u.indices.to_pylist() for u in unique]
                keep = [
                    i is not None
                    and j is not None
                    and similar(sets[0][i], sets[1][j], percent)
                    for i, j in zip(*codes, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part["a"].filter(pa.array(keep)), part["b"].filter(pa.array(keep))],
                    names=["a", "b"],
                )

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(second, "b").join(first, "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(thrifty(run), "a long, b long")


def _fits(percent: int) -> str:
    """Length and positional filter for rows (n_a, at_a) and (n_b, at_b), n_a <= n_b."""
    rest = "1 + least(n_a - at_a - 1, n_b - at_b - 1)"
    return (
        f"100 * n_a >= {percent} * n_b"
        f" AND {100 + percent} * ({rest}) >= {percent} * (n_a + n_b)"
    )


def local_links(homes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between similar nodes among those of one home and chunk (node, home,
    chunk). Each pair that is not yet connected in its chunk is verified; a chunk of
    connected nodes takes as many comparisons as it has nodes."""

    def settle(nodes: list[int], own: list[bytes]) -> tuple[list[int], list[int]]:
        sets = shingle_sets(own, width)
        groups: list[list[int]] = []
        a: list[int] = []
        b: list[int] = []
        for i in range(len(nodes)):
            joined, apart = [i], []
            for members in groups:
                match = next((j for j in members if similar(sets[i], sets[j], percent)), None)
                if match is None:
                    apart.append(members)
                else:
                    joined += members
                    a.append(nodes[i])
                    b.append(nodes[match])
            groups = [*apart, joined]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, own = None, [], []
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("home", "chunk", "node"))
            for home, chunk, node, text in zip(*columns, _texts(batch["text"]), strict=True):
                if (home, chunk) != group:
                    if len(nodes) > 1:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, pa.int64()) for x in settle(nodes, own)], names=["a", "b"]
                        )
                    group, nodes, own = (home, chunk), [], []
                nodes.append(node)
                own.append(text)
        if len(nodes) > 1:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in settle(nodes, own)], names=["a", "b"]
            )

    return (
        homes.join(texts, "node")
        .repartition("home", "chunk")
        .sortWithinPartitions("home", "chunk")
        .select("home", "chunk", "node", "text")
        .mapInArrow(thrifty(run), "a long, b long")
    )


def _homes(shared: DataFrame) -> DataFrame:
    """The n-grams where a node meets others: of those in at most ``CHUNK`` nodes the most
    shared one, and the most shared one of the others twice, where nodes fall into chunks of
    about ``CHUNK`` by another hash either time."""
    top = F.struct("k", "token")
    return (
        shared.groupBy("node")
        .agg(
            F.max(F.when(F.col("k") <= CHUNK, top)).alias("small"),
            F.max(F.when(F.col("k") > CHUNK, top)).alias("large"),
        )
        .select("node", F.posexplode(F.array("small", "large", "large")).alias("turn", "top"))
        .where("top IS NOT NULL")
        .select(
            "node",
            F.col("top.token").alias("home"),
            F.expr(
                f"CAST(2 * pmod(xxhash64(node, turn), ceil(top.k / {CHUNK})) AS INT) + turn DIV 2"
            ).alias("chunk"),
        )
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id of its group) of each row."""
    on_workers(docs.sparkSession)
    with Steps(docs.sparkSession) as steps:
        first = Steps(docs.sparkSession)
        whole = first.store(prefixes(docs, width, percent), "prefixes")
        own = stored(whole.select("doc_id", "digest", "n"), "sets")
        nodes_with_prefixes = steps.store(
            whole.where("n > 0 AND doc_id IS NOT NULL")
            .groupBy("digest")
            .agg(
                F.min("doc_id").alias("node"),
                F.min_by(F.struct("n", "prefix"), "doc_id").alias("own"),
            ),
            "nodes",
        )
        nodes = stored(nodes_with_prefixes.select("digest", "node"), "nodes")
        first.drop()
        tokens = nodes_with_prefixes.select(
            "node",
            F.col("own.n").cast("int").alias("n"),
            F.posexplode("own.prefix").alias("at", "token"),
        ).select("token", "node", F.expr("shiftleft(CAST(n AS BIGINT), 32) | at").alias("place"))
        # What stands in one set alone cannot join anything and goes no further.
        size = F.shiftright("place", 32)
        counts = (
            tokens.groupBy("token")
            .agg(F.count("*").alias("k"), F.min(size).alias("least"), F.max(size).alias("most"))
            .where(f"k > 2 OR k = 2 AND 100 * least >= {percent} * most")
            .select("token", "k")
        )
        shared = steps.store(tokens.join(counts, "token"), "shared")
        texts = steps.store(
            docs.select(F.col("doc_id").alias("node"), "text").join(
                shared.select("node").distinct(), "node"
            ),
            "texts",
        )
        near = steps.store(local_links(_homes(shared), texts, width, percent), "links")
        found = components(near)
        labelled = steps.store(
            shared.join(found, "node", "left").select(
                "token",
                "node",
                F.expr("CAST(shiftright(place, 32) AS INT)").alias("n"),
                F.expr("CAST(place & 4294967295 AS INT)").alias("at"),
                F.coalesce("component", "node").alias("component"),
            ),
            "labelled",
        )
        more = verified(_across(labelled, percent), texts, width, percent)
        repeated = (
            own.where("n > 0")
            .groupBy("doc_id")
            .agg(F.min("digest").alias("first"), F.max("digest").alias("last"))
            .where("first <> last")
            .select("doc_id")
        )
        same_id = (
            own.join(repeated, "doc_id")
            .join(nodes.select("digest", "node"), "digest")
            .select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        )
        final = components(near.union(more).union(same_id))
    named = nodes.select("digest", "node").join(final, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component")
    )
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return own.join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), group.alias("component_id")
    )


def _across(labelled: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs (a, b) between nodes of different components.

    Of the nodes with one n-gram, those outside the largest component among them meet all
    others; the largest component's nodes do not meet each other.
    """
    mixed = (
        labelled.groupBy("token", "component")
        .agg(F.count("*").alias("k"))
        .groupBy("token")
        .agg(
            F.count("*").alias("parts"),
            F.max_by("component", F.struct("k", "component")).alias("most"),
        )
        .where("parts > 1")
        .select("token", "most")
    )
    open_rows = labelled.join(mixed, "token")
    columns = ("node", "n", "at", "component")
    few = open_rows.where("component <> most").select(
        "token", *[F.col(c).alias(f"{c}_x") for c in columns]
    )
    many = open_rows.select("token", "most", *[F.col(c).alias(f"{c}_y") for c in columns])
    # A pair outside the largest component is met from either end: one is enough.
    met = few.join(many, "token").where(
        "component_x <> component_y AND (component_y = most OR node_x < node_y)"
    )
    ordered = F.expr("struct(n_x, node_x) < struct(n_y, node_y)")

    def end(name: str, side: str) -> Column:
        other = "y" if side == "x" else "x"
        return F.when(ordered, F.col(f"{name}_{side}")).otherwise(F.col(f"{name}_{other}"))

    return (
        met.select(
            end("node", "x").alias("a"),
            end("n", "x").alias("n_a"),
            end("at", "x").alias("at_a"),
            end("node", "y").alias("b"),
            end("n", "y").alias("n_b"),
            end("at", "y").alias("at_b"),
        )
        .where(_fits(percent))
        .select("a", "b")
        .distinct()
    )
