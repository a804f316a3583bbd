"""Ranked lexical search of a stated set of items over all documents, by dense blocks.

The items come in blocks whose distinct terms times items fit a bounded matrix of weights. The
documents are read once per block: of each only the terms of the block's vocabulary are kept,
as numbers with their counts, in a stored table. From it Spark counts the documents, their
terms and the documents per term. A tile of documents is then a dense matrix of impacts, and
its product with the weights gives the scores of all items at once.

All numbers are integers held as float64. Vocabulary tiles are cut so that no sum within one can
reach 2 ** 53, up to which float64 adds integers exactly; tiles are added as 64-bit integers.

Results per row:

* a null or empty text, and one without a term, is no document of the collection;
* equal scores ascend by doc_id, a null id last; ties at the last rank are settled by that too;
* repeated documents and repeated items all count and are ranked each on its own;
* an item without terms, or with none that a document has, gets no rows;
* long texts are read whole; empty tables give no rows; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratacart.llm.common import Steps, on_workers, slices

#: Cells of a block's matrix of weights, items times distinct terms: 64 MB.
BLOCK_CELLS = 1 << 23
#: Cells of a tile of impacts, terms times documents: 8 MB.
TILE_CELLS = 1 << 20
#: Terms of a vocabulary tile.
TILE_TERMS = 4096
#: Bytes of text that are looked at together.
TEXT_BYTES = 4 << 20

EXACT = 1 << 53
#: No impact reaches this: (IMPACT * 1000 * tf) div (1000 * tf + something positive).
IMPACT = 1_000_000

#: Bytes of UTF-8 that belong to terms: digits, letters, and all of characters beyond ASCII.
_TERM_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_BREAK = bytes(b if b in _TERM_BYTES else 0x20 for b in bytes(range(256)).lower())

POSTINGS = "doc_id long, n_terms long, terms array<int>, counts array<long>"


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of term characters of a text in UTF-8, with A-Z lower-cased."""
    return text.translate(_BREAK).split()


@dataclass(frozen=True)
class Block:
    """Items with the counts of their terms, numbered within the block."""

    item_ids: list[int | None]
    vocabulary: dict[bytes, int]
    items: np.ndarray
    terms: np.ndarray
    counts: np.ndarray


def _block(rows: Sequence[tuple[int | None, Counter[bytes]]]) -> Block:
    vocabulary = {t: n for n, t in enumerate(sorted(set(chain.from_iterable(c for _, c in rows))))}
    found = [
        (n, vocabulary[t], count) for n, (_, c) in enumerate(rows) for t, count in c.items()
    ]
    items, terms, counts = np.array(found, dtype=np.int64).reshape(-1, 3).T
    return Block([i for i, _ in rows], vocabulary, items, terms, counts)


def blocks(items: Iterable[tuple[int | None, str | None]], cells: int) -> Iterator[Block]:
    """Items with terms, in blocks of at most ``cells`` items times distinct terms; an item
    that exceeds it is a block of its own."""
    rows: list[tuple[int | None, Counter[bytes]]] = []
    known: set[bytes] = set()
    for item_id, text in items:
        counts = Counter(terms_of((text or "").encode()))
        if not counts:
            continue
        if rows and (len(rows) + 1) * len(known | counts.keys()) > cells:
            yield _block(rows)
            rows, known = [], set()
        rows.append((item_id, counts))
        known |= counts.keys()
    if rows:
        yield _block(rows)


def _counted(batch: pa.RecordBatch, vocabulary: dict[bytes, int]) -> pa.RecordBatch:
    texts = pc.fill_null(batch["text"].cast(pa.large_binary()), b"").to_pylist()
    found = [terms_of(t) for t in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    numbers = np.fromiter(
        map(vocabulary.get, chain.from_iterable(found), repeat(-1)), np.int64, lengths.sum()
    )
    rows = np.repeat(np.arange(len(found)), lengths)
    known = numbers >= 0
    size = max(1, len(vocabulary))
    cells, counts = np.unique(rows[known] * size + numbers[known], return_counts=True)
    offsets = np.searchsorted(cells, np.arange(len(found) + 1) * size).astype(np.int32)
    columns = [
        batch["doc_id"],
        pa.array(lengths),
        pa.ListArray.from_arrays(offsets, pa.array((cells % size).astype(np.int32))),
        pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_terms", "terms", "counts"])


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n_terms, and the terms of the vocabulary that each document with terms has."""
    on_workers(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", TEXT_BYTES):
                yield _counted(piece, vocabulary)

    plain = docs.select(F.col("doc_id").cast("long"), "text")
    return plain.mapInArrow(count, POSTINGS).where("n_terms > 0")


def weight(n_docs: int, having: int) -> int:
    """What a term counts that so many of the documents have."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * having + 1)))


def vocabulary_tiles(weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A matrix of items by terms as (term numbers, part of the matrix) such that no product
    with impacts can reach ``EXACT``. Weights too large for that are split over columns."""
    limit = (EXACT - 1) // IMPACT
    whole = weights.astype(np.int64)
    tiles: list[tuple[np.ndarray, np.ndarray]] = []
    columns: list[tuple[int, np.ndarray]] = []
    sums = np.zeros(len(whole), dtype=np.int64)

    def close() -> None:
        nonlocal columns, sums
        if columns:
            numbers = np.array([n for n, _ in columns])
            tiles.append((numbers, np.stack([c for _, c in columns], axis=1).astype(np.float64)))
        columns, sums = [], np.zeros(len(whole), dtype=np.int64)

    for number in range(whole.shape[1]):
        rest = whole[:, number]
        while rest.any():
            part = np.minimum(rest, limit)
            if len(columns) == TILE_TERMS or (sums + part).max() > limit:
                close()
            columns.append((number, part))
            sums = sums + part
            rest = rest - part
    close()
    return tiles


class Best:
    """The best documents of each item so far."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.rows = [np.empty((0, 3), dtype=np.int64) for _ in range(n_items)]
        self.least = np.ones(n_items, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        """scores: items by documents; unknown: 1 where the id is null."""
        for item in np.flatnonzero(scores.max(axis=1) >= self.least):
            better = np.flatnonzero(scores[item] >= self.least[item])
            found = np.stack([scores[item, better], unknown[better], ids[better]], axis=1)
            rows = np.concatenate([self.rows[item], found])
            order = np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]
            self.rows[item] = rows[order]
            if len(order) == self.k:
                self.least[item] = rows[order[-1], 0]


def _impacts(batch: pa.RecordBatch, n_docs: int, n_all: int) -> tuple[np.ndarray, ...]:
    """Offsets of the documents, and the term and impact of each posting."""
    lists, counts = batch["terms"], batch["counts"]
    offsets = np.asarray(lists.offsets)
    terms = np.asarray(lists.values)[offsets[0] : offsets[-1]]
    places = np.asarray(counts.offsets)
    tf = np.asarray(counts.values)[places[0] : places[-1]]
    lengths = np.diff(offsets)
    # Python's integers: the product may pass 64 bits where a sum of all terms does not.
    long = [75 + 25 * n * n_docs // n_all for n in batch["n_terms"].to_pylist()]
    m = np.repeat(np.array(long, dtype=np.int64), lengths)
    return offsets - offsets[0], terms, IMPACT * 1000 * tf // (1000 * tf + 12 * m)


def _ranked(found: DataFrame, block: Block, n_docs: int, n_all: int, having, k: int) -> DataFrame:
    known = np.array([weight(n_docs, n) if n else 0 for n in having], dtype=np.int64)
    entries, item_ids = (block.items, block.terms, block.counts), block.item_ids
    n_items, n_terms = len(item_ids), len(block.vocabulary)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, counts = entries
        matrix = np.zeros((n_items, n_terms), dtype=np.int64)
        matrix[items, terms] = counts * known[terms]
        tiles = vocabulary_tiles(matrix)
        del matrix
        widest = max((len(numbers) for numbers, _ in tiles), default=1)
        n_together = max(1, min(TILE_CELLS // widest, TILE_CELLS // n_items))
        best = Best(n_items, k)
        for whole in batches:
            for start in range(0, whole.num_rows, n_together):
                batch = whole.slice(start, n_together)
                offsets, place, impact = _impacts(batch, n_docs, n_all)
                column = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                scores = np.zeros((n_items, batch.num_rows), dtype=np.int64)
                for numbers, part in tiles:
                    # A split term stands in several columns, but never twice in one tile.
                    row = np.full(n_terms, -1)
                    row[numbers] = np.arange(len(numbers))
                    here = row[place] >= 0
                    dense = np.zeros((len(numbers), batch.num_rows))
                    dense[row[place[here]], column[here]] = impact[here]
                    scores += (part @ dense).astype(np.int64)
                ids = np.asarray(pc.fill_null(batch["doc_id"], 0))
                best.add(scores, ids, np.asarray(batch["doc_id"].is_null()).astype(np.int64))
        rows = np.concatenate(
            [np.insert(r, 0, n, axis=1) for n, r in enumerate(best.rows)] or [np.empty((0, 4))]
        ).astype(np.int64)
        if len(rows):
            null_id = rows[:, 2].astype(bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[:, 0]),
                    pa.array([item_ids[n] for n in rows[:, 0]], type=pa.int64()),
                    pa.array(rows[:, 3], mask=null_id),
                    pa.array(rows[:, 1]),
                ],
                ["item", "item_id", "doc_id", "score"],
            )

    best = found.mapInArrow(rank, "item long, item_id long, doc_id long, score long")
    first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        best.withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )


def search(
    items: DataFrame, docs: DataFrame, k: int = 20, cells: int = BLOCK_CELLS
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item.

    items: item_id, text; docs: doc_id, text. Items pass the driver a block at a time.
    """
    spark = docs.sparkSession
    on_workers(spark)
    steps = Steps(spark)
    result = None
    stated = items.select(F.col("item_id").cast("long"), "text").toLocalIterator()
    for block in blocks(((r["item_id"], r["text"]) for r in stated), cells):
        found = steps.store(postings(docs, block.vocabulary), "postings")
        n_docs, n_all = found.agg(F.count(F.lit(1)), F.sum("n_terms")).head()
        if not n_docs:
            break
        having = [0] * len(block.vocabulary)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            having[r["term"]] = r["count"]
        ranked = _ranked(found, block, n_docs, n_all, having, k)
        result = ranked if result is None else result.union(ranked)
    if result is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return result
