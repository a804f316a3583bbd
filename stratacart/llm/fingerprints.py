"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

A text is cut into short paragraphs: at line ends and behind punctuation, and long runs in
between at words chosen by their hash, so that an edit changes the paragraphs around it
alone. A paragraph's digest is a 64-bit hash; the i-th repeat of one has a digest of its own.
Each digest is put into three cells of a sketch, which add up a count, the digests (xor) and
their check sums (xor). Subtracting the sketches of two versions leaves the digests that only
one of them has; peeling cells with a single digest recovers these. Where a sketch is too
small for the difference, peeling gets stuck, and both versions are sketched anew in four
times the cells, until it succeeds.

All texts of a batch are sketched, subtracted and peeled together as arrays.

Likeness is the share of digests that both versions have among those that either has, from
the recovered differences. Two texts without a paragraph are alike.

Results per row:

* a null text is an empty one; texts of white space have paragraphs like others;
* the next document is the one with the next smaller id; after the smallest (null ids come
  last) follows the largest; equal ids are ordered by text, and repeated rows follow each other;
* a lone document is its own next one; an empty table gives none; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b85encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacart.llm.common import part_of, quantiles, shuffle_partitions, slices
from stratacart.llm.shingles import mixed

#: Cells per hash function of the sketch that is returned; retries have four times as many.
CELLS = 8
GROWTH = 4
BLOCK_BYTES = 2 << 20
_PARAGRAPH = re.compile(r"[^\n.,;:!?]*[\n.,;:!?]+[ \t]*|[^\n.,;:!?]+")
_LONG = 60
_WORD = re.compile(r"\s*\S+\s*|\s+")


def paragraphs(text: str) -> list[str]:
    """``text`` cut into its paragraphs; joined they are the text."""
    out = []
    for piece in _PARAGRAPH.findall(text):
        if len(piece) <= _LONG:
            out.append(piece)
            continue
        start = size = 0
        words = _WORD.findall(piece)
        for i, word in enumerate(words, 1):
            size += len(word)
            if xxhash.xxh32_intdigest(word) % 4 == 0 or size > _LONG:
                out.append("".join(words[start:i]))
                start, size = i, 0
        if start < len(words):
            out.append("".join(words[start:]))
    return out


class Digests:
    """Digests of many texts: ``keys`` in turn and the text ``owner`` of each."""

    def __init__(self, texts: list[str]) -> None:
        own = [paragraphs(t) for t in texts]
        self.counts = np.fromiter(map(len, own), np.int64, len(own))
        self.owner = np.repeat(np.arange(len(own)), self.counts)
        digest = xxhash.xxh3_64_intdigest
        keys = np.fromiter(
            (digest(p) for pieces in own for p in pieces), np.uint64, len(self.owner)
        )
        order = np.lexsort((keys, self.owner))
        ordered, owners = keys[order], self.owner[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (ordered[1:] != ordered[:-1]) | (owners[1:] != owners[:-1])
        firsts = np.flatnonzero(new)
        repeat = np.arange(len(keys)) - firsts[np.cumsum(new) - 1]
        again = mixed(ordered + repeat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        keys[order] = np.where(repeat > 0, again, ordered)
        self.keys = keys


def check_sums(keys: np.ndarray) -> np.ndarray:
    return mixed(keys ^ np.uint64(0xA5A5A5A5C3C3C3C3)) >> np.uint64(32)


def cells_of(keys: np.ndarray, size: int) -> list[np.ndarray]:
    """The three cells of each digest, one in each third of the sketch."""
    spread = mixed(keys + np.uint64(size))
    return [
        ((spread >> np.uint64(21 * i)) & np.uint64((1 << 21) - 1)).astype(np.int64) % size
        + i * size
        for i in range(3)
    ]


class Sketches:
    """One sketch of ``3 * size`` cells per text."""

    def __init__(self, n: int, size: int) -> None:
        self.size, self.width = size, 3 * size
        self.count = np.zeros(n * self.width, dtype=np.int32)
        self.key = np.zeros(n * self.width, dtype=np.uint64)
        self.check = np.zeros(n * self.width, dtype=np.uint64)

    def put(self, owner: np.ndarray, keys: np.ndarray, sign: int | np.ndarray = 1) -> np.ndarray:
        """Add digests (sign 1) or take them out (-1); returns the cells touched."""
        sums = check_sums(keys)
        base = owner * self.width
        touched = []
        for cells in cells_of(keys, self.size):
            at = base + cells
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, sums)
            touched.append(at)
        return np.concatenate(touched)

    def __sub__(self, other: Sketches) -> Sketches:
        left = Sketches(0, self.size)
        left.count = self.count - other.count
        left.key = self.key ^ other.key
        left.check = self.check ^ other.check
        return left

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Takes out all it can recover: (owner, digest, sign) of each, and whether each
        text's sketch came out empty."""
        n = len(self.count) // self.width
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            pure = look[np.abs(self.count[look]) == 1]
            pure = pure[check_sums(self.key[pure]) == self.check[pure]]
            if not len(pure):
                break
            owner, keys, sign = pure // self.width, self.key[pure], self.count[pure]
            order = np.lexsort((keys, owner))
            owner, keys, sign = owner[order], keys[order], sign[order]
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            owner, keys, sign = owner[new], keys[new], sign[new]
            found.append((owner, keys, sign))
            look = np.unique(self.put(owner, keys, -sign))
        dirty = (self.count != 0) | (self.key != 0) | (self.check != 0)
        clean = ~dirty.reshape(n, self.width).any(axis=1) if n else np.zeros(0, dtype=bool)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32), clean
        return *(np.concatenate(x) for x in zip(*found, strict=True)), clean

    def shown(self) -> list[str]:
        """Each sketch as text."""
        n = len(self.count) // self.width
        packed = np.concatenate(
            [
                x.reshape(n, self.width).astype(kind).view("u1").reshape(n, -1)
                for x, kind in ((self.count, "<i2"), (self.key, "<u8"), (self.check, "<u4"))
            ],
            axis=1,
        )
        return [b85encode(row.tobytes()).decode() for row in packed]


def _sketch(digests: Digests, wanted: np.ndarray, size: int) -> Sketches:
    """Sketches of the texts ``wanted``, in that order; a text may be wanted more than once."""
    sketch = Sketches(len(wanted), size)
    starts = np.concatenate(([0], np.cumsum(digests.counts)))
    counts = digests.counts[wanted]
    owner = np.repeat(np.arange(len(wanted)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    sketch.put(owner, digests.keys[np.repeat(starts[wanted], counts) + within])
    return sketch


def reconcile(
    a: Digests, b: Digests, pairs_a: np.ndarray, pairs_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The digests that only one text of each pair has: (pair, digest, sign) with sign 1 for
    those of ``a``, and the cells it took. Larger sketches are tried for what is left over."""
    todo = np.arange(len(pairs_a))
    cells = np.zeros(len(pairs_a), dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = CELLS
    while len(todo):
        # At least so many digests differ; a sketch with fewer cells cannot hold them.
        gap = np.abs(a.counts[pairs_a[todo]] - b.counts[pairs_b[todo]])
        now = todo[gap <= 3 * size]
        if len(now):
            left = _sketch(a, pairs_a[now], size) - _sketch(b, pairs_b[now], size)
            owner, keys, sign, clean = left.peel()
            done = clean[owner]
            found.append((now[owner[done]], keys[done], sign[done]))
            cells[now[clean]] = 3 * size
            todo = np.setdiff1d(todo, now[clean])
        size *= GROWTH
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32), cells
    return *(np.concatenate(x) for x in zip(*found, strict=True)), cells


def likeness(a: Digests, b: Digests, pairs_a: np.ndarray, pairs_b: np.ndarray) -> np.ndarray:
    pair, _, sign, _ = reconcile(a, b, pairs_a, pairs_b)
    n = len(pairs_a)
    only_a = np.bincount(pair[sign > 0], minlength=n)
    only_b = np.bincount(pair[sign < 0], minlength=n)
    shared = a.counts[pairs_a] - only_a
    total = shared + only_a + only_b
    return np.where(total == 0, 1.0, shared / np.maximum(total, 1))


def edited_text(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as many first characters of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def in_sequence(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Partitions of rows (part, ahead, id, text), descending by id: whole ranges of ids, each
    followed by the first row of the next range (``ahead`` = 1). One shuffle of the texts;
    the driver sees one id per range."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    cuts = quantiles(rows, "id", parts)
    placed = rows.withColumn("part", part_of(F.col("id"), cuts))
    first = placed.groupBy("part").agg(F.max("id").alias("id")).orderBy("part").collect()
    # One row per range, at most as many as shuffle partitions.
    heads = [
        (behind["part"], ahead["id"])
        for ahead, behind in zip(first, [*first[1:], *first[:1]], strict=True)
    ]
    if not heads:
        return placed.select("part", F.lit(0).alias("ahead"), "id", "text")
    wanted = F.broadcast(spark.createDataFrame(heads, "target int, head long"))
    ahead = (
        rows.join(wanted, rows["id"].eqNullSafe(wanted["head"]))
        .groupBy("target", "id")
        .agg(F.min("text").alias("text"))
        .select(F.col("target").alias("part"), F.lit(1).alias("ahead"), "id", "text")
    )
    return (
        placed.select("part", F.lit(0).alias("ahead"), "id", "text")
        .union(ahead)
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", "ahead", F.desc_nulls_last("id"), "text")
    )


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, and the
    likeness of its fingerprint to that of its edited text and of the next document."""

    def judged(ids: list, texts: list[str]) -> pa.RecordBatch:
        """``texts`` has one more than ``ids``: the document after the last."""
        n = len(ids)
        edited = [edited_text(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        own, other = Digests(texts), Digests(edited)
        all_own = np.arange(n)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(_sketch(own, all_own, CELLS).shown()),
                pa.array(_sketch(other, all_own, CELLS).shown()),
                pa.array(likeness(own, other, all_own, all_own)),
                pa.array(likeness(own, own, all_own, all_own + 1)),
            ],
            names=[
                key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                "near_edited", "near_next",
            ],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        part = None
        for batch in batches:
            for rows in slices(batch, "text", BLOCK_BYTES):
                for row_part, ahead, row_id, text in zip(
                    *(rows[c].to_pylist() for c in ("part", "ahead", "id", "text")), strict=True
                ):
                    if ahead:
                        if ids and row_part == part:
                            yield judged(ids, [*texts, text])
                        ids, texts = [], []
                    else:
                        ids.append(row_id)
                        texts.append(text)
                        part = row_part
                if len(ids) > 1:  # the last waits for its next one
                    yield judged(ids[:-1], texts)
                    ids, texts = ids[-1:], texts[-1:]

    return in_sequence(docs, key, text).mapInArrow(
        run,
        f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
