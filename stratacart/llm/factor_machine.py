"""Quality scores by a factorisation machine.

A text's features are its hashed words, weighted by their counts and scaled to length one,
and statistics of its structure and size, each cut into levels. A feature has a weight and a
vector of ``FACTORS`` numbers; a score is the logistic of the sum of the weights and of the
products of the vectors of all feature pairs, which takes linear time as half of the square
of sums less the sum of squares.

Learning takes a bounded sample of the labelled rows, ``SAMPLE`` on average, chosen by a hash
of the id, whose features go to the driver; the model has a fixed size and is broadcast.

Results per row:

* a null or empty text has its statistics alone and gets a score from them;
* equal texts get equal scores; a null id is scored like any other;
* a label that is null is none; of several for an id the mean counts, at least one half as 1;
* without a labelled row every score is one half; an empty table gives an empty table;
* other columns are dropped by ``score`` and are no features.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacart.llm.common import on_workers, slices, thrifty
from stratacart.llm.shingles import word_hashes

WORD_BINS = 1 << 15
LEVELS = 16
FACTORS = 8
SAMPLE = 8_000
EPOCHS = 6
BATCH = 64
RATE = 0.08
DECAY = 1e-5
#: Bytes of text whose features are made together: some 80 bytes of memory for each.
BLOCK_BYTES = 512 << 10
STATISTICS = (
    "upper", "digits", "symbols", "stops", "shouts", "spaces", "line_ends", "distinct_words",
    "repeated_neighbours", "most_frequent_word", "word_length", "stop_words", "chars", "words",
)
FEATURES = WORD_BINS + len(STATISTICS) * LEVELS


class Features(NamedTuple):
    """Rows in turn: ``starts`` (one more than rows), and feature and value of each entry."""

    starts: np.ndarray
    index: np.ndarray
    value: np.ndarray


class Model(NamedTuple):
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def _class_table() -> np.ndarray:
    """Per byte: 1 upper, 2 digit, 3 symbol, 4 stop, 5 shout, 6 space, 7 line end, else 0."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[33:127] = 3
    kind[65:91] = 1
    kind[97:123] = 0
    kind[48:58] = 2
    kind[[ord(c) for c in ".,;:?"]] = 4
    kind[ord("!")] = 5
    kind[[9, 11, 12, 13, 32]] = 6
    kind[10] = 7
    return kind


_CLASSES = _class_table()


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``starts``, which may be equal."""
    running = np.cumsum(values, axis=0, dtype=np.float64)
    total = np.concatenate((np.zeros((1, *values.shape[1:])), running))
    return total[starts[1:]] - total[starts[:-1]]


def features(texts: list[bytes]) -> Features:
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(owner * 8 + _CLASSES[data], minlength=8 * n).reshape(n, 8)

    words, stops = word_hashes(texts)
    word_starts = np.concatenate(([0], stops))
    counts = np.diff(word_starts)
    word_owner = np.repeat(np.arange(n), counts)
    bins = (words & np.uint64(WORD_BINS - 1)).astype(np.int64)
    keys, repeats = np.unique(word_owner * WORD_BINS + bins, return_counts=True)
    key_owner = keys // WORD_BINS
    distinct = np.bincount(key_owner, minlength=n)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, key_owner, repeats)
    same = np.zeros(n)
    if len(words) > 1:
        again = (words[1:] == words[:-1]) & (word_owner[1:] == word_owner[:-1])
        same = np.bincount(word_owner[1:][again], minlength=n)
    chars = np.maximum(sizes, 1)
    many = np.maximum(counts, 1)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    punctuated = kinds[:, 4] + kinds[:, 5]
    ratios = np.stack(
        [
            kinds[:, 1] / letters,
            kinds[:, 2] / chars,
            kinds[:, 3] / chars,
            kinds[:, 4] / chars,
            kinds[:, 5] / chars,
            kinds[:, 6] / chars,
            kinds[:, 7] / chars,
            (distinct / many) ** 2,
            same / many,
            most / many,
            np.minimum((sizes / many / 20) ** 2, 1),
            np.minimum(punctuated / many, 1),
            (np.log2(sizes + 1) / 24) ** 2,
            (np.log2(counts + 1) / 22) ** 2,
        ],
        axis=1,
    )
    levels = np.minimum((np.sqrt(ratios) * LEVELS).astype(np.int64), LEVELS - 1)
    fixed = WORD_BINS + np.arange(len(STATISTICS)) * LEVELS + levels

    lengths = np.sqrt(np.bincount(key_owner, weights=repeats.astype(np.float64) ** 2, minlength=n))
    per_row = distinct + len(STATISTICS)
    starts = np.concatenate(([0], np.cumsum(per_row)))
    index = np.empty(starts[-1], dtype=np.int32)
    value = np.empty(starts[-1], dtype=np.float32)
    at = np.arange(len(keys)) + key_owner * len(STATISTICS)
    index[at] = keys % WORD_BINS
    value[at] = repeats / np.maximum(lengths, 1)[key_owner]
    at = (starts[1:] - len(STATISTICS))[:, None] + np.arange(len(STATISTICS))
    index[at] = fixed
    value[at] = 0.5
    return Features(starts, index, value)


def margins(model: Model, rows: Features) -> tuple[np.ndarray, np.ndarray]:
    """The score before the logistic, and the sums of scaled vectors."""
    value = rows.value[:, None]
    scaled = model.factors[rows.index] * value
    sums = _sums(scaled, rows.starts)
    squares = _sums((scaled**2).sum(axis=1), rows.starts)
    linear = _sums(model.weights[rows.index] * rows.value, rows.starts)
    return model.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def scores(model: Model, rows: Features) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins(model, rows)[0], -30, 30)))


def _pick(rows: Features, chosen: np.ndarray) -> Features:
    counts = np.diff(rows.starts)[chosen]
    starts = np.concatenate(([0], np.cumsum(counts)))
    shift = np.repeat(rows.starts[chosen] - starts[:-1], counts)
    at = np.arange(starts[-1]) + shift
    return Features(starts, rows.index[at], rows.value[at])


def fit(rows: Features, labels: np.ndarray) -> Model:
    """Minimises the logistic loss by AdaGrad over small batches, in a fixed random order."""
    rng = np.random.default_rng(1)
    weights = np.zeros(FEATURES)
    factors = rng.normal(0, 0.02, (FEATURES, FACTORS))
    if not len(labels):
        return Model(0.0, weights, np.zeros_like(factors))
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    seen_w, seen_v, seen_b = np.full(FEATURES, 1e-2), np.full((FEATURES, FACTORS), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            batch = _pick(rows, chosen)
            margin, sums = margins(Model(bias, weights, factors), batch)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]
            owner = np.repeat(np.arange(len(chosen)), np.diff(batch.starts))
            used, place = np.unique(batch.index, return_inverse=True)
            value = batch.value.astype(np.float64)
            slope = np.bincount(place, weights=error[owner] * value)
            steps = error[owner, None] * value[:, None] * (
                sums[owner] - factors[batch.index] * value[:, None]
            )
            slopes = np.stack(
                [np.bincount(place, weights=steps[:, k]) for k in range(FACTORS)], axis=1
            )
            slope += DECAY * weights[used]
            slopes += DECAY * factors[used]
            seen_w[used] += slope**2
            seen_v[used] += slopes**2
            weights[used] -= RATE * slope / np.sqrt(seen_w[used])
            factors[used] -= RATE * slopes / np.sqrt(seen_v[used])
            seen_b += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(seen_b)
    return Model(float(bias), weights.astype(np.float32), factors.astype(np.float32))


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def held_out(key: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """A model of ``labels.quality`` from a bounded sample of the rows that are not held out."""
    on_workers(docs.sparkSession)
    known = (
        labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    )
    total = known.count()
    share = min(1.0, SAMPLE / max(total, 1))
    drawn = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1 << 30))
    chosen = known.where(drawn < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                rows = features(_texts(part["text"]))
                offsets = pa.array(rows.starts, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"],
                        part["label"],
                        pa.ListArray.from_arrays(offsets, pa.array(rows.index)),
                        pa.ListArray.from_arrays(offsets, pa.array(rows.value)),
                    ],
                    names=["id", "label", "index", "value"],
                )

    sample = (
        docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), "id")  # SAMPLE rows on average
        .mapInArrow(thrifty(run), "id long, label int, index array<int>, value array<float>")
        .toArrow()
        .sort_by([("id", "ascending")])
    )
    if not sample.num_rows:
        return fit(features([]), np.zeros(0))
    index = sample["index"].combine_chunks()
    starts = np.concatenate(([0], np.cumsum(np.asarray(index.value_lengths()))))
    value = sample["value"].combine_chunks()
    rows = Features(starts, np.asarray(index.flatten()), np.asarray(value.flatten()))
    return fit(rows, np.asarray(sample["label"]).astype(np.float64))


def score(
    docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns ``keep`` as they are, and ``score``, a name that none of them has."""
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, BLOCK_BYTES):
                found = scores(shared.value, features(_texts(part[text])))
                yield pa.RecordBatch.from_arrays(
                    [*(part[n] for n in keep), pa.array(found, pa.float64())],
                    names=[*keep, "score"],
                )

    rows = docs.select(*dict.fromkeys([*keep, text]))
    return rows.mapInArrow(thrifty(run), rows.select(*keep).schema.add("score", "double"))
