from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from stratacart.llm import shingles
from stratacart.llm.common import slices
from stratacart.llm.factor_machine import (
    BLOCK_BYTES,
    FACTORS,
    FEATURES,
    STATISTICS,
    Model,
    features,
    held_out,
    learn,
    margins,
    score,
    scores,
)
from pyspark.sql import functions as F


def texts(n: int) -> list[tuple[str, int]]:
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("be", "la", "mon", "ti") for b in ("ra", "sen", "to", "mu", "del")]
    out = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(8, 120))]
        good = i % 3 > 0
        out.append(
            (" ".join(own).capitalize() + "." if good else "!! ".join(own).upper() + "!!", int(good))
        )
    return out


def test_linear_time_equals_all_pairs():
    rng = np.random.default_rng(0)
    model = Model(0.3, rng.normal(size=FEATURES), rng.normal(size=(FEATURES, FACTORS)))
    rows = features([t.encode() for t, _ in texts(20)] + [b"", b" ", b"x", b"\n\n!", "é".encode() * 9])
    got, _ = margins(model, rows)
    for r, (a, b) in enumerate(zip(rows.starts, rows.starts[1:], strict=False)):
        index, value = rows.index[a:b], rows.value[a:b].astype(float)
        assert len(set(index.tolist())) == len(index)
        total = model.bias + (model.weights[index] * value).sum()
        for i in range(len(index)):
            for j in range(i):
                total += model.factors[index[i]] @ model.factors[index[j]] * value[i] * value[j]
        assert np.isclose(got[r], total)
    assert (np.diff(rows.starts)[-5:-3] == len(STATISTICS)).all()


def test_features_do_not_depend_on_neighbours():
    all_texts = [t.encode() for t, _ in texts(30)] + [b"", b"a"]
    whole = features(all_texts)
    for i, text in enumerate(all_texts):
        alone = features([text])
        a, b = whole.starts[i], whole.starts[i + 1]
        assert (whole.index[a:b] == alone.index).all() and (whole.value[a:b] == alone.value).all()


def test_learns_and_scores(spark):
    rows = texts(900)
    docs = spark.createDataFrame(
        [(i, t, q) for i, (t, q) in enumerate(rows)]
        + [(1000, None, 1), (1001, "", 1), (None, "x", 1), (1002, "word " * 60_000, 1), (1001, "", 1)],
        "doc_id long, text string, score int",
    )
    labels = spark.createDataFrame(
        [(i, q, 0) for i, (_, q) in enumerate(rows)] + [(3, None, 0), (None, 0, 0), (5, rows[5][1], 0)],
        "doc_id long, quality int, toxic int",
    )
    model = learn(docs, labels)
    found = score(docs, model).withColumn("out", held_out(F.col("doc_id"))).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    by_id = [(r.score, rows[r.doc_id][1]) for r in found if r.out and (r.doc_id or 0) < 900]
    assert len(by_id) > 200
    assert np.mean([(s >= 0.5) == (q == 1) for s, q in by_id]) > 0.98
    empty = {r.score for r in found if r.doc_id in (1000, 1001)}
    assert len(empty) == 1
    assert score(docs.limit(0), model).collect() == []
    # Held out labels have no part in the model.
    turned = labels.withColumn(
        "quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    again = learn(docs, turned)
    assert (again.weights == model.weights).all() and again.bias == model.bias


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in score(docs, learn(docs, labels)).collect()] == [0.5]
    assert scores(Model(0.0, np.zeros(FEATURES), np.zeros((FEATURES, FACTORS))), features([b"x"])) == [0.5]


def test_a_batch_of_many_texts_takes_little_memory():
    """Two workers of an executor score at once, beside all that its JVM holds."""
    words = [f"w{i}" for i in range(5_000)]
    rng = random.Random(6)
    long = [" ".join(rng.choices(words, k=700)) for _ in range(1_500)]
    batch = pa.RecordBatch.from_arrays([pa.array(long)], names=["text"])
    model = Model(0.1, np.ones(FEATURES, np.float32), np.ones((FEATURES, FACTORS), np.float32))
    whole = scores(model, features([t.encode() for t in long]))
    tracemalloc.start()
    found = [
        scores(model, features([t.encode() for t in part["text"].to_pylist()]))
        for part in slices(batch, "text", BLOCK_BYTES)
    ]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert np.allclose(np.concatenate(found), whole, rtol=0, atol=1e-12)
    assert batch.nbytes > 4 << 20 and peak < 80 << 20


def test_long_texts_leave_no_tables_behind():
    tracemalloc.start()
    short, _ = shingles.word_hashes([b"ab cd"])
    before, _ = tracemalloc.get_traced_memory()
    long, _ = shingles.word_hashes([b"\n" * (3 << 20) + b"ab cd"])
    after, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert (short == long).all() and after - before < 1 << 20
