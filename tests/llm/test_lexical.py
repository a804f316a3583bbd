from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from stratacart.llm import lexical as x

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(items, docs, k):
    bags = [(i, t) for i, text in docs if (t := terms(text))]
    n_docs, n_all = len(bags), sum(len(t) for _, t in bags)
    having = Counter(w for _, t in bags for w in set(t))
    found = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            tf, m = Counter(bag), 75 + 25 * len(bag) * n_docs // n_all
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * having[w] + 1)))
                * (1000000000 * tf[w] // (1000 * tf[w] + 12 * m))
                for w in terms(text)
                if tf[w]
            )
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort()
        found += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(scores[:k])]
    return sorted(found, key=str)


def searched(spark, items, docs, k=3, **how):
    found = x.search(
        spark.createDataFrame(items, "item_id long, text string"),
        spark.createDataFrame(docs, "doc_id long, text string"),
        k,
        **how,
    )
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=str)


WORDS = "ab cd ef gh Über straße 12 x9 naïve 東京".split()


@pytest.fixture(scope="module")
def corpus():
    pick = np.random.default_rng(7)
    docs = [(i, " ".join(pick.choice(WORDS, pick.integers(1, 30)))) for i in range(60)]
    docs += [(100 + i, docs[i % 4][1]) for i in range(20)]
    items = [(i, " ".join(pick.choice(WORDS, 4))) for i in range(9)]
    return items, docs


def test_terms_are_those_of_the_pattern():
    for text in ("", "A-b_c d9É!", "ÀB c\x7fd", "a\x00b\t東京 ß"):
        assert [t.decode() for t in x.terms_of(text.encode())] == terms(text)


def test_equals_plain_scores(spark, corpus):
    assert searched(spark, *corpus) == brute(*corpus, 3)


def test_blocks_of_items_and_tiles_give_the_same(spark, corpus, monkeypatch):
    monkeypatch.setattr(x, "TILE_CELLS", 50)
    monkeypatch.setattr(x, "TILE_TERMS", 2)
    assert searched(spark, *corpus, k=5, cells=25) == brute(*corpus, 5)


def test_odd_rows(spark):
    docs = [
        (1, "a b"), (1, "a b"), (None, "a b"), (2, None), (3, ""), (4, "!!"), (5, "c"), (6, "d"),
        (7, "A b " + "zz " * 50_000),
    ]
    items = [(1, "a a"), (1, "a"), (None, "b C"), (2, None), (3, "unknown"), (4, "..")]
    assert searched(spark, items, docs, k=4) == brute(items, docs, 4)
    tied = [r[2] for r in searched(spark, [(1, "a")], docs, k=4)]
    assert tied == [1, 1, None, 7]


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, "a")], [(1, ""), (2, None)]) == []


def test_further_columns_are_passed_over(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, "c", 6)], "doc_id long, text string, score int")
    items = spark.createDataFrame([(9, "a", 1)], "item_id long, text string, rank int")
    assert [r.doc_id for r in x.search(items, docs).collect()] == [1]


def test_ties_at_the_last_rank():
    best = x.Best(1, 2)
    for ids in ([9, 4], [7, 1]):
        best.add(np.array([[5, 5]]), np.array(ids), np.zeros(2, dtype=np.int64))
    assert best.rows[0][:, 2].tolist() == [1, 4]


def test_no_tile_passes_the_exact_range():
    """Weights that float64 would round if they were added in one product."""
    top = (x.EXACT - 1) // x.IMPACT
    weights = np.array([[top, 1, 3 * top + 5, 0], [2, top - 1, 0, 0]])
    tiles = x.vocabulary_tiles(weights)
    total = np.zeros_like(weights)
    for numbers, part in tiles:
        assert len(set(numbers.tolist())) == len(numbers)
        assert part.sum(axis=1).max() * x.IMPACT < x.EXACT
        for n, column in zip(numbers, part.T, strict=True):
            total[:, n] += column.astype(np.int64)
    assert (total == weights).all()


def test_blocks_are_bounded_and_whole():
    items = [(i, f"w{i} w{i + 1} common") for i in range(50)] + [(99, " ".join(f"q{i}" for i in range(500)))]
    made = list(x.blocks(items, 60))
    assert [i for b in made for i in b.item_ids] == [i for i, _ in items]
    assert all(
        len(b.item_ids) * len(b.vocabulary) <= 60 or len(b.item_ids) == 1 for b in made
    )
