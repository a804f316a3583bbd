from __future__ import annotations

import random
import re

import numpy as np
import pytest
from stratacart.llm.ngram_join import near_duplicates, similar
from stratacart.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text: str | None, width: int) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows: list[tuple], width: int, percent: int) -> list[tuple]:
    """Per row (id, size, component), by all pairs; rows of one id are one document."""
    sets = [sets_of(t, width) for _, t, *_ in rows]
    label = {r[0]: r[0] for r in rows}
    pairs = set()
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and None not in (rows[a][0], rows[b][0]):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    pairs.add((rows[a][0], rows[b][0]))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return [(r[0], len(s), label[r[0]]) for r, s in zip(rows, sets, strict=True)]


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    texts = []
    for _ in range(25):
        own = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        if rng.random() < 0.5:
            own += passage
        for _ in range(rng.randrange(1, 7)):
            copy = list(own)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(rng.choice([" ", "\t", " \n"]).join(copy))
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80), (3, 3, 50)])
def test_equals_all_pairs(spark, seed, width, percent):
    rows = corpus(seed)
    rows += [
        (900, None, "x"), (901, "", "x"), (902, " \t\n", "x"), (903, "Two Words", "x"),
        (904, "two words", "x"), (905, "two\u00a0words", "x"), (None, rows[0][1], "x"),
        (906, "lone " * 40_000, "x"), (907, "lone " * 39_000, "x"), rows[1], rows[1],
        (None, None, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token string").repartition(5)
    found = near_duplicates(docs, width, percent).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute(rows, width, percent)))


def test_rows_of_one_id_are_one_document(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, a), (2, a), (2, b), (3, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, 4, 85).collect()} == {
        1: 1, 2: 1, 3: 1
    }


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_chain_of_near_copies_is_one_group(spark):
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):  # each shifts its neighbour a little; the ends have little in common
        rows.append((i, " ".join(words[3 * i : 3 * i + 100])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(docs, 4, 85).collect()} == {0}


def test_shingles_equal_sets():
    rng = random.Random(4)
    kinds = ["ab", "AB", "é", "É", " ", "  ", "\n", "\x1c", "\u3000", "x" * 30, "the "]
    texts = ["".join(rng.choice(kinds) for _ in range(rng.randrange(60))) for _ in range(500)]
    hashes = shingle_sets([t.encode() for t in texts], 4)
    plain = [sets_of(t, 4) for t in texts]
    assert [len(h) for h in hashes] == [len(s) for s in plain]
    for i in range(0, 500, 2):
        shared = len(np.intersect1d(hashes[i], hashes[i + 1]))
        assert shared == len(plain[i] & plain[i + 1])


def test_suffix_filter_loses_nothing():
    rng = np.random.default_rng(3)
    for _ in range(2000):
        a = np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64)
        b = np.unique(np.concatenate((a, rng.integers(0, 60, 3).astype(np.uint64))))[: len(a) + 2]
        both = len(np.intersect1d(a, b))
        assert similar(a, b, 85) == (100 * both >= 85 * (len(a) + len(b) - both))
