from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
from stratacart.llm.fingerprints import (
    CELLS,
    Digests,
    edited_text,
    likeness,
    paragraphs,
    reconcile,
    with_next,
)


def texts(n: int, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma,", "delta.", "eps\n", "zeta!", "\t", "  ", "é", "x" * 50]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(400))) for _ in range(n)]


def jaccard(a: str, b: str) -> float:
    x, y = Counter(paragraphs(a)), Counter(paragraphs(b))
    either = sum((x | y).values())
    return sum((x & y).values()) / either if either else 1.0


def test_paragraphs_are_the_text():
    for text in [*texts(200), "", "\n", "word " * 500, "a" * 5000, "\n\n.,;", " \x1c x"]:
        assert "".join(paragraphs(text)) == text


def test_peeling_recovers_the_difference():
    a, b = texts(60), texts(60, 6)
    b[:20] = [t + "! more." for t in a[:20]]
    b[20:25] = a[20:25]
    x, y, all_of = Digests(a), Digests(b), np.arange(60)
    pair, keys, sign, cells = reconcile(x, y, all_of, all_of)
    assert (cells[20:25] == 3 * CELLS).all() and cells.max() > 3 * CELLS
    for i in range(60):
        own, other = set(x.keys[x.owner == i].tolist()), set(y.keys[y.owner == i].tolist())
        at = pair == i
        assert set(keys[at & (sign > 0)].tolist()) == own - other
        assert set(keys[at & (sign < 0)].tolist()) == other - own
    found = likeness(x, y, all_of, all_of)
    assert np.allclose(found, [jaccard(s, t) for s, t in zip(a, b, strict=True)])


def test_rows(spark):
    rows = [(3 * i % 101, t, i) for i, t in enumerate(texts(60))]
    rows += [(200, None, 0), (201, "", 0), (202, "very long. " * 20_000, 0), (None, "no id", 0)]
    rows += [(5, rows[0][1], 0), (5, rows[0][1], 0), (5, "again", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(4)
    found = with_next(docs).collect()
    ordered = sorted(
        ((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1])
    )
    expected = []
    for (i, text), (_, following) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        edited = edited_text(text, following)
        expected.append(
            (
                str(i),
                len(text),
                hashlib.sha256(edited.encode()).hexdigest(),
                round(jaccard(text, edited), 9),
                round(jaccard(text, following), 9),
            )
        )
    got = [
        (str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9))
        for r in found
    ]
    assert sorted(got) == sorted(expected)
    assert len({r.fingerprint for r in found if r.n_chars == 0}) == 1
    assert with_next(docs.limit(0)).collect() == []
    lone = with_next(spark.createDataFrame([(1, "abc. def")], "doc_id long, text string")).head()
    assert lone.near_next == 1.0 and lone.n_chars == 8
