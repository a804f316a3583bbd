from __future__ import annotations

import random

import pytest
from stratacart.llm.components import components


def brute(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize(
    "links",
    [
        [(i, i + 1) for i in range(60)],
        [(0, i) for i in range(1, 50)] + [(100, 101), (100, 101), (101, 100)],
        [(random.Random(i).randrange(90), random.Random(-i).randrange(90)) for i in range(1, 60)],
    ],
)
def test_equals_union_find(spark, links):
    links = [(a, b) for a, b in links if a != b]
    table = spark.createDataFrame([*links, (5, 5), (None, 4)], "a long, b long")
    assert {r.node: r.component for r in components(table).collect()} == brute(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
