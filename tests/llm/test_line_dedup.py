from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from stratacart.llm import line_dedup
from stratacart.llm.line_dedup import keep_bitmaps, without_repeats

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def brute(rows: list[tuple]) -> list[tuple]:
    holders: dict[str, set] = {}
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(line.strip(SPACE).translate(LOWER), set()).add(order(doc_id))
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [
            x
            for x in lines
            if len(key := x.strip(SPACE).translate(LOWER)) < 10
            or min(holders[key]) == order(doc_id)
        ]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def corpus() -> list[tuple]:
    rng = random.Random(9)
    lines = [f"line number {i} of all" for i in range(40)] + ["short", "", "  ", "é" * 9, "É" * 10]
    rows = []
    for i in range(120):
        own = [rng.choice(lines) for _ in range(rng.randrange(0, 90))]
        own.insert(rng.randrange(len(own) + 1), rng.choice(["The Hot Line of all", " the hot line of ALL\t"]))
        rows.append((i, "\n".join(own), "x"))
    rows += [
        (200, None, "x"), (201, "", "x"), (None, "the hot line of all\nline number 1 of all", "x"),
        (None, "an id is missing\nan id is missing", "x"), (202, "an id is missing", "x"),
        (203, "\u3000wide spaces stay", "x"), (204, "wide spaces stay", "x"),
        (205, "\n".join(["a very long text"] * 30_000), "x"), (206, "a very long text", "x"),
        (207, "shared by one id", "x"), (207, "shared by one id\nand more", "x"), rows[4], rows[4],
    ]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [100, 1])
def test_equals_a_plain_count(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string").repartition(4)
    found = without_repeats(docs).select("doc_id", "kept_text", "n_lines", "n_dropped").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute(rows)))


def test_bitmaps_are_sparse(spark):
    text = "\n".join(f"some line {i:06}" for i in range(1000))
    docs = spark.createDataFrame(
        [(1, "some line 000070\nx"), (2, text), (3, "nothing of it all")], "doc_id long, text string"
    )
    (row,) = keep_bitmaps(docs).collect()
    assert (row.doc, row.n_dropped) == (2, 1)
    assert [(w.word, w.bits) for w in row.keep] == [(1, ~(1 << 6))]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert without_repeats(docs).collect() == []


def test_no_python_in_the_plan(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a line of some").alias("text"))
    plan = without_repeats(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
