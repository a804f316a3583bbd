from __future__ import annotations

import time
import tracemalloc

import numpy as np
import pytest
from stratacart.llm import subspace_join
from stratacart.llm.subspace_join import Side, blocks, budgets, linked, near_vectors, rotated, unit


def brute(rows: list[tuple], threshold: float) -> dict:
    """(links, component) by row place, from all pairs."""
    good = [
        v is not None
        and len(v) > 0
        and all(x is not None and np.isfinite(x) for x in v)
        and any(x != 0 for x in v)
        and i is not None
        for i, v, *_ in rows
    ]
    n = len(rows)
    near = np.zeros((n, n), dtype=bool)
    for a in range(n):
        for b in range(n):
            if a != b and good[a] and good[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], dtype=float), np.array(rows[b][1], dtype=float)
                near[a, b] = x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    label = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in np.flatnonzero(near[a]):
                if label[b] < label[a]:
                    label[a], changed = label[b], True
    return [(rows[a][0], int(near[a].sum()), label[a]) for a in range(n)]


@pytest.mark.parametrize(("held", "met"), [(8_192, 32_768), (7, 11)])
def test_equals_all_pairs(spark, monkeypatch, held, met):
    monkeypatch.setattr(subspace_join, "HELD", held)
    monkeypatch.setattr(subspace_join, "MET", met)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 40))
    vectors = [b + rng.normal(size=40) * s for b in base for s in rng.uniform(0.05, 0.6, 12)]
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(vectors)]
    copy = rows[3][1]
    rows += [(500 + i, copy, 1) for i in range(5)] + [(3, copy, 1)]
    rows += [
        (600, None, 1), (601, [], 1), (602, [0.0] * 40, 1), (603, [None] * 40, 1),
        (604, [float("nan")] * 40, 1), (605, [float("inf")] * 40, 1), (606, [1.0, 0.0], 1),
        (607, [2.0, 0.0], 1), (608, [1e30] * 40, 1), (609, [1e-30] * 40, 1), (None, copy, 1),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")
    found = [(r.vec_id, r.n_links, r.component_id) for r in near_vectors(table).collect()]
    assert sorted(map(str, found)) == sorted(map(str, brute(rows, 0.9)))
    kept = {r.vec_id: r.kept for r in near_vectors(table).collect()}
    assert kept[600] and not kept[500]


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(table).collect() == []


def test_some_block_is_within_its_budget():
    rng = np.random.default_rng(0)
    x = unit(rng.normal(size=(500, 64)))
    y = unit(x + rng.normal(size=x.shape) * 0.05)
    close = (x * y).sum(axis=1) >= 0.9
    gaps = np.add.reduceat((rotated(x) - rotated(y)) ** 2, [b.start for b in blocks(64)], axis=1)
    assert close.any() and (gaps <= budgets(64, 0.9)).any(axis=1)[close].all()
    assert (rotated(x) == np.concatenate([rotated(x[i : i + 1]) for i in range(500)])).all()


def _nodes(table):
    return table.selectExpr(
        "vec_id AS node", "1L AS n", "embedding AS vector", "size(embedding) AS dims"
    )


def _side(vectors: np.ndarray, block: int = 0) -> Side:
    n = len(vectors)
    return Side(np.arange(n), np.ones(n, dtype=np.int64), vectors.astype(np.float32), block)


def test_a_task_finds_every_pair_once_in_any_order():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 64))
    x = (base[rng.integers(40, size=1_500)] + rng.normal(size=(1_500, 64)) * 0.25).astype("f4")
    units = unit(x)
    cosines = np.einsum("ik,jk->ij", units, units)
    pairs = np.stack(np.nonzero(np.triu(cosines >= 0.9, 1)), axis=1)
    assert 5_000 < len(pairs) < 50_000
    halves = np.arange(0, 700), np.arange(700, 1_500)
    found = []
    for block in range(len(blocks(64))):
        sides = [Side(at, np.ones(len(at), dtype=np.int64), x[at], block) for at in halves]
        for a, b in ((sides[0], sides[0]), (sides[1], sides[1]), (sides[0], sides[1])):
            found += [np.stack((a.ids[p], b.ids[q]), 1) for p, q in linked(a, b, block, 0.9)]
    found = np.sort(np.concatenate(found), axis=1)
    assert np.array_equal(found[np.lexsort((found[:, 1], found[:, 0]))], pairs)


def test_a_block_costs_less_than_comparing_whole_vectors():
    """Vectors that spread alike in all directions: no grid and no box parts them."""
    x = np.random.default_rng(4).normal(size=(6_000, 64))
    units, side = unit(x), _side(x)

    def least(run) -> float:
        took = []
        for _ in range(4):
            start = time.process_time()
            run()
            took.append(time.process_time() - start)
        return min(took)

    def whole() -> None:
        for at in range(0, len(units), 256):
            np.nonzero(units[at : at + 256] @ units.T >= 0.9)

    assert least(lambda: list(linked(side, side, 0, 0.9))) < 0.8 * least(whole)


def test_tiles_far_apart_are_not_compared(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(32, 64))
    x = np.repeat(base, 256, axis=0) + rng.normal(size=(32 * 256, 64)) * 0.02
    compared, runs = [], subspace_join._runs

    def counted(tiles):
        compared.append(len(tiles))
        return runs(tiles)

    monkeypatch.setattr(subspace_join, "_runs", counted)
    side = _side(x[rng.permutation(len(x))])
    n = sum(len(p) for p, _ in linked(side, side, 0, 0.9))
    assert n > 0 and sum(compared) < 0.3 * 32 * 33 / 2


def test_a_group_of_near_copies_takes_bounded_memory():
    """Its pairs, 18 million, would take 288 MB."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=64) + rng.normal(size=(6_000, 64)) * 0.01
    side = _side(x)
    tracemalloc.start()
    rows = list(subspace_join._summary(side, side, 0, 0.9))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    assert rows[0]["links"].to_pylist() == [5_999] * 6_000
    assert rows[0]["other"].to_pylist() == [0] * 6_000


def test_zeros_of_both_signs_are_equal(spark):
    rows = [(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [1.0, -0.0]), (4, [1.0, 0.0]), (5, [1.0, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(table).collect())
    assert found == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5)]


def test_a_task_holds_fewer_of_long_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6, 40))
    rows = [(i, (base[i % 6] + rng.normal(size=40) * 0.2).tolist()) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").localCheckpoint()
    monkeypatch.setattr(subspace_join, "HELD", 60)
    monkeypatch.setattr(subspace_join, "USUAL_DIMS", 10)
    placed = subspace_join._placed(_nodes(table), 0.9)
    chunks = subspace_join._meetings(placed).where("visit = 0 AND met = 0")
    keys = "dims", "block", "x", "y", "held"
    sizes = [r["count"] for r in chunks.groupBy(*keys).count().collect()]
    assert max(sizes) < 35  # 15 on average over hashes
    found = [(r.vec_id, r.n_links, r.component_id) for r in near_vectors(table).collect()]
    assert sorted(found) == sorted(brute(rows, 0.9))


def test_long_chains_merge_in_few_rounds():
    n = 30_000
    at = np.random.default_rng(7).permutation(n)
    start = time.process_time()
    group = subspace_join._merged(np.arange(n), at[:-1], at[1:])
    group = subspace_join._merged(group, np.array([0]), np.array([n - 1]))
    assert (group == 0).all() and time.process_time() - start < 1
