"""One-to-one matchings: greedy in rounds against the sorted loop, assignments by components against all choices."""

import itertools
import random
import tracemalloc

import numpy as np
import pytest

from sightline.operators import iterative
from sightline.operators.iterative import assignment, greedy_matching, sparse_assignment

PAIR = "scene_id int, a long, b long, coverage double, note string"


def greedy_by_force(rows):
    taken, left, right = [], set(), set()
    for r in sorted(rows, key=lambda r: (r[0], r[3] is None, -(r[3] or 0), r[1], r[2])):
        if (r[0], r[1]) not in left and (r[0], r[2]) not in right:
            left.add((r[0], r[1]))
            right.add((r[0], r[2]))
            taken.append(r)
    return sorted(taken, key=str)


def made(seed, scenes=2, ends=25, n=150):
    rng = random.Random(seed)
    rows = {}
    for _ in range(n):
        s, a, b = rng.randrange(scenes), rng.randrange(ends), rng.randrange(ends)
        rows[s, a, b] = (s, a, b, rng.choice([None, 0.1, 0.2, 0.2, 0.5, rng.random()]), f"{s}-{a}-{b}")
    return list(rows.values())


@pytest.mark.parametrize(("seed", "rounds", "last"), [(1, 8, 50_000), (2, 1, 50_000), (3, 1, 0)])
def test_greedy_is_the_sorted_loop(spark, monkeypatch, seed, rounds, last):
    """Whether rounds go to the end or one pass finishes; ties, nulls, several scenes."""
    monkeypatch.setattr(iterative, "ROUNDS", rounds)
    monkeypatch.setattr(iterative, "LAST_PAIRS", last)
    rows = made(seed)
    got = greedy_matching(spark.createDataFrame(rows, PAIR).repartition(3))
    assert got.columns == ["scene_id", "a", "b", "coverage", "note"]
    assert sorted(map(tuple, got.collect()), key=str) == greedy_by_force(rows)


def test_a_chain_takes_one_pair_a_round(spark, monkeypatch):
    """Each pair of a falling chain waits for the one before it: the pass at the end takes over."""
    monkeypatch.setattr(iterative, "ROUNDS", 2)
    rows = [(0, k // 2, (k + 1) // 2, 1.0 - k / 1000, "") for k in range(60)]
    assert sorted(map(tuple, greedy_matching(spark.createDataFrame(rows, PAIR)).collect()), key=str) == greedy_by_force(rows)


def test_greedy_takes_one_of_equal_rows(spark):
    rows = [(0, 1, 1, 0.5, "x"), (0, 1, 1, 0.5, "y"), (0, None, 2, 0.9, "no end"), (0, 1, 2, 0.4, "z")]
    got = greedy_matching(spark.createDataFrame(rows, PAIR)).collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 1)]
    assert greedy_matching(spark.createDataFrame([], PAIR)).collect() == []


def best_by_force(edges, most_pairs):
    """(number, total) of the best one-to-one set, over all subsets of rows' choices."""
    rows = sorted({a for a, _ in edges})
    best = (0, 0.0)
    for choice in itertools.product(*[[None, *[b for a2, b in edges if a2 == a]] for a in rows]):
        own = [(a, b) for a, b in zip(rows, choice, strict=True) if b is not None]
        if len({b for _, b in own}) == len(own):
            total = round(sum(edges[e] for e in own), 9)
            best = max(best, (len(own), total)) if most_pairs else max(best, (0, total))
    return best


@pytest.mark.parametrize("most_pairs", [True, False])
def test_assignment_against_all_choices(spark, most_pairs):
    rng = random.Random(11)
    scenes, rows = {}, []
    for s in range(30):
        edges = {(rng.randrange(5), rng.randrange(5)): rng.choice([0.1, 0.3, 0.3, 1.0, round(rng.random(), 3)]) for _ in range(rng.randrange(1, 10))}
        scenes[s] = edges
        rows += [(s, a, b, x) for (a, b), x in edges.items()]
    rows.append((99, None, 1, 0.5))
    got = assignment(spark.createDataFrame(rows, "scene_id int, a long, b long, iou double").repartition(3), most_pairs=most_pairs).collect()
    assert not any(r["scene_id"] == 99 for r in got)
    for s, edges in scenes.items():
        own = [(r["a"], r["b"], r["iou"]) for r in got if r["scene_id"] == s]
        assert len({a for a, _, _ in own}) == len({b for _, b, _ in own}) == len(own) and all(edges[a, b] == x for a, b, x in own)
        total = round(sum(x for *_, x in own), 9)
        assert ((len(own), total) if most_pairs else (0, total)) == best_by_force(edges, most_pairs)


def test_sparse_against_all_permutations():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 6), (6, 3), (6, 6)):
        cost = rng.integers(1, 50, (n, m)).astype(float)
        got = sparse_assignment(((i, j, 100 - cost[i, j]) for i in range(n) for j in range(m)), n)
        wide = cost if n <= m else cost.T
        best = min(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert len(got) == min(n, m) and sum(cost[i, j] for i, j in got) == best
    assert sparse_assignment([(0, 0, -1.0), (1, 0, -2.0)], 2) == []  # what costs is left out


def test_one_scene_of_many_pairs_in_bounded_memory(spark):
    """100,000 pairs of one scene: a matrix of its ends would take gigabytes; a component's edges are what a task holds."""
    rng = np.random.default_rng(6)
    n = 33_000
    a = np.repeat(np.arange(n), 3)
    b = (a // 30) * 30 + rng.integers(0, 30, 3 * n)
    tracemalloc.start()
    got = sparse_assignment(zip(a[:9000].tolist(), b[:9000].tolist(), (100 + rng.random(9000)).tolist(), strict=True), 3000)
    assert tracemalloc.get_traced_memory()[1] < 20 << 20 and len(got) > 2500
    tracemalloc.stop()
    rows = spark.createDataFrame([(0, int(x), int(y), float(s)) for x, y, s in zip(a, b, rng.random(3 * n), strict=True)], "scene_id int, a long, b long, iou double")
    out = assignment(rows.repartition(8)).toPandas()
    assert out["a"].is_unique and out["b"].is_unique and len(out) > 0.9 * n
