"""Anchors without depth: topology, permits, the order of batches, calls, against a plain state machine."""

import bisect
import random

import pytest

from sightline.operators import anchors, measured
from sightline.schemas import DataError

STATS = ("pixels", "targets", "finite_targets", "weights", "finite_weights", "nonzero_weights", "nonzero_pixels")
GOOD = (4, 8, 8, 8, 8, 6, 3)


def topology_by_force(ids, n):
    """[(ordinal, {nodes})] of the frames between anchors."""
    return [(t, {bisect.bisect_right(ids, t) - 1, bisect.bisect_right(ids, t)}) for t in range(n) if t not in ids]


class Run:
    """One sequence's tables; a good run unless changed."""

    def __init__(self, ids=(0, 1, 2, 4, 7, 8, 9, 30, 31), n=32, name="s"):
        self.name, self.ids, self.n = name, list(ids), n
        self.topology = topology_by_force(self.ids, n)
        ordinals = [t for t, _ in self.topology]
        self.batches = [ordinals[a : a + 16] for a in range(0, len(ordinals), 16)]
        start = len(self.ids)
        self.calls = [[k, k, start, start + len(b)] for k, b in enumerate(self.batches)]  # call, batch, start, end
        sources = dict(self.topology)
        self.edges = [[k, i, start + local, *GOOD] for k, b in enumerate(self.batches) for local, t in enumerate(b) for i in sorted(sources[t])]
        self.empty, self.measured = [], []

    def tables(self, spark):
        return {k: spark.createDataFrame(*v) for k, v in self.rows().items()}

    def rows(self):
        """(rows, schema) of each table."""
        make = lambda rows, columns: ([(self.name, *r) for r in rows], "sequence_id string, " + ", ".join(f"{c} long" for c in columns))
        return {
            "sequences": make([(self.n,)], ["frames"]), "anchors": make([(i,) for i in self.ids], ["ordinal"]),
            "batches": make([(k, j, t) for k, b in enumerate(self.batches) for j, t in enumerate(b)], ["batch", "local", "ordinal"]),
            "calls": make(self.calls, ["call", "batch", "start", "end"]), "edges": make(self.edges, ["call", "source", "target", *STATS]),
            "empty": make([(i,) for i in self.empty], ["node"]), "measured": make(self.measured, ["call", "node"]),
        }

    def found(self, spark):
        return anchors.refusals(**self.tables(spark))

    def reasons(self, spark):
        return {(r["batch"], r["source"], r["target"], r["reason"]) for r in self.found(spark).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_topology_against_brute_force(spark, seed):
    rng = random.Random(seed)
    n = rng.randrange(3, 120)
    ids = sorted({0, n - 1, *rng.sample(range(n), n // 3)})
    run = Run(ids, n)
    rows = anchors.source_topology(run.tables(spark)["sequences"], run.tables(spark)["anchors"]).orderBy("place").collect()
    assert [(r["ordinal"], {r["previous"], r["next"]}) for r in rows] == run.topology
    assert [(r["place"], r["batch"], r["local"]) for r in rows] == [(k, k // 16, k % 16) for k in range(len(rows))]
    assert all(ids[r["previous"]] == r["previous_ordinal"] and ids[r["next"]] == r["next_ordinal"] for r in rows)
    used = set().union(*[s for _, s in run.topology])
    run.empty = list(range(len(ids)))
    got = {r["node"]: r["permitted"] for r in anchors.permits(run.tables(spark)["empty"], anchors.source_topology(run.tables(spark)["sequences"], run.tables(spark)["anchors"])).collect()}
    assert got == {i: i not in used for i in range(len(ids))}


@pytest.mark.parametrize("ids", [(1, 4), (0, 3), (0, 2, 2, 4), ()])
def test_anchors_must_be_whole(spark, ids):
    run = Run((0, 4), 5)
    run.ids = list(ids)
    with pytest.raises(DataError):
        anchors.source_topology(run.tables(spark)["sequences"], run.tables(spark)["anchors"]).collect()


def test_a_good_run(spark):
    run = Run()
    run.empty = [1, 5]  # between anchors on both sides
    found = run.found(spark)
    assert found.collect() == []
    got = anchors.verdicts(run.tables(spark)["sequences"], found, run.tables(spark)["batches"]).first()
    assert (got["accepted"], got["reasons"], got["batches_done"]) == (True, [], 2)


def change_empty(run):
    run.empty = [3]


def change_order(run):
    b = run.batches[1]
    b[0], b[1] = b[1], b[0]


def change_large(run):
    run.batches = [[t for b in run.batches for t in b]]
    run.calls = [[0, 0, 9, 9 + len(run.batches[0])]]
    sources = dict(run.topology)
    run.edges = [[0, i, 9 + local, *GOOD] for local, t in enumerate(run.batches[0]) for i in sorted(sources[t])]


def change_measured(run):
    run.empty, run.measured = [1], [[1, 1], [0, 4]]


def change_fixed(run):
    run.calls[0][2] -= 1


def change_range(run):
    run.calls[1][3] += 1


def change_source(run):
    run.edges[0][1] = 0


def change_repeated(run):
    run.edges.append(list(run.edges[0]))


def change_missing(run):
    del run.edges[0:2]


def change_statistic(**new):
    def change(run):
        for e in run.edges[:2]:
            for k, v in new.items():
                e[3 + STATS.index(k)] = v

    return change


def change_last(run):
    run.batches, run.calls = run.batches[:1], run.calls[:1]
    run.edges = [e for e in run.edges if e[0] == 0]


def change_one_target(run):
    run.edges[0][3 + STATS.index("finite_targets")] = 7


CASES = [
    (change_empty, {"empty_anchor_used", "empty_source"}, 0), (change_order, {"order_differs"}, 1), (change_large, {"batch_too_large"}, 0), (change_measured, {"empty_anchor_measured"}, 1),
    (change_fixed, {"anchors_not_fixed", "edge_outside_sources", "sources_differ", "source_outside_anchors", "target_without_edges", "unaudited_target", "target_outside_range"}, 0), (change_range, {"target_range_differs", "target_without_edges"}, 1),
    (change_source, {"edge_outside_sources", "sources_differ", "source_outside_anchors"}, 0), (change_repeated, {"sources_differ"}, 0), (change_missing, {"sources_differ", "target_without_edges", "unaudited_target"}, 0),
    (change_statistic(nonzero_weights=0, nonzero_pixels=0), {"target_without_weight"}, 0), (change_statistic(pixels=0, nonzero_weights=0, nonzero_pixels=0), {"empty_source", "target_without_weight"}, 0),
    (change_statistic(weights=7), {"inconsistent_counts", "nonfinite_weights"}, 0), (change_statistic(finite_weights=5), {"nonfinite_weights"}, 0), (change_one_target, {"nonfinite_targets"}, 0), (change_last, {"unaudited_target"}, 1),
]


def test_each_refusal(spark):
    """Each rule that is broken is named, nothing else is, and the batches before it count as done; sequences do not mix."""
    runs = [Run(name=f"{i:02}") for i in range(len(CASES))]
    for run, (change, _, _) in zip(runs, CASES, strict=True):
        change(run)
    every = [run.rows() for run in (*runs, Run(name="good"))]
    tables = {k: spark.createDataFrame([r for rows, _ in (t[k] for t in every) for r in rows], every[0][k][1]) for k in every[0]}
    found = anchors.refusals(**tables).cache()
    rows = found.collect()
    verdicts = {r["sequence_id"]: r for r in anchors.verdicts(tables["sequences"], found, tables["batches"]).collect()}
    assert verdicts["good"]["accepted"] and not any(r["sequence_id"] == "good" for r in rows)
    for run, (change, reasons, done) in zip(runs, CASES, strict=True):
        own, got = [r for r in rows if r["sequence_id"] == run.name], verdicts[run.name]
        assert {r["reason"] for r in own} <= reasons and {r["reason"] for r in own if r["first"]}, change
        assert not got["accepted"] and set(got["reasons"]) <= reasons and got["batches_done"] == done, change
        must = {"change_fixed": "anchors_not_fixed", "change_range": "target_range_differs"}.get(change.__name__)
        assert must is None or must in got["reasons"]
        if len(reasons) <= 2:
            assert {r["reason"] for r in own} == reasons, change


def test_the_audit_of_one_call_is_the_same(spark):
    """The audit of measured.support_audit and that of a call's edges are one rule."""
    run = Run()
    rng = random.Random(7)
    for e in run.edges:
        if rng.random() < 0.4:
            e[3 + rng.randrange(7)] = rng.randrange(0, 10)
    tables = run.tables(spark)
    own = tables["edges"].where("call = 0").drop("sequence_id", "call")
    used = spark.createDataFrame([(i,) for i in set().union(*[s for _, s in run.topology])], "node long")
    one = {(r["source"], r["target"], r["reason"]) for r in measured.support_audit(own, used, used.limit(0), 9, 9 + len(run.batches[0])).collect()}
    assert one and one == {r[1:] for r in run.reasons(spark) if r[0] == 0}
