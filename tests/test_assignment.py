"""Masks chosen by gates before rank, and unknown points assigned by strict and fragment evidence, against plain loops."""

import random
from collections import Counter

import pytest

from sightline.operators import naming

FIELDS = ("score", "coverage", "purity", "iou", "own", "quality")
SCHEMA = "object_id long, frame_id long, mask_id long, score double, coverage double, purity double, iou double, own long, quality double"


def made(seed, objects=3, frames=6):
    rng = random.Random(seed)
    pick = lambda: rng.choice([0.3, 0.45, 0.5, 0.6, 0.75, 0.8, 0.9])
    return [(o, f, m, pick(), pick(), pick(), pick(), rng.choice([10, 30, 80]), rng.choice([0.1, 0.5, 0.5])) for o in range(objects) for f in range(frames) for m in range(rng.randrange(5))]


def chosen(rows, o, f, policy):
    own = [dict(zip(FIELDS, r[3:], strict=True), mask=r[2]) for r in rows if r[:2] == (o, f)]
    gates = {"strict": lambda x: x["score"] >= 0.5 and x["coverage"] >= 0.5 and x["purity"] >= 0.75 and x["iou"] >= 0.4 and x["own"] >= 30, "fragment": lambda x: x["score"] >= 0.6 and x["coverage"] >= 0.8 and x["purity"] >= 0.5 and x["iou"] >= 0.5, "best": lambda x: True}
    fit = sorted((x for x in own if gates[policy](x)), key=lambda x: (-x["quality"], -x["iou"], -x["score"], x["mask"]))
    return fit[0]["mask"] if fit else None


@pytest.mark.parametrize("seed", [1, 2])
def test_gates_before_rank(spark, seed):
    rows = made(seed, 6, 12)
    got = naming.select_masks(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["object_id"], r["frame_id"]) for r in got} == {r[:2] for r in rows}
    for r in got:
        assert [r[k] for k in ("strict", "fragment", "best")] == [chosen(rows, r["object_id"], r["frame_id"], k) for k in ("strict", "fragment", "best")]
    assert any(r["strict"] not in (None, r["best"]) for r in got)


@pytest.mark.parametrize("fragments", [True, False])
def test_assigned_points(spark, monkeypatch, fragments):
    monkeypatch.setattr(naming, "NEEDS", {"strict": (2, 8), "fragment": (3, 5)})
    for seed in (3, 4):
        rng, rows = random.Random(seed), made(seed, 4, 10)
        points = [(r[0], r[1], r[2], p) for r in rows for p in rng.sample(range(40), 22)]
        unknown = {p: rng.randrange(4) for p in range(40) if rng.random() < 0.9}
        want = set()
        for o in range(4):
            held = {k: Counter(p for f in range(10) for p in {q[3] for q in points if q[:3] == (o, f, chosen(rows, o, f, k))}) for k in ("strict", "fragment")}
            frames = {k: sum(chosen(rows, o, f, k) is not None for f in range(10)) for k in held}
            strict = {p for p, n in held["strict"].items() if n >= 2 and unknown.get(p) == o}
            strict = strict if len(strict) >= 8 and frames["strict"] >= 2 else set()
            extra = {p for p, n in held["fragment"].items() if n >= 3 and unknown.get(p) == o} - strict
            extra = extra if fragments and len(extra) >= 5 and frames["fragment"] >= 3 else set()
            want |= {(p, o, "strict", held["strict"][p] / 10) for p in strict} | {(p, o, "fragment", held["fragment"][p] / 3) for p in extra}
        selected = naming.select_masks(spark.createDataFrame(rows, SCHEMA))
        got = naming.assigned_unknown(spark.createDataFrame(points, "object_id long, frame_id long, mask_id long, point_id long"), selected, spark.createDataFrame(list(unknown.items()), "point_id long, object_id long"), spark.createDataFrame([(o, 10) for o in range(4)], "object_id long, frames long"), fragments)
        assert set(map(tuple, got.collect())) == want and any(w[2] == "strict" for w in want)
