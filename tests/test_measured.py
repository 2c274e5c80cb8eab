"""Measured evidence, packed masks, older results and the evaluation commands."""

import hashlib
import itertools
import json
import random

import numpy as np
import pytest

from sightline.__main__ import main
from sightline.operators import evaluation, masks, measured, ordering, spatial
from sightline.plans import query
from sightline.schemas import DataError
from sightline.sources import provenance


def clouds(spark, **tracks):
    rows = [(int(k[1:]), i, *map(float, p)) for k, ps in tracks.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "track_id long, point_id long, x double, y double, z double")


def test_candidates_are_measured(spark):
    rng = np.random.default_rng(1)
    one = rng.uniform(0, 1, (900, 3)) * [1, 1, 0.3]
    turned = one @ np.array([[np.cos(0.02), -np.sin(0.02), 0], [np.sin(0.02), np.cos(0.02), 0], [0, 0, 1]]).T + 0.004
    points = clouds(spark, t1=one, t2=turned, t3=one + 9, t4=one + [0.9, 0, 0], t5=one)
    tracks = spark.createDataFrame([(1, 4), (2, 4), (3, 4), (4, 4), (5, 5)], "track_id long, category int")
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (1, 4, 0.7), (1, 5, 0.6)], "a long, b long, score double")
    got = {r["b"]: r for r in measured.measured_candidates(pairs, tracks, points).collect()}
    assert {b: r["reason"] for b, r in got.items()} == {2: "measured", 3: "disjoint_bounds", 4: "overlap", 5: "incompatible_category"}
    assert got[2]["accepted"] and not any(got[b]["accepted"] for b in (3, 4, 5))
    assert got[2]["fitness"] > 0.9 and abs(got[2]["rotation_deg"] - np.degrees(0.02)) < 0.4 and got[2]["translation_m"] < 0.03
    d = np.sqrt(((one[:, None] - turned[None]) ** 2).sum(2))
    assert got[2]["coverage"] == min((d.min(1) < 0.05).mean(), (d.min(0) < 0.05).mean())


def test_motion_and_nearest_by_force():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(60, 3)), rng.normal(size=(80, 3))
    at, far = measured.nearest_of(a, b, 0.7)
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    for i in range(len(a)):
        assert np.isinf(far[i]) == (d[i].min() > 0.7)
        assert np.isinf(far[i]) or (at[i] == d[i].argmin() and np.isclose(far[i], d[i].min()))
    r, t = measured.fitted_motion(a, a @ np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]]).T + 2)
    assert np.allclose(r, [[0, -1, 0], [1, 0, 0], [0, 0, 1]]) and np.allclose(t, 2)


def test_matches_of_adjacent_frames_by_force(spark):
    r = random.Random(3)
    frames = {f: {p: r.randint(0, 3) for p in r.sample(range(60), 45)} for f in (2, 5, 9)}
    rows = [("s", f, m, p) for f, own in frames.items() for p, m in own.items()]
    seen = spark.createDataFrame([(s, f, p) for s, f, _, p in rows], "sequence_id string, frame_id long, point_id long")
    held = spark.createDataFrame([x for x in rows if x[2]], "sequence_id string, frame_id long, mask_id int, point_id long")
    got = {}
    for x in measured.temporal_matches(held, seen, 5, 0.0).collect():
        got.setdefault((x["frame_a"], x["frame_b"]), []).append(x["iou"])
    for a, b in ((2, 5), (5, 9)):
        common = frames[a].keys() & frames[b].keys()
        sets = [{m: {p for p in common if frames[f][p] == m} for m in (1, 2, 3)} for f in (a, b)]
        big = [[s for s in one.values() if len(s) >= 5] for one in sets]
        iou = lambda x, y: len(x & y) / len(x | y)
        short, long = sorted(big, key=len)
        best = max(sum(iou(x, y) for x, y in zip(short, order, strict=False)) for order in itertools.permutations(long, len(short)))
        assert np.isclose(sum(got[a, b]), best)
    assert measured.transition_events(held, seen, 5).count() == 2


def test_descriptors_match_both_ways(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 8))
    y = np.concatenate([x[:25] + 0.01 * rng.normal(size=(25, 8)), rng.normal(size=(10, 8)), x[30:31], x[30:31]])
    table = lambda t: spark.createDataFrame([("p", i, v.tolist()) for i, v in enumerate(t)] + [("q", 0, [0.0] * 8)], "pair_id string, feature_id long, descriptor array<double>")
    got = {(r["pair_id"], r["a"], r["b"]) for r in measured.descriptor_matches(table(x), table(y)).collect()}
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))

    def clear(m):
        return {i: int(row.argmin()) for i, row in enumerate(m) if np.sort(row)[0] < 0.75 * np.sort(row)[1]}

    back = clear(d.T)
    assert got == {("p", i, j) for i, j in clear(d).items() if back.get(j) == i} and len(got) >= 25


def test_support_audit(spark):
    good = (1, 10, 50, 200, 200, 200, 200, 60, 40)
    columns = "source long, target long, pixels long, targets long, finite_targets long, weights long, finite_weights long, nonzero_weights long, nonzero_pixels long"
    nodes = lambda *x: spark.createDataFrame([(i,) for i in x], "node long")

    def audit(*edges, empty=(), end=11):
        return {(r["source"], r["target"], r["reason"]) for r in measured.support_audit(spark.createDataFrame(edges, columns), nodes(1, 2), nodes(*empty), 10, end).collect()}

    assert audit(good) == set()
    assert audit(good, end=12) == {(None, 11, "target_without_edges")}
    assert audit((1, 10, 50, 200, 200, 200, 200, 0, 0)) == {(None, 10, "target_without_weight")}
    assert audit(good, (3, 10, 50, 200, 200, 200, 200, 60, 40), (2, 30, 50, 200, 200, 200, 200, 60, 40)) == {(3, 10, "source_outside_anchors"), (2, 30, "target_outside_range")}
    assert audit(good, (2, 10, 0, 200, 199, 200, 198, 0, 0), empty=[2]) == {(2, 10, "empty_source"), (2, 10, "nonfinite_targets"), (2, 10, "nonfinite_weights"), (2, None, "empty_anchor_used")}
    assert audit(good, (2, 10, 50, 200, 200, 202, 202, 60, 20)) == {(2, 10, "inconsistent_counts")}
    with pytest.raises(ValueError):
        audit(good, end=10)


def test_packed_masks(spark):
    r = random.Random(5)
    sets = {m: {(r.randrange(7), r.randrange(5)) for _ in range(12)} for m in (1, 2)}
    pixels = spark.createDataFrame([(m, u, v) for m, s in sets.items() for u, v in s], "mask_id int, u int, v int")
    packed = measured.packed_masks(pixels, 7, 5, ["mask_id"])
    assert {x["mask_id"]: x["n"] for x in packed.select("mask_id", measured.packed_area(packed["packed"], 35).alias("n")).collect()} == {m: len(s) for m, s in sets.items()}
    back = {}
    for x in measured.unpacked(packed, 7, 5).collect():
        back.setdefault(x["mask_id"], set()).add((x["u"], x["v"]))
    assert back == sets
    with pytest.raises(DataError):
        measured.unpacked(packed, 9, 9).count()


def test_classless_and_3rscan(spark):
    o = spark.createDataFrame([(1, 0, 5), (1, 3, 0)], "point_id long, mask_id int, class_id int")
    assert [r["class_id"] for r in masks.classless(o).orderBy("mask_id").collect()] == [0, 1]
    vertices = spark.createDataFrame([(0, 4), (1, 9)], "vertex_id long, object_id long")
    groups = spark.createDataFrame([(4, "sofa")], "object_id long, label string")
    assert {r["vertex_id"]: r["label"] for r in evaluation.rscan_reference(vertices, groups, "s1", "s1").collect()} == {0: "sofa", 1: None}
    with pytest.raises(DataError):
        evaluation.rscan_reference(vertices, groups, "s1", "s2")


def test_older_results(tmp_path):
    with pytest.raises(DataError):
        provenance.legacy_layout(str(tmp_path))
    out = tmp_path / "fused" / "export"
    out.mkdir(parents=True)
    for p in (out / "semantic_labeled.ply", tmp_path / "fused" / "classes.json", tmp_path / "fused" / "result.json"):
        p.write_text("{}")
    assert provenance.legacy_layout(str(tmp_path)) == {"map": str(out / "semantic_labeled.ply"), "classes": str(tmp_path / "fused" / "classes.json"), "result": str(tmp_path / "fused" / "result.json")}
    receipt = {**provenance.LEGACY_CLAIMS, "scene": "s", "changed_points": 0, "fragment_policy": False, "objects": []}
    path = tmp_path / "result.json"

    def complete(**change):
        path.write_text(json.dumps({**receipt, **change}))
        return provenance.legacy_complete(str(path))

    assert not complete()
    (tmp_path / "map_labels.npz").write_bytes(b"")
    assert complete() and not any(complete(**c) for c in ({"status": "completed"}, {"scene": ""}, {"changed_points": True}, {"changed_points": -1}, {"GT_used": 0}, {"objects": {}}))


def test_sessions_of_roots(spark, tmp_path):
    for name in ("a/one", "a/two", "b/three", "a/.hidden"):
        (tmp_path / name).mkdir(parents=True)
    roots = [str(tmp_path / x) for x in ("a", "b", "none")]
    assert sorted(r["session_id"] for r in provenance.session_listing(spark, roots).collect()) == ["one", "three", "two"]
    (tmp_path / "b" / "one").mkdir()
    with pytest.raises(DataError, match="one"):
        provenance.session_listing(spark, roots)


def test_evidence_needs_its_hash(spark, tmp_path):
    f = tmp_path / "crop.bin"
    f.write_bytes(b"pixels")
    evidence = spark.createDataFrame([(1, 0, str(f), hashlib.sha256(b"pixels").hexdigest())], "instance_id long, index int, file string, sha256 string")
    assert query.evidence_bytes(evidence, 1, 0, "r", lambda: "r") == b"pixels"
    with pytest.raises(ValueError):
        query.evidence_bytes(evidence, 1, 1, "r", lambda: "r")
    with pytest.raises(query.StaleContext):
        query.evidence_bytes(evidence, 1, 0, "r", lambda: "s")
    f.write_bytes(b"others")
    with pytest.raises(ValueError, match="changed"):
        query.evidence_bytes(evidence, 1, 0, "r", lambda: "r")


def test_numbers_and_components(spark):
    r = random.Random(6)
    ids = r.sample(range(1000), 200)
    rows = spark.createDataFrame([(i % 7, i) for i in ids], "a int, b int").repartition(5)
    want = {x: k for k, x in enumerate(sorted((i % 7, i) for i in ids), 1)}
    assert {(x["a"], x["b"]): x["k"] for x in ordering.numbered(rows, ["a", "b"]).collect()} == want
    assert ordering.numbered(rows.limit(0), ["a", "b"]).count() == 0
    edges = [(s, r.randrange(60), r.randrange(60)) for s in (0, 1) for _ in range(35)] + [(0, k, k + 1) for k in range(100, 140)]
    got = {(x["s"], x["node"]): x["root"] for x in ordering.components(spark.createDataFrame(edges, "s int, a long, b long"), ["s"]).collect()}
    low = {(s, x): x for s, a, b in edges for x in (a, b)}
    for _ in range(200):
        for s, a, b in edges:
            low[s, a] = low[s, b] = min(low[s, a], low[s, b])
    assert got == low


def test_range_pairs_by_force(spark):
    r = random.Random(7)
    sides = [[(a, a + r.choice((0.0, 0.1, 0.5, 30.0 if i % 9 == 0 else 0.3))) for a in (r.uniform(-5, 5) for _ in range(3))] for i in range(150)]
    boxes = [(i, *itertools.chain.from_iterable(s)) for i, s in enumerate(sides)]
    names = [f"{c}{k}" for c in "xyz" for k in ("l", "h")]
    df = spark.createDataFrame(boxes, "id long, " + ", ".join(f"{n} double" for n in names))
    got = sorted(tuple(x) for x in spatial.range_pairs(df, "id", ("xl", "yl", "zl"), ("xh", "yh", "zh"), 0.25).collect())
    near = lambda p, q: all(p[k] - q[k + 1] <= 0.25 and q[k] - p[k + 1] <= 0.25 for k in (1, 3, 5))
    assert got == sorted((p[0], q[0]) for p, q in itertools.combinations(boxes, 2) if near(p, q)) and len(got) >= 20


def test_evaluation_commands(spark, tmp_path, capsys):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 2, 1), (1, 1.0, 0.0, 0.0, 3, 0)], "point_id long, x double, y double, z double, semantic_id int, instance_id long")
    reference = spark.createDataFrame([(0, 0.01, 0.0, 0.0, 2, 1), (1, 5.0, 0.0, 0.0, 3, 2)], points.schema)
    for name, t in (("points", points), ("reference", reference), ("mapping", spark.createDataFrame([(2, 11)], "semantic_id int, class_20 int"))):
        t.write.parquet(str(tmp_path / name))
    paths = [str(tmp_path / x) for x in ("points", "reference", "out")]
    assert main(["evaluate-semantic", *paths]) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (said["points"], said["near_points"], said["covered_vertices"], said["reference_accuracy"]) == (2, 1, 1, 0.5)
    assert spark.read.parquet(f"{paths[2]}/per_class_iou").count() > 0
    assert main(["export-evaluation", paths[0], str(tmp_path / "mapping"), str(tmp_path / "export")]) == 0
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "export")).collect())) == [(0, 11, 1), (1, 0, -1)]
