"""Counter-examples for single operators on hand-made rows."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.functions import geometry, names, scalar
from sightline.operators import depth, evaluation, iterative, masks, naming, spatial, temporal, votes
from sightline.schemas import DataError, check_observations, check_points


def observed(spark, rows):
    return spark.createDataFrame(rows, "frame_id long, point_id long, mask_id int, class_id int, confidence double, interior boolean")


def test_votes(spark):
    o = observed(spark, [(f, p, 1, c, s, True) for f, p, c, s in [(1, 1, 1, 0.9), (2, 1, 1, 0.8), (1, 2, 1, 0.9), (2, 2, 2, 0.9), (1, 3, 1, 0.95), (2, 3, 0, 0.9), (1, 4, 0, 0.9), (1, 5, 2, 0.5), (2, 5, 2, 0.5), (3, 5, 1, 0.45), (4, 5, 1, 0.1)]])
    got = {r["point_id"]: (r["class_id"], r["visible"]) for r in votes.finalize_votes(o).collect()}
    assert got == {1: (1, 2), 2: (0, 2), 3: (0, 2), 4: (0, 1), 5: (0, 4)}
    assert [tuple(r)[:2] for r in votes.single_view(o).collect()] == [(3, 1)]
    labels = spark.createDataFrame([(p, 1, 7, 0.5) for p in range(1, 6)], "point_id long, semantic_id int, instance_id int, confidence double")
    kept = {r["point_id"]: (r["semantic_id"], r["instance_id"], r["guarded"]) for r in votes.conflict_guard(o, labels).collect()}
    assert kept[2] == (0, 0, True) and kept[1] == (1, 7, False) and kept[5] == (0, 0, True)
    with pytest.raises(ValueError):
        votes.conflict_guard(o, labels, "other")
    with pytest.raises(DataError):
        check_observations(o.union(o))


def test_point_checks(spark):
    classes = spark.createDataFrame([(0, "unknown"), (1, "a")], "class_id int, name string")
    row = lambda *r: spark.createDataFrame([r], "point_id long, x double, y double, z double, semantic_id int, instance_id long")
    check_points(row(0, 0.0, 0.0, 0.0, 1, 1), classes)
    for bad in ((0, math.nan, 0.0, 0.0, 1, 1), (0, 0.0, 0.0, 0.0, -1, 1), (0, 0.0, 0.0, 0.0, 2, 1)):
        with pytest.raises(DataError):
            check_points(row(*bad), classes)


def test_pixel_claims(spark):
    c = spark.createDataFrame([(1, 0, 0, 1, 5, 0.9), (1, 0, 0, 1, 4, 0.9), (1, 0, 0, 2, 6, 0.85), (1, 1, 0, 1, 5, 0.4), (1, 2, 0, 2, 1, 0.9), (1, 2, 0, 1, 2, 0.5)], "frame_id int, u int, v int, class_id int, mask_id int, score double")
    assert {r["u"]: (r["class_id"], r["mask_id"]) for r in votes.pixel_claims(c).collect()} == {0: (0, 0), 1: (0, 0), 2: (2, 1)}


def test_compatible(spark):
    df = spark.createDataFrame([(8, 33), (8, 17), (33, 17), (7, 34), (8, 34), (5, 5)], "a int, b int").withColumn("ok", votes.compatible(F.col("a"), F.col("b")))
    assert [r["ok"] for r in df.collect()] == [True, False, True, True, False, True]
    assert df.where("ok").where(votes.compatibility_key(F.col("a")) != votes.compatibility_key(F.col("b"))).count() == 0


def points(spark, rows):
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double")


def test_radius(spark):
    p = points(spark, [(i, float(i), 0.0, 0.0) for i in range(4)] + [(9, 0.0, 0.0, 0.0)])
    assert {r["point_id"]: r["others"] for r in spatial.radius_count(p, 1.0).collect()} == {0: 2, 1: 3, 2: 2, 3: 1, 9: 2}
    kept, removed = spatial.radius_cleanup(p, 1.0, 2)
    assert (kept.count(), removed.count()) == (4, 1)
    with pytest.raises(ValueError):
        spatial.radius_cleanup(p, 0.01, 2)


def test_nearest_ties_and_bound(spark):
    a, b = points(spark, [(1, 0.0, 0.0, 0.0), (2, 9.0, 0.0, 0.0)]), points(spark, [(7, 0.5, 0.0, 0.0), (5, -0.5, 0.0, 0.0), (8, 3.0, 0.0, 0.0)])
    assert [tuple(r) for r in spatial.nearest_within(a, b, 0.5).collect()] == [(1, 5, 0.5)]
    assert spatial.coverage_both_ways(a, a, 0.5) == 1.0 and spatial.coverage_both_ways(a, b, 0.5) == 0.0


@pytest.mark.parametrize("seed", range(3))
def test_range_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    low = rng.integers(0, 40, (60, 3)) / 4
    high = low + rng.integers(0, 12, (60, 3)) / 4
    high[0] = [30, 30, 30]
    boxes = spark.createDataFrame(pd.DataFrame({"id": range(60), **{f"l{i}": low[:, i] for i in range(3)}, **{f"h{i}": high[:, i] for i in range(3)}}))
    got = {(r["a"], r["b"]) for r in spatial.range_pairs(boxes, "id", ("l0", "l1", "l2"), ("h0", "h1", "h2"), 0.5).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if np.all(np.maximum(low[a] - high[b], low[b] - high[a]) <= 0.5)}
    assert got == want
    assert spatial.range_pairs(boxes, "id", ("l0", "l1", "l2"), ("h0", "h1", "h2"), 0.5).count() == len(want)


def test_geometry(spark):
    basis = np.array(geometry.up_basis((0, 0, 2)))
    assert np.allclose(basis @ basis.T, np.eye(3)) and np.allclose(basis[2], (0, 0, 1))
    with pytest.raises(ValueError):
        geometry.up_basis((0, 0, 0))
    turn = [0.0, -1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0, 3.0, 0.0, 0.0, 0.0, 1.0]
    m = spark.createDataFrame([(turn,)], "m array<double>")
    row = m.select(scalar.is_rigid(F.col("m")).alias("ok"), scalar.matrix_product(F.col("m"), scalar.rigid_inverse(F.col("m"))).alias("one"), scalar.rotation_angle(F.col("m")).alias("deg"), scalar.is_rigid(F.transform("m", lambda x: x * 2)).alias("bad")).first()
    assert row["ok"] and not row["bad"] and np.allclose(row["one"], np.eye(4).reshape(-1)) and abs(row["deg"] - 90) < 1e-9
    p = geometry.moved(points(spark, [(1, 1.0, 0.0, 0.0)]), turn).first()
    assert (p["x"], p["y"], p["z"]) == (1.0, 3.0, 3.0)


def test_projection(spark):
    eye = np.eye(4).reshape(-1).tolist()
    frames = spark.createDataFrame([(1, eye, eye, 20.0, 20.0, 4.0, 4.0, 9, 9)], "frame_id int, t_camera_world array<double>, t_world_camera array<double>, fx double, fy double, cx double, cy double, width int, height int")
    d = spark.createDataFrame([(1, 4, 4, 2.0), (1, 5, 4, 0.0), (1, 0, 0, 2.0)], "frame_id int, u int, v int, depth_m double")
    p = points(spark, [(1, 0.0, 0.0, 2.04), (2, 0.0, 0.0, 2.2), (3, 0.1, 0.0, 2.0), (4, 0.0, 0.0, -2.0), (5, 9.0, 0.0, 2.0)])
    assert [tuple(r) for r in geometry.visible_pixels(p, frames, d).collect()] == [(1, 1, 4, 4)]
    assert [(r["x"], r["y"], r["z"]) for r in geometry.back_projected(d, frames, 4).orderBy("u").collect()] == [(-0.4, -0.4, 2.0), (0.0, 0.0, 2.0)]


def test_interior(spark):
    px = spark.createDataFrame([(1, u, v, 3 if (u, v) != (2, 2) else 4) for u in range(5) for v in range(5)], "frame_id int, u int, v int, class_id int")
    inside = {(r["u"], r["v"]) for r in geometry.interior(px).where("interior").collect()}
    assert inside == {(1, 1), (1, 3), (3, 1), (3, 3)}
    assert geometry.interior(px).count() == 25


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.label_key(F.lit("  椅子 ")).alias("a"), scalar.label_key(F.lit("Fridge")).alias("b"), scalar.short_label(F.lit('"Office Chair."')).alias("c"), scalar.short_label(F.lit("a b c d e f g")).alias("d"),
        scalar.half_even(F.lit(2.5)).alias("e"), scalar.histogram(F.array(F.lit(2), F.lit(1), F.lit(2))).alias("f"), names.cleaned(F.lit("The Ｄesk_Lamp")).alias("g"), scalar.coloured(F.lit(0), 37).alias("h"), scalar.forbidden_path(F.lit("/a/GT/b"), ["gt"]).alias("i"),
    ).first()
    assert tuple(row) == ("chair", "refrigerator", "office chair", None, 2.0, {1: 1, 2: 2}, "desk lamp", 90, True)


def test_split_masks(spark):
    rows = [(1, p, 1, 1, 0.9, True) for p in range(40)]
    rows += [(f, p, 1 + p // 20, 1, 0.9, True) for f in (2, 3, 4) for p in range(40)]
    o = observed(spark, rows)
    member = masks.membership(o, 10)
    filtered = {(r["frame_id"], r["mask_id"]) for r in masks.split_statistics(member, o).where("filtered").collect()}
    assert filtered == {(1, 1)}
    edges = masks.consensus_edges(masks.dominant_masks(member, o))
    assert masks.accepted_edges(edges).count() == 6 and edges.where("negative > 0").count() == 9


def test_ownership_tie(spark):
    member = spark.createDataFrame([(f, f, 1, 1, 0.9) for f in range(6)], "frame_id long, mask_id int, point_id long, class_id int, confidence double")
    groups = spark.createDataFrame([(f, f, 1 + f // 3) for f in range(6)], "frame_id long, mask_id int, group_id long")
    assert masks.point_ownership(member, groups).first()["group_id"] == 0


def test_names(spark):
    v = spark.createDataFrame([(1, "cup", 1), (1, "cup", 1), (1, "mug", 2), (2, "cup", 1), (2, "cup", 2), (2, "mug", 3), (3, "a", 1), (3, "a", 2), (3, "b", 3), (3, "b", 4), (4, "unknown", 1), (4, "unknown", 2)], "instance_id long, label string, frame_id long")
    assert {r[0]: r[1] for r in naming.name_consensus(v).collect()} == {1: "unknown", 2: "cup", 3: "unknown", 4: "unknown"}


def test_constrained_merge(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(1, 5)], "scene_id int, node long")
    edges = spark.createDataFrame([(0, 1, 2, 5, 0), (0, 2, 3, 4, 0), (0, 1, 3, 0, 2), (0, 3, 4, 3, 0)], "scene_id int, a long, b long, positive long, negative long")
    got = {r["node"]: r["group_id"] for r in iterative.constrained_merge(edges, nodes).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2}
    assert got == {r["node"]: r["group_id"] for r in iterative.constrained_merge(edges.orderBy(F.desc("a")).repartition(3), nodes.repartition(2)).collect()}


def test_fragment_merge(spark):
    counts = spark.createDataFrame([(1, i, f, 5, 40) for i in (1, 2) for f in (1, 2, 3)] + [(1, 3, f, 6, 40) for f in (1, 2, 3)], "category int, instance_id long, frame_id long, mask_id int, n long")
    edges = spark.createDataFrame([(1, 1, 2, 3, 0), (1, 1, 3, 0, 3), (1, 2, 3, 0, 3)], "category int, a long, b long, positive long, negative long")
    assert {r["instance_id"]: r["merged_id"] for r in iterative.fragment_merge(counts, edges).collect()} == {1: 1, 2: 1, 3: 3}


def test_online_association(spark):
    rows = [("s", f, 1, 1, p) for f in (1, 2) for p in range(40)] + [("s", 3, 1, 2, p) for p in range(40)] + [("s", 3, 2, 1, p) for p in range(100, 110)]
    o = spark.createDataFrame(rows, "stream string, frame_id long, mask_id int, class_id int, point_id long")
    assert sorted(tuple(r)[1:] for r in iterative.online_association(o).collect()) == [(1, 1, 1), (2, 1, 1), (3, 1, 2)]


def test_matchings(spark):
    p = spark.createDataFrame([(0, 1, 1, 0.9), (0, 1, 2, 0.8), (0, 2, 1, 0.85)], "scene_id int, a long, b long, iou double")
    assert sorted(tuple(r)[1:3] for r in iterative.assignment(p).collect()) == [(1, 2), (2, 1)]
    assert [tuple(r)[1:3] for r in iterative.greedy_matching(p.withColumnRenamed("iou", "coverage")).collect()] == [(1, 1)]
    rng = np.random.default_rng(0)
    for _ in range(50):
        n, m = map(int, rng.integers(1, 6, 2))
        c = rng.integers(0, 9, (n, m)).astype(float)
        k = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(r, q, strict=True)) for r in itertools.combinations(range(n), k) for q in itertools.permutations(range(m), k))
        got = iterative.sparse_assignment(((i, j, 100 - c[i, j]) for i in range(n) for j in range(m)), n)
        assert len(got) == k and sum(c[i, j] for i, j in got) == best


def test_mask_scores_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, m, c) for m, own in ((1, (0.1, 0.2, 0.3)), (2, (0.3, 0.2, 0.1))) for c in own]
    got = masks.mask_scores(spark.createDataFrame(rows, "frame_id long, mask_id int, confidence double").coalesce(1)).collect()
    assert {r["mask_id"]: r["size"] for r in got} == {1: 3, 2: 3} and len({r["score"] for r in got}) == 1


def test_suppression(spark):
    m = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7)], "frame_id long, mask_id long, score double")
    like = spark.createDataFrame([(1, 1, 2, 0.9), (1, 2, 3, 0.9)], "frame_id long, a long, b long, iou double")
    assert sorted(r["mask_id"] for r in iterative.suppressed(like, m).collect()) == [1, 3]


def test_diverse_views(spark):
    pose = lambda x: [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    c = spark.createDataFrame([("s", i, q, pose(x), i) for i, (q, x) in enumerate([(0.9, 0.0), (0.8, 0.05), (0.7, 0.5), (0.6, 0.55)])], "scene_id string, frame_id long, quality double, pose array<double>, ordinal long")
    got = [(r["frame_id"], r["reason"]) for r in iterative.diverse_views(c, 3).orderBy("frame_id").collect()]
    assert got == [(0, "quality_and_pose_diversity"), (1, "quality_budget_fallback"), (2, "quality_and_pose_diversity")]


def test_rigid_fit(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 3))
    rows = [(1, *map(float, p), float(p[1] + 1), float(-p[0]), float(p[2] - 2)) for p in a]
    r = iterative.rigid_fit(spark.createDataFrame(rows, "pair_id int, a_x double, a_y double, a_z double, b_x double, b_y double, b_z double")).first()
    assert np.allclose(np.array(r["transform"]).reshape(4, 4), [[0, 1, 0, 1], [-1, 0, 0, 0], [0, 0, 1, -2], [0, 0, 0, 1]], atol=1e-9) and r["rmse"] < 1e-6


def frames(spark, times):
    return spark.createDataFrame([("s", i, t, i) for i, t in enumerate(times)], "sequence_id string, frame_id int, timestamp_us long, ordinal long")


def test_windows(spark):
    f = frames(spark, [1, 2, 2, 1, 5])
    assert [r["frame_id"] for r in temporal.monotone_violations(f).collect()] == [3]
    assert sorted(r["frame_id"] for r in temporal.monotone_violations(f, strict=True).collect()) == [2, 3]
    assert sorted(r["frame_id"] for r in temporal.strided(f, 3).collect()) == [0, 3, 4]
    assert sorted(r["stream"] for r in temporal.alternating(f).collect()) == [0, 0, 0, 1, 1]
    anchors = spark.createDataFrame([("s", 1, 1), ("s", 3, 3)], "sequence_id string, ordinal long, anchor_id long")
    got = {r["frame_id"]: (r["previous_anchor"], r["next_anchor"]) for r in temporal.bracket(f, anchors).collect()}
    assert got == {0: (None, 1), 1: (1, 3), 2: (1, 3), 3: (3, 3), 4: (3, 3)}
    assert [r["anchor_id"] for r in temporal.nearest_anchor(f, anchors).orderBy("frame_id").collect()] == [1, 1, 1, 3, 3]


@pytest.mark.parametrize(("n", "k"), [(31, 23), (100, 7), (5, 9), (1, 1), (50, 50), (377, 60)])
def test_even_decimation(spark, n, k):
    want = sorted(set(np.linspace(0, n - 1, min(n, k)).astype(int).tolist()))
    got = spark.createDataFrame([(n,)], "n long").select(temporal.even_indices(F.col("n"), k).alias("i")).first()["i"]
    assert got == want


def test_exact_cover(spark):
    f = frames(spark, [1, 2, 3])
    t = f.select("sequence_id", "frame_id", "timestamp_us")
    assert temporal.exact_cover(f, t).count() == 3
    for bad in (t.limit(2), t.union(t), t.withColumn("timestamp_us", F.col("timestamp_us") + 1)):
        with pytest.raises(DataError):
            temporal.exact_cover(f, bad)
    assert temporal.exact_cover(f, t.limit(2), allow_superset=True).count() == 2


def test_agreement_leaves_out_empty_pairs(spark):
    f = frames(spark, [1, 2, 3])
    pos = spark.createDataFrame([("s", 0, 1, 1), ("s", 0, 1, 2), ("s", 1, 1, 1)], "sequence_id string, frame_id int, object_id int, point_id long")
    seen = spark.createDataFrame([("s", k, p) for k in range(3) for p in (1, 2)], "sequence_id string, frame_id int, point_id long")
    r = temporal.temporal_agreement(pos, seen, f).first()
    assert (r["mean_iou"], r["pairs"]) == (0.25, 2)


def test_evaluation(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1, 1), (2, 1.0, 0.0, 0.0, 0, 0), (3, 9.0, 0.0, 0.0, 1, 1)], "point_id long, x double, y double, z double, semantic_id int, instance_id long")
    ref = spark.createDataFrame([(1, 0.0, 0.0, 0.01, 1, 5), (2, 1.0, 0.0, 0.01, 1, 5)], p.schema)
    forward, backward = evaluation.paired(p, ref)
    c = evaluation.coverage(forward, backward).first()
    assert (c["near_points"], c["accuracy_unknown_as_error"], c["accuracy_labelled_only"], c["covered_vertices"], c["reference_accuracy"]) == (2, 0.5, 1.0, 2, 0.5)
    assert [(r["class_id"], r["iou"]) for r in evaluation.class_iou(backward).collect()] == [(1, 0.5)]
    assert evaluation.coverage(forward.where("point_id = 3"), backward).first()["accuracy_labelled_only"] is None
    m = evaluation.iou_matrix(backward)
    assert [(r["predicted"], r["reference"], r["iou"]) for r in evaluation.instance_matches(m).collect()] == [(1, 5, 0.5)]


def plane(spark, values):
    return spark.createDataFrame([(1, u, v, values.get((u, v), 2000)) for u in range(9) for v in range(9)], "frame_id int, u int, v int, depth_mm int")


def test_depth(spark):
    flat = depth.bilateral(plane(spark, {}))
    assert {r["depth_mm"] for r in flat.collect()} == {2000}
    spike = {(r["u"], r["v"]): r["depth_mm"] for r in depth.spatial_support(plane(spark, {(4, 4): 3000, (0, 0): 0})).collect()}
    assert spike[(4, 4)] == 0 and spike[(4, 5)] == 2000 and spike[(0, 0)] == 0
    out = {(r["u"], r["v"]): r["depth_mm"] for r in depth.denoised(plane(spark, {(4, 4): 2010, (0, 0): 0})).collect()}
    assert out[(0, 0)] == 0 and 2000 < out[(4, 4)] < 2010
    with pytest.raises(DataError):
        depth.denoised(plane(spark, {(0, 0): 0}), lambda d: d.withColumn("depth_mm", F.lit(5)))
    check = depth.depth_check(spark.createDataFrame([(1, 1.0, 1.01), (1, 1.0, 1.2)], "pair_id int, projected_m double, measured_m double")).first()
    assert check["inlier_ratio"] == 0.5 and abs(check["median"] - 0.105) < 1e-9


def test_latency(spark):
    r = temporal.latency_summary(spark.createDataFrame([("a", float(i), 1, True) for i in range(20)], "k string, latency_s double, tokens int, ok boolean"), ["k"]).first()
    assert (r["median_s"], r["p95_s"], r["tokens"]) == (9.5, 19.0, 20)


def test_smoothing_of_tiles(spark):
    """An image function over tiles with halos gives what it gives on the whole image, and what it may not do is named."""
    rng = np.random.default_rng(8)
    image = rng.integers(1990, 2010, (21, 33)).astype(np.uint16)
    image[3, 4] = image[20, 32] = 0
    rows = [(1, u, v, int(image[v, u])) for v in range(21) for u in range(33)]
    pixels = spark.createDataFrame(rows, "frame_id long, u int, v int, depth_mm int")

    def mean(a):
        wide = np.pad(a.astype(np.int64), 2)
        near = sum(wide[2 + dv : 2 + dv + a.shape[0], 2 + du : 2 + du + a.shape[1]] for du in (-2, 0, 2) for dv in (-2, 0, 2))
        return np.where(a > 0, near // 9, 0).astype(np.uint16), {"pixels": int((a > 0).sum())}

    kept = {(r["u"], r["v"]): r["depth_mm"] for r in depth.spatial_support(pixels).collect()}
    whole = mean(np.array([[kept[u, v] for u in range(33)] for v in range(21)], np.uint16))[0]
    for tile in (5, 16, 64):
        got = {(r["u"], r["v"]): r["depth_mm"] for r in depth.denoised(pixels, depth.tiled(mean, tile, 2)).collect()}
        assert got == {(u, v): whole[v, u] for u in range(33) for v in range(21)}
    for function, why in ((lambda a: np.where(a > 0, a, 7), "filled holes in frame 1"), (lambda a: a[1:], "changed the image's shape in frame 1"), (lambda a: a.astype(int) + 70_000, "left the range|filled holes")):
        with pytest.raises(Exception, match=why):
            depth.denoised(pixels, depth.tiled(function, 16, 2))
    with pytest.raises(DataError, match="removed pixels"):
        depth.denoised(pixels, lambda d: d.where("u > 0"))


def test_mask_pairs_are_counted_beside_the_points_of_a_mask(spark):
    """Pairs are expanded after the shuffle by mask: no exchange follows them, neither for overlaps nor for visibility."""
    rows = [(f, 1 + p % 2, p) for f in range(6) for p in range(40) if (p + f) % 3]
    member = spark.createDataFrame([(*r, 1, 1.0) for r in rows], "frame_id long, mask_id int, point_id long, class_id int, confidence double")
    seen = spark.createDataFrame([(f, p) for f in range(6) for p in range(40)], "frame_id long, point_id long")
    shared, visible = {}, {}
    for fa, ma, p in rows:
        for f in range(6):
            visible[fa, ma, f] = visible.get((fa, ma, f), 0) + 1
        for fb, mb, q in rows:
            if p == q:
                shared[fa, ma, fb, mb] = shared.get((fa, ma, fb, mb), 0) + 1
    for got, want in ((masks.mask_overlaps(member), shared), (masks.mask_visibility(member, seen), visible)):
        assert {tuple(r)[:-1]: r[-1] for r in got.collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan and "Exchange" not in plan[: plan.index("Generate explode" if "Generate explode" in plan else "Generate posexplode")].split("Initial Plan")[-1]
    full = masks.eligible_overlaps(member, seen, masks.Consensus(visibility=0.99)).collect()
    assert {(r["frame_a"], r["mask_a"], r["frame_b"], r["mask_b"]): r["shared"] for r in full} == shared


def test_nearest_meets_equal_points_once_and_sorts_no_pair(spark):
    left = spark.createDataFrame([(i, 0.1 * i, 0.0, 0.0) for i in range(5)], "point_id long, x double, y double, z double")
    right = spark.createDataFrame([(100 * k + i, 0.1 * i + 0.02, 0.0, 0.0) for i in range(5) for k in range(1, 40)], "point_id long, x double, y double, z double")
    got = spatial.nearest_within(left, right, 0.3)
    assert {(r["a"], r["b"], round(r["distance"], 9)) for r in got.collect()} == {(i, 100 + i, 0.02) for i in range(5)}
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
