"""Measured evidence: candidate pairs of tracks, matches between adjacent frames, descriptors, support of a graph's targets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterative import assignment
from .spatial import boxes_apart, nearest_within
from .votes import compatible

#: How far apart points may be, and what a measurement must reach.
REACH, COVERAGE, VOXEL, ROUNDS = 0.05, 0.3, 0.02, 20
FITNESS, RMSE, TRANSLATION, DEGREES = 0.3, 0.03, 0.10, 5.0


def voxel_means(x: np.ndarray, size: float = VOXEL) -> np.ndarray:
    """One mean point for each cell that holds points."""
    _, cell = np.unique(np.floor((x - x.min(0)) / size).astype(np.int64), axis=0, return_inverse=True)
    n = np.bincount(cell)
    return np.stack([np.bincount(cell, x[:, k]) / n for k in range(x.shape[1])], axis=1)


def nearest_of(a: np.ndarray, b: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(index in b, distance) of each point of a's nearest up to reach away, infinite beyond: b sorted by x limits the search."""
    order = np.argsort(b[:, 0], kind="stable")
    b = b[order]
    low, high = np.searchsorted(b[:, 0], a[:, 0] - reach), np.searchsorted(b[:, 0], a[:, 0] + reach, "right")
    at, far = np.zeros(len(a), np.int64), np.full(len(a), np.inf)
    for i in np.flatnonzero(high > low):
        d = ((b[low[i] : high[i]] - a[i]) ** 2).sum(1)
        k = int(d.argmin())
        at[i], far[i] = order[low[i] + k], np.sqrt(d[k])
    far[far > reach] = np.inf
    return at, far


def fitted_motion(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R, t) that moves the points of a onto those of b with least squared error, without reflection."""
    ca, cb = a.mean(0), b.mean(0)
    u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
    turn = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))])
    r = vt.T @ turn @ u.T
    return r, cb - r @ ca


def icp(a: np.ndarray, b: np.ndarray, reach: float = REACH, rounds: int = ROUNDS) -> tuple[float, float, float, float]:
    """(fitness, rmse, translation, degrees) of a's best motion onto b, from no motion on; it is measured, never applied."""
    x, y = voxel_means(a), voxel_means(b)
    r, t = np.eye(3), np.zeros(3)
    before = (-1.0, np.inf)
    for k in range(rounds + 1):
        moved = x @ r.T + t
        at, far = nearest_of(moved, y, reach)
        hit = np.isfinite(far)
        now = (hit.mean(), float(np.sqrt((far[hit] ** 2).mean())) if hit.any() else 0.0)
        if k == rounds or hit.sum() < 3 or abs(now[0] - before[0]) < 1e-6 and abs(now[1] - before[1]) < 1e-6:
            break
        before = now
        r, t = fitted_motion(x[hit], y[at[hit]])
    angle = float(np.degrees(np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))))
    return float(now[0]), now[1], float(np.linalg.norm(t)), angle


def measured_candidates(candidates: DataFrame, tracks: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b, score, reason, coverage, fitness, rmse_m, translation_m, rotation_deg, accepted) of candidate pairs of tracks.

    candidates: a, b, score; tracks: track_id, category; points: track_id, point_id, x, y, z. reason is the first that holds:
    incompatible_category, disjoint_bounds (boxes more than REACH apart), overlap (too little of either has a partner
    nearer than REACH), else measured. Boxes and coverage are joins; only pairs with enough coverage are measured
    by ICP, a pair in a task of its own.
    """
    box = points.groupBy("track_id").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{k}") for c in "xyz" for k, f in (("low", F.min), ("high", F.max))])
    own = tracks.join(box, "track_id")
    pairs = candidates
    for s in ("a", "b"):
        pairs = pairs.join(own.select(F.col("track_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in own.columns if c != "track_id"]), s)
    first = F.when(~compatible(F.col("a_category"), F.col("b_category")), "incompatible_category").when(boxes_apart("a_", "b_", REACH), "disjoint_bounds")
    pairs = pairs.withColumn("first", first).withColumn("pair", F.struct("a", "b"))
    near = pairs.where("first is null").select("pair", "a", "b", "a_n", "b_n")
    side = lambda s: near.select("pair", F.col(s).alias("track_id")).join(points, "track_id").select("pair", "point_id", "x", "y", "z")
    share = near
    for x, y in (("a", "b"), ("b", "a")):
        met = nearest_within(side(x), side(y), REACH, ["pair"]).where(F.col("distance") < REACH).groupBy("pair").agg(F.count("*").alias(f"{x}_met"))
        share = share.join(met, "pair", "left")
    share = share.select("pair", F.least(*[F.coalesce(F.col(f"{s}_met"), F.lit(0)) / F.col(f"{s}_n") for s in ("a", "b")]).alias("coverage"))
    enough = share.where(F.col("coverage") >= COVERAGE).select("pair")
    cloud = lambda s: enough.select("pair", F.col(f"pair.{s}").alias("track_id")).join(points, "track_id").select(F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), F.lit(s).alias("side"), "point_id", "x", "y", "z")

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point_id")
        one, other = (rows.loc[rows["side"] == s, ["x", "y", "z"]].to_numpy(np.float64) for s in ("a", "b"))
        fitness, rmse, shift, angle = icp(one, other)
        return pd.DataFrame({"a": rows["a"].iloc[:1], "b": rows["b"].iloc[:1], "fitness": fitness, "rmse_m": rmse, "translation_m": shift, "rotation_deg": angle})

    fit = cloud("a").union(cloud("b")).groupBy("a", "b").applyInPandas(measure, "a long, b long, fitness double, rmse_m double, translation_m double, rotation_deg double")
    out = pairs.join(share, "pair", "left").join(fit, ["a", "b"], "left")
    good = (F.col("fitness") >= FITNESS) & (F.col("rmse_m") <= RMSE) & (F.col("translation_m") <= TRANSLATION) & (F.col("rotation_deg") <= DEGREES)
    reason = F.coalesce("first", F.when(F.col("coverage") < COVERAGE, "overlap"), F.lit("measured"))
    return out.select("a", "b", "score", reason.alias("reason"), "coverage", "fitness", "rmse_m", "translation_m", "rotation_deg", F.coalesce(good, F.lit(False)).alias("accepted"))


def common_masks(masks: DataFrame, visible: DataFrame, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """(sizes of masks, overlaps) on points that both frames of each consecutive pair see.

    masks: sequence_id, frame_id, mask_id, point_id; visible: sequence_id, frame_id, point_id. Sizes: sequence_id, frame_a,
    frame_b, side, mask_id, n, of masks with at least that many such points; overlaps: ..., mask_a, mask_b, shared, n_a, n_b.
    """
    w = Window.partitionBy("sequence_id").orderBy("frame_id")
    steps = visible.select("sequence_id", "frame_id").distinct().withColumn("frame_b", F.lead("frame_id").over(w)).where("frame_b is not null").withColumnRenamed("frame_id", "frame_a")
    pair = ["sequence_id", "frame_a", "frame_b"]
    seen = lambda s: steps.join(visible.withColumnRenamed("frame_id", f"frame_{s}"), ["sequence_id", f"frame_{s}"]).select(*pair, "point_id")
    both = seen("a").join(seen("b"), [*pair, "point_id"])
    held = {s: both.join(masks.select("sequence_id", F.col("frame_id").alias(f"frame_{s}"), "mask_id", "point_id"), ["sequence_id", f"frame_{s}", "point_id"]) for s in ("a", "b")}
    sizes = None
    for s in ("a", "b"):
        one = held[s].groupBy(*pair, F.lit(s).alias("side"), "mask_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        sizes = one if sizes is None else sizes.union(one)
    met = held["a"].withColumnRenamed("mask_id", "mask_a").join(held["b"].withColumnRenamed("mask_id", "mask_b"), [*pair, "point_id"]).groupBy(*pair, "mask_a", "mask_b").agg(F.count("*").alias("shared"))
    for s in ("a", "b"):
        met = met.join(sizes.where(F.col("side") == s).select(*pair, F.col("mask_id").alias(f"mask_{s}"), F.col("n").alias(f"n_{s}")), [*pair, f"mask_{s}"])
    return sizes, met


def temporal_matches(masks: DataFrame, visible: DataFrame, least: int = 20, iou: float = 0.25) -> DataFrame:
    """(sequence_id, frame_a, frame_b, mask_a, mask_b, iou): masks of consecutive frames matched one to one by the most total IoU."""
    _, met = common_masks(masks, visible, least)
    scored = met.select(F.struct("sequence_id", "frame_a", "frame_b").alias("pair"), F.col("mask_a").cast("long").alias("a"), F.col("mask_b").cast("long").alias("b"), (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("iou"))
    # the assignment wants the highest total, not the most pairs: pairs of one step meet in one task
    got = assignment(scored.withColumn("pair", F.to_json("pair")), by="pair", most_pairs=False)
    name = F.from_json("pair", scored.schema["pair"].dataType.simpleString())
    return got.where(F.col("iou") >= iou).select(name.alias("p"), F.col("a").alias("mask_a"), F.col("b").alias("mask_b"), "iou").select("p.*", "mask_a", "mask_b", "iou")


def transition_events(masks: DataFrame, visible: DataFrame, least: int = 20, share: float = 0.5) -> DataFrame:
    """(sequence_id, frame_a, frame_b, masks_a, masks_b, merge_like, split_like) of consecutive frames with such masks.

    Two masks flow into each other if they share that many points, and that share of the smaller one; merge_like counts
    targets of two or more, split_like sources of two or more.
    """
    sizes, met = common_masks(masks, visible, least)
    pair = ["sequence_id", "frame_a", "frame_b"]
    flow = met.where((F.col("shared") >= least) & (F.col("shared") >= share * F.least("n_a", "n_b")))
    out = sizes.groupBy(*pair).agg(F.count_if(F.col("side") == "a").alias("masks_a"), F.count_if(F.col("side") == "b").alias("masks_b"))
    for s, kind in (("b", "merge_like"), ("a", "split_like")):
        many = flow.groupBy(*pair, f"mask_{s}").count().where("count >= 2").groupBy(*pair).agg(F.count("*").alias(kind))
        out = out.join(many, pair, "left").withColumn(kind, F.coalesce(kind, F.lit(0)))
    return out


def descriptor_matches(left: DataFrame, right: DataFrame, ratio: float = 0.75, by: str = "pair_id") -> DataFrame:
    """(by, a, b): features that are each other's nearest, and nearer than ratio of the second nearest, both ways.

    left, right: by, feature_id, descriptor. A pair of images, some thousand features each, is one task; its distances are
    taken in blocks. A side with fewer than two features matches nothing; equal distances go to the smaller id.
    """
    kind = left.schema[by].dataType.simpleString()

    def best(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Each row's nearest in y if it is clear, else -1."""
        out = np.full(len(x), -1)
        for i in range(0, len(x), 512):
            d = np.sqrt(((x[i : i + 512, None] - y[None]) ** 2).sum(2)) if len(y) * x.shape[1] < 1 << 18 else np.sqrt(np.maximum(0, (x[i : i + 512] ** 2).sum(1)[:, None] - 2 * x[i : i + 512] @ y.T + (y * y).sum(1)[None]))
            two = np.argsort(d, axis=1, kind="stable")[:, :2]
            near, next_ = np.take_along_axis(d, two, 1).T
            out[i : i + 512] = np.where(near < ratio * next_, two[:, 0], -1)
        return out

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("feature_id"), b.sort_values("feature_id")
        rows = []
        if min(len(a), len(b)) >= 2:
            x, y = (np.stack(t["descriptor"].to_numpy()).astype(np.float64) for t in (a, b))
            there, back = best(x, y), best(y, x)
            rows = [(a[by].iloc[0], a["feature_id"].iloc[i], b["feature_id"].iloc[j]) for i, j in enumerate(there) if j >= 0 and back[j] == i]
        return pd.DataFrame(rows, columns=[by, "a", "b"])

    return left.groupBy(by).cogroup(right.groupBy(by)).applyInPandas(match, f"{by} {kind}, a long, b long")


EDGE_REASONS = ("source_outside_anchors", "empty_source", "target_outside_range", "inconsistent_counts", "nonfinite_targets", "nonfinite_weights")


def support_audit(edges: DataFrame, sources: DataFrame, empty: DataFrame, start: int, end: int) -> DataFrame:
    """(source, target, reason): what keeps targets start..end-1 from measured support; none if all are supported.

    edges: source, target, pixels, targets, finite_targets, weights, finite_weights, nonzero_weights, nonzero_pixels, a row
    for each actual edge; sources, empty: node. Every target needs an edge and a weight other than zero from
    measured sources. It says nothing of observability or of the poses' quality.
    """
    if not 0 <= start < end:
        raise ValueError("the range of targets is empty")
    marked = edges.join(sources.select(F.col("node").alias("source"), F.lit(True).alias("used")).distinct(), "source", "left")
    marked = marked.join(empty.select(F.col("node").alias("source"), F.lit(True).alias("bare")).distinct(), "source", "left")
    failed = edge_failures(marked, F.lit(start), F.lit(end)).select("source", "target", "reason")
    both = sources.select("node").intersect(empty.select("node")).select(F.col("node").alias("source"), F.lit(None).cast("long").alias("target"), F.lit("empty_anchor_used").alias("reason"))
    nodes = edges.sparkSession.range(start, end).withColumnRenamed("id", "target")
    bare = target_failures(edges.where((F.col("target") >= start) & (F.col("target") < end)), nodes, []).select(F.lit(None).cast("long").alias("source"), "target", "reason")
    return failed.unionByName(both).unionByName(bare)


def edge_failures(marked: DataFrame, start: Column, end: Column) -> DataFrame:
    """marked with a row for each reason that an edge breaks. marked: edges with used (null: no source of any target) and bare (null: not empty)."""
    c = F.col
    inside = (c("target") >= start) & (c("target") < end)
    half = F.floor(c("weights") / 2)
    fine = (c("pixels") >= 0) & (c("targets") > 0) & (c("weights") == c("targets")) & (c("weights") % 2 == 0)
    fine &= c("finite_targets").between(0, c("targets")) & c("finite_weights").between(0, c("weights")) & c("nonzero_pixels").between(0, half)
    fine &= c("nonzero_weights").between(c("nonzero_pixels"), F.least(2 * c("nonzero_pixels"), c("weights"))) & c("pixels").between(c("nonzero_pixels"), half)
    tests = (
        c("used").isNull() | (c("source") < 0) | (c("source") >= start), c("bare").isNotNull() | (c("pixels") == 0), ~inside,
        inside & ~fine, inside & (c("finite_targets") != c("targets")), inside & (c("finite_weights") != c("weights")),
    )
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, r in zip(tests, EDGE_REASONS, strict=True)]))
    return marked.withColumn("reason", F.explode(reasons))


def target_failures(inside: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """nodes (keys, target) that no edge of inside, or no weight other than zero, supports, with the reason."""
    weight = inside.groupBy(*keys, "target").agg(F.sum("nonzero_weights").alias("w"))
    bare = nodes.join(weight, [*keys, "target"], "left").where(F.coalesce("w", F.lit(0)) == 0)
    return bare.withColumn("reason", F.when(F.col("w").isNull(), "target_without_edges").otherwise("target_without_weight")).drop("w")


def packed_area(packed: Column, bits: int) -> Column:
    """The number of bits set among the first bits of a packed mask, the first pixel in a byte's highest bit."""

    @F.arrow_udf("long")
    def area(masks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in masks:
            yield pa.array([None if m is None else int(np.unpackbits(np.frombuffer(m, np.uint8), count=bits).sum()) for m in batch.to_pylist()], pa.int64())

    return area(packed)


def unpacked(masks: DataFrame, width: int, height: int, packed: str = "packed") -> DataFrame:
    """A row for each set pixel of each mask: masks' other columns, u, v. A mask of another size is refused."""
    from ..schemas import refuse

    refuse(masks, F.length(packed) != -(-width * height // 8), "packed masks have another size")

    @F.arrow_udf("array<int>")
    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if m is None else np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8), count=width * height)).astype(np.int32) for m in batch.to_pylist()], pa.list_(pa.int32()))

    rest = [c for c in masks.columns if c != packed]
    flat = masks.select(*rest, F.explode(places(F.col(packed))).alias("_at"))
    return flat.select(*rest, (F.col("_at") % width).alias("u"), F.floor(F.col("_at") / width).cast("int").alias("v"))


def packed_masks(pixels: DataFrame, width: int, height: int, by: list[str]) -> DataFrame:
    """(by, packed): the inverse of unpacked; a mask's pixels, at most width * height, are collected by mask."""
    @F.arrow_udf("binary")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for places in batch.to_pylist():
                one = np.zeros(width * height, np.uint8)
                one[places] = 1
                out.append(np.packbits(one).tobytes())
            yield pa.array(out, pa.binary())

    return pixels.groupBy(*by).agg(F.collect_set((F.col("v") * width + F.col("u")).cast("int")).alias("_at")).select(*by, pack(F.col("_at")).alias("packed"))
