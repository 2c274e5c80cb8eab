"""Ordered and as-of operators over frames, and top-k choices.

Windows over a whole sequence are partitioned by sequence: a sequence is one recording of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DataError, refuse, refuse_duplicates

BY = "sequence_id"


def monotone_violations(frames: DataFrame, order: str = "ordinal", strict: bool = False) -> DataFrame:
    """Frames whose timestamp falls behind the one before, or equals it if strict."""
    w = Window.partitionBy(BY).orderBy(order)
    before = F.lag("timestamp_us").over(w)
    return frames.withColumn("previous_us", before).where((F.col("timestamp_us") <= F.col("previous_us")) if strict else (F.col("timestamp_us") < F.col("previous_us")))


def adjacent(frames: DataFrame) -> DataFrame:
    """(sequence_id, frame_id, next_frame): consecutive pairs."""
    return frames.withColumn("next_frame", F.lead("frame_id").over(Window.partitionBy(BY).orderBy("frame_id"))).where("next_frame is not null").select(BY, "frame_id", "next_frame")


def strided(frames: DataFrame, stride: int, order: str = "frame_id") -> DataFrame:
    """Every stride-th frame and the last."""
    w = Window.partitionBy(BY).orderBy(order)
    return frames.withColumn("_n", F.row_number().over(w) - 1).withColumn("_last", F.lead(order).over(w).isNull()).where((F.col("_n") % stride == 0) | F.col("_last")).drop("_n", "_last")


def even_indices(n: Column, k: int) -> Column:
    """k indices spread over 0..n-1: the step in floating point first, the last index forced; all if n <= k."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == k - 1, n - 1).otherwise(F.floor(i * ((n - 1).cast("double") / F.lit(float(max(1, k - 1)))))).cast("long"))
    return F.when(n <= k, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array_distinct(spread))


def decimated(rows: DataFrame, k: int, order: list[str], by: str | None = BY, reserve: Column | None = None) -> DataFrame:
    """Up to k rows spread evenly over the order; rows that reserve marks are kept in any case."""
    keys = [by] if by else []
    placed = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    count = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
    wanted = count.select(*keys, F.explode(even_indices(F.col("_size"), k)).alias("_n"))
    if reserve is None:
        return placed.join(wanted, [*keys, "_n"], "left_semi").drop("_n")
    kept = placed.join(wanted.withColumn("_in", F.lit(True)), [*keys, "_n"], "left")
    return kept.where(F.coalesce("_in", F.lit(False)) | reserve).drop("_n", "_in")


def highlighted(points: DataFrame, k: int, ids: list[int]) -> DataFrame:
    """Decimated points with one representative, the lowest point, of each highlighted instance."""
    first = points.where(F.col("instance_id").isin(*ids)).groupBy("instance_id").agg(F.min("point_id").alias("point_id")).select("point_id")
    return decimated(points, k, ["point_id"], by=None).union(points.join(first, "point_id", "left_semi")).distinct()


def alternating(frames: DataFrame) -> DataFrame:
    """frames with stream 0 or 1 in turn."""
    return frames.withColumn("stream", (F.row_number().over(Window.partitionBy(BY).orderBy("frame_id")) - 1) % 2)


def bracket(frames: DataFrame, anchors: DataFrame, order: str = "ordinal") -> DataFrame:
    """frames with previous_anchor and next_anchor by position; an anchor is its own previous, the last anchor its own next too."""
    marked = frames.join(anchors.select(BY, F.col(order), F.col("anchor_id")), [BY, order], "left").withColumn("_at", F.when(F.col("anchor_id").isNotNull(), F.struct(order, "anchor_id")))
    w = Window.partitionBy(BY).orderBy(order)
    back = F.last("_at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # the next anchor is the last one of the opposite order: a frame that only grows costs one pass, one that shrinks is read anew for each row
    ahead = F.last("_at", ignorenulls=True).over(Window.partitionBy(BY).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1))
    out = marked.withColumn("_p", back).withColumn("_n", ahead)
    return out.select(*frames.columns, F.col("_p.anchor_id").alias("previous_anchor"), F.coalesce("_n.anchor_id", F.col("_p.anchor_id")).alias("next_anchor"), F.col(f"_p.{order}").alias("previous_at"), F.col(f"_n.{order}").alias("next_at"))


def nearest_anchor(frames: DataFrame, anchors: DataFrame, order: str = "ordinal") -> DataFrame:
    """frames with the anchor of the nearest position; the earlier one wins ties."""
    b = bracket(frames, anchors, order)
    first = F.col("previous_at").isNotNull() & (F.col("next_at").isNull() | (F.col(order) - F.col("previous_at") <= F.col("next_at") - F.col(order)))
    return b.withColumn("anchor_id", F.when(first, F.col("previous_anchor")).otherwise(F.col("next_anchor"))).select(*frames.columns, "anchor_id")


def exact_cover(manifest: DataFrame, trajectory: DataFrame, allow_superset: bool = False) -> DataFrame:
    """The join of frames and poses by frame; duplicates, gaps and unequal timestamps are refused."""
    keys = [BY, "frame_id"]
    refuse_duplicates(manifest, *keys)
    refuse_duplicates(trajectory, *keys)
    if not trajectory.join(manifest, keys, "left_anti").isEmpty():
        raise DataError("trajectory has frames the manifest lacks")
    if not allow_superset and not manifest.join(trajectory, keys, "left_anti").isEmpty():
        raise DataError("trajectory does not cover the manifest")
    both = manifest.join(trajectory.withColumnRenamed("timestamp_us", "pose_timestamp_us"), keys)
    refuse(both, F.col("timestamp_us") != F.col("pose_timestamp_us"), "timestamps differ")
    return both.drop("pose_timestamp_us")


def loop_closures(poses: DataFrame, metres: float = 1.0, gap: int = 60, degrees: float = 55.0) -> DataFrame:
    """(sequence_id, i, j): per pose and quarter of the sequence the nearest earlier pose by place and view; and the next two.

    poses: sequence_id, ordinal, x, y, z, ax, ay, az (viewing axis).
    """
    from .spatial import in_cells, shifted

    size = poses.groupBy(BY).agg((F.max("ordinal") + 1).alias("n"))
    cols = ["ordinal", "x", "y", "z", "ax", "ay", "az"]
    a = in_cells(poses, metres).select(BY, "c0", "c1", "c2", *[F.col(c).alias(f"i_{c}") for c in cols])
    b = shifted(poses, metres).select(BY, "c0", "c1", "c2", *[F.col(c).alias(f"j_{c}") for c in cols])
    d = F.sqrt(sum(((F.col(f"i_{c}") - F.col(f"j_{c}")) * (F.col(f"i_{c}") - F.col(f"j_{c}")) for c in "yz"), (F.col("i_x") - F.col("j_x")) * (F.col("i_x") - F.col("j_x"))))
    dot = F.col("i_ax") * F.col("j_ax") + F.col("i_ay") * F.col("j_ay") + F.col("i_az") * F.col("j_az")
    met = a.join(b, [BY, "c0", "c1", "c2"]).where(F.col("j_ordinal") - F.col("i_ordinal") > gap).withColumn("d", d).where((F.col("d") < metres) & (F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))) < degrees))
    quarter = F.floor(4 * F.col("j_ordinal") / F.col("n"))
    best = met.join(size, BY).groupBy(BY, "i_ordinal", quarter.alias("q")).agg(F.min(F.struct("d", "j_ordinal")).alias("m"))
    far = best.select(BY, F.col("i_ordinal").alias("i"), F.col("m.j_ordinal").alias("j"))
    steps = poses.join(size, BY).select(BY, F.col("ordinal").alias("i"), F.explode(F.array(F.col("ordinal") + 1, F.col("ordinal") + 2)).alias("j"), "n").where("j < n").drop("n")
    return far.union(steps).distinct()


def temporal_agreement(positives: DataFrame, visible: DataFrame, frames: DataFrame) -> DataFrame:
    """One row: the mean and the weighted IoU of objects' points between consecutive frames, on points that both see.

    positives: sequence_id, frame_id, object_id, point_id; visible: sequence_id, frame_id, point_id. Pairs without any
    positive point are left out, not counted as agreement.
    """
    step = adjacent(frames)
    seen = visible.join(step, [BY, "frame_id"]).join(visible.select(BY, F.col("frame_id").alias("next_frame"), "point_id"), [BY, "next_frame", "point_id"]).select(BY, "frame_id", "next_frame", "point_id")
    now = positives.join(seen, [BY, "frame_id", "point_id"]).select(BY, "frame_id", "object_id", "point_id", F.lit(1).alias("a"))
    then = positives.withColumnRenamed("frame_id", "next_frame").join(seen, [BY, "next_frame", "point_id"]).select(BY, "frame_id", "object_id", "point_id", F.lit(2).alias("a"))
    per = now.union(then).groupBy(BY, "frame_id", "object_id", "point_id").agg(F.sum("a").alias("s")).groupBy(BY, "frame_id", "object_id").agg(F.count_if(F.col("s") == 3).alias("both"), F.count("*").alias("either"))
    return per.agg(F.avg(F.col("both") / F.col("either")).alias("mean_iou"), F.try_divide(F.sum("both"), F.sum("either")).alias("weighted_iou"), F.count("*").alias("pairs"))


def stage_durations(artifacts: DataFrame) -> DataFrame:
    """artifacts with the seconds since the one before, by session."""
    return artifacts.withColumn("seconds", F.col("finished_s") - F.lag("finished_s").over(Window.partitionBy("session_id").orderBy("finished_s", "name")))


def stage_states(events: DataFrame) -> DataFrame:
    """(session_id, stage, state): each stage's last event."""
    return events.groupBy("session_id", "stage").agg(F.max(F.struct("monotonic", "event")).alias("m")).select("session_id", "stage", F.col("m.event").alias("state"))


def side_conflicts(pixels: DataFrame, k: int = 4) -> DataFrame:
    """pixels with conflicts_before and conflicts_after: conflicting neighbours among the k frames on each side."""
    w = Window.partitionBy("pixel_id").orderBy("frame_id")
    flag = F.col("conflict").cast("int")
    return pixels.withColumn("conflicts_before", F.coalesce(F.sum(flag).over(w.rowsBetween(-k, -1)), F.lit(0))).withColumn("conflicts_after", F.coalesce(F.sum(flag).over(w.rowsBetween(1, k)), F.lit(0)))


def top_tracks(tracks: DataFrame, most: int = 128, points: int = 50) -> DataFrame:
    return tracks.where(F.col("points") >= points).orderBy(F.desc("frames"), F.desc("points"), "track_id").limit(most)


#: Classes that are never named by crops.
UNCROPPED = (10, 19)


def top_crops(masks: DataFrame, most: int = 8, area: int = 300, side: int = 10) -> DataFrame:
    """The largest crops of each frame, by area and then mask."""
    able = masks.where(~F.col("class_id").isin(*UNCROPPED) & (F.col("area") >= area) & (F.col("box_width") >= side) & (F.col("box_height") >= side))
    return able.withColumn("place", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("area"), "mask_id"))).where(F.col("place") <= most)


def quality_views(candidates: DataFrame, budget: int) -> DataFrame:
    """The best views by quality, in order of time again."""
    return candidates.orderBy(F.desc("quality"), "ordinal").limit(budget).orderBy("ordinal")


def newest_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions newest first; an id in two roots is refused."""
    refuse_duplicates(sessions, "session_id")
    return sessions.orderBy(F.desc("modified_s"), "session_id")


def latency_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Median (exact), p95 (the value at index int(.95 n), not interpolated), mean, tokens and outcomes."""
    values = F.array_sort(F.collect_list("latency_s"))
    index = F.least(F.floor(F.size(values) * 0.95).cast("int"), F.size(values) - 1)
    return rows.groupBy(*by).agg(F.percentile("latency_s", 0.5).alias("median_s"), F.try_element_at(values, index + 1).alias("p95_s"), F.avg("latency_s").alias("mean_s"), F.sum("tokens").alias("tokens"), F.count_if("ok").alias("succeeded"), F.count("*").alias("requests"))


def class_legend(points: DataFrame, classes: DataFrame, least: int = 50) -> DataFrame:
    counts = points.where("semantic_id > 0").groupBy("semantic_id").agg(F.count("*").alias("points")).where(F.col("points") >= least)
    return counts.join(classes.select(F.col("class_id").alias("semantic_id"), "name"), "semantic_id").orderBy(F.desc("points"), "semantic_id")


def object_catalogue(points: DataFrame) -> DataFrame:
    """(kind, id, points, majority): groups by class and by instance over one scan; the lowest class wins majority ties."""
    per = points.groupBy("semantic_id", "instance_id").agg(F.count("*").alias("n"))
    sets = per.where("semantic_id > 0 or instance_id > 0").select(F.explode(F.array(F.struct(F.lit("class").alias("kind"), F.col("semantic_id").cast("long").alias("id")), F.struct(F.lit("instance").alias("kind"), F.col("instance_id").cast("long").alias("id")))).alias("g"), "semantic_id", "n").where("g.id > 0")
    by = sets.groupBy("g.kind", "g.id", "semantic_id").agg(F.sum("n").alias("n"))
    return by.groupBy("kind", "id").agg(F.sum("n").alias("points"), F.max(F.struct("n", (-F.col("semantic_id")).alias("c"))).alias("b")).select("kind", "id", "points", (-F.col("b.c")).cast("int").alias("majority"))


def instance_list(objects: DataFrame, names: DataFrame) -> DataFrame:
    return objects.join(names.select("instance_id", "name"), "instance_id", "left").orderBy(F.desc("point_count"), "instance_id")


def joint_choice(candidates: DataFrame) -> DataFrame:
    """The best combination of one mask for each of a region's three views: strongest first, then agreement, quality and size.

    candidates: region_id, view (0..2), mask_id, strong, agreement, quality, size; sets are of at most a few masks each.
    """
    sides = [candidates.where(F.col("view") == v).select("region_id", *[F.col(c).alias(f"{c}{v}") for c in ("mask_id", "strong", "agreement", "quality", "size")]) for v in range(3)]
    every = sides[0].join(sides[1], "region_id").join(sides[2], "region_id")
    total = lambda c: F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")
    rank = F.struct(total("strong").alias("s"), total("agreement").alias("a"), total("quality").alias("q"), (-total("size")).alias("z"), *[(-F.col(f"mask_id{v}")).alias(f"m{v}") for v in range(3)])
    return every.groupBy("region_id").agg(F.max(rank).alias("r")).select("region_id", *[(-F.col(f"r.m{v}")).alias(f"mask_{v}") for v in range(3)])
