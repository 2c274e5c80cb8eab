"""Names by consensus: distinct frames vote, and anything unclear stays unknown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered
from .votes import micros

UNNAMED = ("", "unknown", "none")


def name_consensus(votes: DataFrame, key: str = "instance_id") -> DataFrame:
    """(key, name, support_frames): the label of the most distinct frames if they are two at least and more than any other's."""
    per = votes.groupBy(key, "label").agg(F.count_distinct("frame_id").alias("n"))
    named = per.where(~F.col("label").isin(*UNNAMED))
    top = named.groupBy(key).agg(F.max(F.struct("n", "label")).alias("b"), F.array_sort(F.collect_list("n")).alias("all"))
    second = F.coalesce(F.try_element_at("all", F.lit(-2)), F.lit(0))
    clear = (F.col("b.n") >= 2) & (F.col("b.n") > second)
    out = votes.select(key).distinct().join(top, key, "left")
    return out.select(key, F.when(clear, F.col("b.label")).otherwise("unknown").alias("name"), F.when(clear, F.col("b.n")).otherwise(0).alias("support_frames"))


def frame_majority(observations: DataFrame, instances: DataFrame, confidence: float = 0.8, points: int = 30, frame_share: float = 0.8, frames: int = 3, share: float = 0.8) -> DataFrame:
    """(instance_id, class_id, frames, votes): each frame with enough sure points has one vote, for its weighted majority class."""
    own = observations.where((F.col("confidence") >= confidence) & (F.col("class_id") > 0)).join(instances.where("instance_id > 0").select("point_id", "instance_id"), "point_id")
    per = own.groupBy("instance_id", "frame_id", "class_id").agg(F.count("*").alias("n"), F.sum(micros(F.col("confidence"))).alias("w"))
    frame = per.groupBy("instance_id", "frame_id").agg(F.sum("n").alias("n"), F.sum("w").alias("total"), F.max(F.struct("w", (-F.col("class_id")).alias("c"))).alias("b"))
    frame = frame.where(F.col("n") >= points).withColumn("vote", F.when(1000 * F.col("b.w") >= round(1000 * frame_share) * F.col("total"), -F.col("b.c")).otherwise(0))
    tally = frame.groupBy("instance_id", "vote").agg(F.count("*").alias("k"))
    best = tally.groupBy("instance_id").agg(F.sum("k").alias("frames"), F.max(F.when(F.col("vote") > 0, F.struct("k", (-F.col("vote")).alias("c")))).alias("b"))
    clear = (F.col("frames") >= frames) & (F.col("b.k") >= share * F.col("frames"))
    return best.select("instance_id", F.when(clear, -F.col("b.c")).otherwise(0).cast("int").alias("class_id"), "frames", F.coalesce("b.k", F.lit(0)).alias("votes"))


def grounding_confirmed(evidence: DataFrame, score: float = 0.5, coverage: float = 0.5, iou: float = 0.4, other: float = 0.2, frames: int = 2) -> DataFrame:
    """(instance_id, label, support, seen, fraction): labels that enough frames confirm. evidence: instance_id, label, frame_id, score, coverage, iou, other."""
    passed = (F.col("score") >= score) & (F.col("coverage") >= coverage) & (F.col("iou") >= iou) & (F.col("other") <= other)
    per = evidence.groupBy("instance_id", "label").agg(F.count_distinct(F.when(passed, F.col("frame_id"))).alias("support"), F.count_distinct("frame_id").alias("seen"))
    return per.where(F.col("support") >= frames).withColumn("fraction", F.col("support") / F.col("seen"))


def new_class_ids(names: DataFrame, classes: DataFrame) -> DataFrame:
    """(name, class_id): ids for names the dictionary lacks, after its largest id, in order of the names."""
    top = classes.agg(F.max("class_id").alias("top"))
    new = names.select("name").distinct().join(classes, "name", "left_anti")
    return numbered(new, ["name"]).crossJoin(F.broadcast(top)).select("name", (F.col("top") + F.col("k")).cast("int").alias("class_id"))


def crop_owners(crops: DataFrame, instances: DataFrame, points: int = 30, share: float = 0.65) -> DataFrame:
    """(crop_id, instance_id): the instance that most of a crop's mask points have, of all its points, unassigned ones too."""
    per = crops.join(instances.select("point_id", "instance_id"), "point_id", "left").groupBy("crop_id", F.coalesce("instance_id", F.lit(0)).alias("instance_id")).agg(F.count("*").alias("n"))
    top = per.groupBy("crop_id").agg(F.sum("n").alias("total"), F.max(F.when(F.col("instance_id") > 0, F.struct("n", (-F.col("instance_id")).alias("i")))).alias("b"))
    return top.where((F.col("b.n") >= points) & (F.col("b.n") >= share * F.col("total"))).select("crop_id", (-F.col("b.i")).alias("instance_id"))


def verified_pair_fill(pairs: DataFrame, frames: int = 2, support: int = 2) -> DataFrame:
    """(point_id, claim): unknown points that pairs passing in enough frames claim, in enough frames and for one claimant only.

    pairs: a, b, frame_id, passed, claim, point_id.
    """
    good = pairs.where("passed").groupBy("a", "b").agg(F.count_distinct("frame_id").alias("n")).where(F.col("n") >= frames).select("a", "b")
    votes = pairs.where("passed").join(good, ["a", "b"]).groupBy("point_id", "claim").agg(F.count_distinct("frame_id").alias("n")).where(F.col("n") >= support)
    return votes.groupBy("point_id").agg(F.count("*").alias("claims"), F.max("claim").alias("claim")).where("claims = 1").select("point_id", "claim")


#: What a mask must reach to confirm a name strictly, and to fill a fragment; a missing gate is open.
GATES = {"strict": {"score": 0.5, "coverage": 0.5, "purity": 0.75, "iou": 0.4, "own": 30}, "fragment": {"score": 0.6, "coverage": 0.8, "purity": 0.5, "iou": 0.5}}
#: Frames and points that an assignment needs, by policy; fragments fill what is left by strict evidence.
NEEDS = {"strict": (2, 50), "fragment": (3, 50)}


def select_masks(candidates: DataFrame) -> DataFrame:
    """(object_id, frame_id, strict, fragment, best): of each object's masks in a frame the best of those that pass the gates.

    candidates: object_id, frame_id, mask_id, quality, and what the gates name. Masks are ranked by quality, iou and score,
    the lowest id on ties, among those that pass: a broad mask that fails does not hide one that passes. best is of all.
    """
    rank = F.struct("quality", "iou", "score", -F.col("mask_id"))
    passes = {k: reduce(lambda a, b: a & b, [F.col(c) >= v for c, v in gates.items()]) for k, gates in GATES.items()}
    first = lambda when: F.max_by("mask_id", F.when(when, rank))
    return candidates.groupBy("object_id", "frame_id").agg(*[first(w).alias(k) for k, w in passes.items()], first(F.lit(True)).alias("best"))


def assigned_unknown(points: DataFrame, selected: DataFrame, unknown: DataFrame, frames: DataFrame, fragments: bool = True) -> DataFrame:
    """(point_id, object_id, policy, strength): unknown points of objects that enough frames' selected masks hold.

    points: object_id, frame_id, mask_id, point_id; selected: as from select_masks; unknown: point_id, object_id (its own);
    frames: object_id, frames (that named it). An object whose policy has too few frames or points gains none by it.
    strength: the share of naming frames for strict points, of the frames needed for fragments, which may exceed 1.
    """
    own, out = unknown.select("point_id", "object_id"), None
    for policy in ("strict", "fragment") if fragments else ("strict",):
        least, enough = NEEDS[policy]
        chosen = selected.where(F.col(policy).isNotNull()).select("object_id", "frame_id", F.col(policy).alias("mask_id"))
        seen = chosen.groupBy("object_id").agg(F.count_distinct("frame_id").alias("n")).where(F.col("n") >= least).select("object_id")
        left = own if out is None else own.join(out.select("point_id", "object_id"), ["point_id", "object_id"], "left_anti")
        held = points.join(chosen.join(seen, "object_id"), ["object_id", "frame_id", "mask_id"]).join(left, ["point_id", "object_id"])
        support = held.groupBy("point_id", "object_id").agg(F.count_distinct("frame_id").alias("n")).where(F.col("n") >= least)
        gain = support.groupBy("object_id").agg(F.count("*").alias("gain")).where(F.col("gain") >= enough).select("object_id")
        share = F.col("n") / (F.col("frames") if policy == "strict" else F.lit(least))
        got = support.join(gain, "object_id").join(frames, "object_id").select("point_id", "object_id", F.lit(policy).alias("policy"), share.alias("strength"))
        out = got if out is None else out.union(got)
    return out


def assign_unknown(claims: DataFrame, unknown: DataFrame, frames: int = 2, points: int = 50) -> DataFrame:
    """(point_id, object_id): unknown points that enough frames of one object's accepted masks hold, for objects that gain enough."""
    own = claims.join(unknown.select("point_id"), "point_id").groupBy("point_id", "object_id").agg(F.count_distinct("frame_id").alias("n")).where(F.col("n") >= frames)
    single = own.groupBy("point_id").agg(F.count("*").alias("k"), F.max("object_id").alias("object_id")).where("k = 1").select("point_id", "object_id")
    big = single.groupBy("object_id").agg(F.count("*").alias("gain")).where(F.col("gain") >= points)
    return single.join(big, "object_id", "left_semi").select("point_id", "object_id")


#: The gates of grounded masks, strict ones and those for fragments.
STRICT = {"score": 0.5, "coverage": 0.5, "purity": 0.75, "iou": 0.4, "points": 30}
FRAGMENT = {"score": 0.6, "coverage": 0.8, "purity": 0.5, "iou": 0.5, "points": 30}


def pair_mask(candidates: DataFrame, quality: float = 0.5, coverage: float = 0.5) -> DataFrame:
    """One mask for each side of a pair view, by coverage, quality and index."""
    w = Window.partitionBy("a", "b", "frame_id", "side").orderBy(F.desc("coverage"), F.desc("score"), "mask_id")
    return candidates.where((F.col("score") >= quality) & (F.col("coverage") >= coverage)).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def mask_overlap(masks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(masks' keys, coverage, purity, iou) of point sets: masks (object_id, frame_id, mask_id, point_id), anchors (object_id, point_id)."""
    key = ["object_id", "frame_id", "mask_id"]
    size = masks.groupBy(*key).agg(F.count("*").alias("mask_size"))
    anchor = anchors.groupBy("object_id").agg(F.count("*").alias("anchor_size"))
    shared = masks.join(anchors, ["object_id", "point_id"]).groupBy(*key).agg(F.count("*").alias("shared"))
    out = size.join(anchor, "object_id").join(shared, key, "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return out.select(*key, (F.col("shared") / F.col("anchor_size")).alias("coverage"), (F.col("shared") / F.col("mask_size")).alias("purity"), (F.col("shared") / (F.col("mask_size") + F.col("anchor_size") - F.col("shared"))).alias("iou"))


def candidates_from_groups(ownership: DataFrame, instances: DataFrame, points: int = 50) -> DataFrame:
    """(group_id, n, candidate_id, reason): unresolved geometry as candidate objects, numbered after the largest instance."""
    free = ownership.where("group_id > 0").join(instances.where("instance_id > 0").select("point_id"), "point_id", "left_anti")
    per = free.groupBy("group_id").agg(F.count("*").alias("n"))
    top = instances.agg(F.coalesce(F.max("instance_id"), F.lit(0)).alias("top"))
    good = numbered(per.where(F.col("n") >= points), ["group_id"]).crossJoin(F.broadcast(top)).select("group_id", "n", (F.col("top") + F.col("k")).alias("candidate_id"), F.lit("accepted").alias("reason"))
    return good.unionByName(per.where(F.col("n") < points).select("group_id", "n", F.lit(None).cast("long").alias("candidate_id"), F.lit("too_few_points").alias("reason")))


def candidate_anchors(points: DataFrame, candidates: DataFrame) -> DataFrame:
    """points with anchor: the instance, or for unassigned points the candidate."""
    return points.join(candidates.select("point_id", "candidate_id"), "point_id", "left").withColumn("anchor", F.coalesce(F.nullif(F.col("instance_id"), F.lit(0)), F.col("candidate_id"), F.lit(0))).drop("candidate_id")


def object_identity(points: DataFrame) -> DataFrame:
    """(instance_id, class_id): the one known class of an object's points, whatever its share; objects with several are left out."""
    known = points.where("instance_id > 0 and semantic_id > 0").groupBy("instance_id").agg(F.count_distinct("semantic_id").alias("k"), F.max("semantic_id").alias("class_id"))
    return known.where("k = 1").select("instance_id", "class_id")


def pure_mask_votes(member: DataFrame, anchors: DataFrame, purity: float = 0.8, frames: int = 2) -> DataFrame:
    """(point_id, owner, frames): owners by masks that one anchor fills almost alone, for points without any, and unopposed."""
    per = member.join(anchors.where("anchor > 0").select("point_id", "anchor"), "point_id", "left").groupBy("frame_id", "mask_id", "anchor").agg(F.count("*").alias("n"))
    mask = per.groupBy("frame_id", "mask_id").agg(F.sum(F.when(F.col("anchor").isNotNull(), F.col("n"))).alias("anchored"), F.max(F.when(F.col("anchor").isNotNull(), F.struct("n", (-F.col("anchor")).alias("a")))).alias("b"))
    pure = mask.where(F.col("b.n") >= purity * F.col("anchored")).select("frame_id", "mask_id", (-F.col("b.a")).alias("owner"))
    votes = member.join(anchors.where("anchor > 0").select("point_id"), "point_id", "left_anti").join(pure, ["frame_id", "mask_id"]).groupBy("point_id", "owner").agg(F.count_distinct("frame_id").alias("frames"))
    return votes.groupBy("point_id").agg(F.count("*").alias("k"), F.max("owner").alias("owner"), F.max("frames").alias("frames")).where((F.col("k") == 1) & (F.col("frames") >= frames)).select("point_id", "owner", "frames")


def admissible_views(views: DataFrame, points: int = 30, share: float = 0.15, unknown: int = 30, side: int = 10, area: float = 0.8) -> DataFrame:
    """Views that show enough of an object: points, share, unknown points, box sides and box area against the image's."""
    box = F.col("box_width") * F.col("box_height")
    return views.where((F.col("visible") >= points) & (F.col("visible") >= share * F.col("size")) & (F.col("visible_unknown") >= unknown) & (F.col("box_width") >= side) & (F.col("box_height") >= side) & (box <= area * F.col("width") * F.col("height")))


def grounding_plan(names: DataFrame, views: DataFrame) -> DataFrame:
    """(scene_id, frame_id, name, objects): the distinct questions to ask: known names that differ from the class."""
    asked = names.where(~F.col("name").isin(*UNNAMED) & ~F.col("is_part") & (F.col("name") != F.col("label")) & F.col("compatible"))
    return asked.join(views, ["scene_id", "instance_id"]).groupBy("scene_id", "frame_id", "name").agg(F.array_sort(F.collect_set("instance_id")).alias("objects"))


def deduplicated_requests(crops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, crops with request): crops of equal content are asked once."""
    hashed = crops.withColumn("request", F.sha2("content", 256))
    return hashed.select("request", "content").dropDuplicates(["request"]), hashed


def track_scores(track_points: DataFrame, policy: str = "legacy") -> DataFrame:
    """(track_id, score): the mean over points of the highest confidence, of all observations or of the track's own.

    track_points: track_id, point_id, confidence (in the track's masks), global_high.
    """
    high = F.max("confidence") if policy == "track" else F.max("global_high")
    return track_points.groupBy("track_id", "point_id").agg(high.alias("h")).groupBy("track_id").agg(F.avg("h").alias("score"))


def object_consensus(groups: DataFrame, tracks: DataFrame, score: float = 0.8, frames: int = 2, points: int = 50) -> DataFrame:
    """(point_id, group_id): points of merged tracks whose score, frames and size suffice, without points of two groups.

    groups: track, group_id; tracks: track, score, n, frame_ids, point_ids.
    """
    own = tracks.join(groups, "track")
    mean = own.groupBy("group_id").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("score"), F.size(F.array_distinct(F.flatten(F.collect_list("frame_ids")))).alias("frames"))
    pts = own.select("group_id", F.explode("point_ids").alias("point_id")).distinct()
    size = pts.groupBy("group_id").agg(F.count("*").alias("n"))
    good = mean.join(size, "group_id").where((F.col("score") >= score) & (F.col("frames") >= frames) & (F.col("n") >= points))
    claims = pts.join(good, "group_id", "left_semi").groupBy("point_id").agg(F.count("*").alias("k"), F.max("group_id").alias("group_id"))
    return claims.where("k = 1").select("point_id", "group_id")
