"""Mask statistics: overlaps, visibility, splits, dominant masks and consensus edges.

A mask is (frame_id, mask_id); its points are the safe observations of it. Visibility counts all observations of a
frame, unknown ones too, so that unknown mass stays in every denominator.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import numbered
from .votes import clear_winner, micros, safe


@dataclass(frozen=True)
class Consensus:
    """The defaults of the consensus clustering."""

    mask_points: int = 50
    output_points: int = 50
    group_frames: int = 2
    visibility: float = 0.3
    containment: float = 0.8
    split_piece: float = 0.2
    split_share: float = 0.2
    split_frames: int = 2
    support: int = 3
    consensus: float = 0.9
    cannot_link: int = 2
    point_views: int = 2
    share: float = 0.65
    margin: float = 0.15
    object_score: float = 0.8
    mode: str = "mean_observations"

    def __post_init__(self):
        if not (0.5 < self.containment <= 1 and self.support >= 3 and self.mode in ("mean_observations", "max_point")):
            raise ValueError("containment must exceed .5, support is 3 at least")


def membership(observations: DataFrame, least: int = 50) -> DataFrame:
    """(frame_id, mask_id, point_id, class_id, confidence) of masks with enough safe points."""
    own = safe(observations).where("mask_id > 0").select("frame_id", "mask_id", "point_id", "class_id", "confidence")
    big = own.groupBy("frame_id", "mask_id").count().where(F.col("count") >= least).select("frame_id", "mask_id")
    return own.join(big, ["frame_id", "mask_id"])


def mask_scores(member: DataFrame) -> DataFrame:
    """(frame_id, mask_id, size, score): a mask's points and their mean confidence, from whole millionths, so that equal means are equal in any order of rows."""
    return member.groupBy("frame_id", "mask_id").agg(F.count("*").alias("size"), (F.sum(micros(F.col("confidence"))) / F.count("*") / 1_000_000).alias("score"))


def classless(observations: DataFrame) -> DataFrame:
    """Observations whose class says only whether there is a mask, for objects without a name; that class is never exported."""
    return observations.withColumn("class_id", (F.col("mask_id") > 0).cast("int"))


#: A mask's points come in few rows that hold many frames, so they are dealt to as many times the usual number of partitions.
FINER = 4


def sights(member: DataFrame, observations: DataFrame | None = None) -> DataFrame:
    """(frame_a, mask_a, frames, masks, seen): for each point of a mask the masks that hold it, and the frames that see it.

    Pairs arise within a point's observations, as many as its frames squared. Points come to their masks with arrays, so
    pairs are expanded and counted where a mask's points are and none is shuffled. Without observations nothing is seen.
    """
    points = member.where("point_id is not null").groupBy("point_id").agg(F.collect_list(F.struct(F.col("frame_id").alias("f"), F.col("mask_id").alias("m"))).alias("own"))
    seen = F.lit(None).cast("array<long>").alias("seen")
    if observations is not None:
        points = points.join(observations.groupBy("point_id").agg(F.collect_list("frame_id").alias("seen")), "point_id")
        seen = F.col("seen")
    each = points.select(F.inline("own"), F.col("own.f").alias("frames"), F.col("own.m").alias("masks"), seen).toDF("frame_a", "mask_a", "frames", "masks", "seen")
    return each.repartition(FINER * int(member.sparkSession.conf.get("spark.sql.shuffle.partitions")), "frame_a", "mask_a")


def mask_overlaps(member: DataFrame) -> DataFrame:
    """(frame_a, mask_a, frame_b, mask_b, shared): counts of common points, a mask with itself too."""
    met = sights(member).select("frame_a", "mask_a", F.posexplode("frames").alias("_at", "frame_b"), "masks").select("frame_a", "mask_a", "frame_b", F.col("masks")[F.col("_at")].alias("mask_b"))
    return met.groupBy("frame_a", "mask_a", "frame_b", "mask_b").agg(F.count("*").alias("shared"))


def visible_in(points: DataFrame) -> DataFrame:
    return points.select("frame_a", "mask_a", F.explode("seen").alias("frame_b")).groupBy("frame_a", "mask_a", "frame_b").agg(F.count("*").alias("visible"))


def mask_visibility(member: DataFrame, observations: DataFrame) -> DataFrame:
    """(frame_a, mask_a, frame_b, visible): how many of a mask's points each frame sees."""
    return visible_in(sights(member, observations))


def eligible_of(points: DataFrame, config: Consensus) -> DataFrame:
    size = points.groupBy("frame_a", "mask_a").agg(F.count("*").alias("size"))
    return visible_in(points).join(size.hint("shuffle_hash"), ["frame_a", "mask_a"]).where((F.col("visible") > 0) & (F.col("visible") >= config.visibility * F.col("size")))


def eligible_frames(member: DataFrame, observations: DataFrame, config: Consensus = Consensus()) -> DataFrame:
    """mask_visibility where enough of the mask is seen, with the mask's size."""
    return eligible_of(sights(member, observations), config)


def eligible_overlaps(member: DataFrame, observations: DataFrame, config: Consensus = Consensus()) -> DataFrame:
    """(frame_a, mask_a, frame_b, mask_b, shared, visible, size): mask_overlaps in eligible frames; others are not expanded."""
    points = sights(member, observations)
    eligible = eligible_of(points, config).groupBy("frame_a", "mask_a").agg(F.map_from_entries(F.collect_list(F.struct("frame_b", "visible"))).alias("eligible"), F.first("size").alias("size"))
    pairs = F.filter(F.arrays_zip("frames", "masks"), lambda x: F.map_contains_key("eligible", x["frames"]))
    met = points.join(eligible.hint("shuffle_hash"), ["frame_a", "mask_a"]).select("frame_a", "mask_a", "size", "eligible", F.explode(pairs).alias("x"))
    met = met.select("frame_a", "mask_a", F.col("x.frames").alias("frame_b"), F.col("x.masks").alias("mask_b"), F.try_element_at("eligible", F.col("x.frames")).alias("visible"), "size")
    return met.groupBy("frame_a", "mask_a", "frame_b", "mask_b").agg(F.count("*").alias("shared"), F.first("visible").alias("visible"), F.first("size").alias("size"))


def split_of(member: DataFrame, met: DataFrame, config: Consensus) -> DataFrame:
    per = met.where("frame_a != frame_b").groupBy("frame_a", "mask_a", "frame_b").agg(
        F.sum("shared").alias("labelled"), F.max("shared").alias("most"), F.first("visible").alias("visible"), F.count_if(F.col("shared") >= config.split_piece * F.col("visible")).alias("pieces"))
    per = per.where(F.col("labelled") >= config.containment * F.col("visible"))
    split = (F.col("pieces") >= 2) & (F.col("most") < config.containment * F.col("visible"))
    counts = per.groupBy(F.col("frame_a").alias("frame_id"), F.col("mask_a").alias("mask_id")).agg(F.count("*").alias("evaluable_frames"), F.count_if(split).alias("split_frames"))
    out = member.groupBy("frame_id", "mask_id").agg(F.count("*").alias("size")).join(counts, ["frame_id", "mask_id"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("split_frames", "evaluable_frames")})
    return out.withColumn("filtered", (F.col("split_frames") >= config.split_frames) & (F.col("split_frames") > config.split_share * F.col("evaluable_frames")))


def split_statistics(member: DataFrame, observations: DataFrame, config: Consensus = Consensus()) -> DataFrame:
    """(frame_id, mask_id, size, split_frames, evaluable_frames, filtered): masks that other views split apart."""
    return split_of(member, eligible_overlaps(member, observations, config), config)


def dominant_masks(member: DataFrame, observations: DataFrame, config: Consensus = Consensus()) -> DataFrame:
    """(frame_a, mask_a, frame_b, mask_b): the one mask of each frame that holds most of what it sees of a mask."""
    met = eligible_overlaps(member, observations, config)
    filtered = split_of(member, met, config).where("filtered").select("frame_id", "mask_id")
    own = met.where(F.col("shared") >= config.containment * F.col("visible"))  # of masks, and so without the filtered ones only now
    for s in ("a", "b"):
        own = own.join(filtered.select(F.col("frame_id").alias(f"frame_{s}"), F.col("mask_id").alias(f"mask_{s}")), [f"frame_{s}", f"mask_{s}"], "left_anti")
    return own.select("frame_a", "mask_a", "frame_b", "mask_b", "shared", "visible")


def consensus_edges(dominant: DataFrame, config: Consensus = Consensus()) -> DataFrame:
    """(frame_a, mask_a, frame_b, mask_b, positive, negative): frames in which two masks have the same or different dominant masks."""
    one = dominant.select(F.col("frame_b").alias("frame"), F.struct("frame_a", "mask_a").alias("x"), F.col("mask_b").alias("mx"))
    other = dominant.select(F.col("frame_b").alias("frame"), F.struct("frame_a", "mask_a").alias("y"), F.col("mask_b").alias("my"))
    pairs = one.join(other, "frame").where("x < y").groupBy("x", "y").agg(F.count_if(F.col("mx") == F.col("my")).alias("positive"), F.count_if(F.col("mx") != F.col("my")).alias("negative"))
    return pairs.select(F.col("x.frame_a").alias("frame_a"), F.col("x.mask_a").alias("mask_a"), F.col("y.frame_a").alias("frame_b"), F.col("y.mask_a").alias("mask_b"), "positive", "negative")


def accepted_edges(edges: DataFrame, config: Consensus = Consensus()) -> DataFrame:
    return edges.where((F.col("positive") >= config.support) & (F.col("negative") < config.cannot_link) & (F.col("positive") >= config.consensus * (F.col("positive") + F.col("negative"))))


def group_scores(member: DataFrame, groups: DataFrame, config: Consensus = Consensus()) -> DataFrame:
    """(group_id, frames, score): groups (frame_id, mask_id, group_id) with enough frames and a high enough score."""
    own = member.join(groups, ["frame_id", "mask_id"])
    if config.mode == "max_point":
        score = own.groupBy("group_id", "point_id").agg(F.max("confidence").alias("c")).groupBy("group_id").agg(F.avg("c").alias("score"))
    else:
        score = own.groupBy("group_id").agg((F.sum("confidence") / F.count("*")).alias("score"))
    frames = groups.groupBy("group_id").agg(F.count_distinct("frame_id").alias("frames"))
    return frames.join(score, "group_id").where((F.col("frames") >= config.group_frames) & (F.col("score") >= config.object_score))


def point_ownership(member: DataFrame, groups: DataFrame, config: Consensus = Consensus()) -> DataFrame:
    """(point_id, group_id, best, second, total, views): the group that owns each point, 0 where none is clear."""
    own = member.join(groups, ["frame_id", "mask_id"]).groupBy("point_id", "group_id").agg(F.sum(micros(F.col("confidence"))).alias("score"), F.count("*").alias("views"))
    per = own.groupBy("point_id").agg(F.max(F.struct("score", (-F.col("group_id")).alias("g"), "views")).alias("b"), F.sum("score").alias("total"), F.array_sort(F.collect_list("score")).alias("all"))
    second = F.coalesce(F.try_element_at("all", F.lit(-2)), F.lit(0))
    clear = (F.col("b.views") >= config.point_views) & clear_winner(F.col("b.score"), second, F.col("total"), config.share, config.margin)
    unit = lambda c: c / 1_000_000
    return per.select("point_id", F.when(clear, -F.col("b.g")).otherwise(0).cast("long").alias("group_id"), unit(F.col("b.score")).alias("best"), unit(second).alias("second"), unit(F.col("total")).alias("total"), F.col("b.views").alias("views"))


def owned_objects(ownership: DataFrame, semantic: DataFrame, config: Consensus = Consensus()) -> DataFrame:
    """(group_id, semantic_id, point_count, instance_id): objects by group and known class, numbered in that order."""
    own = ownership.where("group_id > 0").join(semantic, "point_id").where("semantic_id > 0").groupBy("group_id", "semantic_id").agg(F.count("*").alias("point_count"))
    own = own.where(F.col("point_count") >= config.output_points)
    return numbered(own, ["group_id", "semantic_id"], "instance_id")


def instance_masks(observations: DataFrame, instances: DataFrame, least: int = 30, containment: float = 0.8) -> DataFrame:
    """(instance_id, frame_id, mask_id, visible, shared): each instance's dominant mask by frame, the lowest one on ties."""
    own = observations.join(instances.where("instance_id > 0").select("point_id", "instance_id"), "point_id")
    # one shuffle by instance, frame and mask; the second aggregation is over its counts
    per = own.groupBy("instance_id", "frame_id", "mask_id").agg(F.count("*").alias("n"))
    top = per.groupBy("instance_id", "frame_id").agg(F.sum("n").alias("visible"), F.max(F.when(F.col("mask_id") > 0, F.struct("n", (-F.col("mask_id")).alias("m")))).alias("b"))
    return top.where((F.col("visible") >= least) & (F.col("b.n") >= containment * F.col("visible"))).select("instance_id", "frame_id", (-F.col("b.m")).alias("mask_id"), "visible", F.col("b.n").alias("shared"))


def uniform_category(points: DataFrame) -> DataFrame:
    """(instance_id, category): an instance's class if all its points have one, else 0."""
    return points.where("instance_id > 0").groupBy("instance_id").agg(F.when(F.min("semantic_id") == F.max("semantic_id"), F.min("semantic_id")).otherwise(0).alias("category"))


def fragment_edges(observations: DataFrame, points: DataFrame, support: int = 3, consensus: float = 0.9, cannot_link: int = 2) -> DataFrame:
    """(category, a, b, positive, negative, accepted): instances of one known class by agreement of dominant masks."""
    category = uniform_category(points).where("category > 0")
    own = instance_masks(observations, points).join(category, "instance_id")
    one = own.select("frame_id", "category", F.col("instance_id").alias("a"), F.col("mask_id").alias("ma"))
    other = own.select("frame_id", "category", F.col("instance_id").alias("b"), F.col("mask_id").alias("mb"))
    pairs = one.join(other, ["frame_id", "category"]).where("a < b").groupBy("category", "a", "b").agg(F.count_if(F.col("ma") == F.col("mb")).alias("positive"), F.count_if(F.col("ma") != F.col("mb")).alias("negative"))
    return pairs.withColumn("accepted", (F.col("positive") >= support) & (F.col("negative") < cannot_link) & (F.col("positive") >= consensus * (F.col("positive") + F.col("negative"))))


def mask_purity(member: DataFrame, guides: DataFrame) -> DataFrame:
    """(frame_id, mask_id, guide, shared, total, purity): the guide (instance of a point) that most of a mask's points have."""
    per = member.join(guides.where("instance_id > 0").select("point_id", F.col("instance_id").alias("guide")), "point_id", "left").groupBy("frame_id", "mask_id", "guide").agg(F.count("*").alias("n"))
    top = per.groupBy("frame_id", "mask_id").agg(F.max(F.when(F.col("guide").isNotNull(), F.struct("n", (-F.col("guide")).alias("g")))).alias("b"), F.sum("n").alias("total"))
    return top.where("b is not null").select("frame_id", "mask_id", (-F.col("b.g")).alias("guide"), F.col("b.n").alias("shared"), "total", (F.col("b.n") / F.col("total")).alias("purity"))


@dataclass(frozen=True)
class Recovery:
    """The thresholds of guided recovery."""

    mask_points: int = 30
    visible: float = 0.3
    containment: float = 0.8
    purity: float = 0.8
    split_piece: float = 0.2
    split_frames: int = 2
    support: int = 2
    point_views: int = 2
    confidence: float = 0.8
    output_points: int = 50
    anchor: float = 0.2
    dominance: float = 0.8


def guide_evidence(observations: DataFrame, guides: DataFrame, config: Recovery = Recovery()) -> DataFrame:
    """(guide, frame_id, visible, mask_id, shared, purity, state): per guide and frame whether a mask holds, splits or blocks it."""
    own = guides.where("instance_id > 0").select("point_id", F.col("instance_id").alias("guide"))
    size = own.groupBy("guide").agg(F.count("*").alias("size"))
    seen = observations.join(own, "point_id").groupBy("guide", "frame_id", "mask_id").agg(F.count("*").alias("n"))
    per = seen.groupBy("guide", "frame_id").agg(F.sum("n").alias("visible"), F.sum(F.when(F.col("mask_id") > 0, F.col("n")).otherwise(0)).alias("labelled"), F.max(F.when(F.col("mask_id") > 0, F.struct("n", (-F.col("mask_id")).alias("m")))).alias("b"), F.collect_list(F.when(F.col("mask_id") > 0, F.col("n"))).alias("parts"))
    per = per.join(size, "guide").where((F.col("visible") >= config.visible * F.col("size")) & F.col("b").isNotNull())
    pieces = F.size(F.filter("parts", lambda n: n >= config.split_piece * F.col("visible")))
    per = per.select("guide", "frame_id", "visible", "labelled", (-F.col("b.m")).alias("mask_id"), F.col("b.n").alias("shared"), pieces.alias("pieces"))
    pure = mask_purity(membership(observations, config.mask_points), guides).select("frame_id", "mask_id", F.col("guide").alias("mask_guide"), "purity")
    out = per.join(pure, ["frame_id", "mask_id"], "left")
    held = F.col("shared") >= config.containment * F.col("visible")
    split = (F.col("labelled") >= config.containment * F.col("visible")) & (F.col("pieces") >= 2) & ~held
    good = held & (F.col("mask_guide") == F.col("guide")) & (F.col("purity") >= config.purity)
    return out.withColumn("state", F.when(good, "support").when(split, "split").when(held, "blocked").otherwise("none"))


def recovered_points(observations: DataFrame, guides: DataFrame, config: Recovery = Recovery()) -> DataFrame:
    """(point_id, guide, views, instance_id): unowned points that supporting masks of one guide add, with new instance ids.

    A guide that is split in enough frames is vetoed; ids follow the largest existing one in the order of guides, and
    rejected guides use none.
    """
    evidence = guide_evidence(observations, guides, config)
    veto = evidence.where("state = 'split'").groupBy("guide").agg(F.count("*").alias("n")).where(F.col("n") >= config.split_frames)
    support = evidence.where("state = 'support'").join(veto, "guide", "left_anti")
    firm = support.groupBy("guide").agg(F.count_distinct("frame_id").alias("frames")).where(F.col("frames") >= config.support)
    new = safe(observations).where(F.col("confidence") >= config.confidence).join(support.join(firm, "guide").select("guide", "frame_id", "mask_id"), ["frame_id", "mask_id"])
    new = new.join(guides.where("instance_id > 0").select("point_id"), "point_id", "left_anti")
    claims = new.groupBy("point_id", "guide").agg(F.count_distinct("frame_id").alias("views")).where(F.col("views") >= config.point_views)
    single = claims.groupBy("point_id").agg(F.count("*").alias("n"), F.max("guide").alias("guide"), F.max("views").alias("views")).where("n = 1").drop("n")
    enough = single.groupBy("guide").agg(F.count("*").alias("n")).where(F.col("n") >= config.output_points)
    top = guides.agg(F.coalesce(F.max("instance_id"), F.lit(0)).alias("top"))
    numbered = numbered(enough.select("guide"), ["guide"]).crossJoin(F.broadcast(top)).select("guide", (F.col("top") + F.col("k")).alias("instance_id"))
    return single.join(numbered, "guide").select("point_id", "guide", "views", "instance_id")
