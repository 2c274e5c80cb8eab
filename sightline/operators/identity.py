"""Identity by co-visibility: pair scores, merges with vetoes, births and completions of objects.

nodes: node_id, frame_id, point_id (a mask's points); visible: frame_id, point_id; base: point_id, semantic_id, instance_id.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterative import Sets, renewed
from .ordering import numbered


@dataclass(frozen=True)
class Identity:
    """The thresholds of co-visibility fusion."""

    mask_points: int = 30
    shared_points: int = 30
    full_iou: float = 0.25
    covisible_iou: float = 0.55
    cannot_iou: float = 0.1
    visible_points: int = 30
    frames: int = 2
    output_points: int = 50
    share: float = 0.65
    margin: float = 0.15
    stuff: float = 0.5
    existing: float = 0.2
    owner_share: float = 0.8
    owner_frames: int = 2
    owner_frame_points: int = 30


#: Classes of walls and floors, and those that no completion takes.
STUFF, UNCOMPLETED = (10, 19), (0, 10, 19)


def pair_scores(nodes: DataFrame, visible: DataFrame, config: Identity = Identity()) -> DataFrame:
    """(a, b, shared, left_visible, right_visible, full_iou, covisible_iou, evaluable, cannot_link) with a < b.

    Pairs that share a point, or see enough of each other for a verdict; all others would score 0 and decide nothing.
    """
    size = nodes.groupBy("node_id", "frame_id").agg(F.count("*").alias("n")).where(F.col("n") >= config.mask_points)
    own = nodes.join(size.select("node_id"), "node_id", "left_semi")
    seen = own.select("node_id", "point_id").join(visible.withColumnRenamed("frame_id", "seen_from"), "point_id").groupBy("node_id", "seen_from").agg(F.count("*").alias("seen"))
    a, b = own.select(F.col("node_id").alias("a"), "point_id"), own.select(F.col("node_id").alias("b"), "point_id")
    shared = a.join(b, "point_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    far = seen.where(F.col("seen") >= config.visible_points).join(size.select(F.col("node_id").alias("other"), F.col("frame_id").alias("seen_from")), "seen_from").where("node_id != other")
    mutual = far.select("node_id", "other").intersect(far.select(F.col("other").alias("node_id"), F.col("node_id").alias("other"))).where("node_id < other")
    pairs = shared.join(mutual.select(F.col("node_id").alias("a"), F.col("other").alias("b")), ["a", "b"], "full").select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"))
    for s in ("a", "b"):
        pairs = pairs.join(size.select(F.col("node_id").alias(s), F.col("frame_id").alias(f"frame_{s}"), F.col("n").alias(f"n_{s}")), s)
    for s, frame, name in (("a", "frame_b", "left_visible"), ("b", "frame_a", "right_visible")):
        pairs = pairs.join(seen.select(F.col("node_id").alias(s), F.col("seen_from").alias(frame), F.col("seen").alias(name)), [s, frame], "left").fillna(0, [name])
    one = F.lit(1)
    pairs = pairs.withColumn("full_iou", F.col("shared") / F.greatest(one, F.col("n_a") + F.col("n_b") - F.col("shared"))).withColumn("covisible_iou", F.col("shared") / F.greatest(one, F.col("left_visible") + F.col("right_visible") - F.col("shared")))
    evaluable = F.least("left_visible", "right_visible") >= config.visible_points
    return pairs.withColumn("evaluable", evaluable).withColumn("cannot_link", evaluable & (F.col("covisible_iou") <= config.cannot_iou)).select("a", "b", "shared", "left_visible", "right_visible", "full_iou", "covisible_iou", "evaluable", "cannot_link")


def merged_groups(nodes: DataFrame, pairs: DataFrame, metric: str = "covisible", config: Identity = Identity()) -> DataFrame:
    """(node_id, group_id): unions by falling score, shared points and ids; none brings a forbidden pair together."""
    score, cut = (F.col("full_iou"), config.full_iou) if metric == "full" else (F.col("covisible_iou"), config.covisible_iou)
    able = (score >= cut) & (F.col("shared") >= config.shared_points) & (F.lit(metric == "full") | F.col("evaluable"))
    links = pairs.where(able | F.col("cannot_link")).select(F.lit(0).alias("scene"), "a", "b", "shared", score.alias("score"), able.alias("able"), "cannot_link")

    def merge(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        sets, apart = Sets(sorted(own["node_id"].tolist())), defaultdict(set)
        for a, b in rows.loc[rows["cannot_link"], ["a", "b"]].itertuples(index=False):
            apart[a].add(b)
            apart[b].add(a)
        for a, b in rows[rows["able"]].sort_values(["score", "shared", "a", "b"], ascending=[False, False, True, True])[["a", "b"]].itertuples(index=False):
            ra, rb = sets.root(a), sets.root(b)
            if ra != rb and not any(apart[x] & sets.members[rb] for x in sets.members[ra]):
                sets.join(min(ra, rb), max(ra, rb))
        return pd.DataFrame({"node_id": list(sets.up), "group_id": [sets.root(x) for x in sets.up]})

    every = renewed(nodes.select(F.lit(0).alias("scene"), "node_id").distinct())
    return every.groupBy("scene").cogroup(renewed(links).groupBy("scene")).applyInPandas(merge, "node_id long, group_id long")


def proposals(nodes: DataFrame, groups: DataFrame, base: DataFrame, complete: bool = False, config: Identity = Identity()) -> tuple[DataFrame, DataFrame]:
    """(groups with measures and kind: birth, complete or a reason of rejection; votes of groups for free points)."""
    own = nodes.join(groups, "node_id").select("group_id", "frame_id", "point_id").distinct()
    support = own.groupBy("group_id", "point_id").agg(F.count("*").alias("votes")).where(F.col("votes") >= 2).join(base, "point_id")
    free = (F.col("instance_id") == 0) & (F.col("semantic_id") == 0)
    measure = support.groupBy("group_id").agg(F.count_if(free).alias("eligible"), F.avg(F.col("semantic_id").isin(*STUFF).cast("int")).alias("stuff"), F.avg((F.col("instance_id") > 0).cast("int")).alias("existing"))
    frames = own.groupBy("group_id").agg(F.count_distinct("frame_id").alias("frames"))
    owner = support.where("instance_id > 0").groupBy("group_id", "instance_id").agg(F.count("*").alias("n")).groupBy("group_id").agg(F.max(F.struct("n", (-F.col("instance_id")).alias("i"))).alias("b"), F.sum("n").alias("owned")).select("group_id", (-F.col("b.i")).alias("owner"), (F.col("b.n") / F.col("owned")).alias("owner_share"))
    owned = base.where("instance_id > 0").groupBy(F.col("instance_id").alias("owner")).agg(F.count("*").alias("owner_size"), F.max("semantic_id").alias("owner_class"))
    per_frame = own.join(base.where("instance_id > 0").select("point_id", F.col("instance_id").alias("owner")), "point_id").groupBy("group_id", "owner", "frame_id").agg(F.count("*").alias("n")).where(F.col("n") >= config.owner_frame_points).groupBy("group_id", "owner").agg(F.count("*").alias("owner_frames"))
    out = frames.join(measure, "group_id", "left").join(owner, "group_id", "left").join(owned, "owner", "left").join(per_frame, ["group_id", "owner"], "left").fillna(0, ["eligible", "stuff", "existing", "owner_frames"])
    fits = F.lit(complete) & (F.col("owner_share") >= config.owner_share) & (F.col("owner_frames") >= config.owner_frames) & (F.col("eligible") <= F.col("owner_size")) & ~F.col("owner_class").isin(*UNCOMPLETED)
    kind = F.when(F.col("frames") < config.frames, "one_frame_only").when(F.col("stuff") > config.stuff, "mostly_known_stuff").when(F.col("eligible") < config.output_points, "insufficient_unknown_points").when(F.col("existing") <= config.existing, "birth").when(F.coalesce(fits, F.lit(False)), "complete").otherwise("already_represented")
    return out.withColumn("kind", kind), support.where(free).select("group_id", "point_id", "votes")


def graph_fusion(nodes: DataFrame, visible: DataFrame, base: DataFrame, metric: str = "covisible", complete: bool = False, config: Identity = Identity()) -> tuple[DataFrame, DataFrame]:
    """((point_id, instance_id) of newly owned points, groups with kind and instance_id). Owned or known points never change.

    Births take ids after the largest one in order of their groups; rejected groups take none. An owner is completed by at most as many
    points as it had.
    """
    groups, votes = proposals(nodes, merged_groups(nodes, pair_scores(nodes, visible, config), metric, config), base, complete, config)
    able = votes.join(groups.where(F.col("kind").isin("birth", "complete")).select("group_id"), "group_id", "left_semi")
    per = able.groupBy("point_id").agg(F.max(F.struct("votes", (-F.col("group_id")).alias("g"))).alias("b"), F.sum("votes").alias("total"), F.array_sort(F.collect_list("votes")).alias("all"))
    second = F.coalesce(F.try_element_at("all", F.lit(-2)), F.lit(0))
    won = per.where((F.col("b.votes") >= config.share * F.col("total")) & (F.col("b.votes") - second >= config.margin * F.col("total"))).select("point_id", (-F.col("b.g")).alias("group_id"))
    size = won.groupBy("group_id").agg(F.count("*").alias("new_points"))
    found = groups.join(size, "group_id", "left").fillna(0, ["new_points"]).withColumn("kind", F.when(F.col("kind").isin("birth", "complete") & (F.col("new_points") < config.output_points), "ambiguous_ownership_or_small").otherwise(F.col("kind")))

    def capped(rows: pd.DataFrame) -> pd.DataFrame:
        used, keep = 0, []
        for n, most in rows.sort_values("group_id")[["new_points", "owner_size"]].itertuples(index=False):
            keep.append(used + n <= most)
            used += n if keep[-1] else 0
        return pd.DataFrame({"group_id": rows.sort_values("group_id")["group_id"], "fits": keep})

    cap = renewed(found.where("kind = 'complete'").select("owner", "group_id", "new_points", "owner_size")).groupBy("owner").applyInPandas(capped, "group_id long, fits boolean")
    found = found.join(cap, "group_id", "left").withColumn("kind", F.when(~F.coalesce("fits", F.lit(True)), "aggregate_owner_completion_cap").otherwise(F.col("kind"))).drop("fits")
    top = base.agg(F.coalesce(F.max("instance_id"), F.lit(0)).alias("top"))
    births = numbered(found.where("kind = 'birth'").select("group_id"), ["group_id"]).crossJoin(F.broadcast(top)).select("group_id", (F.col("top") + F.col("k")).alias("born"))
    found = found.join(births, "group_id", "left").withColumn("instance_id", F.when(F.col("kind") == "complete", F.col("owner")).otherwise(F.col("born"))).drop("born")
    return won.join(found.where("instance_id is not null").select("group_id", "instance_id"), "group_id").select("point_id", "instance_id"), found


def anchored_choices(candidates: DataFrame, visible: DataFrame, seeds: DataFrame, least_anchor: int = 30, least: int = 10, coverage: float = 0.5) -> DataFrame:
    """(region_id, view, mask_id, quality, coverage, points): masks of a region's three views that hold its anchor.

    candidates: region_id, view (0..2), frame_id, mask_id, score, chosen, point_id; the first view keeps its chosen mask. Later views are
    anchored by that mask's points that they see, or by the seed points if too few are seen.
    """
    first = candidates.where("view = 0 and chosen")
    views = candidates.select("region_id", "view", "frame_id").distinct()
    see = lambda points: views.join(points, "region_id").join(visible, ["frame_id", "point_id"]).select("region_id", "view", "point_id")
    anchor = see(first.select("region_id", "point_id").distinct()).where("view > 0")
    enough = anchor.groupBy("region_id", "view").agg(F.count("*").alias("n")).where(F.col("n") >= least_anchor).select("region_id", "view")
    effective = anchor.join(enough, ["region_id", "view"], "left_semi").union(see(seeds.select("region_id", "point_id")).join(enough, ["region_id", "view"], "left_anti"))
    size = effective.groupBy("region_id", "view").agg(F.count("*").alias("anchor_size"))
    met = candidates.join(effective, ["region_id", "view", "point_id"]).groupBy("region_id", "view", "mask_id").agg(F.count("*").alias("n"))
    points = candidates.groupBy("region_id", "view", "mask_id").agg(F.count("*").alias("points"), F.max("score").alias("quality"), F.bool_or("chosen").alias("chosen"))
    good = met.join(size, ["region_id", "view"]).withColumn("coverage", F.col("n") / F.col("anchor_size")).where((F.col("n") >= least) & (F.col("coverage") >= coverage))
    return good.join(points, ["region_id", "view", "mask_id"]).where((F.col("view") > 0) | F.col("chosen")).select("region_id", "view", "mask_id", "quality", "coverage", "points")
