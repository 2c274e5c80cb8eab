"""The object graph: measured objects and their geometric relations, as two tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import along, up_basis
from ..functions.scalar import label_key
from ..plans.bounds import at_most
from . import spatial

LOW, HIGH = ("x_low", "y_low", "z_low"), ("x_high", "y_high", "z_high")


@dataclass(frozen=True)
class Thresholds:
    near_m: float = 0.5
    support_gap_m: float = 0.05
    footprint: float = 0.25
    min_points: int = 1
    max_candidates: int = 1_000_000

    def __post_init__(self):
        if not (self.near_m > 0 and self.support_gap_m > 0 and 0 < self.footprint <= 1 and self.min_points >= 1 and self.max_candidates >= 1):
            raise ValueError("invalid thresholds")


def objects(points: DataFrame, classes: DataFrame | None = None, names: DataFrame | None = None, min_points: int = 1, up: Sequence[float] | None = None) -> DataFrame:
    """One row per positive instance with enough points: class by majority (a tie is unknown), box, centroid, shares.

    A name counts only with two distinct support frames and unless it is empty, unknown or none.
    """
    own = points.where("instance_id > 0")
    axes = up_basis(up) if up is not None else []
    turned = {f"{n}": along(a) for n, a in zip("pqr", axes, strict=False)}
    own = own.withColumns(turned) if turned else own
    cols = [*"xyz", *turned]
    extra = [F.sum("semantic_confidence").alias("s_conf")] if "semantic_confidence" in own.columns else []
    # one shuffle by (instance, class), then one by instance over a row for each class
    per = own.groupBy("instance_id", "semantic_id").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in cols for k, f in (("lo", F.min), ("hi", F.max), ("sum", F.sum))], *extra)
    node = per.groupBy("instance_id").agg(
        F.sum("n").alias("point_count"),
        F.max("n").alias("top"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("semantic_id", "n")))).alias("semantic_class_counts"),
        *[f(F.col(f"{k}_{c}")).alias(f"{k}_{c}") for c in cols for k, f in (("lo", F.min), ("hi", F.max), ("sum", F.sum))],
        *([F.sum("s_conf").alias("s_conf")] if extra else []),
    ).where(F.col("point_count") >= min_points)
    winners = F.filter(F.map_keys("semantic_class_counts"), lambda k: F.col("semantic_class_counts")[k] == F.col("top"))
    node = node.withColumn("semantic_class_tie", F.size(winners) > 1).withColumn("semantic_id", F.when(F.size(winners) == 1, winners[0]).otherwise(0))
    out = node.select(
        "instance_id", "semantic_id", "semantic_class_tie", "semantic_class_counts", "point_count", (F.col("top") / F.col("point_count")).alias("class_share"),
        *[F.col(f"lo_{c}").alias(f"{c}_low") for c in cols], *[F.col(f"hi_{c}").alias(f"{c}_high") for c in cols], *[(F.col(f"sum_{c}") / F.col("point_count")).alias(c) for c in cols],
        *([(F.col("s_conf") / F.col("point_count")).alias("mean_observation_score")] if extra else []),
    )
    if classes is not None:
        out = out.join(classes.select(F.col("class_id").alias("semantic_id"), F.col("name").alias("label")), "semantic_id", "left")
    if names is not None:
        frames = F.array_sort(F.array_distinct("support_frames"))
        said = F.lower(F.trim("vlm_name"))
        usable = (F.size(frames) >= 2) & ~said.isin("", "unknown", "none")
        named = names.select("instance_id", F.when(usable, said).alias("name"), frames.alias("evidence_frames"))
        out = out.join(named, "instance_id", "left")
        if classes is not None:
            known = classes.agg(F.collect_set(label_key(F.col("name"))).alias("known"))
            conflict = F.col("name").isNotNull() & (F.col("semantic_id") > 0) & F.array_contains("known", label_key(F.col("name"))) & (label_key(F.col("name")) != label_key(F.col("label")))
            out = out.crossJoin(F.broadcast(known)).withColumn("name_category_conflict", F.coalesce(conflict, F.lit(False))).drop("known")  # one row
    return out


def omitted(points: DataFrame, min_points: int) -> DataFrame:
    return points.where("instance_id > 0").groupBy("instance_id").count().where(F.col("count") < min_points).select("instance_id")


def unknown_counts(points: DataFrame) -> DataFrame:
    return points.agg(F.count_if(F.col("instance_id") == 0).alias("unassigned_instance_points"), F.count_if(F.col("semantic_id") == 0).alias("semantic_unknown_points"))


def _sides(pairs: DataFrame, nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    for s in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("instance_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns]), s)
    return pairs


def near_edges(nodes: DataFrame, t: Thresholds = Thresholds(), pairs: DataFrame | None = None) -> DataFrame:
    """(source, target, relation, symmetric, aabb_gap_m), one edge for an unordered pair up to near_m apart."""
    pairs = pairs if pairs is not None else spatial.range_pairs(nodes, "instance_id", LOW, HIGH, t.near_m, limit=t.max_candidates)
    met = _sides(pairs, nodes, [*LOW, *HIGH]).withColumn("aabb_gap_m", spatial.gap("a_", "b_", LOW, HIGH)).where(F.col("aabb_gap_m") <= t.near_m)
    return met.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("near").alias("relation"), F.lit(True).alias("symmetric"), "aabb_gap_m")


def contains_edges(nodes: DataFrame, t: Thresholds = Thresholds(), pairs: DataFrame | None = None) -> DataFrame:
    """(source, target, ...): the source's box holds the target's and is larger on some side."""
    pairs = pairs if pairs is not None else spatial.range_pairs(nodes, "instance_id", LOW, HIGH, t.near_m, limit=t.max_candidates)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = _sides(both, nodes, [*LOW, *HIGH])
    holds, larger = F.lit(True), F.lit(False)
    for lo, hi in zip(LOW, HIGH, strict=True):
        holds = holds & (F.col(f"a_{lo}") <= F.col(f"b_{lo}")) & (F.col(f"a_{hi}") >= F.col(f"b_{hi}"))
        larger = larger | (F.col(f"a_{lo}") < F.col(f"b_{lo}")) | (F.col(f"a_{hi}") > F.col(f"b_{hi}"))
    return met.where(holds & larger).select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("contains").alias("relation"), F.lit(False).alias("symmetric"))


def vertical_edges(nodes: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(source, target, relation, symmetric, vertical_gap_m, footprint_overlap): above, and supported_by where the gap is small.

    nodes must have been made with an up vector.
    """
    if "r_low" not in nodes.columns:
        raise ValueError("world_up_required")
    pairs = spatial.range_pairs(nodes, "instance_id", ("p_low", "q_low"), ("p_high", "q_high"), 0.0, limit=t.max_candidates)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = _sides(both, nodes, [f"{c}_{k}" for c in "pqr" for k in ("low", "high")] + ["r"])
    area = lambda s: (F.col(f"{s}_p_high") - F.col(f"{s}_p_low")) * (F.col(f"{s}_q_high") - F.col(f"{s}_q_low"))
    side = lambda c: F.greatest(F.lit(0.0), F.least(f"a_{c}_high", f"b_{c}_high") - F.greatest(f"a_{c}_low", f"b_{c}_low"))
    least = F.least(area("a"), area("b"))
    share = F.when(least > 0, side("p") * side("q") / F.when(least > 0, least)).otherwise(0.0)
    met = met.withColumn("footprint_overlap", share).withColumn("vertical_gap_m", F.col("a_r_low") - F.col("b_r_high"))
    met = met.where((F.col("footprint_overlap") >= t.footprint) & (F.col("vertical_gap_m") >= -t.support_gap_m) & (F.col("a_r") > F.col("b_r")))
    kinds = F.when(F.abs("vertical_gap_m") <= t.support_gap_m, F.array(F.lit("above"), F.lit("supported_by"))).otherwise(F.array(F.lit("above")))
    return met.select(F.col("a").alias("source"), F.col("b").alias("target"), F.explode(kinds).alias("relation"), F.lit(False).alias("symmetric"), "vertical_gap_m", "footprint_overlap")


@dataclass
class SceneGraph:
    """nodes and edges; up is None where vertical relations are unknown."""

    nodes: DataFrame
    edges: DataFrame
    up: Sequence[float] | None = None
    revision: str = ""


def build_graph(points: DataFrame, classes: DataFrame, names: DataFrame | None = None, up: Sequence[float] | None = None, t: Thresholds = Thresholds()) -> SceneGraph:
    nodes = objects(points, classes, names, t.min_points, up)
    if "name" not in nodes.columns:
        nodes = nodes.withColumn("name", F.lit(None).cast("string"))
    pairs = spatial.range_pairs(nodes, "instance_id", LOW, HIGH, t.near_m, limit=t.max_candidates)
    edges = near_edges(nodes, t, pairs).unionByName(contains_edges(nodes, t, pairs), allowMissingColumns=True)
    if up is not None:
        edges = edges.unionByName(vertical_edges(nodes, t), allowMissingColumns=True)
    return SceneGraph(nodes, edges, up)


def validate_graph(graph: SceneGraph, most_vertical: int = 1_000_000) -> None:
    """Unique positive ids, edges between two nodes, known relations, and no cycle of vertical relations."""
    from ..schemas import DataError, refuse, refuse_duplicates

    refuse(graph.nodes, F.col("instance_id").isNull() | (F.col("instance_id") <= 0), "graph requires unique positive instance ids")
    refuse_duplicates(graph.nodes, "instance_id")
    edges = graph.edges
    relations = ("near", "contains", "above", "supported_by")
    refuse(edges, ~F.col("relation").isin(*relations) | (F.col("source") == F.col("target")) | (F.col("symmetric") != (F.col("relation") == "near")), "invalid graph relation")
    ends = edges.select(F.explode(F.array("source", "target")).alias("instance_id")).distinct()
    if not ends.join(graph.nodes, "instance_id", "left_anti").isEmpty():
        raise DataError("graph edge requires existing instances")
    vertical = edges.where(F.col("relation").isin("above", "supported_by")).select("source", "target").distinct()
    if graph.up is None:
        refuse(vertical, F.lit(True), "vertical graph relations require world_up")
    # peel nodes without predecessors; the edges of one scene are few, and their number is checked
    left = {(r[0], r[1]) for r in at_most(vertical, most_vertical, "vertical edges").collect()}
    while left:
        low = {b for _, b in left}
        free = {a for a, _ in left} - low
        if not free:
            raise DataError("vertical graph relations contain a cycle")
        left = {(a, b) for a, b in left if a not in free}
