"""Evaluation of labels against a reference: exact counts, and null where a ratio is undefined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spatial
from .iterative import assignment

DISTANCE, IOU, PART = 0.05, 0.5, 0.1


def paired(points: DataFrame, reference: DataFrame, radius: float = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(points with their nearest reference, reference with its nearest point): columns ref_semantic, ref_instance and
    semantic, instance, null and 0 where nothing is within the radius."""
    there = spatial.nearest_within(points, reference, radius).select(F.col("a").alias("point_id"), "b")
    ref = reference.select(F.col("point_id").alias("b"), F.col("semantic_id").alias("ref_semantic"), F.col("instance_id").alias("ref_instance"))
    forward = points.join(there, "point_id", "left").join(ref, "b", "left").drop("b").withColumn("near", F.col("ref_semantic").isNotNull())
    back = spatial.nearest_within(reference, points, radius).select(F.col("a").alias("point_id"), "b")
    own = points.select(F.col("point_id").alias("b"), F.col("semantic_id").alias("semantic"), F.col("instance_id").alias("instance"))
    backward = reference.join(back, "point_id", "left").join(own, "b", "left").drop("b").withColumn("covered", F.col("semantic").isNotNull()).fillna(0, ["semantic", "instance"])
    return forward, backward


def coverage(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """One row of counts and accuracies of points and reference vertices."""
    supported = F.col("near") & (F.col("ref_semantic") > 0)
    right = supported & (F.col("semantic_id") == F.col("ref_semantic"))
    a = forward.agg(
        F.count("*").alias("points"), F.count_if("near").alias("near_points"), F.count_if(supported).alias("supported_points"), F.count_if(supported & (F.col("semantic_id") > 0)).alias("labelled_supported_points"),
        F.try_divide(F.count_if(right), F.count_if(supported)).alias("accuracy_unknown_as_error"), F.try_divide(F.count_if(right), F.count_if(supported & (F.col("semantic_id") > 0))).alias("accuracy_labelled_only"),
    )
    known = F.col("semantic_id") > 0
    b = backward.agg(
        F.count("*").alias("vertices"), F.count_if("covered").alias("covered_vertices"), F.count_if(known).alias("shared_class_vertices"),
        F.try_divide(F.count_if(known & (F.col("semantic") == F.col("semantic_id"))), F.count_if(known)).alias("reference_accuracy"),
    )
    return a.crossJoin(b)  # one row each


def class_iou(backward: DataFrame) -> DataFrame:
    """(class_id, vertices, covered, correct, iou) of every class of the reference."""
    # a vertex counts for its own class and for the one predicted there
    seen = backward.select(F.explode(F.array_distinct(F.array("semantic_id", "semantic"))).alias("class_id"), "semantic_id", "semantic", "covered").where("class_id > 0")
    own = F.col("semantic_id") == F.col("class_id")
    both = own & (F.col("semantic") == F.col("class_id"))
    per = seen.groupBy("class_id").agg(F.count_if(own).alias("vertices"), F.count_if(own & F.col("covered")).alias("covered"), F.count_if(both).alias("correct"), F.count("*").alias("either"))
    return per.where("vertices > 0").select("class_id", "vertices", "covered", "correct", F.try_divide("correct", "either").alias("iou"))


def iou_matrix(backward: DataFrame) -> DataFrame:
    """(predicted, reference, overlap, iou, reference_size) of instances on reference vertices."""
    cells = backward.groupBy(F.col("instance").alias("predicted"), F.col("instance_id").alias("reference")).agg(F.count("*").alias("overlap"))
    p = cells.where("predicted > 0").groupBy("predicted").agg(F.sum("overlap").alias("p_size"))
    r = cells.where("reference > 0").groupBy("reference").agg(F.sum("overlap").alias("reference_size"))
    both = cells.where("predicted > 0 and reference > 0").join(p, "predicted").join(r, "reference")
    return both.select("predicted", "reference", "overlap", (F.col("overlap") / (F.col("p_size") + F.col("reference_size") - F.col("overlap"))).alias("iou"), "reference_size")


def instance_matches(matrix: DataFrame, classes: DataFrame | None = None, threshold: float = IOU) -> DataFrame:
    """(predicted, reference, iou): one-to-one, most matches first and then the highest total IoU.

    With classes (predicted, reference, same_class) only pairs of one class can match.
    """
    able = matrix.where(F.col("iou") >= threshold)
    if classes is not None:
        able = able.join(classes.where("same_class"), ["predicted", "reference"], "left_semi")
    pairs = able.select(F.lit(0).alias("scene_id"), F.col("predicted").alias("a"), F.col("reference").alias("b"), "iou")
    return assignment(pairs).select(F.col("a").alias("predicted"), F.col("b").alias("reference"), "iou")


def split_objects(matrix: DataFrame, part: float = PART) -> DataFrame:
    """(reference, pieces): reference objects of which several predictions hold a substantial part."""
    big = matrix.where(F.col("overlap") >= part * F.col("reference_size"))
    return big.groupBy("reference").agg(F.array_sort(F.collect_set("predicted")).alias("pieces")).where(F.size("pieces") > 1)


def merged_objects(matrix: DataFrame, part: float = PART) -> DataFrame:
    big = matrix.where(F.col("overlap") >= part * F.col("reference_size"))
    return big.groupBy("predicted").agg(F.array_sort(F.collect_set("reference")).alias("objects")).where(F.size("objects") > 1)


def weighted_purity(forward: DataFrame, least: int = 20) -> DataFrame:
    """One row: purity (dominant over assigned points), assigned, of instances with enough points near reference objects."""
    per = forward.where(F.col("near") & (F.col("ref_instance") > 0) & (F.col("instance_id") > 0)).groupBy("instance_id", "ref_instance").agg(F.count("*").alias("n"))
    inst = per.groupBy("instance_id").agg(F.sum("n").alias("total"), F.max("n").alias("top")).where(F.col("total") >= least)
    return inst.agg(F.try_divide(F.sum("top"), F.sum("total")).alias("purity"), F.coalesce(F.sum("total"), F.lit(0)).alias("assigned"))


def before_after(points: DataFrame) -> DataFrame:
    """One row of changes. points: old_semantic, old_instance, semantic_id, instance_id, near, ref_semantic, ref_instance, old_correct, new_correct."""
    count = lambda c, name: F.count_if(c).alias(name)
    added = (F.col("old_instance") == 0) & (F.col("instance_id") > 0)
    supported = F.col("near") & (F.col("ref_semantic") > 0)
    named = (F.col("old_semantic") == 0) & (F.col("semantic_id") > 0)
    right_before = supported & (F.col("old_semantic") > 0) & (F.col("old_semantic") == F.col("ref_semantic"))
    right_now = supported & (F.col("semantic_id") > 0) & (F.col("semantic_id") == F.col("ref_semantic"))
    return points.agg(
        count(added, "newly_owned"), count(added & F.col("new_correct"), "newly_owned_correct"), F.try_divide(F.count_if(added & F.col("new_correct")), F.count_if(added)).alias("newly_owned_correct_fraction"),
        count(added & ~supported, "newly_owned_outside_support"), count(named, "recovered"), F.try_divide(F.count_if(named & right_now), F.count_if(named)).alias("recovered_correct_fraction"),
        count(F.col("old_correct"), "correct_owner_before"), count(F.col("old_correct") & ~F.col("new_correct"), "owner_degraded"),
        count(right_before, "correct_semantic_before"), count(right_before & ~right_now, "semantic_degraded"), count((F.col("old_instance") > 0) & (F.col("old_instance") != F.col("instance_id")), "owner_changed"),
    )


def loss_attribution(stages: DataFrame, points: DataFrame) -> DataFrame:
    """(class_id, stage, points): the deepest stage that each point reached. stages: point_id, stage."""
    deepest = stages.groupBy("point_id").agg(F.max("stage").alias("stage"))
    return points.join(deepest, "point_id", "left").groupBy("class_id", F.coalesce("stage", F.lit(0)).alias("stage")).agg(F.count("*").alias("points"))


def same_vocabulary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(class_id_before, class_id_after, name); raises unless the two dictionaries have the same names."""
    from ..schemas import DataError

    if not before.select("name").exceptAll(after.select("name")).isEmpty() or not after.select("name").exceptAll(before.select("name")).isEmpty():
        raise DataError("class names differ")
    return before.select(F.col("class_id").alias("class_id_before"), "name").join(after.select(F.col("class_id").alias("class_id_after"), "name"), "name")


def scannet_reference(vertices: DataFrame, segments: DataFrame, groups: DataFrame) -> DataFrame:
    """vertices with object_id. segments: vertex_id, segment; groups: object_id, segments array. Overlapping groups are refused."""
    from ..schemas import refuse_duplicates

    owned = groups.select("object_id", F.explode("segments").alias("segment")).distinct()
    refuse_duplicates(owned, "segment")
    return vertices.join(segments.join(owned, "segment", "left").select("vertex_id", F.coalesce("object_id", F.lit(-1)).alias("object_id")), "vertex_id")


def rscan_reference(vertices: DataFrame, groups: DataFrame, scan_id: str, annotated: str | None = None) -> DataFrame:
    """vertices (with object_id) with label, null where groups (object_id, label) name none; another scan's groups are refused."""
    from ..schemas import DataError, refuse_duplicates

    if annotated is not None and annotated != scan_id:
        raise DataError(f"the annotation is of {annotated}, not of {scan_id}")
    refuse_duplicates(groups, "object_id")
    return vertices.join(groups.select("object_id", "label"), "object_id", "left")


def label_export(points: DataFrame, mapping: DataFrame, most: int = 65535) -> DataFrame:
    """(point_id, class_20, instance): names mapped to the evaluator's ids, unknown 0, instance 0 as -1."""
    from ..schemas import refuse

    refuse(points, F.col("instance_id") >= most, "instance ids must be below 65535")
    return points.join(mapping.select("semantic_id", "class_20"), "semantic_id", "left").select("point_id", F.coalesce("class_20", F.lit(0)).alias("class_20"), F.when(F.col("instance_id") == 0, -1).otherwise(F.col("instance_id")).alias("instance"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows of either side that the other lacks, counted with their multiplicity."""
    a, b = left.exceptAll(right).agg(F.count("*").alias("only_left")), right.exceptAll(left).agg(F.count("*").alias("only_right"))
    return a.crossJoin(b)  # one row each
