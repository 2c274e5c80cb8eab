"""Explicit schemas of the tables and of their versions; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schema ids that payloads must carry.
MANIFEST, TRAJECTORY = "rgbd_sequence_manifest.v1", "pose_trajectory.v1"

INTRINSICS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("fx", "fy", "cx", "cy")])
FRAME = T.StructType([
    T.StructField("frame_id", T.IntegerType()), T.StructField("timestamp_us", T.LongType()), T.StructField("color_path", T.StringType()),
    T.StructField("depth_path", T.StringType()), T.StructField("intrinsics", T.ArrayType(T.DoubleType())), T.StructField("rotate_ccw", T.BooleanType()),
])
MANIFEST_SCHEMA = T.StructType([
    T.StructField("schema", T.StringType()), T.StructField("dataset", T.StringType()), T.StructField("sequence_id", T.StringType()),
    T.StructField("depth_scale", T.DoubleType()), T.StructField("frames", T.ArrayType(FRAME)), T.StructField("payload_sha256", T.StringType()),
])
POSE = T.StructType([
    T.StructField("frame_id", T.IntegerType()), T.StructField("timestamp_us", T.LongType()), T.StructField("t_world_camera", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("valid", T.BooleanType()), T.StructField("source", T.StringType()),
])
TRAJECTORY_SCHEMA = T.StructType([
    T.StructField("schema", T.StringType()), T.StructField("sequence_id", T.StringType()), T.StructField("poses", T.ArrayType(POSE)), T.StructField("payload_sha256", T.StringType()),
])
MAP_POINTS = T.StructType([T.StructField("point_id", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in "xyz"] + [T.StructField("semantic_id", T.IntegerType()), T.StructField("instance_id", T.LongType())])
OBSERVATIONS = T.StructType([
    T.StructField("frame_id", T.LongType()), T.StructField("point_id", T.LongType()), T.StructField("mask_id", T.IntegerType()),
    T.StructField("class_id", T.IntegerType()), T.StructField("confidence", T.DoubleType()), T.StructField("interior", T.BooleanType()),
])


class DataError(ValueError):
    """The data break an invariant."""


def finite(*columns: str) -> Column:
    """Whether all are numbers that are neither null, NaN nor infinite."""
    out = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        out = out & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return out


def refuse(df: DataFrame, condition: Column, message: str) -> None:
    """Raises DataError if a row meets the condition; stops at the first."""
    if not df.where(condition).limit(1).isEmpty():
        raise DataError(message)


def refuse_duplicates(df: DataFrame, *keys: str) -> None:
    if not df.groupBy(*keys).count().where("count > 1").limit(1).isEmpty():
        raise DataError(f"duplicate {', '.join(keys)}")


def check_observations(observations: DataFrame) -> None:
    """One row for each (frame, point), and confidence within [0, 1]."""
    refuse_duplicates(observations, "frame_id", "point_id")
    refuse(observations, ~finite("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence must be finite in [0,1]")


def check_points(points: DataFrame, classes: DataFrame) -> None:
    """Finite coordinates, non-negative ids, 0 named unknown, every class in the dictionary."""
    refuse(points, ~finite("x", "y", "z"), "finite coordinates required")
    refuse(points, F.col("semantic_id").isNull() | F.col("instance_id").isNull() | (F.col("semantic_id") < 0) | (F.col("instance_id") < 0), "non-negative point labels required")
    if classes.where("class_id = 0 and name = 'unknown'").isEmpty():
        raise DataError("class 0 must be named unknown")
    if not points.select(F.col("semantic_id").alias("class_id")).distinct().join(classes, "class_id", "left_anti").isEmpty():
        raise DataError("every observed class must be in the dictionary")
