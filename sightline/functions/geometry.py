"""Row-wise geometry: transforms, projections and pixel neighbourhoods."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bounds import small
from .scalar import angle_degrees, norm


def moved(points: DataFrame, matrix: Sequence[float]) -> DataFrame:
    """points with x, y, z under a constant row-major 4x4 rigid transform."""
    x, y, z = (F.col(c) for c in "xyz")
    new = {c: float(matrix[4 * i]) * x + float(matrix[4 * i + 1]) * y + float(matrix[4 * i + 2]) * z + float(matrix[4 * i + 3]) for i, c in enumerate("xyz")}
    return points.withColumns(new)


def up_basis(up: Sequence[float]) -> list[list[float]]:
    """Three orthonormal axes of which the last is up; the first is square to the axis that up leans to least."""
    v = [float(a) for a in up]
    size = math.sqrt(sum(a * a for a in v)) if len(v) == 3 and all(map(math.isfinite, v)) else 0.0
    if size < 1e-8:
        raise ValueError("up must be a finite nonzero 3-vector")
    v = [a / size for a in v]
    seed = [0.0, 0.0, 0.0]
    seed[min(range(3), key=lambda i: abs(v[i]))] = 1.0
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    first = cross(seed, v)
    size = math.sqrt(sum(a * a for a in first))
    first = [a / size for a in first]
    return [first, cross(v, first), v]


def along(axis: Sequence[float], cols: Sequence[str] = ("x", "y", "z")) -> Column:
    """A point's coordinate along an axis."""
    return sum((float(a) * F.col(c) for a, c in zip(axis[1:], cols[1:], strict=True)), float(axis[0]) * F.col(cols[0]))


def visible_pixels(points: DataFrame, frames: DataFrame, depth: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(frame_id, point_id, u, v): points that each frame sees where its measured depth agrees.

    frames: frame_id, t_camera_world (16 numbers), fx, fy, cx, cy, width, height, and optionally scene_id, by which points are joined if
    both have it; depth: frame_id, u, v, depth_m with 0 for no measure.
    """
    keys = [c for c in ("scene_id",) if c in points.columns and c in frames.columns]
    # without a scene column every frame meets every point by the operator's nature; the frames' size is checked
    both = points.join(frames, keys) if keys else points.crossJoin(small(frames))
    m = F.col("t_camera_world")
    cam = [m[4 * i] * F.col("x") + m[4 * i + 1] * F.col("y") + m[4 * i + 2] * F.col("z") + m[4 * i + 3] for i in range(3)]
    seen = both.select("frame_id", "point_id", *[c.alias(f"c{i}") for i, c in enumerate(cam)], "fx", "fy", "cx", "cy", "width", "height").where("c2 > 0")
    seen = seen.withColumn("u", F.rint(F.col("fx") * F.col("c0") / F.col("c2") + F.col("cx")).cast("int")).withColumn("v", F.rint(F.col("fy") * F.col("c1") / F.col("c2") + F.col("cy")).cast("int"))
    seen = seen.where("u >= 0 and v >= 0 and u < width and v < height")
    return seen.join(depth.where("depth_m > 0"), ["frame_id", "u", "v"]).where(F.abs(F.col("c2") - F.col("depth_m")) <= tolerance).select("frame_id", "point_id", "u", "v")


def back_projected(depth: DataFrame, frames: DataFrame, stride: int = 8, low: float = 0.2, high: float = 4.5) -> DataFrame:
    """(frame_id, u, v, x, y, z): every stride-th pixel of depths in range, in world coordinates. frames: t_world_camera."""
    z = F.col("depth_m")
    some = depth.where((F.col("u") % stride == 0) & (F.col("v") % stride == 0) & (z > low) & (z < high)).join(frames, "frame_id")
    cx, cy = (F.col("u") - F.col("cx")) * z / F.col("fx"), (F.col("v") - F.col("cy")) * z / F.col("fy")
    m = F.col("t_world_camera")
    return some.select("frame_id", "u", "v", *[(m[4 * i] * cx + m[4 * i + 1] * cy + m[4 * i + 2] * z + m[4 * i + 3]).alias(c) for i, c in enumerate("xyz")])


def interior(pixels: DataFrame, value: str = "class_id", keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """pixels (u, v) with interior: the value is positive and that of all four neighbours, which must be there."""
    by = [*keys]
    around = F.array(*[F.struct((F.col("u") + du).alias("u"), (F.col("v") + dv).alias("v")) for du, dv in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    sent = pixels.where(F.col(value) > 0).select(*by, F.col(value).alias("_near"), F.explode(around).alias("_p")).select(*by, "_near", F.col("_p.u").alias("u"), F.col("_p.v").alias("v"))
    # four rows arrive at each pixel; equal ones are counted before they join it
    same = sent.groupBy(*by, "u", "v", F.col("_near").alias(value)).agg(F.count("*").alias("_n"))
    return pixels.join(same, [*by, "u", "v", value], "left").withColumn("interior", (F.col(value) > 0) & (F.coalesce("_n", F.lit(0)) == 4)).drop("_n")


def eroded(pixels: DataFrame, keys: Sequence[str] = ("frame_id", "mask_id")) -> DataFrame:
    """The pixels of a boolean mask whose four neighbours it has too."""
    return interior(pixels.withColumn("_one", F.lit(1)), "_one", keys).where("interior").drop("_one", "interior")


def distinct_pose(a: Column, b: Column, metres: float = 0.12, degrees: float = 8.0) -> Column:
    """Whether two row-major camera poses differ in place or in viewing axis."""
    move = norm([a[4 * i + 3] - b[4 * i + 3] for i in range(3)])
    dot = a[2] * b[2] + a[6] * b[6] + a[10] * b[10]
    return (move >= metres) | (angle_degrees(dot) >= degrees)
