"""Writers: create-only files, map exports, inventories and staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import coloured
from ..plans.bounds import at_most
from ..schemas import MANIFEST, TRAJECTORY, finite
from .files import canonical, digest, ply_bytes


def create_only(path: str, text: str) -> None:
    """A new file; an existing one is an error. It appears whole or not at all."""
    folder = os.path.dirname(path) or "."
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(f.name, path)
    finally:
        os.unlink(f.name)


def replace(path: str, value) -> None:
    """Replaces a JSON file durably: a reader sees the old or the new one."""
    temp = f"{path}.{uuid.uuid4().hex}"
    with open(temp, "w", encoding="utf-8") as f:
        f.write(canonical(value))
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


def self_hashed(body: dict) -> dict:
    return {**body, "payload_sha256": digest(body)}


def write_manifest(frames: DataFrame, path: str, dataset: str, sequence_id: str, depth_scale: float = 1000.0, most: int = 1_000_000) -> None:
    """A manifest with its own digest from frames (one sequence; their number is checked)."""
    k = lambda r: [r["intrinsics"][c] for c in ("fx", "fy", "cx", "cy")]
    rows = [{"frame_id": r["frame_id"], "timestamp_us": r["timestamp_us"], "color_path": r["color_path"], "depth_path": r["depth_path"], "intrinsics": k(r), "rotate_ccw": r["rotate_ccw"]} for r in at_most(frames, most, "frames").orderBy("frame_id").collect()]
    create_only(path, canonical(self_hashed({"schema": MANIFEST, "dataset": dataset, "sequence_id": sequence_id, "depth_scale": depth_scale, "frames": rows})))


def write_trajectory(poses: DataFrame, path: str, sequence_id: str, most: int = 1_000_000) -> None:
    """Poses rounded to 1e-7, so that their digest is stable."""
    rows = []
    for r in at_most(poses, most, "poses").orderBy("frame_id").collect():
        m = [round(x, 7) + 0.0 for x in r["t_world_camera"]]
        rows.append({"frame_id": r["frame_id"], "timestamp_us": r["timestamp_us"], "t_world_camera": [m[a : a + 4] for a in range(0, 16, 4)], "valid": r["valid"], "source": r["source"]})
    create_only(path, canonical(self_hashed({"schema": TRAJECTORY, "sequence_id": sequence_id, "poses": rows})))


def hash_audit(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, sha256) of every file."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def labelled_map(points: DataFrame, labels: DataFrame) -> DataFrame:
    """points with all their fields, the three labels and the colours of both variants."""
    own = labels.select("point_id", *[F.col(c).alias(f"_{c}") for c in ("semantic_id", "instance_id", "semantic_confidence")])
    out = points.drop("semantic_id", "instance_id", "semantic_confidence").join(own, "point_id", "left")
    out = out.select(*[c for c in out.columns if not c.startswith("_")], F.coalesce("_semantic_id", F.lit(0)).alias("semantic_id"), F.coalesce("_instance_id", F.lit(0)).alias("instance_id"), F.coalesce("_semantic_confidence", F.lit(0.0)).alias("semantic_confidence"))
    factors = (37, 67, 97)
    return out.withColumns({f"{v}_{c}": coloured(F.col(f"{v}_id"), f) for v in ("semantic", "instance") for c, f in zip(("red", "green", "blue"), factors, strict=True)})


def label_coverage(labelled: DataFrame) -> DataFrame:
    share = lambda c: F.avg((F.col(c) > 0).cast("int"))
    return labelled.agg(F.count("*").alias("points"), share("semantic_id").alias("semantic_coverage"), share("instance_id").alias("instance_coverage"))


def object_summary(labelled: DataFrame) -> DataFrame:
    """(instance_id, points, semantic_id): majority classes, the lowest on ties."""
    per = labelled.where("instance_id > 0").groupBy("instance_id", "semantic_id").agg(F.count("*").alias("n"))
    return per.groupBy("instance_id").agg(F.sum("n").alias("points"), F.max(F.struct("n", (-F.col("semantic_id")).alias("c"))).alias("b")).select("instance_id", "points", (-F.col("b.c")).alias("semantic_id"))


def write_ply(points: DataFrame, path: str, most: int = 20_000_000) -> None:
    """One PLY file in order of point_id; the number of points is checked. Larger maps stay tables."""
    table = at_most(points, most, "points").orderBy("point_id").drop("point_id").toPandas()
    with open(path, "xb") as f:
        f.write(ply_bytes(table))


def object_extract(points: DataFrame, kind: str, ident: int) -> DataFrame:
    return points.where(F.col({"class": "semantic_id", "instance": "instance_id"}[kind]) == ident)


def highlighted(points: DataFrame, ids: list[int]) -> DataFrame:
    """points with highlighted; ids must be positive and all be instances of these points, or they are refused."""
    if any(type(i) is not int or i <= 0 for i in ids):
        raise ValueError("instance ids are positive integers")
    asked = points.sparkSession.createDataFrame([(i,) for i in sorted({*ids})], "instance_id long")
    if unknown := [r[0] for r in asked.join(points.select("instance_id").distinct(), "instance_id", "left_anti").limit(10).collect()]:
        raise ValueError(f"no such instances: {sorted(unknown)}")
    marked = points.join(F.broadcast(asked.withColumn("highlighted", F.lit(True))), "instance_id", "left")
    return marked.select(*points.columns, F.coalesce("highlighted", F.lit(False)).alias("highlighted"))


def publishable(cloud: DataFrame, most: int = 100_000) -> DataFrame:
    """Finite points, decimated evenly."""
    from ..operators.temporal import decimated

    return decimated(cloud.where(finite("x", "y", "z")), most, ["point_id"], by=None)


def inventory(files: dict[str, str], root: str, scene_id: str, dataset: str, required: tuple[str, ...] = ()) -> dict:
    """Relative paths and digests of artifacts; required names can't be left out."""
    import hashlib

    out = {}
    for name, path in sorted(files.items()):
        full = os.path.realpath(path)
        if not full.startswith(os.path.realpath(root) + os.sep):
            raise ValueError(f"{name} lies outside {root}")
        with open(full, "rb") as f:
            out[name] = {"path": os.path.relpath(full, os.path.realpath(root)), "sha256": hashlib.sha256(f.read()).hexdigest()}
    if missing := set(required) - set(out):
        raise ValueError(f"missing {sorted(missing)}")
    return {"scene_id": scene_id, "dataset": dataset, "provenance_bound": True, "files": out}


class Checkpoints:
    """Stage tables kept by the digest of everything they depend on: inputs, configuration and code version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, stage: str, context: dict) -> str:
        return f"{self.root}/{stage}/{digest(context)}"

    def seal(self, stage: str, context: dict, table: DataFrame) -> DataFrame:
        table.write.mode("errorifexists").parquet(self.path(stage, context))
        return self.restore(stage, context)

    def restore(self, stage: str, context: dict) -> DataFrame | None:
        """The stage's table, or None if it was never finished: a write is finished when its success mark is there."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(stage, context) + "/_SUCCESS")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(self.path(stage, context))

    def run(self, stage: str, context: dict, make) -> DataFrame:
        found = self.restore(stage, context)
        return found if found is not None else self.seal(stage, context, make())
