"""Surfaces bound to a finished map: publishing once, and loading only what has not changed."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import surface
from ..schemas import DataError
from .files import read_ply_mesh
from .provenance import file_digest
from .sinks import create_only

INDEX, SCHEMA = "SURFACE.json", "surface.v1"
#: The files that a surface is bound to.
BOUND = ("map", "input_manifest", "trajectory", "mesh", "refusion", "viewer")


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def bound_receipt(receipt: dict, hashes: dict[str, str]) -> bool:
    """Whether a receipt is complete and names these manifest, trajectory and mesh."""
    return receipt.get("status") == "completed" and all(receipt.get(f"{k}_sha256") == hashes[v] for k, v in (("manifest", "input_manifest"), ("trajectory", "trajectory"), ("mesh", "mesh")))


def publish(spark: SparkSession, folder: str, map_path: str, manifest: str, trajectory: str, receipt_path: str, most: int = 150_000) -> str:
    """Writes the viewer's mesh and, create-only, the index that binds it; the path of the index.

    The receipt must be complete, have consumed no ground truth and used no identity poses, and name the digests and counts
    of manifest, trajectory and mesh (a PLY file). Nothing that is there is written again.
    """
    index = os.path.join(folder, INDEX)
    if os.path.exists(index):
        raise FileExistsError("a surface is already published here")
    receipt = read_json(receipt_path)
    paths = {"map": map_path, "input_manifest": manifest, "trajectory": trajectory, "mesh": receipt["mesh"], "refusion": receipt_path}
    hashes = {k: file_digest(p) for k, p in paths.items()}
    if not bound_receipt(receipt, hashes) or receipt.get("gt_consumed") is not False or receipt.get("identity_fallback_used") is not False:
        raise DataError("the receipt is not that of this surface")
    vertices, faces = read_ply_mesh(spark, receipt["mesh"])
    counts = {"vertices": vertices.count(), "triangles": faces.count()}
    if any(counts[k] != receipt.get(f"mesh_{k}") for k in counts) or counts["triangles"] < 1:
        raise DataError("the mesh has other counts than its receipt")
    surface.check_mesh(vertices, faces)
    small_vertices, small_faces = surface.simplified(vertices, faces, most)
    content = surface.mesh_bytes(small_vertices, small_faces, most)
    points, kept = surface.decode_mesh(content)

    own = os.path.join(folder, f"surface-view-{uuid.uuid4().hex[:12]}")
    os.mkdir(own)
    paths["viewer"] = os.path.join(own, "surface.bin")
    with open(paths["viewer"], "xb") as f:
        f.write(content)
    hashes["viewer"] = file_digest(paths["viewer"])
    body = {
        "schema": SCHEMA, "color_mode": "rgb", **counts, "viewer_vertices": len(points), "viewer_triangles": len(kept),
        "bounds": {"min": points[:, :3].min(0).tolist(), "max": points[:, :3].max(0).tolist()},
        "voxel_length_m": receipt.get("voxel_length_m"), "integrated_frame_count": receipt.get("integrated_frame_count"),
        "files": {k: {"path": os.path.relpath(os.path.realpath(paths[k]), os.path.realpath(folder)), "sha256": hashes[k]} for k in BOUND},
    }
    create_only(index, json.dumps(body, indent=2, allow_nan=False) + "\n")
    return index


def load(folder: str, root: str, final_map: str, trajectory: str, status: str = "completed") -> dict | None:
    """{metadata, paths, hashes} of a folder's surface, None if it has none.

    root: the session's folder, which every file must lie in; final_map, trajectory: those of the session's result. A file
    that has changed, lies outside or belongs to another map is refused, as is a session that was not completed.
    """
    if status != "completed":
        raise DataError("the session is not completed")
    index = os.path.join(folder, INDEX)
    if not os.path.isfile(index):
        return None
    body = read_json(index)
    if body.get("schema") != SCHEMA:
        raise DataError("unsupported surface schema")
    paths, home = {}, os.path.realpath(root)
    for name in BOUND:
        entry = body["files"].get(name)
        path = entry and os.path.realpath(os.path.join(folder, entry["path"]))
        if not path or os.path.commonpath([home, path]) != home or not os.path.isfile(path) or file_digest(path) != entry["sha256"]:
            raise DataError(f"surface file {name} is missing, has changed or lies outside the session")
        paths[name] = path
    if paths["map"] != os.path.realpath(final_map) or paths["trajectory"] != os.path.realpath(trajectory):
        raise DataError("the surface belongs to another map or trajectory")
    hashes = {k: v["sha256"] for k, v in body["files"].items()}
    if not bound_receipt(read_json(paths["refusion"]), hashes):
        raise DataError("the receipt is not that of this surface")
    public = {k: v for k, v in body.items() if k != "files"}
    return {"metadata": {**public, "available": True, "revision": file_digest(index), "mesh_sha256": hashes["mesh"]}, "paths": paths, "hashes": hashes}


def session_surfaces(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, viewer_triangles, triangles, name, file, sha256): a row for each bound file of every index that matches."""
    entry = "struct<path: string, sha256: string>"
    form = f"schema string, triangles long, viewer_triangles long, files map<string, {entry}>"
    rows = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", form).alias("j"))
    return rows.where(F.col("j.schema") == SCHEMA).select("path", "j.viewer_triangles", "j.triangles", F.explode("j.files").alias("name", "f")).select("path", "viewer_triangles", "triangles", "name", F.col("f.path").alias("file"), "f.sha256")
