"""Artifacts and their digests: resolution, verification and completion states."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DataError

#: The names of inventory and state files, in the order in which they are looked for.
INVENTORIES = ("artifacts.json", "inventory.json")
STATES = {"COMPLETE": "complete", "FAILURE": "failed", "RUNNING": "running"}


def mismatches(inventory: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, reason): files of the inventory that are missing or have another digest. Both: name, sha256."""
    both = inventory.select("name", "sha256").join(actual.select("name", F.col("sha256").alias("found")), "name", "left")
    return both.where(F.col("found").isNull() | (F.col("found") != F.col("sha256"))).select("name", F.when(F.col("found").isNull(), "missing").otherwise("digest").alias("reason"))


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def load_inventory(spark: SparkSession, root: str, require_bound: bool = True) -> DataFrame:
    """(name, path, sha256) of a completed result, verified against the files."""
    state = run_state(root)
    if state != "complete":
        raise DataError(f"run is {state}")
    found = next((os.path.join(root, n) for n in INVENTORIES if os.path.exists(os.path.join(root, n))), None)
    if found is None:
        raise DataError("no artifact inventory")
    with open(found, encoding="utf-8") as f:
        body = json.load(f)
    if require_bound and not body.get("provenance_bound"):
        raise DataError("artifacts are not bound to their inputs")
    rows = [(n, os.path.join(root, v["path"]), v["sha256"]) for n, v in sorted(body["files"].items())]
    listed = spark.createDataFrame(rows, "name string, path string, sha256 string")
    files = spark.read.format("binaryFile").load([r[1] for r in rows]).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.sha2("content", 256).alias("sha256"))
    actual = listed.select("name", "path").join(files, "path").select("name", "sha256")
    bad = mismatches(listed, actual).limit(10).collect()
    if bad:
        raise DataError(f"artifacts differ: {[(r[0], r[1]) for r in bad]}")
    return listed


#: What older results call their files, and the claims that an older refinement's receipt must make.
LEGACY_MAPS, LEGACY_RESULTS, LEGACY_FOLDERS = ("map_labeled.ply", "semantic_labeled.ply"), ("result.json", "RESULT.json"), ("", "export", "fused/export", "fused")
LEGACY_CLAIMS = {"scope": "fixed geometry semantic refinement; no SLAM or SGA inference", "known_labels_preserved": True, "geometry_modified": False, "instance_ids_preserved": True, "GT_used": False}


def legacy_layout(root: str) -> dict[str, str]:
    """Paths of map, classes and result of a result without inventory, by the first layout that has all three."""
    def layouts():
        for part in LEGACY_FOLDERS:
            folder = os.path.normpath(os.path.join(root, part))
            for name in LEGACY_MAPS:
                for beside in (folder, os.path.dirname(folder)):
                    for result in LEGACY_RESULTS:
                        yield {"map": os.path.join(folder, name), "classes": os.path.join(beside, "classes.json"), "result": os.path.join(beside, result)}

    found = next((x for x in layouts() if all(map(os.path.isfile, x.values()))), None)
    if found is None:
        raise DataError("no result: a labelled map, classes and a result file are needed")
    return found


def legacy_complete(result: str) -> bool:
    """Whether a receipt without a status is an older refinement's, in its exact form. Its use must be asked for."""
    with open(result, encoding="utf-8") as f:
        receipt = json.load(f)
    kinds = {"scene": str, "changed_points": int, "fragment_policy": bool, "objects": list}
    exact = all(type(receipt.get(k)) is type(v) and receipt[k] == v for k, v in LEGACY_CLAIMS.items()) and all(type(receipt.get(k)) is t for k, t in kinds.items())
    beside = os.path.isfile(os.path.join(os.path.dirname(result), "map_labels.npz"))
    return exact and beside and "status" not in receipt and bool(receipt["scene"]) and receipt["changed_points"] >= 0 and os.path.basename(result).lower() == "result.json"


def session_listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(session_id, root, modified) of the folders directly below the roots; an id in two roots is refused."""
    rows = [(e.name, root, e.stat().st_mtime) for root in roots if os.path.isdir(root) for e in os.scandir(root) if e.is_dir() and not e.name.startswith(".")]
    names = [r[0] for r in rows]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise DataError(f"sessions in more than one root: {twice[:10]}")
    return spark.createDataFrame(rows, "session_id string, root string, modified double").orderBy(F.desc("modified"), "session_id")


def run_state(root: str) -> str:
    """complete, failed, running or unknown; a failure mark outweighs others."""
    for mark in ("FAILURE", "RUNNING", "COMPLETE"):
        if os.path.exists(os.path.join(root, mark)):
            return STATES[mark]
    return "unknown"


def session_status(sessions: DataFrame) -> DataFrame:
    """sessions with status, by the first that holds."""
    status = (
        F.when(F.col("failed"), "failed").when(F.col("complete"), "complete").when(F.col("running"), "running").when(F.col("sealed"), "captured").when(F.col("frames") > 0, "partial").otherwise("empty")
    )
    return sessions.withColumn("status", status)


def same_identity(a: DataFrame, b: DataFrame) -> None:
    """Raises unless both name the same single scene and dataset."""
    pick = lambda x: x.select("dataset", "sequence_id").distinct().limit(2).collect()
    if len(pick(a)) != 1 or pick(a) != pick(b):
        raise DataError("manifest and trajectory are of different scenes")


def receipt_valid(frames: DataFrame, receipt: DataFrame) -> bool:
    """Whether a mapping receipt has exactly the frames and times, in order."""
    both = frames.select("ordinal", "frame_id", "timestamp_us").join(receipt.select("ordinal", F.col("frame_id").alias("f"), F.col("timestamp_us").alias("t")), "ordinal", "full")
    return both.where(F.col("frame_id").isNull() | F.col("f").isNull() | (F.col("frame_id") != F.col("f")) | (F.col("timestamp_us") != F.col("t"))).limit(1).isEmpty()


def frames_from_plan(frames: DataFrame, plan_ids: list[int], digest_matches: bool) -> DataFrame:
    """The planned frames; the plan must be of these inputs, and an ordered subset of them."""
    if not digest_matches:
        raise DataError("plan was made for other inputs")
    if any(b <= a for a, b in zip(plan_ids, plan_ids[1:], strict=False)):
        raise DataError("plan is not in order")
    kept = frames.where(F.col("frame_id").isin(plan_ids))
    if kept.count() != len(plan_ids):
        raise DataError("plan names frames the manifest lacks")
    return kept


def selection_budget(n: int, stride: int, budget: int | None = None) -> int:
    """The stride's count of n frames, or an explicit budget of 1 to n."""
    if budget is None:
        return len(range(0, n, stride)) + (n > 0 and (n - 1) % stride != 0)
    if type(budget) is not int or not 1 <= budget <= n:
        raise ValueError("budget must be from 1 to the number of frames")
    return budget


def authorised(request: dict, receipt: dict) -> bool:
    """Whether a refusion request is for the very inputs that a receipt lists."""
    return bool(receipt) and all(request.get(k) == receipt.get(k) for k in ("dataset", "sequence_id", "manifest_sha256", "trajectory_sha256"))
