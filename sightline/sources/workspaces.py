"""Refinement workspaces: a finished result's inputs copied under a check, and trees of digests that find what has changed.

A tree has a row for each folder: the digest of its files' names, sizes and times and of its folders' digests. Two trees are
compared from the root down, and only folders below a difference are looked at; files are read in changed folders only.
"""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DataError
from .provenance import file_digest
from .sinks import create_only, replace
from .surfaces import read_json

LOCK = "LOCK.json"
#: An input's name in the workspace, and where a result has it.
INPUTS = {"target.npz": "fused/target.npz", "base.npz": "fused/map_labels.npz", "classes.json": "fused/classes.json"}


def prepare(result: str, manifest: str, runtime: str, scene: str = "capture") -> str:
    """A new workspace below a result, with copies of its inputs; candidates only if they are those of these labels."""
    root = os.path.join(result, "refinement")
    own = os.path.join(root, "inputs", scene)
    os.makedirs(own, exist_ok=False)
    sources = {"manifest.json": manifest, "trajectory.json": read_json(os.path.join(result, "mapping/mapping_result.json"))["trajectory"], **{k: os.path.join(result, v) for k, v in INPUTS.items()}}
    candidates = os.path.join(result, "fused/candidates.npz")
    if os.path.exists(candidates):
        receipt = read_json(os.path.join(result, "fused/CANDIDATES.json"))
        if receipt.get("candidates_sha256") != file_digest(candidates) or receipt.get("labels_sha256") != file_digest(sources["base.npz"]):
            raise DataError("candidates are not those of these labels")
        sources["candidates.npz"] = candidates
    for name, path in sources.items():
        shutil.copyfile(path, os.path.join(own, name))
    shutil.copyfile(runtime, os.path.join(root, "runtime.json"))
    replace(os.path.join(own, "INPUT.json"), {"rgb_registration": "already_registered", "source": result, "GT_used": False})
    replace(os.path.join(root, "INPUT_PLAN.json"), {"scenes": [scene]})
    return root


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(folder, name, bytes, time) of all files below root, their contents unread; folder is relative, "" for root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", "modificationTime")
    at = F.substring(F.col("path"), F.lit(len(os.path.realpath(root).rstrip("/")) + 2), F.length("path"))
    name = F.element_at(F.split(at, "/"), -1)
    folder = F.rtrim(F.substring(at, F.lit(1), F.length(at) - F.length(name)), F.lit("/"))
    return files.select(folder.alias("folder"), name.alias("name"), F.col("length").alias("bytes"), F.unix_micros("modificationTime").alias("time"))


def above(folder):
    """The folder that holds a folder; null for the root."""
    return F.when(folder != "", F.array_join(F.slice(parts := F.split(folder, "/"), F.lit(1), F.size(parts) - 1), "/"))


def tree(files: DataFrame, *what: str) -> DataFrame:
    """(folder, parent, depth, digest) of every folder above a file; files: folder, name and the columns what, which are digested.

    Digests are put together a level at a time, from the deepest up: one aggregation for each level of folders.
    """
    own = files.groupBy("folder").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("name", *what)))), 256).alias("files"))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    every = own.select("folder", depth.alias("depth")).select(F.explode(F.transform(F.sequence(F.lit(0), "depth"), lambda k: F.array_join(F.slice(F.split("folder", "/"), F.lit(1), k), "/"))).alias("folder")).distinct()
    level = every.join(own, "folder", "left").withColumn("depth", depth)
    done, below = None, None
    for k in range(level.agg(F.max("depth")).first()[0] or 0, -1, -1):
        here = level.where(F.col("depth") == k)
        if below is not None:
            inner = below.groupBy(F.col("parent").alias("folder")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("folder", "digest")))).alias("inner"))
            here = here.join(inner, "folder", "left")
        else:
            here = here.withColumn("inner", F.lit(None).cast("string"))
        below = here.select("folder", above(F.col("folder")).alias("parent"), "depth", F.sha2(F.concat_ws("|", F.coalesce("files", F.lit("")), F.coalesce("inner", F.lit(""))), 256).alias("digest"))
        done = below if done is None else done.union(below)
    return done


def changed_folders(before: DataFrame, after: DataFrame) -> list[str]:
    """Folders whose own files may differ between two trees: below a folder of equal digests nothing is looked at.

    The driver holds the differing folders of one level at a time.
    """
    rows = lambda t, at: t.where(F.col("folder") == "") if at is None else t.where(F.col("parent").isin(at))
    out, at = [], None
    while at is None or at:
        both = rows(before, at).select("folder", F.col("digest").alias("old")).join(rows(after, at).select("folder", F.col("digest").alias("new")), "folder", "full")
        at = [r[0] for r in both.where("not old <=> new").select("folder").collect()]
        out += at
    return sorted(out)


def workspace_files(root: str) -> list[str]:
    """Relative paths of a workspace's files: its plan, its runtime and the inputs of each scene, which must all be there."""
    scenes = read_json(os.path.join(root, "INPUT_PLAN.json")).get("scenes")
    if not scenes or len(scenes) != len(set(scenes)):
        raise DataError("a workspace has scenes, each once")
    if any(os.path.isabs(s) or ".." in s.split("/") or s in ("", ".") for s in scenes):
        raise DataError("a scene lies outside the workspace")
    names = ["INPUT.json", "manifest.json", "trajectory.json", *INPUTS]
    files = ["INPUT_PLAN.json", "runtime.json", *[f"inputs/{s}/{n}" for s in scenes for n in names]]
    if missing := [f for f in files if not os.path.isfile(os.path.join(root, f))]:
        raise DataError(f"the workspace lacks {missing[:10]}")
    return files + [f for f in (f"inputs/{s}/candidates.npz" for s in scenes) if os.path.isfile(os.path.join(root, f))]


def contents(spark: SparkSession, root: str, files: list[str]) -> DataFrame:
    """(file, sha256) of files below root, by relative path."""
    read = spark.read.format("binaryFile").load([os.path.join(root, f) for f in files])
    at = F.lit(len(os.path.realpath(root).rstrip("/")) + 2)
    return read.select(F.substring(F.regexp_replace("path", "^file:/+", "/"), at, F.length("path")).alias("file"), F.sha2("content", 256).alias("sha256"))


def lock(spark: SparkSession, root: str) -> str:
    """Seals a workspace: the digest of each of its files, create-only."""
    path = os.path.join(root, LOCK)
    create_only(path, json.dumps({"files": {r["file"]: r["sha256"] for r in contents(spark, root, workspace_files(root)).collect()}}, sort_keys=True))
    return path


def validate(spark: SparkSession, root: str) -> int:
    """The number of a locked workspace's files; a changed, missing or extra one is refused by name."""
    sealed = spark.createDataFrame(sorted(read_json(os.path.join(root, LOCK))["files"].items()), "file string, sealed string")
    files = workspace_files(root)
    inputs = {os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(os.path.join(root, "inputs")) for n in names}
    both = sealed.join(contents(spark, root, sorted({*files, *inputs})), "file", "full")
    bad = both.where("not sealed <=> sha256").select("file", F.when(F.col("sha256").isNull(), "missing").when(F.col("sealed").isNull(), "extra").otherwise("changed").alias("reason")).limit(10).collect()
    if bad:
        raise DataError(f"workspace differs from its lock: {sorted((r[0], r[1]) for r in bad)}")
    return len(files)
