"""Portable bundles: a folder of files with an inventory that is sealed from the digests that the writing tasks report.

Tasks write their files under names of their own attempt; only when all have ended does the driver give them their names and
write the inventory, create-only. So what a lost or repeated task left is never part of a bundle. A reader checks the
inventory's own digest and the folder's listing first, and each file's digest in the task that reads it: a changed, a
missing and an extra file are refused by name. The folder is one that driver and executors share.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schemas import DataError
from .files import canonical, digest
from .sinks import create_only, self_hashed

INVENTORY, SCHEMA = "BUNDLE.json", "bundle.v1"
#: The ending of files whose task has not been committed.
PENDING = ".pending"


def inside(root: str, name: str) -> str:
    """The path of a bundle's file; a name that leads out of the folder, or is the inventory's, is refused."""
    path = os.path.normpath(os.path.join(root, name))
    if not name or os.path.isabs(name) or not path.startswith(os.path.normpath(root) + os.sep) or path == os.path.join(os.path.normpath(root), INVENTORY) or name.endswith(PENDING):
        raise DataError(f"not a name of a bundle's file: {name}")
    return path


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, int, str]]  # name, pending path, bytes, digest


class BundleWriter(DataSourceWriter):
    def __init__(self, root: str, head: dict):
        self.root, self.head = root, head
        if os.path.exists(os.path.join(root, INVENTORY)):
            raise FileExistsError(f"a bundle is already sealed in {root}")

    def write(self, iterator: Iterator[Row]) -> Written:
        out = []
        for r in iterator:
            path, content = inside(self.root, r["name"]), bytes(r["content"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            pending = f"{path}.{uuid.uuid4().hex}{PENDING}"
            with open(pending, "xb") as f:
                f.write(content)
                f.flush()
                os.fsync(f.fileno())
            out.append((r["name"], pending, len(content), hashlib.sha256(content).hexdigest()))
        return Written(out)

    def commit(self, messages) -> None:
        files = [x for m in messages if m is not None for x in m.files]
        if len({n for n, *_ in files}) < len(files):
            self.abort(messages)
            raise DataError("two files of one name in a bundle")
        for name, pending, _, _ in files:
            os.replace(pending, inside(self.root, name))
        for path in pending_files(self.root):  # of attempts that did not count
            os.unlink(path)
        os.makedirs(self.root, exist_ok=True)
        listed = {n: {"bytes": size, "sha256": sha} for n, _, size, sha in sorted(files)}
        create_only(os.path.join(self.root, INVENTORY), canonical(self_hashed({"schema": SCHEMA, **self.head, "files": listed})))

    def abort(self, messages) -> None:
        for m in messages:
            for _, pending, _, _ in m.files if m is not None else ():
                if os.path.exists(pending):
                    os.unlink(pending)


def pending_files(root: str) -> list[str]:
    return [os.path.join(d, n) for d, _, names in os.walk(root) for n in names if n.endswith(PENDING)]


class Part(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class BundleReader(DataSourceReader):
    def __init__(self, root: str, files_each: int):
        self.root, self.files_each = root, files_each

    def partitions(self) -> list[Part]:
        files = sorted((n, v["sha256"]) for n, v in inventory_of(self.root)["files"].items())
        return [Part(files[a : a + self.files_each]) for a in range(0, len(files), self.files_each)] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        for name, sha in partition.files:
            with open(inside(self.root, name), "rb") as f:
                content = f.read()
            if hashlib.sha256(content).hexdigest() != sha:
                raise DataError(f"bundle file changed: {name}")
            yield name, content


class BundleSource(DataSource):
    """spark.read.format("bundle") and df.write.format("bundle"), with the option path; df has name and content."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema) -> BundleReader:
        return BundleReader(self.options["path"], int(self.options.get("filesEach", 16)))

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        if overwrite or set(schema.names) != {"name", "content"}:
            raise DataError("a bundle is written once, of name and content")
        return BundleWriter(self.options["path"], json.loads(self.options.get("head", "{}")))


def inventory_of(root: str) -> dict:
    """A sealed bundle's inventory; its digest must be its own, and the folder must hold its files and no others."""
    with open(os.path.join(root, INVENTORY), encoding="utf-8") as f:
        body = json.load(f)
    own = body.pop("payload_sha256", None)
    if body.get("schema") != SCHEMA or own != digest(body):
        raise DataError("not a bundle, or its inventory has changed")
    there = {os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names} - {INVENTORY}
    for what, names in (("missing from", set(body["files"]) - there), ("not of", there - set(body["files"]))):
        if names:
            raise DataError(f"{what} the bundle: {sorted(names)[:10]}")
    return body


def write_bundle(files: DataFrame, root: str, **head) -> dict:
    """Writes and seals files (name, content) in a new or empty folder; the inventory, with head's entries."""
    files.sparkSession.dataSource.register(BundleSource)
    if os.path.isdir(root) and os.listdir(root):
        raise FileExistsError(f"{root} is not empty")
    files.select("name", "content").write.format("bundle").option("path", root).option("head", canonical(head)).mode("append").save()
    return inventory_of(root)


def read_bundle(spark: SparkSession, root: str) -> DataFrame:
    """(name, content) of a sealed bundle's files, each checked where it is read."""
    spark.dataSource.register(BundleSource)
    inventory_of(root)
    return spark.read.format("bundle").option("path", root).load()


def evidence_files(projections: DataFrame, masks: DataFrame, width: int, height: int) -> DataFrame:
    """(name, content): for each query an NPZ of what it saw: visible, scores, and points_0 .. of all its masks.

    projections: query, point_id, u, v (each point's pixel); masks: query, mask, score, packed. Points of a mask are those on
    its interior pixels, which have all four neighbours in it. A query's points are one image's at most.
    """
    from ..functions.geometry import eroded
    from ..operators.measured import unpacked

    safe = eroded(unpacked(masks.select("query", "mask", "packed"), width, height), ("query", "mask"))
    points = safe.join(projections, ["query", "u", "v"]).groupBy("query", "mask").agg(F.sort_array(F.collect_set("point_id")).alias("points"))
    listed = masks.select("query", "mask", "score").join(points, ["query", "mask"], "left").select("query", F.struct("mask", "score", F.coalesce("points", F.array().cast("array<long>")).alias("points")).alias("m"))
    seen = projections.groupBy("query").agg(F.sort_array(F.collect_set("point_id")).alias("visible"))
    rows = seen.join(listed.groupBy("query").agg(F.sort_array(F.collect_list("m")).alias("masks")), "query", "left")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, visible, own in batch[["query", "visible", "masks"]].itertuples(index=False):
                own = [] if own is None else own
                arrays = {"visible": np.array(visible, np.int64), "scores": np.array([m["score"] for m in own], float)}
                arrays |= {f"points_{k}": np.array(m["points"], np.int64) for k, m in enumerate(own)}
                data = io.BytesIO()
                np.savez_compressed(data, **arrays)
                out.append((f"evidence/{query}.npz", data.getvalue()))
            yield pd.DataFrame(out, columns=["name", "content"])

    return rows.mapInPandas(pack, "name string, content binary")


def bundle_evidence(files: DataFrame) -> DataFrame:
    """(query, mask, score, point_id) of a bundle's evidence files; mask is null for the visible points."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in batch[["name", "content"]].itertuples(index=False):
                query = name.removeprefix("evidence/").removesuffix(".npz")
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    yield pd.DataFrame({"query": query, "mask": pd.array([None] * len(z["visible"]), "Int64"), "score": np.nan, "point_id": z["visible"]})
                    for k, score in enumerate(z["scores"].tolist()):
                        yield pd.DataFrame({"query": query, "mask": pd.array([k] * len(z[f"points_{k}"]), "Int64"), "score": score, "point_id": z[f"points_{k}"]})

    return files.where("name like 'evidence/%.npz'").mapInPandas(parse, "query string, mask long, score double, point_id long").withColumn("score", F.nanvl("score", F.lit(None)))
