"""Readers: manifests, trajectories, labelled point clouds, archives, packets and dictionaries."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import is_rigid, rigid_inverse
from ..schemas import MANIFEST, MANIFEST_SCHEMA, TRAJECTORY, TRAJECTORY_SCHEMA, DataError, finite, refuse, refuse_duplicates


def canonical(value) -> str:
    """JSON with sorted keys and no spaces or NaN: what digests are taken of."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def check_self_hash(spark: SparkSession, path: str) -> None:
    """The file's payload_sha256 must be the digest of the rest."""
    for r in spark.read.text(path, wholetext=True).collect():
        body = json.loads(r[0])
        if body.pop("payload_sha256", None) != digest(body):
            raise DataError("payload digest differs")


def read_manifest(spark: SparkSession, path: str, hashed: bool = False) -> DataFrame:
    """One row per frame with dataset, sequence_id and depth_scale; ids are unique, times don't fall, focal lengths are positive."""
    if hashed:
        check_self_hash(spark, path)
    top = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)
    refuse(top, F.col("schema").isNull() | (F.col("schema") != MANIFEST), "unsupported manifest schema")
    rows = top.select("dataset", "sequence_id", "depth_scale", F.posexplode("frames").alias("ordinal", "f")).select("dataset", "sequence_id", "depth_scale", "ordinal", "f.*")
    k = F.col("intrinsics")
    rows = rows.withColumn("intrinsics", F.struct(*[k[i].alias(c) for i, c in enumerate(("fx", "fy", "cx", "cy"))]))
    refuse_duplicates(rows, "sequence_id", "frame_id")
    refuse(rows, F.col("intrinsics.fx").isNull() | (F.col("intrinsics.fx") <= 0) | (F.col("intrinsics.fy") <= 0), "focal lengths must be positive")
    from ..operators.temporal import monotone_violations

    if not monotone_violations(rows).limit(1).isEmpty():
        raise DataError("timestamps must not fall")
    return rows


def read_trajectory(spark: SparkSession, path: str, hashed: bool = False) -> DataFrame:
    """One row per pose with a row-major matrix of 16; valid poses are rigid."""
    if hashed:
        check_self_hash(spark, path)
    top = spark.read.schema(TRAJECTORY_SCHEMA).json(path, multiLine=True)
    refuse(top, F.col("schema").isNull() | (F.col("schema") != TRAJECTORY), "unsupported trajectory schema")
    rows = top.select("sequence_id", F.explode("poses").alias("p")).select("sequence_id", "p.frame_id", "p.timestamp_us", F.flatten("p.t_world_camera").alias("t_world_camera"), "p.valid", "p.source")
    refuse_duplicates(rows, "sequence_id", "frame_id")
    refuse(rows, F.col("valid") & ~is_rigid(F.col("t_world_camera")), "poses must be rigid")
    return rows


def read_legacy_trajectory(spark: SparkSession, path: str, frame_ids: list[int] | None = None) -> DataFrame:
    """Text lines of 18 fields (frame, time, camera-from-world matrix in millimetres) as world-from-camera poses in metres."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    refuse(lines, F.size(parts) != 18, "a pose line has 18 fields")
    m = F.transform(F.slice(parts, 3, 16), lambda x: x.cast("double"))
    metres = F.transform(m, lambda x, i: F.when(i.isin(3, 7, 11), x / 1000).otherwise(x))
    rows = lines.select(parts[0].cast("int").alias("frame_id"), parts[1].cast("long").alias("timestamp_us"), metres.alias("m"))
    if frame_ids is not None:
        rows = rows.where(F.col("frame_id").isin(frame_ids))
    refuse(rows, ~is_rigid(F.col("m")), "poses must be rigid")
    return rows.select("frame_id", "timestamp_us", rigid_inverse(F.col("m")).alias("t_world_camera"))


#: The PLY format's type names.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def ply_head(content: bytes) -> tuple[str, list[tuple[str, int, list[tuple]]], bytes]:
    """(format, elements with their count and properties, body) of a PLY file; a list property has three parts."""
    head, mark, body = content.partition(b"end_header")
    lines = head.decode("ascii").split("\n")
    if lines[0].strip() != "ply" or not mark:
        raise DataError("not a PLY file")
    form, elements = "", []
    for words in (x.split() for x in lines[1:]):
        if words[:1] == ["format"]:
            form = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"] and elements:
            kinds = words[2:4] if words[1] == "list" else words[1:2]
            elements[-1][2].append((words[-1], *[PLY_TYPES[k] for k in kinds]))
    return form, elements, body.split(b"\n", 1)[1]


def ply_vertices(content: bytes) -> np.ndarray:
    """The vertex table of a PLY file, ascii or binary; list properties of vertices are refused."""
    form, elements, body = ply_head(content)
    if not elements or elements[0][0] != "vertex":
        raise DataError("vertices must come first")
    _, count, fields = elements[0]
    if any(len(f) > 2 for f in fields):
        raise DataError("list properties of vertices are not supported")
    if form == "ascii":
        rows = [tuple(x.split()) for x in body.decode("ascii").split("\n")[:count]]
        return np.array(rows, dtype=[(n, "f8") for n, _ in fields]).astype(fields)
    order = "<" if form == "binary_little_endian" else ">"
    return np.frombuffer(body, [(n, order + t) for n, t in fields], count)


def ply_faces(content: bytes) -> np.ndarray:
    """The places of each triangle's vertices. Faces must follow the vertices, as a list of three each and nothing else."""
    form, elements, body = ply_head(content)
    if len(elements) < 2 or elements[1][0] != "face" or [len(f) for f in elements[1][2]] != [3]:
        raise DataError("a mesh has vertices, then faces of one list each")
    (_, before, fields), (_, count, [(_, size, kind)]) = elements[:2]
    if form == "ascii":
        rows = np.array([x.split() for x in body.decode("ascii").split("\n")[before : before + count]], np.int64).reshape(count, -1)
        sizes, places = rows[:, :1].ravel(), rows[:, 1:]
    else:
        order = "<" if form == "binary_little_endian" else ">"
        own = np.dtype([("n", order + size), ("at", order + kind, 3)])
        start = before * np.dtype([(n, order + t) for n, t in fields]).itemsize
        if len(body) - start < count * own.itemsize:
            raise DataError("only whole triangles are read")
        rows = np.frombuffer(body, own, count, start)
        sizes, places = rows["n"], rows["at"].astype(np.int64)
    if (sizes != 3).any() or places.shape != (count, 3):
        raise DataError("only whole triangles are read")
    if count and (places.min() < 0 or places.max() >= before):
        raise DataError("faces name vertices that are not there")
    return places


def ply_mesh_bytes(vertices: pd.DataFrame, faces: np.ndarray) -> bytes:
    """A binary little-endian PLY of vertices and triangles."""
    head, mark, body = ply_bytes(vertices).partition(b"end_header\n")
    rows = np.empty(len(faces), [("n", "u1"), ("at", "<i4", 3)])
    rows["n"], rows["at"] = 3, faces
    return head + f"element face {len(faces)}\nproperty list uchar int vertex_indices\n".encode() + mark + body + rows.tobytes()


def ply_bytes(table: pd.DataFrame) -> bytes:
    """A binary little-endian PLY of a vertex table; integers as int, others as double."""
    kinds = [(c, "<i4" if pd.api.types.is_integer_dtype(table[c]) else "<f8") for c in table.columns]
    names = {"<i4": "int", "<f8": "double"}
    head = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {len(table)}", *[f"property {names[k]} {c}" for c, k in kinds], "end_header", ""])
    rows = np.empty(len(table), kinds)
    for c, _ in kinds:
        rows[c] = table[c].to_numpy()
    return head.encode("ascii") + rows.tobytes()


def read_ply(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """(path, point_id, fields) of the vertices of PLY files; only the asked fields leave Python. point_id is the place in the file."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                v = ply_vertices(content)
                for a in range(0, len(v), 100_000):
                    part = v[a : a + 100_000]
                    yield pd.DataFrame({"path": p, "point_id": np.arange(a, a + len(part)), **{f: part[f].astype("f8") for f in fields}})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, point_id long, " + ", ".join(f"{f} double" for f in fields))


def read_ply_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of one PLY mesh: vertex_id, x, y, z, red, green, blue (0 to 1); face_id, a, b, c.

    A mesh without colours is plain. Colours of bytes are shares of 255.
    """
    from ..operators.surface import AXES, COLOURS, CORNERS, PLAIN

    files = spark.read.format("binaryFile").load(path).select("content")

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for content in (x for batch in batches for x in batch["content"]):
            v = ply_vertices(content)
            coloured = all(c in v.dtype.names for c in COLOURS)
            for a in range(0, len(v), 100_000):
                part = v[a : a + 100_000]
                own = {c: part[c] / (255.0 if part[c].dtype.kind in "iu" else 1.0) if coloured else p for c, p in zip(COLOURS, PLAIN, strict=True)}
                yield pd.DataFrame({"vertex_id": np.arange(a, a + len(part)), **{x: part[x].astype("f8") for x in AXES}, **own})

    def triangles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for content in (x for batch in batches for x in batch["content"]):
            f = ply_faces(content)
            for a in range(0, len(f), 100_000):
                part = f[a : a + 100_000]
                yield pd.DataFrame({"face_id": np.arange(a, a + len(part)), **{c: part[:, i] for i, c in enumerate(CORNERS)}})

    numbers = ", ".join(f"{c} double" for c in (*AXES, *COLOURS))
    return files.mapInPandas(points, f"vertex_id long, {numbers}"), files.mapInPandas(triangles, "face_id long, a long, b long, c long")


def read_npz(spark: SparkSession, path: str, arrays: list[str]) -> DataFrame:
    """(path, array, place, value) of flattened arrays in NPZ files, without pickles."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for name in arrays:
                        flat = z[name].reshape(-1)
                        yield pd.DataFrame({"path": p, "array": name, "place": np.arange(len(flat)), "value": flat.astype("f8")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, array string, place long, value double")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, name) of a JSON object of ids and names; 0 is unknown and names are unique."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "name")).select(F.col("k").cast("int").alias("class_id"), "name")
    if rows.where("class_id = 0 and name = 'unknown'").isEmpty():
        raise DataError("class 0 must be named unknown")
    refuse_duplicates(rows, "name")
    return rows


#: The magic numbers of packets and frame containers.
PACKET_MAGIC = b"SGFIPD01"


def decode_packet(content: bytes) -> tuple[dict, list[bytes]]:
    """Header and three payloads of a packet: magic, big-endian header length, JSON header, payloads with CRC-32s."""
    if content[:8] != PACKET_MAGIC or len(content) < 12:
        raise DataError("not a packet")
    (size,) = struct.unpack(">I", content[8:12])
    head = json.loads(content[12 : 12 + size])
    at, parts = 12 + size, []
    for p in head["payloads"]:
        part = content[at : at + p["bytes"]]
        if len(part) != p["bytes"] or zlib.crc32(part) != p["crc32"]:
            raise DataError("payload cut short or changed")
        parts.append(part)
        at += p["bytes"]
    if len(parts) != 3 or at != len(content):
        raise DataError("a packet has three payloads")
    return head, parts


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """(index, header, color, depth, confidence) of sealed packets, in order of their index."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(h.get("index"), canonical(h), *parts) for h, parts in map(decode_packet, batch["content"])]
            yield pd.DataFrame(rows, columns=["index", "header", "color", "depth", "confidence"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "index long, header string, color binary, depth binary, confidence binary").orderBy("index")


def valid_tablet_depth(depth: Column, confidence: Column, most: float, least_confidence: int) -> Column:
    return depth.isNotNull() & ~F.isnan(depth) & (depth > 0) & (depth <= most) & (confidence >= least_confidence)


def tablet_millimetres(depth: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(65535), F.rint(depth * 1000))).cast("int")


def valid_wireless(p: DataFrame, sync_us: int = 15_000) -> DataFrame:
    """Packets whose size, scale, alignment, intrinsics, times and ids are sound. Payloads are never unpickled."""
    return p.where(
        (F.col("width") > 0) & (F.col("height") > 0) & (F.col("depth_scale") == 1000) & (F.col("alignment") == "color") & (F.size("intrinsics") == 4)
        & F.forall("intrinsics", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.abs(F.col("timestamp_us") - F.col("depth_timestamp_us")) <= sync_us)
        & (F.col("sensor_frame_id") >= 0) & (F.col("depth_frame_id") >= 0) & finite("min_depth_m", "max_depth_m") & (F.col("min_depth_m") < F.col("max_depth_m"))
    )


def demo_scene(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(points, classes): the surface lattices of a table, a cup just above it and a chair beside."""
    boxes = [(1, 1, (0.0, 0.0, 0.0), (1.0, 1.0, 0.7)), (2, 2, (0.4, 0.4, 0.72), (0.5, 0.5, 0.82)), (3, 3, (1.2, 0.2, 0.0), (1.7, 0.7, 0.8))]
    box = F.inline(F.array(*[F.struct(F.lit(i).alias("instance_id"), F.lit(c).alias("semantic_id"), *[F.lit(v).alias(f"{n}{a}") for n, vs in (("lo", lo), ("hi", hi)) for a, v in enumerate(vs)]) for i, c, lo, hi in boxes]))
    grid = spark.range(216).select((F.col("id") % 6).alias("i"), (F.floor(F.col("id") / 6) % 6).alias("j"), F.floor(F.col("id") / 36).alias("k")).where("i in (0, 5) or j in (0, 5) or k in (0, 5)")
    every = grid.select("*", box)
    at = lambda a, c: (F.col(f"lo{a}") + (F.col(f"hi{a}") - F.col(f"lo{a}")) * F.col(c) / 5)
    points = every.select((F.col("instance_id") * 1000 + F.col("k") * 36 + F.col("j") * 6 + F.col("i")).alias("point_id"), at(0, "i").alias("x"), at(1, "j").alias("y"), at(2, "k").alias("z"), "semantic_id", F.col("instance_id").cast("long").alias("instance_id"))
    classes = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("class_id"), F.lit(n).alias("name")) for i, n in enumerate(("unknown", "table", "cup", "chair"))])))
    return points, classes
