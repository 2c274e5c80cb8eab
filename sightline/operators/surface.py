"""Triangle meshes as tables: simplification to a number of faces, normals, the viewer's binary form.

vertices: vertex_id, x, y, z, red, green, blue (0 to 1); faces: face_id, a, b, c (vertex ids, in order of turning).

Simplification is vertex clustering: vertices of one cell of a cubic grid become one. Where it stands is the point of
least squared distance from the planes of all faces with a corner in the cell; each plane's quadric is ten sums, put
together by cell. Faces are renamed by cell, and those that fall together or flat are dropped. The grid is the finest
one tried that leaves no more faces than asked for; a try counts faces and moves nothing.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.bounds import at_most
from ..plans.folders import cut
from ..schemas import DataError, finite, refuse, refuse_duplicates
from .ordering import numbered

AXES, COLOURS, CORNERS = ("x", "y", "z"), ("red", "green", "blue"), ("a", "b", "c")
#: The binary form's mark, and the colour of meshes without one.
MAGIC, PLAIN = b"RVMESH01", (0.65, 0.68, 0.72)
#: Share of the mean diagonal that draws a cell's point to the mean of its vertices, where planes leave it open.
PULL = 1e-3
#: Cells along the longest side are at most 2**21, so that a cell's three places fit into 63 bits.
FINEST = 1 << 21


def check_mesh(vertices: DataFrame, faces: DataFrame) -> None:
    """At least one face, finite places and colours, vertex ids that are unique and known to every face."""
    if faces.limit(1).isEmpty():
        raise DataError("a mesh needs faces")
    refuse_duplicates(vertices, "vertex_id")
    refuse(vertices, ~finite(*AXES, *COLOURS), "finite places and colours required")
    corners = faces.select(F.explode(F.array(*CORNERS)).alias("vertex_id"))
    if not corners.where("vertex_id is null").isEmpty() or not corners.distinct().join(vertices, "vertex_id", "left_anti").isEmpty():
        raise DataError("faces name vertices that are not there")


def cornered(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """faces with the places of their corners: ax to cz."""
    for k in CORNERS:
        faces = faces.join(vertices.select(F.col("vertex_id").alias(k), *[F.col(x).alias(f"{k}{x}") for x in AXES]), k)
    return faces


def bounds_of(vertices: DataFrame) -> tuple[tuple[float, float, float], float]:
    """(the lowest corner of the mesh's box, its longest side)."""
    r = vertices.agg(*[f(x).alias(f"{n}{x}") for x in AXES for n, f in (("low", F.min), ("high", F.max))]).first()
    return tuple(r[f"low{x}"] for x in AXES), max(r[f"high{x}"] - r[f"low{x}"] for x in AXES)


def cell(places: tuple[Column, Column, Column], low, side: float, cells: int) -> Column:
    """The number of the grid cell that holds a place: three axes of 21 bits."""
    at = [F.least(F.lit(cells - 1), F.floor((p - F.lit(float(o))) / F.lit(side / cells))).cast("long") if side > 0 else F.lit(0).cast("long") for p, o in zip(places, low, strict=True)]
    return F.shiftleft(at[0], 42).bitwiseOR(F.shiftleft(at[1], 21)).bitwiseOR(at[2])


def renamed_faces(corners: DataFrame, low, side: float, cells: int) -> DataFrame:
    """Distinct (a, b, c) of cells, the smallest first in the order of turning; faces within one or two cells are dropped."""
    a, b, c = (cell(tuple(F.col(f"{k}{x}") for x in AXES), low, side, cells) for k in CORNERS)
    named = corners.select(a.alias("a"), b.alias("b"), c.alias("c")).where("a != b and b != c and a != c")
    turned = F.when(F.expr("a < b and a < c"), F.struct("a", "b", "c")).when(F.expr("b < c"), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), F.col("a").alias("c"))).otherwise(F.struct(F.col("c").alias("a"), F.col("a").alias("b"), F.col("b").alias("c")))
    return named.select(turned.alias("f")).select("f.*").distinct()


def finest_grid(corners: DataFrame, low, side: float, most: int, tries: int = 12, close: float = 0.9) -> int:
    """The most cells along a side, of those tried, that leave at most that many faces; one cell leaves none.

    Faces grow about as the square of the cells, which says where to try next; between a grid that fits and one that
    does not the try lies strictly inside.
    """
    fits, over, at = 1, FINEST + 1, min(FINEST, max(2, int(most**0.5)))
    for _ in range(tries):
        n = renamed_faces(corners, low, side, at).count()
        if n <= most:
            fits = at
            if n >= close * most:
                break
        else:
            over = at
        if over - fits <= 1:
            break
        guess = at * (most / max(n, 1)) ** 0.5 if n else at * 4
        at = int(min(over - 1, max(fits + 1, guess)))
    return fits


def quadrics(corners: DataFrame, low, side: float, cells: int) -> DataFrame:
    """(cell, qxx .. qzz, rx, ry, rz) of the planes of all faces with a corner in a cell, weighed by squared area.

    Places are taken from the box's lowest corner, so that far coordinates do not drown them.
    """
    p = {k: [F.col(f"{k}{x}") - F.lit(float(o)) for x, o in zip(AXES, low, strict=True)] for k in CORNERS}
    u, v = ([p[k][i] - p["a"][i] for i in range(3)] for k in ("b", "c"))
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    planes = corners.select(F.array(*[cell(tuple(F.col(f"{k}{x}") for x in AXES), low, side, cells) for k in CORNERS]).alias("at"), *[e.alias(f"n{x}") for x, e in zip(AXES, n, strict=True)], (n[0] * p["a"][0] + n[1] * p["a"][1] + n[2] * p["a"][2]).alias("h"))
    met = planes.select(F.explode("at").alias("cell"), "nx", "ny", "nz", "h")
    square = [F.sum(F.col(f"n{a}") * F.col(f"n{b}")).alias(f"q{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]]
    return met.groupBy("cell").agg(*square, *[F.sum(F.col(f"n{a}") * F.col("h")).alias(f"r{a}") for a in AXES])


def best_places(sums: DataFrame, low, side: float, cells: int) -> DataFrame:
    """sums with x, y, z: the solution of each cell's three equations, kept within its cell.

    sums: quadrics' columns and the mean of the cell's vertices, mx to mz, from the box's lowest corner.
    """
    q = lambda a, b: F.col("q" + "".join(sorted((a, b))))
    pull = (F.col("qxx") + F.col("qyy") + F.col("qzz")) * (PULL / 3)
    m = [[q(a, b) + pull if a == b else q(a, b) for b in AXES] for a in AXES]
    r = [F.col(f"r{a}") + pull * F.col(f"m{a}") for a in AXES]

    def det(x: list[list[Column]]) -> Column:
        return x[0][0] * (x[1][1] * x[2][2] - x[1][2] * x[2][1]) - x[0][1] * (x[1][0] * x[2][2] - x[1][2] * x[2][0]) + x[0][2] * (x[1][0] * x[2][1] - x[1][1] * x[2][0])

    whole = det(m)
    out = {}
    for i, (a, o) in enumerate(zip(AXES, low, strict=True)):
        solved = F.when(whole > 0, det([[r[j] if k == i else m[j][k] for k in range(3)] for j in range(3)]) / whole).otherwise(F.col(f"m{a}"))
        start = F.shiftright(F.col("cell"), 42 - 21 * i).bitwiseAND(FINEST - 1) * (side / cells)
        out[a] = F.least(F.greatest(solved, start), start + side / cells) + float(o)
    return sums.withColumns(out)


def clustered(vertices: DataFrame, faces: DataFrame, cells: int) -> tuple[DataFrame, DataFrame]:
    """(vertices by cell: cell, x, y, z, colours; faces: a, b, c) on a grid of that many cells along the longest side.

    Vertices that no face keeps are dropped.
    """
    low, side = bounds_of(vertices)
    return _clustered(vertices, cornered(vertices, faces), low, side, cells)


def _clustered(vertices: DataFrame, corners: DataFrame, low, side: float, cells: int) -> tuple[DataFrame, DataFrame]:
    kept = renamed_faces(corners, low, side, cells)
    at = cell(tuple(F.col(x) for x in AXES), low, side, cells)
    mean = vertices.groupBy(at.alias("cell")).agg(*[F.avg(F.col(x) - F.lit(float(o))).alias(f"m{x}") for x, o in zip(AXES, low, strict=True)], *[F.avg(c).alias(c) for c in COLOURS])
    used = kept.select(F.explode(F.array(*CORNERS)).alias("cell")).distinct()
    sums = quadrics(corners, low, side, cells).join(used, "cell").join(mean, "cell")
    return best_places(sums, low, side, cells).select("cell", *AXES, *COLOURS), kept


def simplified(vertices: DataFrame, faces: DataFrame, most: int = 150_000) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of at most that many faces, ids from 0 on in the order of cells. A mesh that fits stays as it is.

    A mesh that falls flat on every grid that fits, as one of fewer cells than faces asked for, is refused.
    """
    if most < 1:
        raise ValueError("at least one face must be allowed")
    if faces.limit(most + 1).count() <= most:
        return vertices, faces
    low, side = bounds_of(vertices)
    corners = cut(cornered(vertices, faces).select(*[f"{k}{x}" for k in CORNERS for x in AXES]))
    points, kept = _clustered(vertices, corners, low, side, finest_grid(corners, low, side, most))
    ids = numbered(points, ["cell"]).withColumn("vertex_id", F.col("k") - 1).drop("k")
    if (ids := cut(ids)).limit(1).isEmpty():
        raise DataError("no face is left on a grid that coarse")
    for k in CORNERS:
        kept = kept.join(ids.select(F.col("cell").alias(k), F.col("vertex_id").alias(f"_{k}")), k)
    kept = kept.select(*[F.col(f"_{k}").alias(k) for k in CORNERS])
    return ids.drop("cell"), numbered(kept, list(CORNERS)).select((F.col("k") - 1).alias("face_id"), *CORNERS)


def with_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vertices with nx, ny, nz: the unit sum of their faces' normals by area; along z where it is zero."""
    u, v = ([F.col(f"{k}{x}") - F.col(f"a{x}") for x in AXES] for k in ("b", "c"))
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    each = cornered(vertices, faces).select(F.array(*CORNERS).alias("at"), *[e.alias(f"s{x}") for x, e in zip(AXES, n, strict=True)])
    sums = each.select(F.explode("at").alias("vertex_id"), "sx", "sy", "sz").groupBy("vertex_id").agg(*[F.sum(f"s{x}").alias(f"s{x}") for x in AXES])
    length = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz"))
    unit = [F.when(length > 0, F.col(f"s{x}") / length).otherwise(F.lit(float(x == "z"))).alias(f"n{x}") for x in AXES]
    return vertices.join(sums, "vertex_id", "left").select(*vertices.columns, *unit)


def encode_mesh(vertices: np.ndarray, colours: np.ndarray, normals: np.ndarray, faces: np.ndarray) -> bytes:
    """The mark, two counts, nine floats for each vertex and three places for each face, all little-endian."""
    vertices, colours, normals = (np.asarray(x, "<f4") for x in (vertices, colours, normals))
    faces = np.asarray(faces)
    shaped = all(x.ndim == 2 and x.shape == (len(vertices), 3) for x in (vertices, colours, normals)) and faces.ndim == 2 and faces.shape[1] == 3
    if not shaped or not len(vertices) or not len(faces):
        raise DataError("a mesh has vertices, colours and normals alike, and faces")
    if faces.dtype.kind not in "iu" or faces.min() < 0 or faces.max() >= len(vertices):
        raise DataError("faces must be places of vertices")
    if not all(np.isfinite(x).all() for x in (vertices, colours, normals)):
        raise DataError("finite places, colours and normals required")
    body = np.hstack([vertices, colours.clip(0, 1), normals]).astype("<f4")
    return MAGIC + struct.pack("<II", len(vertices), len(faces)) + body.tobytes() + faces.astype("<u4").tobytes()


def decode_mesh(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(vertices of nine floats, faces) of a binary mesh; one that is cut short or goes on is refused."""
    if content[:8] != MAGIC or len(content) < 16:
        raise DataError("not a mesh")
    n, m = struct.unpack("<II", content[8:16])
    if len(content) != 16 + 36 * n + 12 * m:
        raise DataError("a mesh of another size than it says")
    faces = np.frombuffer(content, "<u4", 3 * m, 16 + 36 * n).reshape(m, 3)
    if m and faces.max() >= n:
        raise DataError("faces must be places of vertices")
    return np.frombuffer(content, "<f4", 9 * n, 16).reshape(n, 9), faces


def mesh_bytes(vertices: DataFrame, faces: DataFrame, most: int = 150_000) -> bytes:
    """The binary form of a mesh of at most that many faces, whose vertices are at most three times as many."""
    f = at_most(faces, most, "faces").orderBy("face_id").select(*CORNERS).toPandas()
    v = at_most(with_normals(vertices, faces), 3 * most, "vertices").orderBy("vertex_id").toPandas()
    places = np.searchsorted(v["vertex_id"].to_numpy(), f.to_numpy())
    return encode_mesh(v[[*AXES]].to_numpy(), v[[*COLOURS]].to_numpy(), v[["nx", "ny", "nz"]].to_numpy(), places)


def read_meshes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices with normals, faces) of binary meshes, each with its file's path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [*AXES, *COLOURS, "nx", "ny", "nz"]

    def part(pick, columns: list[str], key: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for p, content in zip(batch["path"], batch["content"], strict=True):
                    rows = pick(decode_mesh(content))
                    yield pd.DataFrame({"path": p, key: np.arange(len(rows)), **{c: rows[:, i] for i, c in enumerate(columns)}})

        return run

    vertices = files.mapInPandas(part(lambda x: x[0], names, "vertex_id"), "path string, vertex_id long, " + ", ".join(f"{c} double" for c in names))
    faces = files.mapInPandas(part(lambda x: x[1].astype(np.int64), list(CORNERS), "face_id"), "path string, face_id long, a long, b long, c long")
    return vertices, faces
