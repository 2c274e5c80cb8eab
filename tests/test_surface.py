"""Meshes: simplification against a plain version, the binary form, surfaces bound to their inputs."""

import json
import os
import struct

import numpy as np
import pandas as pd
import pytest

from sightline.operators import surface
from sightline.schemas import DataError
from sightline.sources import surfaces
from sightline.sources.files import ply_faces, ply_mesh_bytes, read_ply_mesh
from sightline.sources.provenance import file_digest


def sphere(n=24, m=48, centre=(5.0, -3.0, 100.0)):
    """A closed mesh of a unit sphere: poles and rings, faces turned outwards."""
    places = [(0, 0, 1)] + [(np.sin(np.pi * i / n) * np.cos(2 * np.pi * j / m), np.sin(np.pi * i / n) * np.sin(2 * np.pi * j / m), np.cos(np.pi * i / n)) for i in range(1, n) for j in range(m)] + [(0, 0, -1)]
    at = lambda i, j: 1 + (i - 1) * m + j % m
    faces = [(0, at(1, j), at(1, j + 1)) for j in range(m)] + [(len(places) - 1, at(n - 1, j + 1), at(n - 1, j)) for j in range(m)]
    faces += [f for i in range(1, n - 1) for j in range(m) for f in ((at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1)))]
    return np.array(places, float) + centre, np.array(faces)


def tables(spark, places, faces, colours=None):
    colours = np.full(places.shape, 0.5) if colours is None else colours
    v = spark.createDataFrame([(i, *map(float, p), *map(float, c)) for i, (p, c) in enumerate(zip(places, colours, strict=True))], "vertex_id long, x double, y double, z double, red double, green double, blue double")
    return v, spark.createDataFrame([(i, *map(int, f)) for i, f in enumerate(faces)], "face_id long, a long, b long, c long")


def clustered_by_force(places, faces, cells):
    """{cell: place}, {faces as turned triples of cells}, by loops and a solver."""
    low, side = places.min(0), np.ptp(places, 0).max()
    at = np.minimum(cells - 1, np.floor((places - low) / (side / cells))).astype(int)
    name = [tuple(x) for x in at]
    quadric, members, kept = {}, {}, set()
    for i, c in enumerate(name):
        members.setdefault(c, []).append(places[i] - low)
    for f in faces:
        p = places[f] - low
        n = np.cross(p[1] - p[0], p[2] - p[0])
        for k in f:
            a, r = quadric.setdefault(name[k], [np.zeros((3, 3)), np.zeros(3)])
            a += np.outer(n, n)
            r += n * (n @ p[0])
        c = [name[k] for k in f]
        if len(set(c)) == 3:
            k = c.index(min(c))
            kept.add((*c[k:], *c[:k]))
    out = {}
    for c in {x for f in kept for x in f}:
        a, r = quadric[c]
        pull = np.trace(a) * surface.PULL / 3
        mean = np.mean(members[c], 0)
        best = np.linalg.solve(a + pull * np.eye(3), r + pull * mean)
        start = np.array(c) * (side / cells)
        out[c] = np.clip(best, start, start + side / cells) + low
    return out, kept


def unpacked(c):
    return c >> 42, (c >> 21) & (surface.FINEST - 1), c & (surface.FINEST - 1)


@pytest.mark.parametrize("cells", [3, 7, 20])
def test_clusters_against_brute_force(spark, cells):
    places, faces = sphere()
    v, f = surface.clustered(*tables(spark, places, faces), cells)
    want, kept = clustered_by_force(places, faces, cells)
    assert {tuple(unpacked(c) for c in r) for r in f.select("a", "b", "c").collect()} == kept
    got = {unpacked(r["cell"]): (r["x"], r["y"], r["z"]) for r in v.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


@pytest.mark.parametrize("most", [10_000, 2207, 700, 60, 14])
def test_never_more_faces_than_asked_for(spark, most):
    places, faces = sphere()
    v, f = surface.simplified(*tables(spark, places, faces), most)
    rows, points = f.collect(), {r["vertex_id"]: np.array([r["x"], r["y"], r["z"]]) for r in v.collect()}
    assert 0 < len(rows) <= most and (most < 100 or len(rows) >= most / 3 or len(rows) == len(faces))
    assert {r[k] for r in rows for k in "abc"} == points.keys() == set(range(len(points))) or len(rows) == len(faces)
    assert all(len({r["a"], r["b"], r["c"]}) == 3 for r in rows)
    if most >= 700:  # still the sphere: the quadrics keep the points on it
        assert max(abs(np.linalg.norm(p - (5, -3, 100)) - 1) for p in points.values()) < 0.02


def test_sharp_edges_stay(spark):
    """A box's corner is where its three planes meet, not the mean of the points near it."""
    n = 12
    grid = [(i / n, j / n) for i in range(n + 1) for j in range(n + 1)]
    places, faces = [], []
    for axis in range(3):
        base = len(places)
        places += [tuple(np.insert(g, axis, 0.0)) for g in grid]
        faces += [t for i in range(n) for j in range(n) for k in [base + i * (n + 1) + j] for t in ((k, k + 1, k + n + 2), (k, k + n + 2, k + n + 1))]
    v, _ = surface.clustered(*tables(spark, np.array(places), np.array(faces)), 3)
    assert min(np.linalg.norm([r["x"], r["y"], r["z"]]) for r in v.collect()) < 0.01


def test_refusals(spark):
    places, faces = sphere(4, 6)
    v, f = tables(spark, places, faces)
    surface.check_mesh(v, f)
    bad = places.copy()
    bad[0, 0] = np.nan
    for wrong in (tables(spark, bad, faces), (v, f.limit(0)), (v, tables(spark, places, [(0, 1, 99)])[1]), (v.union(v.limit(1)), f)):
        with pytest.raises(DataError):
            surface.check_mesh(*wrong)
    with pytest.raises(ValueError, match="at least one"):
        surface.simplified(v, f, 0)
    with pytest.raises(DataError, match="coarse"):  # any grid of two cells a side leaves more
        surface.simplified(*tables(spark, *sphere()), 1)


def test_colours_and_normals(spark):
    places, faces = sphere()
    colours = np.where(places[:, :1] < 5, [[1.0, 0, 0]], [[0, 0, 1.0]])
    v, f = surface.simplified(*tables(spark, places, faces, colours), 600)
    for r in surface.with_normals(v, f).collect():
        out = np.array([r["x"], r["y"], r["z"]]) - (5, -3, 100)
        assert out @ [r["nx"], r["ny"], r["nz"]] > 0.9
        assert abs(r["red"] + r["blue"] - 1) < 1e-9 and (abs(out[0]) < 0.2 or (r["red"] > 0.99) == (out[0] < 0))
    alone = v.limit(1).withColumn("vertex_id", v.vertex_id + 10_000)
    assert [(r["nx"], r["ny"], r["nz"]) for r in surface.with_normals(alone, f).collect()] == [(0, 0, 1)]


def test_binary_form(spark, tmp_path):
    eye = np.eye(3)
    content = surface.encode_mesh(eye, eye * 2, eye, np.array([[0, 1, 2]]))
    assert content[:8] == b"RVMESH01" and struct.unpack("<II", content[8:16]) == (3, 1)
    assert np.frombuffer(content[-12:], "<u4").tolist() == [0, 1, 2] and surface.decode_mesh(content)[0][:, 3:6].max() == 1
    nan = eye.copy()
    nan[0, 0] = np.nan
    for wrong in ((eye, eye, eye, [[0, 1, 3]]), (eye, eye, eye, [[0.0, 1.0, 2.0]]), (nan, eye, eye, [[0, 1, 2]]), (eye, eye[:2], eye, [[0, 1, 2]]), (eye, eye, eye, np.zeros((0, 3), int))):
        with pytest.raises(DataError):
            surface.encode_mesh(*map(np.asarray, wrong))
    for wrong in (content[:-1], content + b"x", b"RVMESH02" + content[8:]):
        with pytest.raises(DataError):
            surface.decode_mesh(wrong)
    places, faces = sphere(6, 8)
    v, f = tables(spark, places, faces)
    (tmp_path / "a.bin").write_bytes(surface.mesh_bytes(v, f))
    back_v, back_f = surface.read_meshes(spark, str(tmp_path / "*.bin"))
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in back_v.orderBy("vertex_id").collect()], places, atol=1e-5)
    assert [(r["a"], r["b"], r["c"]) for r in back_f.orderBy("face_id").collect()] == [tuple(x) for x in faces.tolist()]


def test_ply_meshes(spark, tmp_path):
    places, faces = sphere(5, 7)
    table = pd.DataFrame(places, columns=list("xyz"))
    for coloured in (False, True):
        own = table.assign(red=np.arange(len(table)) % 256, green=0, blue=255) if coloured else table
        path = tmp_path / f"{coloured}.ply"
        path.write_bytes(ply_mesh_bytes(own, faces))
        v, f = read_ply_mesh(spark, str(path))
        rows = v.orderBy("vertex_id").collect()
        assert np.allclose([[r["x"], r["y"], r["z"]] for r in rows], places) and (rows[1]["red"], rows[1]["blue"]) == ((1 / 255, 1.0) if coloured else (0.65, 0.72))
        assert [(r["a"], r["b"], r["c"]) for r in f.orderBy("face_id").collect()] == [tuple(x) for x in faces.tolist()]
    text = b"ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n0 1 0\n"
    assert ply_faces(text + b"3 0 1 2\n").tolist() == [[0, 1, 2]]
    for wrong in (b"4 0 1 2 0\n", b"3 0 1 3\n"):
        with pytest.raises(DataError):
            ply_faces(text + wrong)


@pytest.fixture
def session(tmp_path):
    """A finished session's files and its receipt."""
    folder = tmp_path / "session" / "pipeline"
    folder.mkdir(parents=True)
    places, faces = sphere()
    (folder / "mesh.ply").write_bytes(ply_mesh_bytes(pd.DataFrame(places, columns=list("xyz")), faces))
    paths = {k: str(folder / n) for k, n in (("map", "map.ply"), ("manifest", "manifest.json"), ("trajectory", "trajectory.json"))}
    for k, p in paths.items():
        with open(p, "w") as f:
            f.write(k)
    receipt = {"status": "completed", "gt_consumed": False, "identity_fallback_used": False, "mesh": str(folder / "mesh.ply"), "mesh_sha256": file_digest(str(folder / "mesh.ply")), "mesh_vertices": len(places), "mesh_triangles": len(faces), "voxel_length_m": 0.02, "integrated_frame_count": 3} | {f"{k}_sha256": file_digest(paths[k]) for k in ("manifest", "trajectory")}
    (folder / "receipt.json").write_text(json.dumps(receipt))
    return folder, paths, receipt


def publish(spark, folder, paths, most=500):
    return surfaces.publish(spark, str(folder), paths["map"], paths["manifest"], paths["trajectory"], str(folder / "receipt.json"), most)


def load(folder, paths, **other):
    return surfaces.load(str(folder), str(folder.parent), paths["map"], paths["trajectory"], **other)


def test_publish_and_load(spark, session):
    folder, paths, receipt = session
    assert load(folder, paths) is None
    before = {p: p.read_bytes() for p in folder.iterdir()}
    index = publish(spark, folder, paths)
    assert all(p.read_bytes() == x for p, x in before.items())
    found = load(folder, paths)
    meta = found["metadata"]
    assert meta["triangles"] == receipt["mesh_triangles"] and 0 < meta["viewer_triangles"] <= 500 and meta["revision"] == file_digest(index)
    v, f = surface.decode_mesh(open(found["paths"]["viewer"], "rb").read())
    assert (len(v), len(f)) == (meta["viewer_vertices"], meta["viewer_triangles"]) and np.allclose(meta["bounds"]["min"], v[:, :3].min(0))
    listed = surfaces.session_surfaces(spark, str(folder / "SURFACE.json")).collect()
    assert {r["name"]: r["sha256"] for r in listed} == found["hashes"] and {r["triangles"] for r in listed} == {meta["triangles"]}
    with pytest.raises(FileExistsError):
        publish(spark, folder, paths)


@pytest.mark.parametrize(("key", "value"), [("status", "failed"), ("gt_consumed", True), ("identity_fallback_used", None), ("manifest_sha256", "0"), ("trajectory_sha256", "0"), ("mesh_sha256", "0"), ("mesh_vertices", 1), ("mesh_triangles", 1)])
def test_receipts_that_do_not_bind(spark, session, key, value):
    folder, paths, receipt = session
    (folder / "receipt.json").write_text(json.dumps(receipt | {key: value}))
    with pytest.raises(DataError):
        publish(spark, folder, paths)
    assert not (folder / "SURFACE.json").exists()


def test_changed_or_foreign_surfaces_are_refused(spark, session, tmp_path):
    folder, paths, receipt = session
    index = publish(spark, folder, paths)
    body = json.loads(open(index).read())
    viewer = load(folder, paths)["paths"]["viewer"]
    with pytest.raises(DataError, match="not completed"):
        load(folder, paths, status="failed")
    with pytest.raises(DataError, match="another map"):
        surfaces.load(str(folder), str(folder.parent), paths["manifest"], paths["trajectory"])
    for name in surfaces.BOUND:  # each file is checked by its bytes
        path = os.path.join(folder, body["files"][name]["path"])
        old = open(path, "rb").read()
        with open(path, "wb") as f:
            f.write(old + b" ")
        with pytest.raises(DataError, match=name):
            load(folder, paths)
        with open(path, "wb") as f:
            f.write(old)
    assert load(folder, paths)
    outside = tmp_path / "outside.bin"
    outside.write_bytes(open(viewer, "rb").read())
    for change in ({"viewer": {"path": os.path.relpath(outside, folder), "sha256": file_digest(str(outside))}}, {"viewer": {"path": "gone", "sha256": "0"}}):
        with open(index, "w") as f:
            f.write(json.dumps(body | {"files": body["files"] | change}))
        with pytest.raises(DataError, match="viewer"):
            load(folder, paths)
    with open(index, "w") as f:
        f.write(json.dumps(body | {"schema": "other"}))
    with pytest.raises(DataError, match="schema"):
        load(folder, paths)
