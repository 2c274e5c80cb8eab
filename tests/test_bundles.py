"""Bundles and workspaces: sealed from the tasks' digests, refused when anything differs; trees of digests."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.errors import PythonException

from sightline.functions.geometry import eroded
from sightline.operators.measured import packed_masks
from sightline.schemas import DataError
from sightline.sources import bundles, workspaces
from sightline.sources.provenance import file_digest


def files_of(spark, n=20):
    return spark.createDataFrame([(f"part{i % 3}/f{i}.bin", bytes([i]) * (i * 100)) for i in range(n)], "name string, content binary")


@pytest.fixture
def sealed(spark, tmp_path):
    root = str(tmp_path / "bundle")
    return root, bundles.write_bundle(files_of(spark).repartition(4), root, scene="s", point_count=7)


def test_round_trip(spark, sealed):
    root, body = sealed
    assert body["scene"] == "s" and body["point_count"] == 7 and len(body["files"]) == 20
    assert {(r["name"], bytes(r["content"])) for r in bundles.read_bundle(spark, root).collect()} == {(r["name"], bytes(r["content"])) for r in files_of(spark).collect()}
    assert all(v["sha256"] == file_digest(os.path.join(root, n)) and v["bytes"] == os.path.getsize(os.path.join(root, n)) for n, v in body["files"].items())
    with pytest.raises(FileExistsError):
        bundles.write_bundle(files_of(spark), root)


def test_what_differs_is_refused_by_name(spark, sealed):
    root, _ = sealed
    path = os.path.join(root, "part1/f7.bin")
    old = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(old[:-1] + b"x")
    with pytest.raises(PythonException, match="part1/f7.bin"):
        bundles.read_bundle(spark, root).collect()
    os.unlink(path)
    with pytest.raises(DataError, match="missing from the bundle.*part1/f7.bin"):
        bundles.read_bundle(spark, root)
    with open(path, "wb") as f:
        f.write(old)
    bundles.read_bundle(spark, root).collect()
    with open(os.path.join(root, "extra"), "wb"):
        pass
    with pytest.raises(DataError, match="not of the bundle.*extra"):
        bundles.read_bundle(spark, root)
    os.unlink(os.path.join(root, "extra"))
    index = os.path.join(root, bundles.INVENTORY)
    body = json.load(open(index))
    body["scene"] = "other"
    with open(index, "w") as f:
        json.dump(body, f)
    with pytest.raises(DataError, match="inventory has changed"):
        bundles.read_bundle(spark, root)


@pytest.mark.parametrize("name", ["../out", "/abs", "", "a/../../b", bundles.INVENTORY, "x.pending"])
def test_names_stay_inside(spark, tmp_path, name):
    root = tmp_path / "bundle"
    with pytest.raises((DataError, PythonException), match="not a name"):
        bundles.inside(str(root), name)
    with pytest.raises(Exception, match="not a name"):
        bundles.write_bundle(spark.createDataFrame([(name, b"x")], "name string, content binary"), str(root))
    assert not root.exists() or not (root / bundles.INVENTORY).exists()


def test_equal_names_are_not_sealed(spark, tmp_path):
    root = tmp_path / "bundle"
    with pytest.raises(Exception, match="one name"):
        bundles.write_bundle(spark.createDataFrame([("a", b"x"), ("a", b"y")], "name string, content binary").repartition(2), str(root))
    assert not (root / bundles.INVENTORY).exists() and bundles.pending_files(str(root)) == []


def test_attempts_that_do_not_count(tmp_path):
    """What an attempt left that was lost after it wrote, or one that ran beside another, is no part of the bundle."""
    root = str(tmp_path / "bundle")
    lost = bundles.BundleWriter(root, {}).write(iter([{"name": "a/x", "content": b"1"}, {"name": "b", "content": b"2"}]))
    writer = bundles.BundleWriter(root, {})
    counted = writer.write(iter([{"name": "a/x", "content": b"1"}]))
    assert len(bundles.pending_files(root)) == 3
    writer.commit([counted, None])
    assert bundles.pending_files(root) == [] and set(bundles.inventory_of(root)["files"]) == {"a/x"}
    assert all(not os.path.exists(p) for _, p, _, _ in lost.files)
    other = bundles.BundleWriter(str(tmp_path / "second"), {})
    other.abort([other.write(iter([{"name": "c", "content": b"3"}]))])
    assert bundles.pending_files(str(tmp_path / "second")) == []


def test_empty_bundle(spark, tmp_path):
    root = str(tmp_path / "bundle")
    assert bundles.write_bundle(files_of(spark).limit(0), root)["files"] == {}
    assert bundles.read_bundle(spark, root).collect() == []


def test_evidence(spark, tmp_path):
    """All masks of each query, by the points on their interior pixels, through a bundle and back."""
    rng = random.Random(2)
    w, h = 9, 7
    pixels = [(f"q{q}", m, u, v) for q in range(3) for m in range(2) for u in range(w) for v in range(h) if rng.random() < 0.85]
    table = spark.createDataFrame(pixels, "query string, mask int, u int, v int")
    score = spark.createDataFrame([(f"q{q}", m, (q + m) / 10) for q in range(3) for m in range(2)], "query string, mask int, score double")
    masks = packed_masks(table, w, h, ["query", "mask"]).join(score, ["query", "mask"])
    projections = spark.createDataFrame([(f"q{q}", 100 * q + i, rng.randrange(w), rng.randrange(h)) for q in range(4) for i in range(50)], "query string, point_id long, u int, v int")
    root = str(tmp_path / "bundle")
    bundles.write_bundle(bundles.evidence_files(projections, masks, w, h), root)
    rows = bundles.bundle_evidence(bundles.read_bundle(spark, root)).collect()
    safe = {(r["query"], r["mask"], r["u"], r["v"]) for r in eroded(table, ("query", "mask")).collect()}
    points = projections.collect()
    assert {(r["query"], r["point_id"]) for r in rows if r["mask"] is None} == {(p["query"], p["point_id"]) for p in points}
    want = {(q, m, (int(q[1]) + m) / 10, p["point_id"]) for q, m, u, v in safe for p in points if (p["query"], p["u"], p["v"]) == (q, u, v)}
    assert want and {(r["query"], r["mask"], r["score"], r["point_id"]) for r in rows if r["mask"] is not None} == want


def result(tmp_path, candidates=True):
    out = tmp_path / "result"
    (out / "mapping").mkdir(parents=True)
    (out / "fused").mkdir()
    for name in ("fused/target.npz", "fused/map_labels.npz", "fused/classes.json", "manifest.json", "trajectory.json", "runtime.json"):
        (out / name).write_bytes(name.encode())
    (out / "mapping/mapping_result.json").write_text(json.dumps({"trajectory": str(out / "trajectory.json")}))
    if candidates:
        np.savez(out / "fused/candidates.npz", a=[1])
        (out / "fused/CANDIDATES.json").write_text(json.dumps({"candidates_sha256": file_digest(str(out / "fused/candidates.npz")), "labels_sha256": file_digest(str(out / "fused/map_labels.npz"))}))
    return out


def prepare(out):
    return workspaces.prepare(str(out), str(out / "manifest.json"), str(out / "runtime.json"))


@pytest.mark.parametrize("candidates", [True, False])
def test_workspace(spark, tmp_path, candidates):
    out = result(tmp_path, candidates)
    root = prepare(out)
    own = os.path.join(root, "inputs/capture")
    assert os.path.exists(os.path.join(own, "candidates.npz")) == candidates
    assert open(os.path.join(own, "base.npz"), "rb").read() == b"fused/map_labels.npz" and json.load(open(os.path.join(own, "INPUT.json")))["GT_used"] is False
    with pytest.raises(FileExistsError):
        prepare(out)
    workspaces.lock(spark, root)
    assert workspaces.validate(spark, root) == 8 + candidates
    with pytest.raises(FileExistsError):
        workspaces.lock(spark, root)
    with open(os.path.join(own, "base.npz"), "ab") as f:
        f.write(b"x")
    with open(os.path.join(own, "more"), "w") as f:
        f.write("x")
    with pytest.raises(DataError, match=r"base.npz', 'changed'.*more', 'extra'"):
        workspaces.validate(spark, root)
    os.unlink(os.path.join(own, "base.npz"))
    with pytest.raises(DataError, match="lacks"):
        workspaces.validate(spark, root)


def test_candidates_of_other_labels(tmp_path):
    out = result(tmp_path)
    (out / "fused/map_labels.npz").write_bytes(b"other labels")
    with pytest.raises(DataError, match="candidates"):
        prepare(out)


@pytest.mark.parametrize("scenes", [[], ["a", "a"], ["../x"], ["/abs"], None])
def test_scenes_of_a_workspace(tmp_path, scenes):
    (tmp_path / "INPUT_PLAN.json").write_text(json.dumps({"scenes": scenes}))
    with pytest.raises(DataError):
        workspaces.workspace_files(str(tmp_path))


def test_trees_find_changes(spark, tmp_path):
    names = [f"a/b{i}/c{j}/f{k}" for i in range(3) for j in range(2) for k in range(2)] + ["top", "a/side"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    look = lambda: spark.createDataFrame(workspaces.tree(workspaces.listing(spark, str(tmp_path)), "bytes", "time").collect(), "folder string, parent string, depth int, digest string")
    before = look()
    assert {r["folder"] for r in before.collect()} == {"", "a", *{os.path.dirname(os.path.dirname(n)) for n in names[:12]}, *{os.path.dirname(n) for n in names[:12]}}
    assert workspaces.changed_folders(before, look()) == []
    (tmp_path / "a/b1/c0/f0").write_text("changed text")
    (tmp_path / "a/b2/new").write_text("x")
    assert workspaces.changed_folders(before, look()) == ["", "a", "a/b1", "a/b1/c0", "a/b2"]
    assert workspaces.changed_folders(before, before.where("folder not like 'a/b0%'")) == []  # its digest in "a" has not changed: it is not looked at
