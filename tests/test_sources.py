"""Readers, writers and provenance: round trips and refusals."""

import json
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.schemas import DataError
from sightline.sources import files, provenance, sinks

EYE = [[1.0, 0.0, 0.0, 0.5], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]


def frame_table(spark):
    return spark.createDataFrame([(i, 1000 * i, f"c{i}", f"d{i}", (20.0, 20.0, 4.0, 4.0), False) for i in range(3)], "frame_id int, timestamp_us long, color_path string, depth_path string, intrinsics struct<fx:double,fy:double,cx:double,cy:double>, rotate_ccw boolean")


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "m.json")
    sinks.write_manifest(frame_table(spark), path, "set", "seq")
    got = files.read_manifest(spark, path, hashed=True).orderBy("ordinal").collect()
    assert [(r["frame_id"], r["timestamp_us"], r["intrinsics"]["fx"], r["dataset"]) for r in got] == [(i, 1000 * i, 20.0, "set") for i in range(3)]
    with pytest.raises(FileExistsError):
        sinks.write_manifest(frame_table(spark), path, "set", "seq")
    body = json.loads(open(path).read())
    body["frames"][2]["timestamp_us"] = 5
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps(body))
    with pytest.raises(DataError, match="digest"):
        files.read_manifest(spark, str(bad), hashed=True)
    with pytest.raises(DataError, match="fall"):
        files.read_manifest(spark, str(bad))
    bad.write_text(json.dumps({**body, "schema": "other"}))
    with pytest.raises(DataError, match="schema"):
        files.read_manifest(spark, str(bad))


def test_trajectory(spark, tmp_path):
    poses = spark.createDataFrame([(i, 1000 * i, sum(EYE, []), True, "x") for i in range(2)], "frame_id int, timestamp_us long, t_world_camera array<double>, valid boolean, source string")
    path = str(tmp_path / "t.json")
    sinks.write_trajectory(poses, path, "seq")
    assert [r["t_world_camera"][3] for r in files.read_trajectory(spark, path, hashed=True).collect()] == [0.5, 0.5]
    body = json.loads(open(path).read())
    body["poses"][0]["t_world_camera"][0][0] = 2.0
    (tmp_path / "bad.json").write_text(json.dumps(body))
    with pytest.raises(DataError, match="rigid"):
        files.read_trajectory(spark, str(tmp_path / "bad.json"))


def test_legacy_trajectory(spark, tmp_path):
    m = "0 -1 0 1000 1 0 0 2000 0 0 1 3000 0 0 0 1"
    (tmp_path / "l.txt").write_text(f"# head\n7 70 {m}\n\n8 80 {m}\n")
    r = files.read_legacy_trajectory(spark, str(tmp_path / "l.txt"), [8]).collect()
    assert len(r) == 1 and np.allclose(np.array(r[0]["t_world_camera"]).reshape(4, 4), np.linalg.inv(np.array(m.split(), float).reshape(4, 4) * np.array([[1, 1, 1, 1e-3]] * 3 + [[1, 1, 1, 1]])))
    (tmp_path / "s.txt").write_text("1 2 3\n")
    with pytest.raises(DataError, match="18"):
        files.read_legacy_trajectory(spark, str(tmp_path / "s.txt"))


def test_ply(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), 0.5, -1.0, i % 3) for i in range(20)], "point_id long, x double, y double, z double, semantic_id int")
    sinks.write_ply(df, str(tmp_path / "a.ply"))
    got = files.read_ply(spark, str(tmp_path / "a.ply"), ["x", "semantic_id"]).orderBy("point_id").collect()
    assert [(r["point_id"], r["x"], r["semantic_id"]) for r in got] == [(i, float(i), float(i % 3)) for i in range(20)]
    ascii_ = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty int k\nelement face 0\nend_header\n1.5 2\n2.5 3\n"
    assert files.ply_vertices(ascii_)["k"].tolist() == [2, 3]
    with pytest.raises(DataError):
        files.ply_vertices(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int q\nend_header\n")
    with pytest.raises(DataError):
        files.ply_vertices(b"nothing")


def test_npz_and_dictionary(spark, tmp_path):
    np.savez(tmp_path / "a.npz", s=np.array([[1, 2], [3, 4]]))
    assert [r["value"] for r in files.read_npz(spark, str(tmp_path / "a.npz"), ["s"]).orderBy("place").collect()] == [1, 2, 3, 4]
    (tmp_path / "d.json").write_text('{"0": "unknown", "4": "cup"}')
    assert sorted(tuple(r) for r in files.read_dictionary(spark, str(tmp_path / "d.json")).collect()) == [(0, "unknown"), (4, "cup")]
    (tmp_path / "e.json").write_text('{"0": "cup"}')
    with pytest.raises(DataError):
        files.read_dictionary(spark, str(tmp_path / "e.json"))


def packet(index, parts, damage=False):
    head = json.dumps({"index": index, "payloads": [{"bytes": len(p), "crc32": zlib.crc32(p)} for p in parts]}).encode()
    return files.PACKET_MAGIC + struct.pack(">I", len(head)) + head + b"".join(parts)[: -1 if damage else None]


def test_packets(spark, tmp_path):
    for i in (1, 0):
        (tmp_path / f"p{i}.bin").write_bytes(packet(i, [b"a" * (i + 1), b"b", b"c"]))
    assert [(r["index"], bytes(r["color"])) for r in files.read_packets(spark, str(tmp_path / "*.bin")).collect()] == [(0, b"a"), (1, b"aa")]
    for bad in (b"xx", packet(0, [b"a", b"b", b"c"], True), packet(0, [b"a", b"b"])):
        with pytest.raises(DataError):
            files.decode_packet(bad)


def test_inventory(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "COMPLETE").write_text("")
    body = sinks.inventory({"a": str(tmp_path / "a.txt")}, str(tmp_path), "s", "d", ("a",))
    (tmp_path / "artifacts.json").write_text(json.dumps(body))
    assert provenance.load_inventory(spark, str(tmp_path)).count() == 1
    (tmp_path / "a.txt").write_text("two")
    with pytest.raises(DataError, match="differ"):
        provenance.load_inventory(spark, str(tmp_path))
    (tmp_path / "FAILURE").write_text("")
    with pytest.raises(DataError, match="failed"):
        provenance.load_inventory(spark, str(tmp_path))
    with pytest.raises(ValueError):
        sinks.inventory({}, str(tmp_path), "s", "d", ("a",))


def test_checkpoints(spark, tmp_path):
    store = sinks.Checkpoints(spark, f"file://{tmp_path}/stages")
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [store.run("s", {"v": 1}, make).count() for _ in range(2)] == [3, 3] and len(made) == 1
    assert store.restore("s", {"v": 2}) is None


def test_map_export(spark):
    p = spark.createDataFrame([(1, 0.0, 9), (2, 1.0, 8)], "point_id long, x double, red int")
    labels = spark.createDataFrame([(1, 3, 4, 0.5)], "point_id long, semantic_id int, instance_id int, semantic_confidence double")
    out = sinks.labelled_map(p, labels)
    got = {r["point_id"]: (r["red"], r["semantic_id"], r["instance_red"]) for r in out.collect()}
    assert got == {1: (9, 3, 50 + 4 * 37 % 206), 2: (8, 0, 90)}
    assert sinks.label_coverage(out).first()["semantic_coverage"] == 0.5


def test_wireless(spark):
    good = (640, 480, 1000, "color", [1.0, 1.0, 1.0, 1.0], 100_000, 110_000, 1, 1, 0.1, 5.0)
    rows = [good, (*good[:2], 1, *good[3:]), (*good[:6], 120_001, *good[7:]), (*good[:4], [1.0, float("nan"), 1.0, 1.0], *good[5:])]
    df = spark.createDataFrame(rows, "width int, height int, depth_scale int, alignment string, intrinsics array<double>, timestamp_us long, depth_timestamp_us long, sensor_frame_id long, depth_frame_id long, min_depth_m double, max_depth_m double")
    assert files.valid_wireless(df).count() == 1


def test_plans_and_receipts(spark):
    f = spark.createDataFrame([(i, i, 10 * i) for i in range(4)], "ordinal long, frame_id int, timestamp_us long")
    assert provenance.receipt_valid(f, f) and not provenance.receipt_valid(f, f.limit(3))
    assert provenance.frames_from_plan(f, [0, 2], True).count() == 2
    for ids, ok in (([2, 0], True), ([0, 9], True), ([0], False)):
        with pytest.raises(DataError):
            provenance.frames_from_plan(f, ids, ok)
    assert provenance.selection_budget(10, 3) == 4 and provenance.selection_budget(10, 3, 5) == 5
    with pytest.raises(ValueError):
        provenance.selection_budget(10, 3, True)
    s = spark.createDataFrame([(True, True, False, False, 3), (False, False, False, False, 2), (False, False, False, False, 0)], "failed boolean, complete boolean, running boolean, sealed boolean, frames int")
    assert [r["status"] for r in provenance.session_status(s).collect()] == ["failed", "partial", "empty"]


def test_digest_of_pandas_round_trip():
    assert files.ply_vertices(files.ply_bytes(pd.DataFrame({"x": [1.0], "k": [2]})))["k"][0] == 2
    assert files.digest({"b": 1, "a": 2}) == files.digest({"a": 2, "b": 1})
    with pytest.raises(ValueError):
        files.digest({"a": float("nan")})


def test_hash_audit(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    r = sinks.hash_audit(spark, str(tmp_path / "*.bin")).select("bytes", F.substring("sha256", 1, 8)).first()
    assert tuple(r) == (3, "ba7816bf")


def test_highlighted_instances(spark):
    points = spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, 0), (5, None)], "point_id long, instance_id long")
    got = {r["point_id"]: r["highlighted"] for r in sinks.highlighted(points, [7, 7]).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False}
    assert not any(r["highlighted"] for r in sinks.highlighted(points, []).collect())
    for wrong in ([9], [5, 8], [0], [-1], ["5"], [True], [5.0]):
        with pytest.raises(ValueError):
            sinks.highlighted(points, wrong)
