"""Co-visibility fusion, container indices and the command line."""

import json
import struct

import pytest

from sightline.__main__ import main
from sightline.operators import identity
from sightline.schemas import DataError
from sightline.sources import containers


def tables(spark, nodes, seen, base):
    n = spark.createDataFrame([(k, f, p) for k, f, ps in nodes for p in ps], "node_id long, frame_id long, point_id long")
    v = spark.createDataFrame([(f, p) for f, ps in seen for p in ps], "frame_id long, point_id long")
    b = spark.createDataFrame(base, "point_id long, semantic_id int, instance_id long")
    return n, v, b


def test_birth_and_cannot_link(spark):
    left, right = range(0, 100), range(100, 200)
    nodes = [(0, 1, left), (1, 2, left), (2, 1, right), (3, 2, right)]
    n, v, b = tables(spark, nodes, [(1, range(200)), (2, range(200))], [(p, 0, 0) for p in range(200)] + [(900, 3, 7)])
    pairs = {(r["a"], r["b"]): (r["covisible_iou"], r["cannot_link"]) for r in identity.pair_scores(n, v).collect()}
    assert pairs[(0, 1)] == (1.0, False) and pairs[(0, 3)] == (0.0, True)
    points, groups = identity.graph_fusion(n, v, b)
    got = {}
    for r in points.collect():
        got.setdefault(r["instance_id"], set()).add(r["point_id"])
    assert got == {8: set(left), 9: set(right)}
    assert {r["kind"] for r in groups.collect()} == {"birth"}


def test_completion_and_rejections(spark):
    body = range(0, 200)
    base = [(p, 4 if p < 140 else 0, 5 if p < 140 else 0) for p in body]
    n, v, b = tables(spark, [(0, 1, body), (1, 2, body), (2, 3, range(0, 40))], [(1, body), (2, body), (3, range(300, 400))], base)
    points, groups = identity.graph_fusion(n, v, b, complete=True)
    assert {(r["point_id"], r["instance_id"]) for r in points.collect()} == {(p, 5) for p in range(140, 200)}
    kinds = {r["group_id"]: r["kind"] for r in groups.collect()}
    assert kinds == {0: "complete", 2: "one_frame_only"}
    assert identity.graph_fusion(n, v, b)[0].count() == 0


def test_anchored_choices(spark):
    rows = [("r", 0, 10, 1, 0.9, True, p) for p in range(50)] + [("r", 1, 11, 1, 0.8, False, p) for p in range(45)] + [("r", 1, 11, 2, 0.99, False, p) for p in range(100, 150)] + [("r", 2, 12, 3, 0.7, False, p) for p in range(0, 50, 5)]
    c = spark.createDataFrame(rows, "region_id string, view int, frame_id long, mask_id int, score double, chosen boolean, point_id long")
    v = spark.createDataFrame([(f, p) for f in (10, 11) for p in range(160)] + [(12, p) for p in range(20)], "frame_id long, point_id long")
    seeds = spark.createDataFrame([("r", p) for p in range(20)], "region_id string, point_id long")
    got = {(r["view"], r["mask_id"]) for r in identity.anchored_choices(c, v, seeds).collect()}
    assert got == {(0, 1), (1, 1)}


def test_container_index(spark, tmp_path):
    frames = [(b"jpeg0", b"zz"), (b"j1", b"depth1")]
    head = struct.pack("<IQ", 4, 3) + b"abc" + bytes(256) + struct.pack("<iiIIIIfQ", 2, 1, 4, 4, 4, 4, 1000.0, len(frames))
    body = b"".join(bytes(80) + struct.pack("<QQ", len(c), len(d)) + c + d for c, d in frames)
    (tmp_path / "a.sens").write_bytes(head + body)
    raw = head + body
    got = containers.read_container_index(spark, [str(tmp_path / "a.sens")]).orderBy("frame_id").collect()
    assert [(raw[r["color_offset"] : r["color_offset"] + r["color_bytes"]], raw[r["depth_offset"] : r["depth_offset"] + r["depth_bytes"]]) for r in got] == frames
    (tmp_path / "b.sens").write_bytes(struct.pack("<I", 3))
    with pytest.raises(DataError), (tmp_path / "b.sens").open("rb") as f:
        list(containers.payload_index(f))


def test_commands(spark, tmp_path, capsys):
    assert main(["demo"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["instance_ids"] for x in lines] == [[2], [3]]
    from sightline.sources.files import demo_scene

    points, _ = demo_scene(spark)
    points.write.parquet(str(tmp_path / "p"))
    (tmp_path / "c.json").write_text('{"0": "unknown", "1": "table", "2": "cup", "3": "chair"}')
    assert main(["build-scene-graph", str(tmp_path / "p"), str(tmp_path / "c.json"), str(tmp_path / "g"), "--up", "0", "0", "1"]) == 0
    assert main(["query-scene", str(tmp_path / "g"), "--question", "how many chairs are there", "--up", "0", "0", "1"]) == 0
    assert json.loads([x for x in capsys.readouterr().out.splitlines() if x.startswith("{")][-1])["instance_ids"] == [3]
    assert main(["clean-pointcloud", str(tmp_path / "p"), str(tmp_path / "k"), "--radius", "0.3", "--neighbours", "1"]) == 0
