"""Online association: the indexed batch against a scan of all tracks, and streams cut anywhere against the batch."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators.iterative import online_association
from sightline.streaming import tracks

COLUMNS = ["stream", "frame_id", "mask_id", "class_id", "point_id"]
RULES = {"least": 3, "overlap": 0.3, "gap": 0.15}


def by_scan(rows, least, overlap, gap):
    """{(stream, frame, mask): track}, each mask compared with every track's set of points."""
    out = {}
    for stream in sorted({r[0] for r in rows}):
        held = []
        for frame in sorted({r[1] for r in rows if r[0] == stream}):
            used = set()
            seen = [r for r in rows if r[:2] == (stream, frame) and r[2] > 0]
            for mask in sorted({r[2] for r in seen}):
                points, classes = {r[4] for r in seen if r[2] == mask}, {r[3] for r in seen if r[2] == mask}
                if len(points) < least or len(classes) != 1 or min(classes) <= 0:
                    continue
                near = []
                for k, (category, own) in enumerate(held):
                    n = len(points & own)
                    if {category} == classes and k not in used and n >= least and n / min(len(points), len(own)) >= overlap:
                        near.append((n / min(len(points), len(own)), k))
                near.sort(reverse=True)
                if len(near) > 1 and near[0][0] - near[1][0] < gap:
                    continue
                if near:
                    k = near[0][1]
                    held[k][1].update(points)
                else:
                    k = len(held)
                    held.append((min(classes), set(points)))
                used.add(k)
                out[stream, frame, mask] = k + 1
    return out


def made(seed, streams=("a", "b"), frames=14):
    """Masks of moving windows of points, of mixed classes at times, that meet, part and come in copies."""
    rng = random.Random(seed)
    rows = []
    for stream in streams:
        for frame in range(frames):
            for mask in range(rng.randrange(5)):
                start, size = rng.randrange(0, 60) * 97, rng.randrange(1, 14)
                category = rng.choice([1, 1, 1, 2, 0])
                rows += [(stream, frame, mask, 2 if rng.random() < 0.01 else category, start + 97 * rng.randrange(size)) for _ in range(size)]
    return rows


def given(result):
    return {(r["stream"], r["frame_id"], r["mask_id"]): r["track_id"] for r in result.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_against_a_scan(spark, seed, monkeypatch):
    rows = made(seed)
    want = by_scan(rows, **RULES)
    assert given(online_association(spark.createDataFrame(rows, COLUMNS), **RULES)) == want and max(want.values()) > 5
    for part in (1, 7, 1 << 40):  # whatever the parts of the index
        monkeypatch.setattr(tracks, "PART", part)
        for stream in ("a", "b"):
            own, got = tracks.Association(*RULES.values()), {}
            table = pd.DataFrame([r for r in rows if r[0] == stream], columns=COLUMNS)
            for frame, seen in table.groupby("frame_id"):
                got |= {(stream, frame, m): k for m, k in own.add_frame(seen)}
            assert got == {k: v for k, v in want.items() if k[0] == stream}


def run_stream(spark, tmp_path, batches, name):
    """Each batch is a file, and each file a micro-batch."""
    folder = tmp_path / name
    (folder / "in").mkdir(parents=True)
    kind = "stream string, frame_id long, mask_id long, class_id long, point_id long"
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    out = tracks.track_stream(source, **RULES).writeStream.format("parquet").outputMode("append").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state"))
    for i, rows in enumerate(batches):
        pd.DataFrame(rows, columns=COLUMNS).to_json(folder / "in" / f"{i:04}.json", orient="records", lines=True)
        if i in (len(batches) // 2, len(batches) - 1):  # a query that is stopped goes on from its state
            query = out.trigger(availableNow=True).start()
            assert query.awaitTermination(300)
    return spark.read.parquet(str(folder / "out")).collect()


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("cut", ["frames", "anywhere"])
def test_stream_is_the_batch(spark, tmp_path, rocks, cut):
    """In order of frames, cut between any two rows, within a mask too."""
    rows = sorted(made(3, frames=8), key=lambda r: (r[1], r[2]))
    rng = random.Random(4)
    if cut == "frames":
        batches = [[r for r in rows if r[1] == f] for f in range(8)]
    else:
        at = sorted(rng.sample(range(1, len(rows)), 4))
        batches = [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)], strict=True)]
        for b in batches:
            rng.shuffle(b)
    batches.append([(s, 8, 0, 0, 0) for s in ("a", "b")])  # closes the last frames
    got = run_stream(spark, tmp_path, batches, f"tracks_{cut}")
    assert {(r["stream"], r["frame_id"], r["mask_id"]): r["track_id"] for r in got} == by_scan(rows, **RULES)
    assert not any(r["late"] for r in got)


def test_late_rows(spark, tmp_path, rocks):
    one = [("a", 5, 1, 1, p) for p in range(6)]
    batches = [one, [("a", 6, 1, 1, p) for p in range(6)], [("a", 4, 2, 1, 1), ("a", 4, 2, 1, 2), ("a", 7, 0, 0, 0)]]
    got = run_stream(spark, tmp_path, batches, "tracks_late")
    assert sorted((r["frame_id"], r["mask_id"], r["track_id"], r["late"]) for r in got if not r["late"]) == [(5, 1, 1, False), (6, 1, 1, False)]
    assert [(r["frame_id"], r["mask_id"], r["track_id"]) for r in got if r["late"]] == [(4, 2, None)]


def test_another_store_is_refused(spark, rocks):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.example.Other")
    with pytest.raises(ValueError, match="RocksDB"):
        tracks.track_stream(spark.createDataFrame([], "stream string, frame_id long, mask_id long, class_id long, point_id long"))


def test_a_mask_reads_its_own_parts():
    """Neither the whole index nor all tracks are read for a mask."""
    asked = []
    own = tracks.Association(3, 0.3, 0.15, 1000, lambda k: asked.append(k), lambda k: pytest.fail("no track is near"))
    own.add_frame(pd.DataFrame({"mask_id": 1, "class_id": 1, "point_id": np.arange(50) + 10_000 * tracks.PART}))
    assert list(own.add_frame(pd.DataFrame({"mask_id": 1, "class_id": 1, "point_id": np.arange(50) + 10_000 * tracks.PART}))) == [(1, 1001)] and asked == [10_000]


def test_null_and_empty(spark):
    rows = spark.createDataFrame([("a", 1, 0, 0, 5), ("a", 2, 1, 1, 5)], COLUMNS)
    assert online_association(rows, **RULES).collect() == []
    assert online_association(rows.where(F.lit(False)), **RULES).collect() == []
