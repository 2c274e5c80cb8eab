"""The journal, the guards and uploads."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.streaming import journal


def line(i, ts=None):
    return json.dumps({"frame_id": i, "timestamp_us": 1000 * i if ts is None else ts, "color_path": "é", "depth_path": "d", "intrinsics": [1.0] * 4, "rotate_ccw": False, "audit": 1}, ensure_ascii=False) + "\n"


def test_snapshot_leaves_out_the_unfinished_row(spark, tmp_path):
    path = tmp_path / "j.jsonl"
    path.write_bytes((line(1) + line(2)).encode() + line(3).encode()[:-20])
    assert [r["frame_id"] for r in journal.journal_snapshot(spark, str(path)).collect()] == [1, 2]


def test_tail(spark, tmp_path):
    path = str(tmp_path / "j.jsonl")
    open(path, "w").write(line(1))
    q = journal.read_journal(spark, path).writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        half = line(2)
        with open(path, "a") as f:
            f.write(half[:10])
        q.processAllAvailable()
        assert spark.table("tail").count() == 1
        with open(path, "a") as f:
            f.write(half[10:] + line(3))
        q.processAllAvailable()
        assert sorted(r["frame_id"] for r in spark.table("tail").collect()) == [1, 2, 3]
    finally:
        q.stop()


def test_replaced_or_cut_journal(tmp_path):
    path = str(tmp_path / "j.jsonl")
    open(path, "w").write(line(1) + line(2))
    at, inode = journal.committed(path, 0, None)
    with open(path, "w") as f:
        f.write(line(1))
    with pytest.raises(journal.JournalError, match="cut"):
        journal.committed(path, at, inode)
    open(path + ".new", "w").write(line(1) * 9)
    os.replace(path + ".new", path)
    with pytest.raises(journal.JournalError, match="replaced"):
        journal.committed(path, at, inode)
    os.unlink(path)
    with pytest.raises(journal.JournalError, match="gone"):
        journal.committed(path, at, inode)


def test_order_guard(spark, tmp_path):
    schema = "sequence_id string, ordinal long, timestamp_us long"
    for k, rows in enumerate(([("a", 0, 1), ("a", 1, 5), ("b", 0, 1)], [("a", 2, 5), ("a", 3, 9), ("b", 1, 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"), mode="append" if k else "overwrite")
    q = journal.order_guard(journal.replayed(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)).writeStream.format("memory").queryName("guard").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = {(r["sequence_id"], r["ordinal"]): r["accepted"] for r in spark.table("guard").collect()}
    finally:
        q.stop()
    assert got[("b", 0)] and got[("b", 1)] and len(got) == 6


def test_sync_and_catch_up(spark):
    df = spark.createDataFrame([(100, 15_100), (100, 15_101)], "timestamp_us long, depth_timestamp_us long")
    assert journal.in_sync(df).count() == 1
    assert [journal.catch_up(b) for b in (0, 8, 16, 24, 99)] == [1, 1, 2, 3, 3]


def test_uploads(spark):
    content = [b"MAGC" + bytes([i]) * 4 for i in range(3)]
    rows = spark.createDataFrame([("u", i, bytearray(c)) for i, c in enumerate(content)], "upload_id string, frame_index int, content binary")
    manifest = rows.select("upload_id", "frame_index", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    arrived = spark.createDataFrame([("u", 0, bytearray(content[0])), ("u", 0, bytearray(content[0])), ("u", 1, bytearray(b"MAGCxxxx")), ("u", 2, bytearray(b"XXXX2222"))], rows.schema)
    stored = journal.accepted_chunks(manifest, arrived, b"MAGC")
    assert [r["frame_index"] for r in stored.collect()] == [0]
    assert sorted(r["frame_index"] for r in journal.missing_chunks(manifest, stored).collect()) == [1, 2]
    assert journal.sealable(manifest, stored).first()["complete"] is False and journal.sealable(manifest, manifest).first()["complete"] is True


class Clock:
    """A group's state with a clock: what Spark keeps between calls, and clears."""

    def __init__(self):
        self.now, self.value, self.due, self.hasTimedOut = 0, None, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.due = self.now + ms


def test_watchdog_counts_valid_frames_only():
    watch, state = journal._watchdog(20.0, 8.0), Clock()

    def call(now, *valid):
        state.now, state.due = now, None
        rows = pd.DataFrame({"valid": list(valid), "reason": ["" if v else "dark" for v in valid]})
        return next(watch(("s",), iter([rows]), state))["valid"][0]

    assert call(0, False) == 0 and state.due == 20_000
    assert call(15_000, False, False) == 0 and state.due == 20_000  # invalid frames do not move it
    assert call(18_000, True) == 1 and state.due == 26_000
    assert call(25_000, False) == 1 and state.due == 26_000
    assert call(25_500, True, False) == 2 and state.due == 33_500
    state.hasTimedOut = True
    last = next(watch(("s",), iter([]), state)).iloc[0]
    assert (last["event"], last["valid"], last["rejects"]) == ("expired", 2, '{"dark": 5}') and not state.exists
