"""Streaming: a growing journal of frames, order and validity guards, resumable uploads.

A journal is a file of JSON lines to which a capture appends; a line counts once its line feed is there. Spark's file
source ignores growth of a file it has seen, so the journal is a data source of its own, whose offset is a byte.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import FRAME


class JournalError(ValueError):
    """A live journal was replaced, cut or lost."""


def committed(path: str, at: int, inode: int | None) -> tuple[int, int]:
    """(byte after the last committed line, inode); the file must be the one begun with, and no shorter."""
    try:
        stat = os.stat(path)
    except FileNotFoundError:
        if inode is None:
            return 0, 0
        raise JournalError("journal is gone") from None
    if inode and stat.st_ino != inode:
        raise JournalError("journal was replaced")
    if stat.st_size < at:
        raise JournalError("journal was cut")
    with open(path, "rb") as f:
        f.seek(at)
        last = f.read().rfind(b"\n")
    return at + last + 1, stat.st_ino


def read_lines(path: str, start: int, end: int) -> Iterator[tuple]:
    with open(path, "rb") as f:
        f.seek(start)
        for line in f.read(end - start).splitlines():
            if line.strip():
                r = json.loads(line)
                yield tuple(r.get(c) for c in FRAME.names)


class Piece(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class JournalReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path, self.at, self.inode = path, 0, None

    def initialOffset(self) -> dict:
        return {"byte": 0, "inode": 0}

    def latestOffset(self) -> dict:
        self.at, inode = committed(self.path, self.at, self.inode)
        self.inode = inode or self.inode
        return {"byte": self.at, "inode": inode}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        if start["inode"] and end["inode"] and start["inode"] != end["inode"]:
            raise JournalError("journal was replaced")
        return [Piece(start["byte"], end["byte"])]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return read_lines(self.path, partition.start, partition.end)


class JournalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_journal"

    def schema(self):
        return FRAME

    def streamReader(self, schema) -> JournalReader:
        return JournalReader(self.options["path"])


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The journal as a stream."""
    spark.dataSource.register(JournalSource)
    return spark.readStream.format("frame_journal").option("path", path).load()


def journal_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows as a table; an unfinished last line is left out."""
    end, _ = committed(path, 0, None)
    return spark.createDataFrame(list(read_lines(path, 0, end)), FRAME)


def in_sync(pairs: DataFrame, most_us: int = 15_000) -> DataFrame:
    return pairs.where(F.abs(F.col("timestamp_us") - F.col("depth_timestamp_us")) <= most_us)


def joined_in_sync(color: DataFrame, depth: DataFrame, most_ms: int = 15, late: str = "10 seconds") -> DataFrame:
    """Stream-stream interval join of colour (ts, ...) and depth (depth_ts, ...) by device."""
    a, b = color.withWatermark("ts", late), depth.withWatermark("depth_ts", late)
    gap = F.expr(f"depth_ts >= ts - interval {most_ms} milliseconds and depth_ts <= ts + interval {most_ms} milliseconds")
    return a.join(b.withColumnRenamed("device_id", "depth_device"), (F.col("device_id") == F.col("depth_device")) & gap)


def _order_guard(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, broken = state.get if state.exists else (-1, False)
    rows = pd.concat(list(batches), ignore_index=True)
    out = []
    for ordinal, ts in rows[["ordinal", "timestamp_us"]].sort_values("ordinal").itertuples(index=False):
        broken = broken or ts <= last  # the first fall ends the sequence; what came before stays
        last = max(last, ts)
        out.append((key[0], int(ordinal), int(ts), not broken))
    state.update((last, broken))
    yield pd.DataFrame(out, columns=["sequence_id", "ordinal", "timestamp_us", "accepted"])


def order_guard(stream: DataFrame) -> DataFrame:
    """Frames with accepted: timestamps of a sequence must rise strictly; from the first that doesn't on, none is accepted."""
    return stream.groupBy("sequence_id").applyInPandasWithState(_order_guard, "sequence_id string, ordinal long, timestamp_us long, accepted boolean", "last long, broken boolean", "append", GroupStateTimeout.NoTimeout)


def _watchdog(startup_s: float, running_s: float):
    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        valid, rejects, deadline = state.get if state.exists else (0, "{}", None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "expired", valid, rejects)], columns=["sequence_id", "event", "valid", "rejects"])
            return
        counts = json.loads(rejects)
        fresh = 0
        for rows in batches:
            fresh += int(rows["valid"].sum())
            for reason, n in rows.loc[~rows["valid"], "reason"].value_counts().items():
                counts[reason] = counts.get(reason, 0) + int(n)
        now = state.getCurrentProcessingTimeMs()
        if fresh or deadline is None:  # only a valid frame moves the deadline
            deadline = now + int(1000 * (running_s if fresh else startup_s))
        state.update((valid + fresh, json.dumps(counts, sort_keys=True), deadline))
        state.setTimeoutDuration(max(1, deadline - now))  # every call clears the timeout, invalid traffic's too
        yield pd.DataFrame([(key[0], "alive", valid + fresh, json.dumps(counts, sort_keys=True))], columns=["sequence_id", "event", "valid", "rejects"])

    return watch


def watchdog(stream: DataFrame, startup_s: float = 20.0, running_s: float = 8.0) -> DataFrame:
    """(sequence_id, event, valid, rejects): expired when no valid frame came in time; invalid traffic doesn't count."""
    return stream.groupBy("sequence_id").applyInPandasWithState(_watchdog(startup_s, running_s), "sequence_id string, event string, valid long, rejects string", "valid long, rejects string, deadline long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def catch_up(backlog: int) -> int:
    """How many frames a preview steps ahead: 1 to 3, by an eighth of the backlog."""
    return min(3, max(1, backlog // 8))


def missing_chunks(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """(upload_id, frame_index) that an upload still lacks: not stored, or stored with another size or digest."""
    good = stored.select("upload_id", "frame_index", "bytes", "sha256").distinct()
    return manifest.join(good, ["upload_id", "frame_index", "bytes", "sha256"], "left_anti").select("upload_id", "frame_index")


def accepted_chunks(manifest: DataFrame, arrived: DataFrame, magic: bytes) -> DataFrame:
    """Arrived chunks that the manifest lists with their size, magic number and digest; repeats count once."""
    checked = arrived.withColumn("sha256", F.sha2("content", 256)).withColumn("bytes", F.octet_length("content").cast("long")).where(F.substring("content", 1, len(magic)) == F.lit(bytearray(magic)))
    return checked.join(manifest.select("upload_id", "frame_index", "bytes", "sha256"), ["upload_id", "frame_index", "bytes", "sha256"], "left_semi").dropDuplicates(["upload_id", "frame_index"])


def sealable(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """(upload_id, complete): whether every listed chunk is stored as listed."""
    lacks = missing_chunks(manifest, stored).select("upload_id").distinct().withColumn("lacks", F.lit(True))
    return manifest.select("upload_id").distinct().join(lacks, "upload_id", "left").select("upload_id", F.col("lacks").isNull().alias("complete"))


def publish_preview(stream: DataFrame, sink, most: int = 100, every: str = "1 second"):
    """Starts a query that gives sink(batch, id) up to most evenly chosen rows at an interval."""
    from ..operators.temporal import decimated

    return stream.writeStream.trigger(processingTime=every).foreachBatch(lambda batch, i: sink(decimated(batch, most, ["frame_id"], by=None), i)).start()


def replayed(spark: SparkSession, folder: str, schema, files_a_step: int = 1) -> DataFrame:
    """A paced replay of recorded files, so many a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_step).json(folder)


def merged_events(*streams: DataFrame) -> DataFrame:
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out
