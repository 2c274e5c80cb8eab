"""Archived RGB-D frame containers: an index of payloads, without decoding poses or images."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schemas import DataError


def payload_index(f) -> Iterator[tuple[int, int, int, int, int]]:
    """(frame, offset of the colour payload, its bytes, offset of the depth payload, its bytes) of a version-4 container."""

    def take(form: str) -> tuple:
        raw = f.read(struct.calcsize("<" + form))
        if len(raw) < struct.calcsize("<" + form):
            raise DataError("container is cut short")
        return struct.unpack("<" + form, raw)

    if take("I")[0] != 4:
        raise DataError("unsupported container version")
    f.seek(take("Q")[0], 1)  # the sensor's name
    f.seek(4 * 64, 1)  # intrinsics and extrinsics of both cameras
    color, depth = take("ii")
    if (color, depth) != (2, 1):
        raise DataError("unsupported payload codecs")
    f.seek(4 * 4 + 4, 1)  # image sizes and depth scale
    for frame in range(take("Q")[0]):
        f.seek(80, 1)  # the pose and times are never decoded
        n_color, n_depth = take("QQ")
        at = f.tell()
        yield frame, at, n_color, at + n_color, n_depth
        f.seek(n_color + n_depth, 1)


def read_container_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, frame_id, color_offset, color_bytes, depth_offset, depth_bytes), one task for each container."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import urlparse

        from pyarrow import fs

        for batch in batches:
            for path in batch["path"]:
                store, inner = fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)
                with store.open_input_file(inner) as f:
                    rows = list(payload_index(f))
                yield pd.DataFrame([(path, *r) for r in rows], columns=["path", "frame_id", "color_offset", "color_bytes", "depth_offset", "depth_bytes"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return listed.mapInPandas(index, "path string, frame_id long, color_offset long, color_bytes long, depth_offset long, depth_bytes long")
