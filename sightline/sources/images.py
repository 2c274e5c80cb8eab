"""RGB-D frames: PNG images of 8 and 16 bits, read by tasks and aligned with their frames.

An image is a row and its pixels one binary cell, in rows from the top, little-endian where they have 16 bits. The codec is
the standard library's inflate and the format's five line filters; a file in another format, or interlaced, is refused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DataError, refuse

#: The format's mark, and the samples of a pixel by colour type.
PNG_MARK = b"\x89PNG\r\n\x1a\n"
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Pixels that an image may have; a header that promises more is refused before anything is inflated.
MOST_PIXELS = 1 << 28
#: Bytes that can be unfiltered one by one in the time of one diagonal.
DIAGONAL = 150


def png_chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of a PNG's chunks up to the last; each one's CRC-32 is checked."""
    if content[:8] != PNG_MARK:
        raise DataError("not a PNG image")
    at = 8
    while at + 12 <= len(content):
        (size,) = struct.unpack(">I", content[at : at + 4])
        kind, body = content[at + 4 : at + 8], content[at + 8 : at + 8 + size]
        if len(body) != size or content[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise DataError("image cut short or changed")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise DataError("image cut short or changed")


def unfiltered(lines: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    """The bytes of filtered lines; step: bytes of a pixel.

    A pixel depends on those to the left, above and between at most, so all pixels of one diagonal are computed at once, unless
    there are so few bytes in lines whose filter needs that, that going through these one by one costs less.
    """
    height, row = lines.shape
    if len(filters) and filters.max() > 4:
        raise DataError("unknown line filter")
    if not (filters > 2).any():
        return simply_unfiltered(lines, filters, step)
    width = row // step
    if int((filters > 2).sum()) * row < DIAGONAL * (width + height):
        return unfiltered_by_bytes(lines, filters, step)
    coded = lines.reshape(height, width, step).astype(np.int16)
    out = np.zeros((height + 1, width + 1, step), np.int16)  # a line of zeros above, a pixel of zeros to the left
    for diagonal in range(width + height - 1):
        y = np.arange(max(0, diagonal - width + 1), min(height - 1, diagonal) + 1)
        x = diagonal - y
        left, up, over = out[y + 1, x], out[y, x + 1], out[y, x]
        away = np.stack([np.abs(up - over), np.abs(left - over), np.abs(left + up - 2 * over)])  # of left, up, over from left + up - over
        nearest = np.where((away[0] <= away[1]) & (away[0] <= away[2]), left, np.where(away[1] <= away[2], up, over))
        kind = filters[y, None]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)
        out[y + 1, x + 1] = (coded[y, x] + guess) & 255
    return out[1:, 1:].reshape(height, row).astype(np.uint8)


def unfiltered_by_bytes(lines: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    """The same a line at a time, and those of filters 3 and 4 a byte at a time."""
    out = np.zeros_like(lines)
    for y, kind in enumerate(filters.tolist()):
        if kind == 1:
            out[y] = np.cumsum(lines[y].reshape(-1, step), 0, np.uint8).reshape(-1)
        elif kind < 3:
            out[y] = lines[y] + out[y - 1] if kind == 2 and y else lines[y]
        else:
            above, got = [0] * step + (out[y - 1].tolist() if y else [0] * lines.shape[1]), [0] * step
            for i, (coded, up) in enumerate(zip(lines[y].tolist(), above[step:], strict=True)):
                left, over = got[i], above[i]
                if kind == 3:
                    guess = left + up >> 1
                else:
                    a, b, c = abs(up - over), abs(left - over), abs(left + up - 2 * over)
                    guess = left if a <= b and a <= c else up if b <= c else over
                got.append(coded + guess & 255)
            out[y] = got[step:]
    return out


def simply_unfiltered(lines: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    """The same where no line's filter needs the pixels to the left and above together: a line at a time."""
    out = np.zeros_like(lines)
    for y, kind in enumerate(filters.tolist()):
        if kind == 1:
            out[y] = np.cumsum(lines[y].reshape(-1, step), 0, np.uint8).reshape(-1)
        else:
            out[y] = lines[y] + out[y - 1] if kind == 2 and y else lines[y]
    return out


def decode_png(content: bytes) -> np.ndarray:
    """Rows of pixels: height x width for grey and palette places, else height x width x samples; uint8 or uint16."""
    head, data, palette = None, [], None
    for kind, body in png_chunks(content):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    if head is None:
        raise DataError("image without a header")
    width, height, bits, colour, packing, filtering, interlace = head
    if (packing, filtering, interlace) != (0, 0, 0) or bits not in (8, 16) or colour not in PNG_SAMPLES or (colour == 3 and (bits, palette is None) != (8, False)):
        raise DataError("only PNG images of 8 or 16 bits that are not interlaced are read")
    if not 0 < width * height <= MOST_PIXELS:
        raise DataError("an image of no size that is read")
    samples, wide = PNG_SAMPLES[colour], bits // 8
    row = width * samples * wide
    unpack = zlib.decompressobj()
    try:
        flat = unpack.decompress(b"".join(data), (row + 1) * height + 1)
    except zlib.error as e:
        raise DataError("image cut short or changed") from e
    if len(flat) != (row + 1) * height:
        raise DataError("image of another size than it says")
    lines = np.frombuffer(flat, np.uint8).reshape(height, row + 1)
    pixels = unfiltered(lines[:, 1:], lines[:, 0], samples * wide)
    if wide == 2:
        pixels = np.ascontiguousarray(pixels).view(">u2").astype(np.uint16)
    pixels = pixels.reshape(height, width, samples)
    if colour == 3:
        if pixels.max() >= len(palette):
            raise DataError("image with a colour that its palette lacks")
        return palette[pixels[:, :, 0]]
    return pixels[:, :, 0] if samples == 1 else pixels


def encode_png(pixels: np.ndarray, filters: int | list[int] = 2) -> bytes:
    """A PNG of grey (height x width) or colour (height x width x 2, 3 or 4) pixels of 8 or 16 bits.

    filters: one line filter for all lines, or one each.
    """
    cube = pixels if pixels.ndim == 3 else pixels[:, :, None]
    height, width, samples = cube.shape
    wide = cube.dtype.itemsize
    raw = np.ascontiguousarray(cube.astype(">u2") if wide == 2 else cube.astype(np.uint8)).view(np.uint8).reshape(height, -1)
    step, kinds, line = samples * wide, np.broadcast_to(np.asarray(filters, np.uint8), (height,)), raw.astype(np.int16)
    shifted = np.pad(line, ((1, 0), (step, 0)))  # a line of zeros above, a pixel of zeros to the left
    guess = np.zeros_like(line)
    for kind in np.unique(kinds).tolist():
        own = kinds == kind
        left, up, over = shifted[1:, :-step][own], shifted[:-1, step:][own], shifted[:-1, :-step][own]
        if kind == 4:
            near = np.stack([left, up, over])
            guess[own] = np.take_along_axis(near, np.abs(near - (left + up - over)).argmin(0)[None], 0)[0]
        else:
            guess[own] = (0, left, up, (left + up) // 2)[kind]
    body = np.concatenate([kinds[:, None], ((line - guess) & 255).astype(np.uint8)], 1).tobytes()
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[samples]
    chunks = ((b"IHDR", struct.pack(">IIBBBBB", width, height, 8 * wide, colour, 0, 0, 0)), (b"IDAT", zlib.compress(body)), (b"IEND", b""))
    return PNG_MARK + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in chunks)


def area_shares(old: int, new: int) -> np.ndarray:
    """new x old: the share of each old cell in each new one's length. Where new is larger, places are interpolated."""
    out = np.zeros((new, old))
    if new <= old:
        edges = np.arange(new + 1) * (old / new)
        for i in range(new):
            a, b = edges[i], min(edges[i + 1], old)
            at = np.arange(int(a), min(old, int(np.ceil(b - 1e-9))))
            out[i, at] = np.minimum(at + 1, b) - np.maximum(at, a)
        return out / out.sum(1, keepdims=True)
    place = np.clip((np.arange(new) + 0.5) * (old / new) - 0.5, 0, old - 1)
    low = np.minimum(place.astype(int), max(0, old - 2))
    out[np.arange(new), low] = 1 - (place - low)
    out[np.arange(new), np.minimum(low + 1, old - 1)] += place - low
    return out


def resized(colour: np.ndarray, height: int, width: int) -> np.ndarray:
    """Colour pixels averaged by area onto another size."""
    if colour.shape[:2] == (height, width):
        return colour
    rows, columns = area_shares(colour.shape[0], height), area_shares(colour.shape[1], width)
    return np.rint(np.einsum("ih,jw,hwc->ijc", rows, columns, colour, optimize=True)).clip(0, 255).astype(np.uint8)


def aligned(colour: np.ndarray, depth: np.ndarray, intrinsics: tuple[float, float, float, float], rotate: bool):
    """(colour, depth, intrinsics) of a frame, turned by a quarter against the clock if asked for, colour in the depth's size."""
    if depth.ndim != 2 or depth.dtype != np.uint16:
        raise DataError("depth must be one channel of 16 bits")
    if colour.dtype != np.uint8:
        raise DataError("colour must be of 8 bits")
    colour = np.repeat(colour[:, :, None], 3, 2) if colour.ndim == 2 else np.repeat(colour[:, :, :1], 3, 2) if colour.shape[2] == 2 else colour[:, :, :3]
    fx, fy, cx, cy = intrinsics
    if rotate:
        fx, fy, cx, cy = fy, fx, cy, depth.shape[1] - 1.0 - cx
        colour, depth = np.rot90(colour), np.rot90(depth)
    return resized(np.ascontiguousarray(colour), *depth.shape), np.ascontiguousarray(depth), (fx, fy, cx, cy)


FRAME_IMAGES = "width int, height int, fx double, fy double, cx double, cy double, colour binary, depth binary"


def aligned_frames(frames: DataFrame, rotate: str = "rotate_ccw") -> DataFrame:
    """frames with width, height, intrinsics, colour and depth in place of color_png and depth_png.

    frames: any columns, intrinsics (struct of fx, fy, cx, cy), rotate, color_png and depth_png (bytes). A frame that lacks
    an image, or has one of another kind, is refused by its frame_id.
    """
    refuse(frames, F.col("color_png").isNull() | F.col("depth_png").isNull(), "a frame lacks its colour or depth image")
    rest = [f for f in frames.schema.fields if f.name not in ("intrinsics", "color_png", "depth_png")]
    k = [F.col(f"intrinsics.{c}").alias(f"_{c}") for c in ("fx", "fy", "cx", "cy")]
    rows = frames.select(*[f"`{f.name}`" for f in rest], *k, "color_png", "depth_png")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for frame, turn, a, b, *own in zip(batch["frame_id"], batch[rotate], batch["color_png"], batch["depth_png"], *[batch[f"_{c}"] for c in ("fx", "fy", "cx", "cy")], strict=True):
                try:
                    colour, depth, (fx, fy, cx, cy) = aligned(decode_png(a), decode_png(b), tuple(own), bool(turn))
                except DataError as e:
                    raise DataError(f"frame {frame}: {e}") from e
                out.append((depth.shape[1], depth.shape[0], fx, fy, cx, cy, colour.tobytes(), depth.astype("<u2").tobytes()))
            new = pd.DataFrame(out, columns=["width", "height", "fx", "fy", "cx", "cy", "colour", "depth"])
            yield pd.concat([batch[[f.name for f in rest]].reset_index(drop=True), new], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return rows.mapInPandas(run, f"{kept}, {FRAME_IMAGES}")


def read_rgbd(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """A manifest's frames with their images, read from the paths below folder; see aligned_frames.

    manifest: as read by read_manifest. Only files that a frame names are kept, each joined once.
    """
    root = F.lit(folder.rstrip("/") + "/")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(folder).select(plain(F.col("path")).alias("_path"), "content")
    frames = manifest
    for column, name in (("color_path", "color_png"), ("depth_path", "depth_png")):
        own = files.select("_path", F.col("content").alias(name))
        at = plain(F.when(F.col(column).startswith("/"), F.col(column)).otherwise(F.concat(root, F.col(column))))
        frames = frames.withColumn("_path", at).join(own, "_path", "left").drop("_path")
    return aligned_frames(frames)


def pixel_table(frames: DataFrame, near: float | None = None, far: float | None = None, scale: float = 1000.0) -> DataFrame:
    """(frame_id, u, v, depth, depth_m, red, green, blue, grey, valid): a row for each pixel of aligned frames.

    depth in the image's units, depth_m by scale; valid where depth is above 0 and between near and far, where given;
    grey by the usual weights of the three colours.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("u", "v", "depth", "red", "green", "blue")
        ids, held, size = [], [], 0

        def flush() -> pd.DataFrame:
            frames = pd.Series(ids).repeat([len(x[0]) for x in held]).reset_index(drop=True)
            return pd.DataFrame({"frame_id": frames, **{n: np.concatenate(c) for n, c in zip(names, zip(*held, strict=True), strict=True)}})

        for batch in batches:
            for r in batch.itertuples(index=False):
                depth = np.frombuffer(r.depth, "<u2").reshape(r.height, r.width)
                colour = np.frombuffer(r.colour, np.uint8).reshape(r.height, r.width, 3)
                step = max(1, (1 << 18) // r.width)
                for top in range(0, r.height, step):
                    d, c = depth[top : top + step], colour[top : top + step].reshape(-1, 3)
                    v, u = np.indices(d.shape, np.int32)
                    ids.append(r.frame_id)
                    held.append((u.ravel(), v.ravel() + np.int32(top), d.ravel().astype(np.int32), *[c[:, i].astype(np.int32) for i in range(3)]))
                    size += d.size
                    if size >= 1 << 18:
                        yield flush()
                        ids, held, size = [], [], 0
        if held:
            yield flush()

    kind = frames.schema["frame_id"].dataType.simpleString()
    rows = frames.select("frame_id", "width", "height", "colour", "depth").mapInPandas(run, f"frame_id {kind}, u int, v int, depth int, red int, green int, blue int")
    metres = F.col("depth") / scale
    valid = (F.col("depth") > 0) & (F.lit(True) if near is None else metres >= near) & (F.lit(True) if far is None else metres <= far)
    grey = F.lit(0.299) * F.col("red") + F.lit(0.587) * F.col("green") + F.lit(0.114) * F.col("blue")
    return rows.select("frame_id", "u", "v", "depth", metres.alias("depth_m"), "red", "green", "blue", grey.alias("grey"), valid.alias("valid"))
