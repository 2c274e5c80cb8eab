"""Depth images as pixel tables: statistics, support filters and smoothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_quality(pixels: DataFrame) -> DataFrame:
    """(frame_id, quality): valid_fraction * (.5 + .5 * s / (s + 50)) with the variance s of the grey image's Laplacian.

    pixels: frame_id, u, v, grey, valid; the border uses mirrored neighbours.
    """
    size = pixels.groupBy("frame_id").agg(F.max("u").alias("mu"), F.max("v").alias("mv"), F.avg(F.col("valid").cast("int")).alias("valid_fraction"))
    near = pixels.join(size, "frame_id")
    flip = lambda x, top: F.when(x < 0, -x).when(x > top, 2 * top - x).otherwise(x)
    asked = near.select("frame_id", F.col("u").alias("u0"), F.col("v").alias("v0"), F.col("grey").alias("own"), F.explode(F.array(*[F.struct(flip(F.col("u") + du, F.col("mu")).alias("u"), flip(F.col("v") + dv, F.col("mv")).alias("v")) for du, dv in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("p"))
    got = asked.select("frame_id", "u0", "v0", "own", F.col("p.u").alias("u"), F.col("p.v").alias("v")).join(pixels.select("frame_id", "u", "v", "grey"), ["frame_id", "u", "v"])
    lap = got.groupBy("frame_id", "u0", "v0").agg((F.sum("grey") - 4 * F.first("own")).alias("l")).groupBy("frame_id").agg(F.var_pop("l").alias("s"))
    return size.join(lap, "frame_id", "left").select("frame_id", (F.col("valid_fraction") * (0.5 + 0.5 * F.coalesce(F.col("s") / (F.col("s") + 50), F.lit(0.0)))).alias("quality"))


def depth_check(pairs: DataFrame, inlier: float = 0.05) -> DataFrame:
    """(pair_id, projected, inlier_ratio, median, rmse) of projected against measured depths."""
    error = F.abs(F.col("projected_m") - F.col("measured_m"))
    return pairs.withColumn("e", error).groupBy("pair_id").agg(F.count("*").alias("projected"), F.avg((F.col("e") <= inlier).cast("int")).alias("inlier_ratio"), F.percentile("e", 0.5).alias("median"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))


def information(points: DataFrame, sigma: float = 0.02) -> DataFrame:
    """(pair_id, information): the 21 distinct sums of J'J / sigma**2 over points, J = [-[p]x | I], by rows of the upper triangle."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = [[zero, z, -y, one, zero, zero], [-z, zero, x, zero, one, zero], [y, -x, zero, zero, zero, one]]
    sums = [F.sum(sum((r[i] * r[j] for r in rows[1:]), rows[0][i] * rows[0][j])) / (sigma * sigma) for i in range(6) for j in range(i, 6)]
    return points.groupBy("pair_id").agg(F.array(*sums).alias("information"))


def _around(pixels: DataFrame, reach: int = 1) -> DataFrame:
    """Each pixel's value at its neighbours' places: (frame_id, u, v, du, dv, near)."""
    offsets = [F.struct(F.lit(du).alias("du"), F.lit(dv).alias("dv")) for du in range(-reach, reach + 1) for dv in range(-reach, reach + 1) if du or dv]
    sent = pixels.where("depth_mm > 0").select("frame_id", F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("depth_mm").alias("near"), F.explode(F.array(*offsets)).alias("o"))
    return sent.select("frame_id", (F.col("_u") + F.col("o.du")).alias("u"), (F.col("_v") + F.col("o.dv")).alias("v"), F.col("o.du").alias("du"), F.col("o.dv").alias("dv"), "near")


def agrees(a, b, absolute: float = 30.0, relative: float = 0.01):
    return F.abs(a - b) <= F.greatest(F.lit(absolute), relative * a)


def spatial_support(pixels: DataFrame, least: int = 2) -> DataFrame:
    """pixels with support, the neighbours of like depth, and depth_mm 0 where they are too few."""
    met = _around(pixels).join(pixels.where("depth_mm > 0"), ["frame_id", "u", "v"]).where(agrees(F.col("depth_mm"), F.col("near"))).groupBy("frame_id", "u", "v").agg(F.count("*").alias("support"))
    out = pixels.join(met, ["frame_id", "u", "v"], "left").withColumn("support", F.coalesce("support", F.lit(0)))
    return out.withColumn("depth_mm", F.when(F.col("support") >= least, F.col("depth_mm")).otherwise(0))


def temporal_consistency(reprojected: DataFrame, references: DataFrame, conflicts: int = 2) -> DataFrame:
    """(pixel, rejected, support, conflicts_before, conflicts_after): pixels that references on both sides contradict.

    reprojected: pixel_id, ref_id, side (-1 or 1), u, v, depth_mm as seen from the reference; references: ref_id, u, v,
    depth_mm. A reference contradicts a pixel if it measures clearly behind it and no depth in the 3x3 footprint agrees.
    """
    spots = F.array(*[F.struct((F.col("u") + du).alias("u"), (F.col("v") + dv).alias("v"), F.lit(du == 0 and dv == 0).alias("mid")) for du in (-1, 0, 1) for dv in (-1, 0, 1)])
    asked = reprojected.select("pixel_id", "ref_id", "side", F.col("depth_mm").alias("z"), F.explode(spots).alias("p")).select("pixel_id", "ref_id", "side", "z", "p.u", "p.v", "p.mid")
    met = asked.join(references.where("depth_mm > 0"), ["ref_id", "u", "v"])
    per = met.groupBy("pixel_id", "ref_id", "side").agg(F.bool_or(agrees(F.col("z"), F.col("depth_mm"))).alias("like"), F.bool_or(F.col("mid") & (F.col("depth_mm") > F.col("z")) & ~agrees(F.col("z"), F.col("depth_mm"))).alias("behind"))
    bad = ~F.col("like") & F.col("behind")
    return per.groupBy("pixel_id").agg(F.count_if("like").alias("support"), F.count_if(bad & (F.col("side") < 0)).alias("conflicts_before"), F.count_if(bad & (F.col("side") > 0)).alias("conflicts_after")).withColumn("rejected", (F.col("support") == 0) & (F.col("conflicts_before") >= 1) & (F.col("conflicts_after") >= 1) & (F.col("conflicts_before") + F.col("conflicts_after") >= conflicts))


def bilateral(pixels: DataFrame, sigma_px: float = 1.0, sigma_mm: float = 10.0, gate: float = 30.0, clip: float = 10.0) -> DataFrame:
    """pixels with smoothed depth: a gated weighted mean of the eight neighbours, moved by clip at most, half-even, 1..65535.

    Holes stay holes.
    """
    delta = F.col("near") - F.col("depth_mm")
    weight = F.exp(-(F.col("du") * F.col("du") + F.col("dv") * F.col("dv")) / F.lit(2 * sigma_px**2)) * F.exp(-(delta * delta) / F.lit(2 * sigma_mm**2))
    met = _around(pixels).join(pixels.where("depth_mm > 0"), ["frame_id", "u", "v"]).where(F.abs(delta) <= gate).withColumn("w", weight).groupBy("frame_id", "u", "v").agg((F.sum(F.col("w") * delta) / (1 + F.sum("w"))).alias("shift"))
    out = pixels.join(met, ["frame_id", "u", "v"], "left")
    moved = F.rint(F.col("depth_mm") + F.greatest(F.lit(-clip), F.least(F.lit(clip), F.coalesce("shift", F.lit(0.0)))))
    return out.withColumn("depth_mm", F.when(F.col("depth_mm") > 0, F.greatest(F.lit(1), F.least(F.lit(65535), moved))).otherwise(0).cast("int")).drop("shift")


def denoised(pixels: DataFrame, smooth=bilateral) -> DataFrame:
    """Spatial support and then a smoothing function of pixel tables, which may neither fill holes nor change which pixels there are.

    A function of images is one by tiled(). What it broke is named, with a frame where it did.
    """
    from ..schemas import DataError

    kept = spatial_support(pixels).drop("support")
    joined = kept.select("frame_id", "u", "v", F.col("depth_mm").alias("_was")).join(out := smooth(kept), ["frame_id", "u", "v"], "full")
    lost = F.when(F.col("_was").isNull(), "added pixels").when(F.col("depth_mm").isNull(), "removed pixels").when((F.col("_was") == 0) & (F.col("depth_mm") != 0), "filled holes")
    lost = F.coalesce(lost, F.when((F.col("depth_mm") < 0) | (F.col("depth_mm") > 65535), "left the range of 16 bits"))
    if found := joined.withColumn("_broke", lost).where("_broke is not null").select("frame_id", "_broke").first():
        raise DataError(f"smoothing {found[1]} in frame {found[0]}")
    return out


def tiled(function, tile: int = 256, halo: int = 8):
    """A smoothing function for denoised() from one of images: it gets a tile of depths with a halo around it, as uint16, and
    gives an array of the same shape, alone or with statistics, which are dropped. Outside of the image all is 0.

    Tiles are tasks' groups of (tile + 2 * halo)**2 pixels at most, whatever the image's size; with a halo as wide as the
    function reaches, the result does not depend on the tiles.
    """
    wide = tile + 2 * halo

    def smooth(pixels: DataFrame) -> DataFrame:
        near = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
        dealt = pixels.select("frame_id", "u", "v", "depth_mm").withColumn("tu", F.explode(near("u"))).withColumn("tv", F.explode(near("v")))

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            from ..schemas import DataError

            frame, tu, tv = rows.loc[0, ["frame_id", "tu", "tv"]]
            u, v = (rows["u"] - tu * tile + halo).to_numpy(int), (rows["v"] - tv * tile + halo).to_numpy(int)
            image = np.zeros((wide, wide), np.uint16)
            image[v, u] = rows["depth_mm"]
            given = function(image.copy())
            given = np.asarray(given[0] if isinstance(given, tuple) else given)
            if given.shape != image.shape:
                raise DataError(f"smoothing changed the image's shape in frame {frame}")
            own = (u >= halo) & (u < halo + tile) & (v >= halo) & (v < halo + tile)
            return pd.DataFrame({"frame_id": frame, "u": rows["u"][own], "v": rows["v"][own], "depth_mm": given[v[own], u[own]].astype(np.int64)})

        kind = pixels.schema["frame_id"].dataType.simpleString()
        new = dealt.groupBy("frame_id", "tu", "tv").applyInPandas(run, f"frame_id {kind}, u int, v int, depth_mm int")
        return pixels.drop("depth_mm").join(new, ["frame_id", "u", "v"])

    return smooth


def resampled_masks(masks: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Mask pixels on another grid by nearest neighbour: target (u, v) takes the source pixel at floor((u + .5) * scale)."""
    sx, sy = width / new_width, height / new_height
    lo = lambda x, s: F.ceil(x / s - 0.5).cast("int")
    grid = masks.withColumn("nu", F.explode(F.sequence(lo(F.col("u"), sx) - 1, lo(F.col("u") + 1, sx) + 1))).withColumn("nv", F.explode(F.sequence(lo(F.col("v"), sy) - 1, lo(F.col("v") + 1, sy) + 1)))
    fit = (F.floor((F.col("nu") + 0.5) * sx) == F.col("u")) & (F.floor((F.col("nv") + 0.5) * sy) == F.col("v")) & (F.col("nu") >= 0) & (F.col("nu") < new_width) & (F.col("nv") >= 0) & (F.col("nv") < new_height)
    return grid.where(fit).drop("u", "v").withColumnsRenamed({"nu": "u", "nv": "v"})


