"""Spatial joins as equi-joins on grid cells, with the exact predicate as a residual."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import box_gap
from ..plans.bounds import LimitExceeded


def cell(x: Column, size: float | Column) -> Column:
    return F.floor(x / size).cast("long")


def range_pairs(boxes: DataFrame, ident: str, low: Sequence[str], high: Sequence[str], margin: float, by: Sequence[str] = (), limit: int | None = 1_000_000) -> DataFrame:
    """(by, a, b) with a < b: boxes whose gap is at most margin on every axis, boundaries included.

    The grid's cell is about the 90th percentile of the boxes' extent on the first two axes, plus the margin. Larger boxes
    are at home in coarser grids, each of twice the cell of the one before, so that no box lies in many cells of its
    home; a box is also listed in every coarser grid that has boxes, where only those meet it. Of a grid a pair is kept
    in the one cell that holds the larger of its lower corners, so no distinct is needed.
    """
    axes = list(zip(low, high, strict=True))
    on = axes[:2]
    spread = boxes.agg(*[F.percentile_approx(F.col(h) - F.col(lo), 0.9).alias(f"p{i}") for i, (lo, h) in enumerate(on)]).first()
    size = [max((spread[f"p{i}"] or 0.0) + margin, margin, 1e-9) for i in range(len(on))]
    pad = margin / 2 + 1e-9  # rounding must not part two boxes whose gap is the margin
    grid = boxes.select(*by, F.col(ident).alias("id"), *[F.col(c).alias(f"{s}{i}") for i, (lo, h) in enumerate(axes) for s, c in (("l", lo), ("h", h))])
    wide = F.greatest(F.lit(1.0), *[(F.col(f"h{i}") - F.col(f"l{i}")) / size[i] for i in range(len(on))])
    grid = grid.withColumn("home", F.ceil(F.log2(wide)).cast("int"))
    levels = sorted(r["home"] for r in grid.select("home").distinct().collect())  # at most one for each power of two
    grid = grid.withColumn("level", F.explode(F.array(*map(F.lit, levels or [0])))).where("level >= home")
    at = lambda x, i: cell(x, F.lit(size[i]) * F.pow(F.lit(2.0), F.col("level")))
    for i in range(len(on)):
        grid = grid.withColumn(f"c{i}", F.explode(F.sequence(at(F.col(f"l{i}") - pad, i), at(F.col(f"h{i}") + pad, i))))
    keys = [*by, "level", *[f"c{i}" for i in range(len(on))]]
    rest = [c for c in grid.columns if c not in keys]
    home = grid.where("level = home").select(*keys, *[F.col(c).alias(f"a_{c}") for c in rest])
    pairs = home.join(grid.select(*keys, *[F.col(c).alias(f"b_{c}") for c in rest]), keys).where("b_home < a_home or a_id < b_id")
    for i in range(len(on)):  # the pair's own cell: that of the later start
        pairs = pairs.where(F.col(f"c{i}") == at(F.greatest(f"a_l{i}", f"b_l{i}") - pad, i))
    for i in range(len(axes)):
        pairs = pairs.where((F.col(f"a_l{i}") - F.col(f"b_h{i}") <= margin) & (F.col(f"b_l{i}") - F.col(f"a_h{i}") <= margin))
    found = pairs.select(*by, F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    if limit is not None and found.limit(limit + 1).count() > limit:
        raise LimitExceeded("relation candidate limit exceeded; reduce the map's scope or raise the limit")
    return found


def gap(prefix_a: str, prefix_b: str, low: Sequence[str], high: Sequence[str]) -> Column:
    """The distance of two boxes whose columns carry prefixes."""
    side = lambda p: ([F.col(p + c) for c in low], [F.col(p + c) for c in high])
    return box_gap(side(prefix_a), side(prefix_b))


def shifted(points: DataFrame, size: float) -> DataFrame:
    """Each point in its own cell and the 26 around it."""
    for i, c in enumerate("xyz"):
        points = points.withColumn(f"c{i}", F.explode(F.array(*[cell(F.col(c), size) + d for d in (-1, 0, 1)])))
    return points


def in_cells(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({f"c{i}": cell(F.col(c), size) for i, c in enumerate("xyz")})


def distance(a: str, b: str) -> Column:
    d = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def neighbours_within(left: DataFrame, right: DataFrame, radius: float, by: Sequence[str] = (), more: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, distance, more): points of left with those of right up to radius away. Both have point_id, x, y, z."""
    keys = [*by, "c0", "c1", "c2"]
    near = in_cells(left, radius).select(*keys, F.col("point_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in "xyz"], *more)
    far = shifted(right.select(*by, "point_id", "x", "y", "z"), radius).select(*keys, F.col("point_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in "xyz"])
    return near.join(far, keys).withColumn("distance", distance("a_", "b_")).where(F.col("distance") <= radius).select(*by, "a", "b", "distance", *more)


def nearest_within(left: DataFrame, right: DataFrame, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, distance): each point of left with its nearest of right up to radius away; ties to the lowest id.

    Of equal points of right the lowest id stands for all. Pairs are gone through twice, for the least distance and for the
    lowest id at it, so that both are numbers kept in place and no pair is sorted.
    """
    places = right.groupBy(*by, "x", "y", "z").agg(F.min("point_id").alias("point_id"))
    least = neighbours_within(left, places, radius, by).groupBy(*by, F.col("a").alias("point_id")).agg(F.min("distance").alias("least"))
    near = neighbours_within(left.join(least, [*by, "point_id"]), places, radius, by, ["least"]).where("distance = least")
    return near.groupBy(*by, "a").agg(F.min("b").alias("b"), F.min("distance").alias("distance"))


def k_nearest_within(left: DataFrame, right: DataFrame, k: int, radius: float) -> DataFrame:
    w = Window.partitionBy("a").orderBy("distance", "b")
    return neighbours_within(left, right, radius).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def radius_count(points: DataFrame, radius: float = 0.06, by: Sequence[str] = ()) -> DataFrame:
    """(by, point_id, others): how many other points lie up to radius away; coincident points count."""
    own = points.select(*by, "point_id")
    # each cell's points meet those of 27 cells; a row for each pair is never shuffled: partial counts are
    near = neighbours_within(points, points, radius, by).where("a != b").groupBy(*by, F.col("a").alias("point_id")).agg(F.count("*").alias("others"))
    return own.join(near, [*by, "point_id"], "left").withColumn("others", F.coalesce("others", F.lit(0)))


def radius_cleanup(points: DataFrame, radius: float = 0.06, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) points with all their columns, by one pass of the neighbour count."""
    marked = points.join(radius_count(points, radius), "point_id")
    kept, removed = marked.where(F.col("others") >= least).drop("others"), marked.where(F.col("others") < least).drop("others")
    if kept.limit(1).isEmpty():
        raise ValueError("no point survives")
    return kept, removed


def coverage_both_ways(a: DataFrame, b: DataFrame, radius: float = 0.05) -> float:
    """The smaller share of points with a partner nearer than radius (not at it), of both directions."""
    def share(x: DataFrame, y: DataFrame) -> float:
        n = x.count()
        return nearest_within(x, y, radius).where(F.col("distance") < radius).count() / n if n else 0.0

    return min(share(a, b), share(b, a))


def boxes_apart(a: str, b: str, limit: float = 0.05) -> Column:
    """Whether two boxes with columns x_low ... z_high are farther apart than limit on some axis."""
    out = F.lit(False)
    for c in "xyz":
        out = out | (F.col(f"{a}{c}_low") - F.col(f"{b}{c}_high") > limit) | (F.col(f"{b}{c}_low") - F.col(f"{a}{c}_high") > limit)
    return out


def voxel_average(points: DataFrame, size: float = 0.02) -> DataFrame:
    """Average positions by voxel: an approximation of a fused cloud, not a surface reconstruction."""
    return in_cells(points, size).groupBy("c0", "c1", "c2").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"])
