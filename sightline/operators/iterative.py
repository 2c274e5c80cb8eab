"""Order-dependent algorithms: evidence is aggregated by Spark, the loop runs in one Python task for each scene.

Merges with vetoes, greedy choices and assignments depend on their order. Merges are parted first: sets that no chain of
acceptable edges connects can never be joined, and neither veto each other, so that each component of these edges has a
task of its own. Choices and assignments of a scene, whose candidates grow with its objects and not with its points, meet in one
task; scenes run in parallel.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.folders import cut
from .ordering import components, numbered


class Sets:
    """Disjoint sets with members, joined under a caller's rule for the root."""

    def __init__(self, items: Iterable):
        self.up = {x: x for x in items}
        self.members = {x: {x} for x in self.up}

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, keep, gone) -> None:
        self.up[gone] = keep
        self.members[keep] |= self.members.pop(gone)


def renewed(df: DataFrame) -> DataFrame:
    """df with new column identities, for a cogroup of two tables of one origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def in_components(edges: DataFrame, good: DataFrame, by: str, node: str, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with the root of their component of good edges, null if alone; the edges within components, with it)."""
    roots = cut(components(good.select(by, "a", "b"), [by]))
    side = lambda s: roots.select(by, F.col("node").alias(s), F.col("root").alias("root" if s == "a" else "_root"))
    within = edges.join(side("a"), [by, "a"]).join(side("b"), [by, "b"]).where("root = _root").drop("_root")
    return nodes.join(roots.select(by, F.col("node").alias(node), "root"), [by, node], "left"), within


def constrained_merge(edges: DataFrame, nodes: DataFrame, support: int = 3, consensus: float = 0.9, cannot_link: int = 2, by: str = "scene_id") -> DataFrame:
    """(by, node, group_id): consensus clusters in which no two members are seen apart too often.

    edges: by, a, b, positive, negative; nodes: by, node. Edges go by most positive, fewest negative and ids; a union that
    would bring a forbidden pair together is vetoed. Groups are numbered by their smallest node. Edges of nodes that are not
    in nodes are left out.
    """
    kind = edges.schema[by].dataType.simpleString()
    nodes = nodes.select(by, "node").distinct()
    for s in ("a", "b"):
        edges = edges.join(renewed(nodes).withColumnRenamed("node", s), [by, s], "left_semi")
    edges = cut(edges.select(by, "a", "b", "positive", "negative"))
    accepted = (F.col("positive") >= support) & (F.col("negative") < cannot_link) & (F.col("positive") >= consensus * (F.col("positive") + F.col("negative")))
    placed, within = in_components(edges, edges.where(accepted), by, "node", nodes)

    def merge(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        names = sorted(own["node"].tolist())
        sets, apart = Sets(names), defaultdict(set)
        for a, b in links.loc[links["negative"] >= cannot_link, ["a", "b"]].itertuples(index=False):
            apart[a].add(b)
            apart[b].add(a)
        good = links[(links["positive"] >= support) & (links["negative"] < cannot_link) & (links["positive"] >= consensus * (links["positive"] + links["negative"]))]
        for a, b in good.sort_values(["positive", "negative", "a", "b"], ascending=[False, True, True, True])[["a", "b"]].itertuples(index=False):
            ra, rb = sets.root(a), sets.root(b)
            if ra == rb or any(apart[x] & sets.members[rb] for x in sets.members[ra]):
                continue
            keep, gone = (ra, rb) if len(sets.members[ra]) >= len(sets.members[rb]) else (rb, ra)
            sets.join(keep, gone)
        rows = [(x, min(g)) for g in sets.members.values() for x in g]
        return pd.DataFrame({by: own[by].iloc[0] if len(own) else None, "node": [r[0] for r in rows], "low": [r[1] for r in rows]})

    both = renewed(placed.where("root is not null")).groupBy(by, "root").cogroup(renewed(within.select(by, "root", "a", "b", "positive", "negative")).groupBy(by, "root"))
    low = both.applyInPandas(merge, f"{by} {kind}, node long, low long")
    low = cut(low.union(placed.where("root is null").select(by, "node", F.col("node").cast("long").alias("low"))))
    groups = numbered(low.where("node = low").select(by, "low"), [by, "low"])  # over all scenes
    first = groups.groupBy(by).agg((F.min("k") - 1).alias("before"))
    groups = groups.join(first, by).select(by, "low", (F.col("k") - F.col("before")).alias("group_id"))
    return low.join(groups, [by, "low"]).select(by, "node", "group_id")


def fragment_merge(counts: DataFrame, edges: DataFrame, visible: int = 30, containment: float = 0.8, support: int = 3, consensus: float = 0.9, cannot_link: int = 2) -> DataFrame:
    """(category, instance_id, merged_id): instances of a class merged by agreement, re-checked for whole components.

    counts: category, instance_id, frame_id, mask_id, n (mask 0: none); edges: category, a, b, positive, negative.
    A union needs the two components' own dominant masks to agree as single instances' do.
    """
    edges = cut(edges)
    accepted = (F.col("positive") >= support) & (F.col("negative") < cannot_link) & (F.col("positive") >= consensus * (F.col("positive") + F.col("negative")))
    placed, within = in_components(edges, edges.where(accepted), "category", "instance_id", counts)

    def merge(seen: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(seen["instance_id"].tolist()))
        sets, per = Sets(ids), {i: {} for i in ids}
        for i, f, m, n in seen[["instance_id", "frame_id", "mask_id", "n"]].itertuples(index=False):
            total, masks = per[i].setdefault(f, [0, {}])
            per[i][f][0] = total + n
            if m > 0:
                masks[m] = masks.get(m, 0) + n

        def dominant(members: set) -> dict:
            sums: dict = {}
            for i in members:
                for f, (total, masks) in per[i].items():
                    mine = sums.setdefault(f, [0, {}])
                    mine[0] += total
                    for m, n in masks.items():
                        mine[1][m] = mine[1].get(m, 0) + n
            out = {}
            for f, (total, masks) in sums.items():
                if total >= visible and masks:
                    n, m = max((n, -m) for m, n in masks.items())
                    if n >= containment * total:
                        out[f] = -m
            return out

        apart = {frozenset((a, b)) for a, b, n in links[["a", "b", "negative"]].itertuples(index=False) if n >= cannot_link}
        agree = lambda p, n: p >= support and n < cannot_link and p >= consensus * (p + n)
        good = [(-p, n, a, b) for a, b, p, n in links[["a", "b", "positive", "negative"]].itertuples(index=False) if agree(p, n)]
        for _, _, a, b in sorted(good):
            ra, rb = sets.root(a), sets.root(b)
            if ra == rb:
                continue
            left, right = sets.members[ra], sets.members[rb]
            da, db = dominant(left), dominant(right)
            both = da.keys() & db.keys()
            same = sum(da[f] == db[f] for f in both)
            if agree(same, len(both) - same) and not any(frozenset((x, y)) in apart for x in left for y in right):
                sets.join(min(ra, rb), max(ra, rb))
        return pd.DataFrame({"category": seen["category"].iloc[0] if len(seen) else None, "instance_id": ids, "merged_id": [sets.root(i) for i in ids]})

    kept = ["category", "root", "instance_id", "frame_id", "mask_id", "n"]
    both = renewed(placed.where("root is not null").select(*kept)).groupBy("category", "root").cogroup(renewed(within.select("category", "root", "a", "b", "positive", "negative")).groupBy("category", "root"))
    merged = both.applyInPandas(merge, "category int, instance_id long, merged_id long")
    alone = placed.where("root is null").select(F.col("category").cast("int").alias("category"), F.col("instance_id").cast("long").alias("instance_id")).distinct()
    return merged.union(alone.select("category", "instance_id", F.col("instance_id").alias("merged_id")))


def online_association(observations: DataFrame, least: int = 30, overlap: float = 0.4, gap: float = 0.15, by: str = "stream") -> DataFrame:
    """(by, frame_id, mask_id, track_id): masks joined over frames by the points they share; ambiguous ones stay out.

    observations: by, frame_id, mask_id, class_id, point_id; frames go in order of their id, masks by theirs. A mask meets
    tracks of its class only, so a stream's classes are tasks of their own, which read their masks in order and hold no more
    than an index of points; tracks are then numbered over the stream in the order of the masks that found them. A stream that
    does not end is streaming.tracks.track_stream's.
    """
    from ..streaming.tracks import Indexed

    kind = observations.schema[by].dataType.simpleString()
    own = observations.where("mask_id > 0 and frame_id is not null").groupBy(by, "frame_id", "mask_id")
    masks = own.agg(F.min("class_id").alias("class_id"), F.max("class_id").alias("_high"), (F.count("class_id") == F.count("*")).alias("_known"), F.collect_set(F.col("point_id").cast("long")).alias("points"))
    masks = masks.where((F.col("class_id") == F.col("_high")) & F.col("_known") & (F.col("class_id") > 0) & (F.size("points") >= least))
    masks = masks.select(by, *[F.col(c).cast("long").alias(c) for c in ("class_id", "frame_id", "mask_id")], F.sort_array("points").alias("points"))
    # more parts than usual, so that few hold two classes
    dealt = masks.repartition(4 * int(masks.sparkSession.conf.get("spark.sql.shuffle.partitions")), by, "class_id").sortWithinPartitions(by, "class_id", "frame_id", "mask_id")

    def associate(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        key, at, held, taken = None, None, None, set()
        for batch in batches:
            names = [batch.column(c).to_pylist() for c in (by, "class_id", "frame_id", "mask_id")]
            points = batch.column("points")
            ends, flat = points.offsets.to_numpy(), points.values.to_numpy()
            rows, new, tracks = [], [], []
            for i, (stream, category, frame, _) in enumerate(zip(*names, strict=True)):
                if key != (stream, category):
                    key, at, held = (stream, category), None, Indexed(least, overlap, gap)
                if at != frame:
                    at, taken = frame, set()
                before = held.founded
                if (k := held.add_mask(category, flat[ends[i] : ends[i + 1]], taken)) is not None:
                    rows.append(i)
                    new.append(held.founded > before)
                    tracks.append(k)
            got = batch.select([by, "class_id", "frame_id", "mask_id"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(tracks, pa.int64()), pa.array(new, pa.bool_())], names=[*got.schema.names, "_own", "_new"])

    joined = cut(dealt.mapInArrow(associate, f"{by} {kind}, class_id long, frame_id long, mask_id long, _own long, _new boolean"))
    placed = numbered(joined.where("_new").select(F.col(by).alias("_by"), F.col("class_id").alias("_class"), "frame_id", "mask_id", F.col("_own").alias("_k")), ["_by", "frame_id", "mask_id"], "_at")
    first = placed.groupBy(F.col("_by").alias("_of")).agg((F.min("_at") - 1).alias("_before"))
    named = placed.join(first, F.col("_by").eqNullSafe(F.col("_of"))).select("_by", "_class", "_k", (F.col("_at") - F.col("_before")).alias("track_id"))
    met = joined.join(named, F.col(by).eqNullSafe(F.col("_by")) & (F.col("class_id") == F.col("_class")) & (F.col("_own") == F.col("_k")))
    return met.select(by, "frame_id", "mask_id", "track_id")


#: Rounds that a greedy matching makes before what is left, if that is no more than so many pairs, is chosen from in one pass.
ROUNDS, LAST_PAIRS = 8, 50_000


def greedy_matching(pairs: DataFrame, by: str = "scene_id", order: tuple[str, ...] = ("coverage",), ascending: tuple[bool, ...] = (False,)) -> DataFrame:
    """The pairs (by, a, b, ...) that a greedy one-to-one choice by the order, then ids, takes.

    A pair that comes first among those of its a and among those of its b is taken whatever the others do, so each round
    takes all such pairs and drops those that share an end with them: two aggregations and no group of a scene. The first of
    what is left is always among them. Nulls come last; of rows equal in order and ids one is taken.
    """
    rank = [x for c, up in zip(order, ascending, strict=True) for x in (F.col(c).isNull().alias(f"_null_{c}"), (F.col(c) if up else -F.col(c)).alias(f"_{c}"))]
    row = F.struct(*[F.col(f"`{c}`") for c in pairs.columns]).alias("_row")
    left = pairs.where("a is not null and b is not null").select(by, "a", "b", F.struct(*rank, "a", "b").alias("_rank"), row)
    left = cut(left.groupBy(by, "a", "b").agg(F.min("_rank").alias("_rank"), F.min_by("_row", "_rank").alias("_row")))
    taken, rounds = [], 0
    while (n := left.count()) and (rounds < ROUNDS or n > LAST_PAIRS):
        first = lambda side, other: left.groupBy(by, side).agg(F.min("_rank").alias("_rank"), F.min_by(F.struct(other, "_row"), "_rank").alias("_of"))
        met = first("a", "b").select(by, "a", "_rank", F.col("_of.b").alias("b"), F.col("_of._row").alias("_row"))
        now = cut(met.join(first("b", "a").select(by, "b", "_rank"), [by, "b", "_rank"], "left_semi"))
        taken.append(now.select("_row.*"))
        for side in ("a", "b"):
            left = left.join(now.select(by, side), [by, side], "left_anti")
        left, rounds = cut(left), rounds + 1
    if n:
        taken.append(chosen_in_order(left, by).select("_row.*"))
    return reduce(DataFrame.union, taken) if taken else pairs.limit(0)


def chosen_in_order(pairs: DataFrame, by: str) -> DataFrame:
    """The same choice in one pass over each scene's pairs (by, a, b, _rank), for a number of pairs that has been checked."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, keep = set(), set(), []
        for a, b in rows.sort_values("_at")[["a", "b"]].itertuples(index=False):
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                keep.append((a, b))
        return pd.DataFrame({by: rows[by].iloc[0], "a": [k[0] for k in keep], "b": [k[1] for k in keep]})

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in (by, "a", "b"))
    ranked = pairs.select(by, "a", "b", F.row_number().over(Window.partitionBy(by).orderBy("_rank")).alias("_at"))
    return pairs.join(ranked.groupBy(by).applyInPandas(choose, kinds), [by, "a", "b"], "left_semi")


def sparse_assignment(edges: Iterable[tuple[int, int, float]], rows: int) -> list[tuple[int, int]]:
    """A set of one-to-one edges (row, column, benefit) of the highest total benefit; rows and columns may stay alone.

    Rows enter one by one along the cheapest alternating path, found over the edges that are there; a column of its own at
    no cost lets a row stay alone. So memory follows the edges, and a path ends where it meets a free column.
    """
    near: list[list[tuple[int, float]]] = [[(-1 - i, 0.0)] for i in range(rows)]
    for i, j, benefit in edges:
        near[i].append((j, -benefit))
    row_price, price, owner, taken = [0.0] * rows, defaultdict(float), {}, {}
    for new in range(rows):
        reach, before, closed, heap = {}, {}, {}, []
        row, far = new, 0.0
        while True:
            for j, cost in near[row]:
                d = far + cost - row_price[row] - price[j]
                if j not in closed and d < reach.get(j, np.inf):
                    reach[j], before[j] = d, row
                    heappush(heap, (d, j))
            far, column = heappop(heap)
            while column in closed:
                far, column = heappop(heap)
            closed[column] = far
            if column not in owner:
                break
            row = owner[column]
        for j, d in closed.items():
            if j in owner:
                row_price[owner[j]] += far - d
            price[j] -= far - d
        row_price[new] += far
        while column is not None:
            row = before[column]
            owner[column], taken[row], column = row, column, taken.get(row)
    return sorted((i, j) for j, i in owner.items() if j >= 0)


def assignment(pairs: DataFrame, by: str = "scene_id", score: str = "iou", most_pairs: bool = True) -> DataFrame:
    """(by, a, b, score): as many one-to-one pairs as possible, and of those sets one with the highest total score.

    Without most_pairs the total score alone counts. Components of pairs are found by Spark, and each is solved on its own:
    no pair leads from one to another, so the whole is best where each part is.
    """
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in (by, "a", "b")}
    pairs = cut(pairs.where("a is not null and b is not null").groupBy(by, "a", "b").agg(F.max(score).cast("double").alias(score)))
    ends = pairs.select(by, F.concat(F.lit("a"), F.col("a").cast("string")).alias("a"), F.concat(F.lit("b"), F.col("b").cast("string")).alias("b"))
    roots = components(ends, [by]).where("startswith(node, 'a')")
    roots = roots.select(by, F.substring("node", 2, 100).cast(kinds["a"]).alias("a"), "root")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a", "b"])
        ia, a = pd.factorize(rows["a"])
        ib, b = pd.factorize(rows["b"])
        s = rows[score].to_numpy()
        base = 1 + 2 * min(len(a), len(b)) * np.abs(s).max() if most_pairs else 0.0
        benefit = {(i, j): x for i, j, x in zip(ia.tolist(), ib.tolist(), s.tolist(), strict=True)}
        got = [(a[i], b[j], benefit[i, j]) for i, j in sparse_assignment(((i, j, base + x) for (i, j), x in benefit.items()), len(a)) if base + benefit[i, j] > 0]
        return pd.DataFrame({by: rows[by].iloc[0], "a": [g[0] for g in got], "b": [g[1] for g in got], score: [g[2] for g in got]})

    return pairs.join(roots, [by, "a"]).groupBy(by, "root").applyInPandas(solve, f"{by} {kinds[by]}, a {kinds['a']}, b {kinds['b']}, {score} double")


def suppressed(pairs: DataFrame, masks: DataFrame, iou: float = 0.8, by: str = "frame_id") -> DataFrame:
    """(by, mask_id): masks kept when, by falling score and index, those too like a kept one go. pairs: by, a, b, iou."""
    kind = masks.schema[by].dataType.simpleString()

    def keep(own: pd.DataFrame, like: pd.DataFrame) -> pd.DataFrame:
        near = defaultdict(set)
        for a, b in like.loc[like["iou"] >= iou, ["a", "b"]].itertuples(index=False):
            near[a].add(b)
            near[b].add(a)
        kept: set = set()
        for m in own.sort_values(["score", "mask_id"], ascending=[False, True])["mask_id"]:
            if not near[m] & kept:
                kept.add(m)
        return pd.DataFrame({by: own[by].iloc[0] if len(own) else None, "mask_id": sorted(kept)})

    return renewed(masks).groupBy(by).cogroup(renewed(pairs).groupBy(by)).applyInPandas(keep, f"{by} {kind}, mask_id long")


def pose_apart(a: np.ndarray, b: np.ndarray, metres: float, degrees: float) -> bool:
    a, b = a.reshape(4, 4), b.reshape(4, 4)
    if np.linalg.norm(a[:3, 3] - b[:3, 3]) >= metres:
        return True
    return bool(np.degrees(np.arccos(np.clip(a[:3, 2] @ b[:3, 2], -1, 1))) >= degrees)


def diverse_views(candidates: DataFrame, budget: int, metres: float = 0.12, degrees: float = 8.0, by: str = "scene_id") -> DataFrame:
    """(by, frame_id, reason): up to budget views by quality, each distinct from those before; the best others fill up.

    candidates: by, frame_id, quality, pose (16 numbers), ordinal.
    """
    kind = candidates.schema[by].dataType.simpleString()

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["quality", "ordinal"], ascending=[False, True], kind="stable").reset_index(drop=True)
        poses = [np.asarray(p, float) for p in rows["pose"]]
        taken: list[int] = []
        for i in range(len(rows)):
            if len(taken) < budget and all(pose_apart(poses[i], poses[j], metres, degrees) for j in taken):
                taken.append(i)
        reason = {i: "quality_and_pose_diversity" for i in taken}
        for i in range(len(rows)):
            if len(reason) >= budget:
                break
            reason.setdefault(i, "quality_budget_fallback")
        out = rows.loc[sorted(reason, key=lambda i: rows["ordinal"][i])]
        return pd.DataFrame({by: out[by], "frame_id": out["frame_id"], "reason": [reason[i] for i in out.index]})

    return candidates.groupBy(by).applyInPandas(choose, f"{by} {kind}, frame_id long, reason string")


def three_views(candidates: DataFrame, apart: int = 20, by: str = "object_id") -> DataFrame:
    """(by, frame_id): up to three views by quality, at least apart frames from each other and distinct in pose."""
    kind = candidates.schema[by].dataType.simpleString()

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[int, np.ndarray]] = []
        for f, p in rows.sort_values(["quality", "frame_id"], ascending=[False, True])[["frame_id", "pose"]].itertuples(index=False):
            p = np.asarray(p, float)
            if len(taken) < 3 and all(abs(f - g) >= apart and pose_apart(p, q, 0.12, 8.0) for g, q in taken):
                taken.append((f, p))
        return pd.DataFrame({by: rows[by].iloc[0], "frame_id": sorted(f for f, _ in taken)})

    return candidates.groupBy(by).applyInPandas(choose, f"{by} {kind}, frame_id long")


def rigid_fit(pairs: DataFrame, by: str = "pair_id") -> DataFrame:
    """(by, transform, rmse): the least-squares rigid motion from points a to b; sums are aggregated by Spark."""
    kind = pairs.schema[by].dataType.simpleString()
    axes = "xyz"
    sums = pairs.groupBy(by).agg(
        F.count("*").alias("n"),
        *[F.sum(f"{s}_{c}").alias(f"{s}{c}") for s in "ab" for c in axes],
        *[F.sum(F.col(f"a_{c}") * F.col(f"b_{d}")).alias(f"p{c}{d}") for c in axes for d in axes],
        *[F.sum(F.col(f"{s}_{c}") * F.col(f"{s}_{c}")).alias(f"q{s}{c}") for s in "ab" for c in axes],
    )

    def solve(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                n = r.n
                ma, mb = (np.array([getattr(r, s + c) for c in axes]) / n for s in "ab")
                h = np.array([[getattr(r, f"p{c}{d}") for d in axes] for c in axes]) - n * np.outer(ma, mb)
                u, _, vt = np.linalg.svd(h)
                flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
                rot = vt.T @ flip @ u.T
                spread = sum(getattr(r, "qa" + c) + getattr(r, "qb" + c) for c in axes) - n * (ma @ ma + mb @ mb)
                rmse = np.sqrt(max(0.0, (spread - 2 * np.trace(rot @ h)) / n))
                m = np.eye(4)
                m[:3, :3], m[:3, 3] = rot, mb - rot @ ma
                out.append((getattr(r, by), m.reshape(-1).tolist(), float(rmse)))
            yield pd.DataFrame(out, columns=[by, "transform", "rmse"])

    return sums.mapInPandas(solve, f"{by} {kind}, transform array<double>, rmse double")
