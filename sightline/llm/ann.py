"""Approximate nearest neighbours over balanced posting lists (operator 8).

Centroids are fitted by k-means on a sample and balanced: clusters that hold too much of the sample are split again.
A neighbour graph over the centroids is kept in memory and searched with a beam, many vectors at once. Each vector goes
to its nearest centroid's posting list and, as a boundary vector, to further lists whose centroids are hardly farther
away. A query reads the lists whose centroids are within a ratio of the nearest one's distance. Long lists are dealt
into parts of about PART vectors by hash, so that no task holds a whole long list. Within a part distances are exact, in
double precision.

That gives a distance up to which a query's answer can lie (none if too few candidates were found). Every list whose
centroid less its radius is not beyond that distance is then read too, so answers are whole and exact, wherever
a query lies. Vectors count to the radius of their nearest list only. Queries are broadcast in blocks of at most ASKED;
where lists overlap much, as in data without clusters, this reads nearly all vectors for each query.

Equal vectors are one entry with their smallest ids, as many as an answer can need, so copies neither fill lists nor
multiply work; equal queries are searched once.

The index is fitted on at most SAMPLE vectors of SAMPLE_NUMBERS components in all, those of smallest hash, and holds every vector. Null, empty and all-zero
vectors, those with null or non-finite components, those of another length than most, and rows without id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE, SAMPLE_NUMBERS = 50_000, 1 << 25
#: Larger components are scaled down for the graph, which is in single precision.
FLOAT_MOST = 1e15
A_LIST, MOST_LISTS, PART = 200, 4096, 2000
LINKS, BEAM = 16, 48
ASKED = 50_000
#: A vector is in lists up to this ratio of the nearest centroid's distance; a query reads lists up to the other.
REPLICATE, COPIES, READ = 1.05, 4, 1.3


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None])


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centre = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([distances(x[a : a + 4096], centre).argmin(1) for a in range(0, len(x), 4096)])
        count = np.bincount(near, minlength=len(centre))
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], np.searchsorted(near[order], full), axis=0)
        centre = sums / count[full, None]
    return centre


def balanced(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Centroids of clusters of which none has far more than its share of the sample, unless its vectors are equal."""
    rng = np.random.default_rng(seed)
    most = 2 * max(1, len(x) // k)
    out = []
    centre = k_means(x, k, rng)
    near = np.concatenate([distances(x[a : a + 4096], centre).argmin(1) for a in range(0, len(x), 4096)])
    todo = [x[near == i] for i in range(len(centre))]
    while todo:
        part = todo.pop()
        if not len(part):
            continue
        if len(part) > most:
            two = k_means(part, 2, rng)
            if len(two) == 2:
                left = distances(part, two).argmin(1) == 0
                if 0 < left.sum() < len(part):
                    todo += [part[left], part[~left]]
                    continue
        out.append(part.mean(0))
    return np.array(out, np.float32)


@dataclass
class Graph:
    """Centroids with links to their nearest ones and to some at random; entries are spread over all.

    Centroids are in units of scale, which is 1 unless vectors exceed single precision.
    """

    centre: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    scale: float = 1.0

    @classmethod
    def over(cls, centre: np.ndarray, scale: float = 1.0, seed: int = 4) -> Graph:
        rng, n = np.random.default_rng(seed), len(centre)
        near = min(LINKS, max(0, n - 1))
        rows = []
        for a in range(0, n, 1024):
            d = distances(centre[a : a + 1024], centre)
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            rows.append(np.argsort(d, axis=1)[:, :near])
        links = np.concatenate([np.concatenate(rows), rng.integers(0, n, (n, 4))], axis=1)
        entries = [0]
        d = distances(centre, centre[:1])[:, 0]
        for _ in range(min(n, 8) - 1):
            entries.append(int(d.argmax()))
            d = np.minimum(d, distances(centre, centre[entries[-1:]])[:, 0])
        return cls(centre, links, np.unique(entries), scale)

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of each row's beam, nearest first."""
        n, k = len(x), len(self.centre)
        beam = min(beam, k)
        seen = np.zeros((n, k), bool)
        rows = np.arange(n)[:, None]
        ids = np.broadcast_to(self.entries, (n, len(self.entries)))
        dist = distances(x, self.centre[self.entries])
        seen[rows, ids] = True
        pad = max(0, beam - ids.shape[1])
        ids = np.concatenate([ids, np.zeros((n, pad), np.int64)], axis=1)
        dist = np.concatenate([dist, np.full((n, pad), np.inf)], axis=1)
        done = np.isinf(dist)
        norm = (self.centre * self.centre).sum(1)
        own = (x * x).sum(1)
        while True:
            open_ = np.where(done, np.inf, dist)
            at = open_.argmin(1)
            live = np.flatnonzero(np.isfinite(open_[np.arange(n), at]))
            if not len(live):
                break
            done[live, at[live]] = True
            new = self.links[ids[live, at[live]]]
            fresh = ~seen[live[:, None], new]
            seen[live[:, None], new] = True
            d = own[live, None] + norm[new] - 2 * np.einsum("nd,nkd->nk", x[live], self.centre[new])
            order = np.argsort(new, axis=1, kind="stable")
            twice = np.zeros_like(fresh)  # a centroid linked twice counts once
            twice[np.arange(len(live))[:, None], order[:, 1:]] = np.take_along_axis(new, order, 1)[:, 1:] == np.take_along_axis(new, order, 1)[:, :-1]
            d = np.where(fresh & ~twice, np.maximum(0, d), np.inf)
            every_i = np.concatenate([ids[live], new], axis=1)
            every_d = np.concatenate([dist[live], d], axis=1)
            every_f = np.concatenate([done[live], np.isinf(d)], axis=1)
            best = np.argsort(every_d, axis=1, kind="stable")[:, : ids.shape[1]]
            ids[live] = np.take_along_axis(every_i, best, 1)
            dist[live] = np.take_along_axis(every_d, best, 1)
            done[live] = np.take_along_axis(every_f, best, 1) | np.isinf(dist[live])
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def usable(vector: Column) -> Column:
    """Whether a vector takes part, its length aside."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def listed(rows: DataFrame, graph, ratio: float, most: int | None) -> DataFrame:
    """rows (with a vector column v) once for each posting list: list int, away double before the other columns.

    away is the distance to the centroid in a row's nearest list, null in the others.
    """
    names = rows.columns
    schema = f"list int, away double, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = graph.value
        for whole in batches:
            for a in range(0, len(whole), 1024):
                batch = whole.slice(a, 1024)
                whole_x = np.array(batch.column("v").to_pylist(), np.float64)
                if not len(whole_x):
                    continue
                x = (whole_x / own.scale).astype(np.float32)
                ids, d = own.search(x, COPIES * 2 if most else BEAM * 2)
                fit = np.sqrt(d) <= ratio * np.sqrt(d[:, :1]) + 1e-6
                fit[:, 0] = True
                if most:
                    fit[:, most:] = False
                row, col = np.nonzero(fit)
                got = batch.take(pa.array(row))
                exact = whole_x - own.centre[ids[:, 0]].astype(np.float64) * own.scale
                away = pa.array(np.sqrt((exact * exact).sum(1))[row], mask=col > 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col].astype(np.int32)), away, *[got.column(c) for c in names]], names=["list", "away", *names])

    return rows.mapInArrow(deal, schema)


def read_on(home: DataFrame, asked: DataFrame, centre: np.ndarray, radius: np.ndarray, k: int) -> DataFrame:
    """(h1, h2, score, ids) of home's entries that can be among the k + 1 nearest of asked's vectors.

    home has list, v, ids, rows of a list one after another; asked h1, h2, v, reach; no answer lies beyond reach.
    """
    spark = home.sparkSession
    table = asked.toArrow()
    q = np.array(table.column("v").to_pylist(), np.float64)
    h1, h2, reach = (table.column(c).to_numpy() for c in ("h1", "h2", "reach"))
    shared = spark.sparkContext.broadcast((q, h1, h2, reach, centre.astype(np.float64), radius))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, h1, h2, reach, centre, radius = shared.value
        reach = reach.copy()
        own = (q * q).sum(1)
        for batch in batches:
            if not len(batch):
                continue
            x = np.array(batch.column("v").to_pylist(), np.float64)
            lists = batch.column("list").to_numpy()
            ids = batch.column("ids")
            starts = np.flatnonzero(np.diff(lists, prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(lists)], strict=True):
                gap = np.sqrt(((q - centre[lists[a]]) ** 2).sum(1)) - radius[lists[a]]
                need = np.flatnonzero(gap <= reach * (1 + 1e-9) + 1e-9)
                for c in range(a, b, PART):
                    part = x[c : min(b, c + PART)]
                    norm = (part * part).sum(1)
                    for s in range(0, len(need), 1024):
                        asks = need[s : s + 1024]
                        d = own[asks, None] - 2 * (q[asks] @ part.T) + norm[None]
                        slack = 1e-9 * (own[asks, None] + norm[None])
                        if len(part) > k:  # k + 1 entries lie within this distance
                            reach[asks] = np.minimum(reach[asks], np.sqrt(np.maximum(0, np.partition(d + slack, k, axis=1)[:, k])))
                        row, col = np.nonzero(d <= reach[asks, None] ** 2 + slack)
                        if len(row):
                            score = np.sqrt(((part[col] - q[asks[row]]) ** 2).sum(1))
                            yield pa.RecordBatch.from_arrays([pa.array(h1[asks[row]]), pa.array(h2[asks[row]]), pa.array(score), ids.take(pa.array(col + c))], names=["h1", "h2", "score", "ids"])

    return home.mapInArrow(scan, "h1 long, h2 long, score double, ids array<long>")


def nearest(vectors: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest other rows for each row that queries marks.

    queries is a condition on the column vec_id. Nearest first by Euclidean distance, ties by the smaller vec_id.
    """
    spark = vectors.sparkSession
    kind = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null").where(usable(F.col("v")))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], kind)
    rows = rows.where(F.size("v") == length["d"])
    # two hashes of 64 bits name a vector; a task keeps its k + 1 smallest ids before anything is shuffled
    same = ["h1", "h2"]
    rows = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    place = F.row_number().over(Window.partitionBy(*same).orderBy("vec_id"))
    entries = rows.distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    entries = written(entries.groupBy(*same).agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    n = entries.count()
    top = entries.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    scale = float(top) if top > FLOAT_MOST else 1.0
    sample = min(sample, max(1000, SAMPLE_NUMBERS // max(1, length["d"])))
    some = np.array([np.array(r["v"]) / scale for r in entries.select("v", *same).orderBy(*same).limit(sample).select("v").toLocalIterator()], np.float32)
    graph = Graph.over(balanced(some, max(1, min(MOST_LISTS, n // A_LIST, len(some) // 4))), scale)
    shared = spark.sparkContext.broadcast(graph)  # bounded by MOST_LISTS centroids, doubled at most by balancing
    postings = written(listed(entries.select("v", "ids"), shared, REPLICATE, COPIES), "postings")
    sizes = postings.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.max("away").alias("radius")).collect()
    radius = np.full(len(graph.centre), -np.inf)
    for r in sizes:
        if r["radius"] is not None:
            radius[r["list"]] = r["radius"]
    parts = F.broadcast(spark.createDataFrame([(r["list"], r["parts"]) for r in sizes], "list int, parts int"))  # a row for each list
    home = postings.where("away is not null").select("list", "v", "ids")
    postings = postings.join(parts, "list").select("list", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int").alias("part"), "v", "ids")
    asked = rows.where(queries).distinct()
    distinct = asked.groupBy(*same).agg(F.first("v").alias("v"))
    wanted = listed(distinct.select("h1", "h2", "v"), shared, READ, None).join(parts, "list")
    wanted = wanted.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "h1", "h2", F.col("v").alias("q"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            x = np.stack(left["v"].to_numpy())
            ids = left["ids"].to_numpy()
            low = np.array([i[0] for i in ids])
            for h1, h2, q in zip(right["h1"], right["h2"], right["q"], strict=True):
                d = np.sqrt(((x - q) ** 2).sum(1))
                few = np.flatnonzero(d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)])
                few = few[np.lexsort((low[few], d[few]))][: k + 1]
                out += [(h1, h2, float(d[i]), ids[i].tolist()) for i in few]
        return pd.DataFrame(out, columns=["h1", "h2", "score", "ids"])

    found = wanted.groupBy("list", "part").cogroup(postings.groupBy("list", "part")).applyInPandas(lambda q, p: search(p, q), "h1 long, h2 long, score double, ids array<long>")
    found = written(found, "found")
    within = Window.partitionBy(*same).orderBy("score", "low")
    reach = found.select(*same, "score", F.col("ids")[0].alias("low")).distinct().withColumn("place", F.row_number().over(within)).where(F.col("place") == k + 1).select(*same, F.col("score").alias("reach"))
    distinct = distinct.join(reach, same, "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    blocks = -(-distinct.count() // ASKED)
    home = home.join(parts, "list").repartition("list", F.pmod(F.xxhash64("ids"), F.col("parts"))).sortWithinPartitions("list").select("list", "v", "ids")
    if blocks > 1:
        distinct, home = written(distinct, "asked"), written(home, "home")
    for i in range(blocks):
        asks = distinct.where(F.pmod(F.xxhash64(F.lit(2), *same), F.lit(blocks)) == i)
        found = found.unionByName(written(read_on(home, asks, graph.centre.astype(np.float64) * scale, radius, k), "further"))
    by_query = Window.partitionBy(*same).orderBy("score", "vec_id")
    # the k + 1 nearest entries of a query, its own among them
    answers = found.select("h1", "h2", "score", F.explode("ids").alias("vec_id")).groupBy(*same, "vec_id").agg(F.min("score").alias("score")).withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= k + 1)
    answers = written(answers.select("h1", "h2", "score", "vec_id"), "answers")
    own = asked.select(F.col("vec_id").alias("query_id"), *same).join(answers, same).where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
