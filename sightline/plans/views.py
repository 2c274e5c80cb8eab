"""The engine's tables derived from the star schema, and the same derivations in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import cut

CLASSES = ("unknown", "table", "cup", "book", "chair", "cabinet", "lamp", "monitor", "box", "door")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_points(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Points from the first three components of the embeddings; objects by label and id."""
    e = table(spark, sf_dir, "embeddings")
    p = e.select(F.col("vec_id").alias("point_id"), *[(F.col("embedding")[i].cast("double") * 10).alias(c) for i, c in enumerate("xyz")], F.col("label").cast("int").alias("semantic_id"), F.when(F.col("vec_id") % 11 == 0, 0).otherwise(F.col("label") * 13 + F.col("vec_id") % 13 + 1).cast("long").alias("instance_id"))
    if spread:
        i = F.col("instance_id")
        p = p.withColumns({"x": F.col("x") + 1.5 * (i % 12), "y": F.col("y") + 1.5 * F.floor(i / 12), "z": F.col("z") + 0.9 * (i % 7)})
    return p


def classes(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("class_id"), F.lit(n).alias("name")) for i, n in enumerate(CLASSES)])))


#: Rows that a task sorts when observations are made; more rows are more tasks, however many partitions the session asks for.
TASK_ROWS = 500_000


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames are suppliers, points are parts; of several rows for both the first by order and line counts.

    Lines are dealt by part once, for the choice of the first and for what is joined by part.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity", "l_discount")
    li = li.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-li.count() // TASK_ROWS)), "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    first = li.groupBy(F.col("l_suppkey").alias("frame_id"), F.col("l_partkey").alias("point_id")).agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount")).alias("m"))
    both = first.join(part, F.col("point_id") == F.col("p_partkey"))
    cls = F.when(F.col("m.l_returnflag") == "R", (F.col("p_size") + 1) % 6).otherwise(F.col("p_size") % 6)
    return both.select("frame_id", "point_id", (F.col("p_size") % 4 + 1).cast("int").alias("mask_id"), cls.cast("int").alias("class_id"), (F.col("m.l_quantity") / 50).alias("confidence"), (F.col("m.l_discount") > 0.01).alias("interior"))


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of observed points: (point_id, semantic_id, instance_id)."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"), (F.col("p_size") % 6).cast("int").alias("semantic_id"), (F.col("p_partkey") % 40).cast("long").alias("instance_id"))


def name_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("instance_id"), F.when(F.col("event_type") == "error", "unknown").otherwise(F.col("event_type")).alias("label"), (F.col("event_id") % 20).alias("frame_id"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen sequences of frames; ordinal is the place by event id, so times may fall."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select((F.col("user_id") % 16).cast("string").alias("sequence_id"), F.col("event_id").alias("frame_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp_us"))
    return e.withColumn("ordinal", (F.row_number().over(Window.partitionBy("sequence_id").orderBy("frame_id")) - 1).cast("long"))


def relief(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of a surface of parts in rows as long as the square root of their number, their sizes as heights."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    wide = part.agg(F.floor(F.sqrt(F.max("p_partkey"))).cast("long").alias("w"))
    own = part.crossJoin(F.broadcast(wide)).withColumn("k", F.col("p_partkey"))
    vertices = own.select(F.col("k").alias("vertex_id"), (F.col("k") % F.col("w")).cast("double").alias("x"), F.floor(F.col("k") / F.col("w")).cast("double").alias("y"), (F.col("p_size") / 5).alias("z"), (F.col("p_size") / 50).alias("red"), F.lit(0.5).alias("green"), F.lit(0.25).alias("blue"))
    k, w = F.col("k"), F.col("w")
    corners = own.where(k % w < w - 1).select(F.inline(F.array(F.struct(k.alias("a"), (k + 1).alias("b"), (k + w).alias("c")), F.struct((k + 1).alias("a"), (k + w + 1).alias("b"), (k + w).alias("c")))))
    for c in "abc":
        corners = corners.join(vertices.select(F.col("vertex_id").alias(c)), c, "left_semi")
    return vertices, corners.withColumn("face_id", 2 * F.least("a", "c") + (F.col("b") > F.col("c")).cast("long")).select("face_id", "a", "b", "c")


def depth_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by supplier with PNG images of 16 pixels a line: prices as depth, quantities as colour, in order of lines.

    A supplier's lines are a fixed number whatever the scale, so they are collected by frame. Every third frame is turned.
    """
    import pandas as pd

    from ..sources.images import encode_png

    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("frame_id"), "l_orderkey", "l_linenumber", (F.floor("l_extendedprice") % 65536).cast("int").alias("depth"), F.col("l_quantity").cast("int").alias("colour"))
    own = li.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "depth", "colour"))).alias("p"))

    def images(batches):
        for batch in batches:
            out = []
            for frame, depth, colour in zip(batch["frame_id"], batch["depth"], batch["colour"], strict=True):
                flat = np.zeros((2, -(-len(depth) // 16) * 16), np.uint16)
                flat[0, : len(depth)], flat[1, : len(depth)] = depth, colour
                both = flat.reshape(2, -1, 16)
                out.append((frame, frame % 3 == 0, encode_png(both[1].astype(np.uint8), frame % 5), encode_png(both[0], [(frame + y) % 5 for y in range(both.shape[1])])))
            yield pd.DataFrame(out, columns=["frame_id", "rotate_ccw", "color_png", "depth_png"])

    made = own.select("frame_id", "p.depth", "p.colour").mapInPandas(images, "frame_id long, rotate_ccw boolean, color_png binary, depth_png binary")
    return made.withColumn("intrinsics", F.struct(F.lit(500.0).alias("fx"), F.lit(510.0).alias("fy"), F.lit(7.5).alias("cx"), F.lit(3.0).alias("cy")))


def refinement(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of operators.anchors for the sequences of frames: three anchors in nine frames and the last one.

    Every second anchor between two others is empty, and those of sequence 5 that targets need. Sequence 3 swaps two targets
    of its second batch; edges lack weight, sources or finite targets where the target's number says so.
    """
    from ..operators.anchors import source_topology

    f = cut(frames(spark, sf_dir).select("sequence_id", "ordinal"))  # all tables are made from these, and some of them met several times
    sequences = cut(f.groupBy("sequence_id").agg(F.count("*").alias("frames")))
    anchors = cut(f.join(sequences, "sequence_id").where("ordinal % 9 < 3 or ordinal = frames - 1").select("sequence_id", "ordinal"))
    t = source_topology(sequences, anchors)
    swap = F.when((F.col("sequence_id") == "3") & F.col("place").isin(20, 21), 41 - F.col("place")).otherwise(F.col("place"))
    batches = t.select("sequence_id", F.floor(swap / 16).alias("batch"), (swap % 16).alias("local"), "ordinal")
    nodes = f.join(sequences, "sequence_id").where("ordinal % 9 < 3").select("sequence_id", (3 * F.floor(F.col("ordinal") / 9) + F.col("ordinal") % 9).alias("node"), (F.col("ordinal") % 9).alias("m"))
    empty = nodes.where("(m = 1 and node % 2 = 0) or (sequence_id = '5' and m = 0 and node = 6)").select("sequence_id", "node")
    fixed = anchors.groupBy("sequence_id").agg(F.count("*").alias("start"))
    calls = batches.groupBy("sequence_id", "batch").agg(F.count("*").alias("n")).join(fixed, "sequence_id").select("sequence_id", F.col("batch").alias("call"), "batch", "start", (F.col("start") + F.col("n")).alias("end"))
    each = t.join(fixed, "sequence_id").select("sequence_id", F.col("batch").alias("call"), F.explode(F.array("previous", "next")).alias("source"), (F.col("start") + F.col("local")).alias("target"), "place")
    p, eight = F.col("place"), F.lit(8)
    edges = each.select("sequence_id", "call", "source", "target", F.when(p % 101 == 5, 0).otherwise(4).alias("pixels"), eight.alias("targets"), F.when(p % 89 == 7, 7).otherwise(8).alias("finite_targets"), eight.alias("weights"), eight.alias("finite_weights"), F.when((p % 97 == 11) | (p % 101 == 5), 0).otherwise(6).alias("nonzero_weights"), F.when((p % 97 == 11) | (p % 101 == 5), 0).otherwise(3).alias("nonzero_pixels"))
    edges = edges.where(p % 113 != 9)
    measured = empty.where("sequence_id = '7'").groupBy("sequence_id").agg(F.min("node").alias("node")).select("sequence_id", F.lit(1).cast("long").alias("call"), "node")
    return {"sequences": sequences, "anchors": anchors, "batches": batches, "calls": calls, "edges": edges, "empty": empty, "measured": measured}


def artifacts(spark: SparkSession, sf_dir: str, name: str = "benchmark", key: str = "item_id") -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).cast("string").alias("name"), F.sha2("text", 256).alias("sha256"))


POINTS_SQL = """
points AS (
  SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z,
         CAST(label AS INTEGER) AS semantic_id, CAST(CASE WHEN vec_id % 11 = 0 THEN 0 ELSE label * 13 + vec_id % 13 + 1 END AS BIGINT) AS instance_id
  FROM embeddings)"""
SPREAD_SQL = (
    POINTS_SQL.replace("points AS", "packed AS")
    + """,
points AS (
  SELECT point_id, x + 1.5::DOUBLE * (instance_id % 12) AS x, y + 1.5::DOUBLE * floor(instance_id / 12) AS y, z + 0.9::DOUBLE * (instance_id % 7) AS z, semantic_id, instance_id FROM packed)"""
)
OBSERVATIONS_SQL = """
obs AS (
  SELECT l_suppkey AS frame_id, l_partkey AS point_id, CAST(p_size % 4 + 1 AS INTEGER) AS mask_id,
         CAST(CASE WHEN l_returnflag = 'R' THEN (p_size + 1) % 6 ELSE p_size % 6 END AS INTEGER) AS class_id, l_quantity / 50 AS confidence, l_discount > 0.01 AS interior
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) JOIN part ON p_partkey = l_partkey WHERE rn = 1),
lab AS (SELECT p_partkey AS point_id, CAST(p_size % 6 AS INTEGER) AS semantic_id, CAST(p_partkey % 40 AS BIGINT) AS instance_id FROM part)"""
NAMES_SQL = """
votes AS (SELECT user_id AS instance_id, CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS label, event_id % 20 AS frame_id FROM events)"""
FRAMES_SQL = """
frames AS (
  SELECT CAST(user_id % 16 AS VARCHAR) AS sequence_id, event_id AS frame_id, epoch_us(ts) AS timestamp_us,
         row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) - 1 AS ordinal FROM events)"""
TOPOLOGY_SQL = (
    FRAMES_SQL
    + """,
sizes AS (SELECT sequence_id, count(*) AS frames FROM frames GROUP BY ALL),
anchors AS (SELECT sequence_id, ordinal, row_number() OVER (PARTITION BY sequence_id ORDER BY ordinal) - 1 AS node FROM frames JOIN sizes USING (sequence_id) WHERE ordinal % 9 < 3 OR ordinal = frames - 1),
targets AS (SELECT f.sequence_id, f.ordinal, row_number() OVER (PARTITION BY f.sequence_id ORDER BY f.ordinal) - 1 AS place FROM frames f WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE a.sequence_id = f.sequence_id AND a.ordinal = f.ordinal)),
topology AS (
  SELECT t.sequence_id, t.ordinal, place, place // 16 AS batch, place % 16 AS local, p.node AS previous, p.node + 1 AS next, p.ordinal AS previous_ordinal, n.ordinal AS next_ordinal
  FROM targets t ASOF JOIN anchors p ON t.sequence_id = p.sequence_id AND t.ordinal >= p.ordinal JOIN anchors n ON n.sequence_id = p.sequence_id AND n.node = p.node + 1)"""
)
RELIEF_SQL = """
wide AS (SELECT CAST(floor(sqrt(max(p_partkey))) AS BIGINT) AS w FROM part),
own AS (SELECT p_partkey AS k, w, CAST(p_partkey % w AS DOUBLE) AS x, CAST(p_partkey // w AS DOUBLE) AS y, p_size / 5 AS z, p_size / 50 AS red FROM part, wide),
tri AS (SELECT k AS a, k + 1 AS b, k + w AS c FROM own WHERE k % w < w - 1 UNION ALL SELECT k + 1, k + w + 1, k + w FROM own WHERE k % w < w - 1),
faces AS (SELECT * FROM tri WHERE a IN (SELECT k FROM own) AND b IN (SELECT k FROM own) AND c IN (SELECT k FROM own))"""
CLASSES_SQL = "classes(class_id, name) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(CLASSES)) + ")"
#: Objects with their boxes: needs points; thresholds as in the graph.
NODES_SQL = """
counts AS (SELECT instance_id, semantic_id, count(*) AS n FROM points WHERE instance_id > 0 GROUP BY ALL),
top AS (SELECT instance_id, max(n) AS m FROM counts GROUP BY ALL),
win AS (SELECT c.instance_id, count(*) AS k, min(semantic_id) AS s FROM counts c JOIN top t ON c.instance_id = t.instance_id AND c.n = t.m GROUP BY c.instance_id),
nodes AS (
  SELECT p.instance_id, CASE WHEN any_value(k) = 1 THEN any_value(s) ELSE 0 END AS semantic_id, count(*) AS point_count, any_value(m) / count(*) AS class_share,
         min(x) AS x_low, max(x) AS x_high, min(y) AS y_low, max(y) AS y_high, min(z) AS z_low, max(z) AS z_high, avg(x) AS x, avg(y) AS y, avg(z) AS z
  FROM points p JOIN win USING (instance_id) JOIN top USING (instance_id) WHERE p.instance_id > 0 GROUP BY p.instance_id HAVING count(*) >= 3)"""
