"""The registered queries of the engine's operators and, for each that SQL can express, its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.scalar import coloured, label_key
from ..operators import anchors, evaluation, graph, iterative, masks, measured, naming, spatial, surface, temporal, votes
from ..sources import images, provenance, sinks
from . import query, views
from .folders import cut

UP = (0.0, 0.0, 1.0)
#: The packed points are so close that a small margin is selective; supports need a wide gap there.
PACKED = graph.Thresholds(near_m=0.5, min_points=3, max_candidates=100_000_000)
WIDE = graph.Thresholds(near_m=0.5, support_gap_m=0.5, min_points=3, max_candidates=100_000_000)
#: Consensus thresholds for the derived observations, whose masks are small.
SMALL = masks.Consensus(mask_points=20, output_points=10)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(c: str):
    return F.round(c, 6).alias(c)


def _nodes(spark, d, spread=False, up=None):
    return graph.objects(views.map_points(spark, d, spread), min_points=3, up=up)


TOP2_SQL = """
scores AS (SELECT point_id, class_id, sum(CAST(round(confidence * 1000000) AS BIGINT)) AS s, count(*) AS n FROM obs WHERE class_id > 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY s DESC, class_id) AS rn, sum(s) OVER (PARTITION BY point_id) AS total, lead(s) OVER (PARTITION BY point_id ORDER BY s DESC, class_id) AS second FROM scores),
known AS (SELECT point_id, class_id, n, s / total AS conf FROM ranked WHERE rn = 1 AND n >= 2 AND 1000 * s >= 650 * total AND 1000 * (s - coalesce(second, 0)) >= 150 * total)"""


@register(f"""WITH {views.OBSERVATIONS_SQL}, {TOP2_SQL},
seen AS (SELECT point_id, count(*) AS visible FROM obs GROUP BY ALL)
SELECT seen.point_id, coalesce(known.class_id, 0) AS class_id, round(coalesce(conf, 0), 6) AS confidence, visible, coalesce(ranked.n, 0) AS votes
FROM seen LEFT JOIN known USING (point_id) LEFT JOIN (SELECT point_id, n FROM ranked WHERE rn = 1) ranked USING (point_id)""")
def votes_argmax_margin(spark, d):
    return votes.finalize_votes(views.observations(spark, d)).select("point_id", "class_id", r6("confidence"), "visible", "votes")


@register(f"""WITH {views.OBSERVATIONS_SQL} SELECT point_id, class_id, round(sum(confidence), 6) AS score, count(*) AS votes FROM obs WHERE class_id > 0 GROUP BY ALL""")
def votes_accumulated(spark, d):
    return votes.votes(views.observations(spark, d)).select("point_id", "class_id", r6("score"), "votes")


@register(f"""WITH {views.OBSERVATIONS_SQL} SELECT point_id, max(confidence) AS high FROM obs WHERE interior AND class_id > 0 AND confidence >= .5 GROUP BY ALL""")
def votes_point_maximum(spark, d):
    return votes.point_maximum(views.observations(spark, d))


@register(f"""WITH {views.OBSERVATIONS_SQL}, o2 AS (SELECT * REPLACE (point_id * 25 + frame_id % 25 AS point_id) FROM obs), {TOP2_SQL.replace("FROM obs", "FROM o2")},
one AS (SELECT point_id, count(*) AS n, max(class_id) AS class_id FROM o2 WHERE class_id > 0 GROUP BY ALL HAVING count(*) = 1),
high AS (SELECT point_id, max(confidence) AS high FROM o2 WHERE interior AND class_id > 0 AND confidence >= .5 GROUP BY ALL)
SELECT point_id, one.class_id, high FROM one JOIN high USING (point_id) WHERE high >= .9 AND point_id NOT IN (SELECT point_id FROM known)""")
def votes_single_view(spark, d):
    # each part is 25 points, told apart by frame, so that many points have one view; every observation counts
    return votes.single_view(views.observations(spark, d).withColumn("point_id", F.col("point_id") * 25 + F.col("frame_id") % 25))


@register(f"""WITH {views.OBSERVATIONS_SQL}, {TOP2_SQL},
one AS (SELECT point_id, count(*) AS n, max(class_id) AS class_id FROM obs WHERE class_id > 0 GROUP BY ALL HAVING count(*) = 1),
high AS (SELECT point_id, max(confidence) AS high FROM obs WHERE interior AND class_id > 0 AND confidence >= .5 GROUP BY ALL)
SELECT point_id, one.class_id, high FROM one JOIN high USING (point_id) WHERE high >= .9 AND point_id NOT IN (SELECT point_id FROM known)""")
def votes_single_view_whole(spark, d):
    return votes.single_view(views.observations(spark, d))


@register(f"""WITH {views.OBSERVATIONS_SQL}, {TOP2_SQL},
bad AS (SELECT point_id FROM obs WHERE class_id > 0 GROUP BY ALL HAVING count(DISTINCT class_id) > 1)
SELECT lab.point_id, CASE WHEN g THEN 0 ELSE semantic_id END AS semantic_id, CASE WHEN g THEN 0 ELSE instance_id END AS instance_id, CASE WHEN g THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence, g AS guarded
FROM (SELECT lab.*, point_id IN (SELECT point_id FROM bad) AND point_id NOT IN (SELECT point_id FROM known) AS g FROM lab) lab""")
def conflict_guard(spark, d):
    labels = views.part_labels(spark, d).withColumn("confidence", F.lit(1.0))
    return votes.conflict_guard(views.observations(spark, d), labels)


@register(f"""WITH {views.POINTS_SQL}, {views.NODES_SQL}
SELECT instance_id, semantic_id, point_count, round(class_share, 6) AS class_share, x_low, x_high, y_low, y_high, z_low, z_high, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM nodes""")
def object_nodes(spark, d):
    return _nodes(spark, d).select("instance_id", "semantic_id", "point_count", r6("class_share"), *[f"{c}_{k}" for c in "xyz" for k in ("low", "high")], *map(r6, "xyz"))


@register(f"""WITH {views.POINTS_SQL} SELECT count_if(instance_id = 0) AS unassigned_instance_points, count_if(semantic_id = 0) AS semantic_unknown_points FROM points""")
def unknown_counts(spark, d):
    return graph.unknown_counts(views.map_points(spark, d))


@register(f"""WITH {views.POINTS_SQL} SELECT instance_id FROM points WHERE instance_id > 0 GROUP BY ALL HAVING count(*) < 3""")
def omitted_objects(spark, d):
    return graph.omitted(views.map_points(spark, d), 3)


GAP_SQL = "sqrt(" + " + ".join(f"greatest(0.0, a.{c}_low - b.{c}_high, b.{c}_low - a.{c}_high) ^ 2" for c in "xyz") + ")"


@register(f"""WITH {views.SPREAD_SQL}, {views.NODES_SQL}
SELECT a.instance_id AS source, b.instance_id AS target, round({GAP_SQL}, 6) AS aabb_gap_m FROM nodes a JOIN nodes b ON a.instance_id < b.instance_id WHERE {GAP_SQL} <= .5""")
def edges_near(spark, d):
    return graph.near_edges(_nodes(spark, d, True), PACKED).select("source", "target", r6("aabb_gap_m"))


HOLDS = " AND ".join(f"a.{c}_low <= b.{c}_low AND a.{c}_high >= b.{c}_high" for c in "xyz")
LARGER = " OR ".join(f"a.{c}_low < b.{c}_low OR a.{c}_high > b.{c}_high" for c in "xyz")


@register(f"""WITH {views.POINTS_SQL}, {views.NODES_SQL} SELECT a.instance_id AS source, b.instance_id AS target FROM nodes a JOIN nodes b ON a.instance_id <> b.instance_id WHERE {HOLDS} AND ({LARGER})""")
def edges_contains(spark, d):
    return graph.contains_edges(_nodes(spark, d), PACKED).select("source", "target")


# with up along z the basis is (x', y') = (y, -x): seed axis x, crossed with z
VERTICAL_SQL = """
foot AS (SELECT a.instance_id AS source, b.instance_id AS target, a.z_low - b.z_high AS gap,
  greatest(0.0, least(a.x_high, b.x_high) - greatest(a.x_low, b.x_low)) * greatest(0.0, least(a.y_high, b.y_high) - greatest(a.y_low, b.y_low)) AS common,
  least((a.x_high - a.x_low) * (a.y_high - a.y_low), (b.x_high - b.x_low) * (b.y_high - b.y_low)) AS area
  FROM nodes a JOIN nodes b ON a.instance_id <> b.instance_id WHERE a.z > b.z)"""


@register(f"""WITH {views.SPREAD_SQL}, {views.NODES_SQL}, {VERTICAL_SQL} SELECT source, target, round(gap, 6) AS vertical_gap_m, round(common / area, 6) AS footprint_overlap FROM foot WHERE area > 0 AND common / area >= .25 AND gap >= -.05""")
def edges_above(spark, d):
    return graph.vertical_edges(_nodes(spark, d, True, UP), PACKED).where("relation = 'above'").select("source", "target", r6("vertical_gap_m"), r6("footprint_overlap"))


@register(f"""WITH {views.POINTS_SQL}, {views.NODES_SQL}, {VERTICAL_SQL} SELECT source, target, round(gap, 6) AS vertical_gap_m FROM foot WHERE area > 0 AND common / area >= .25 AND gap >= -.5 AND abs(gap) <= .5""")
def edges_supported(spark, d):
    return graph.vertical_edges(_nodes(spark, d, False, UP), WIDE).where("relation = 'supported_by'").select("source", "target", r6("vertical_gap_m"))


def _graph(spark, d):
    return graph.build_graph(views.map_points(spark, d, True), views.classes(spark), up=UP, t=PACKED)


LABELLED_SQL = f"WITH {views.SPREAD_SQL}, {views.NODES_SQL}, {views.CLASSES_SQL}, own AS (SELECT nodes.*, name AS label FROM nodes JOIN classes ON class_id = semantic_id)"


@register(f"""{LABELLED_SQL} SELECT instance_id, label FROM own WHERE label = 'chair'""")
def query_label(spark, d):
    return query.execute(_graph(spark, d), question="find all chairs").matches.select("instance_id", "label")


REF_SQL = ", ref AS (SELECT * FROM own ORDER BY instance_id LIMIT 1)"


@register(f"""{LABELLED_SQL}{REF_SQL} SELECT a.instance_id FROM own a, ref b WHERE a.instance_id <> b.instance_id AND {GAP_SQL} <= .5 AND a.label = 'table'""")
def query_relation_and(spark, d):
    g = _graph(spark, d)
    first = g.nodes.agg(F.min("instance_id")).first()[0]
    return query.execute(g, plan={"label": "table", "conditions": [{"relation": "near", "reference": {"instance_id": first}}]}).matches.select("instance_id")


@register(f"""{LABELLED_SQL}{REF_SQL}, dist AS (SELECT a.instance_id, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2) AS dd FROM own a, ref b WHERE a.instance_id <> b.instance_id AND a.label = 'lamp')
SELECT instance_id FROM dist WHERE dd <= (SELECT min(dd) FROM dist) + 1e-6""")
def query_nearest_ties(spark, d):
    g = _graph(spark, d)
    first = g.nodes.agg(F.min("instance_id")).first()[0]
    return query.execute(g, plan={"label": "lamp", "conditions": [{"relation": "nearest", "reference": {"instance_id": first}}]}).matches.select("instance_id")


TURNED_SQL = f"{views.POINTS_SQL}, l AS (SELECT * FROM points), r AS (SELECT point_id, y + 0.125::DOUBLE AS x, z AS y, x AS z FROM points), m AS (SELECT l.point_id AS a, r.point_id AS b, sqrt((l.x - r.x) ^ 2 + (l.y - r.y) ^ 2 + (l.z - r.z) ^ 2) AS dd FROM l JOIN r ON abs(l.x - r.x) <= .5)"


@register(f"""WITH {TURNED_SQL} SELECT a, b, round(dd, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dd, b) AS rn FROM m WHERE dd <= .5) WHERE rn = 1""")
def knn_within_threshold(spark, d):
    p = views.map_points(spark, d)
    turned = p.select("point_id", (F.col("y") + 0.125).alias("x"), F.col("z").alias("y"), F.col("x").alias("z"))  # a second whole cloud
    return spatial.nearest_within(p, turned, 0.5).select("a", "b", r6("distance"))


@register(f"""WITH {views.POINTS_SQL} SELECT p.point_id, count(q.point_id) AS others FROM points p LEFT JOIN points q ON p.point_id <> q.point_id AND abs(p.x - q.x) <= .4 AND sqrt((p.x - q.x) ^ 2 + (p.y - q.y) ^ 2 + (p.z - q.z) ^ 2) <= .4 GROUP BY p.point_id""")
def radius_count(spark, d):
    return spatial.radius_count(views.map_points(spark, d), 0.4)


MEMBER_SQL = f"""{views.OBSERVATIONS_SQL},
own AS (SELECT * FROM obs WHERE interior AND class_id > 0 AND confidence >= .5 AND mask_id > 0),
member AS (SELECT * FROM own JOIN (SELECT frame_id, mask_id, count(*) AS size FROM own GROUP BY ALL HAVING count(*) >= 20) USING (frame_id, mask_id)),
ov AS (SELECT a.frame_id AS frame_a, a.mask_id AS mask_a, b.frame_id AS frame_b, b.mask_id AS mask_b, count(*) AS shared FROM member a JOIN member b USING (point_id) GROUP BY ALL),
vis AS (SELECT a.frame_id AS frame_a, a.mask_id AS mask_a, o.frame_id AS frame_b, count(*) AS visible, any_value(size) AS size FROM member a JOIN obs o USING (point_id) GROUP BY ALL),
el AS (SELECT * FROM vis WHERE visible >= .3 * size)"""


def _member(spark, d):
    o = views.observations(spark, d)
    return masks.membership(o, SMALL.mask_points), o


@register(f"""WITH {MEMBER_SQL} SELECT frame_a, mask_a, frame_b, mask_b, shared FROM ov""")
def mask_overlap_pairs(spark, d):
    return masks.mask_overlaps(_member(spark, d)[0])


@register(f"""WITH {MEMBER_SQL} SELECT frame_a, mask_a, frame_b, visible FROM vis""")
def mask_visibility(spark, d):
    return masks.mask_visibility(*_member(spark, d))


SPLIT_SQL = f"""{MEMBER_SQL},
per AS (SELECT frame_a, mask_a, frame_b, sum(shared) AS labelled, max(shared) AS most, any_value(visible) AS visible, count_if(shared >= .2 * visible) AS pieces FROM ov JOIN el USING (frame_a, mask_a, frame_b) WHERE frame_a <> frame_b GROUP BY ALL),
st AS (SELECT frame_a, mask_a, count(*) AS evaluable_frames, count_if(pieces >= 2 AND most < .8 * visible) AS split_frames FROM per WHERE labelled >= .8 * visible GROUP BY ALL),
sp AS (SELECT frame_id, mask_id, size, coalesce(split_frames, 0) AS split_frames, coalesce(evaluable_frames, 0) AS evaluable_frames, coalesce(split_frames, 0) >= 2 AND coalesce(split_frames, 0) > .2 * coalesce(evaluable_frames, 0) AS filtered
  FROM (SELECT DISTINCT frame_id, mask_id, size FROM member) m LEFT JOIN st ON frame_id = frame_a AND mask_id = mask_a)"""


@register(f"""WITH {SPLIT_SQL} SELECT * FROM sp""")
def split_statistics(spark, d):
    return masks.split_statistics(*_member(spark, d), SMALL)


DOMINANT_SQL = f"""{SPLIT_SQL},
dm AS (SELECT ov.frame_a, ov.mask_a, ov.frame_b, ov.mask_b, shared, visible FROM ov JOIN el USING (frame_a, mask_a, frame_b) JOIN sp s1 ON s1.frame_id = ov.frame_a AND s1.mask_id = ov.mask_a AND NOT s1.filtered JOIN sp s2 ON s2.frame_id = ov.frame_b AND s2.mask_id = ov.mask_b AND NOT s2.filtered WHERE shared >= .5 * visible)"""
DOMINANT = masks.Consensus(mask_points=20, containment=0.501)


@register(f"""WITH {DOMINANT_SQL.replace("most < .8 *", "most < .501 *").replace("labelled >= .8 *", "labelled >= .501 *").replace("shared >= .5 * visible)", "shared >= .501 * visible)")} SELECT * FROM dm""")
def dominant_mask(spark, d):
    return masks.dominant_masks(*_member(spark, d), DOMINANT)


@register(f"""WITH {DOMINANT_SQL.replace("most < .8 *", "most < .501 *").replace("labelled >= .8 *", "labelled >= .501 *").replace("shared >= .5 * visible)", "shared >= .501 * visible)")}
SELECT x.frame_a, x.mask_a, y.frame_a AS frame_b, y.mask_a AS mask_b, count_if(x.mask_b = y.mask_b) AS positive, count_if(x.mask_b <> y.mask_b) AS negative
FROM dm x JOIN dm y ON x.frame_b = y.frame_b AND (x.frame_a, x.mask_a) < (y.frame_a, y.mask_a) GROUP BY ALL""")
def consensus_edges(spark, d):
    return masks.consensus_edges(masks.dominant_masks(*_member(spark, d), DOMINANT), DOMINANT)


def _groups(member):
    return member.select("frame_id", "mask_id").distinct().withColumn("group_id", (F.col("mask_id") + 4 * (F.col("frame_id") % 2)).cast("long"))


@register(f"""WITH {MEMBER_SQL}, g AS (SELECT DISTINCT frame_id, mask_id, mask_id + 4 * (frame_id % 2) AS group_id FROM member),
sc AS (SELECT point_id, group_id, sum(CAST(round(confidence * 1000000) AS BIGINT)) AS s, count(*) AS n FROM member JOIN g USING (frame_id, mask_id) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY s DESC, group_id) AS rn, sum(s) OVER (PARTITION BY point_id) AS total, lead(s) OVER (PARTITION BY point_id ORDER BY s DESC, group_id) AS nx FROM sc)
SELECT point_id, CAST(CASE WHEN n >= 2 AND 1000 * s >= 650 * total AND 1000 * (s - coalesce(nx, 0)) >= 150 * total THEN group_id ELSE 0 END AS BIGINT) AS group_id, round(s / 1000000, 6) AS best, n AS views FROM rk WHERE rn = 1""")
def point_ownership(spark, d):
    member, _ = _member(spark, d)
    return masks.point_ownership(member, _groups(member), SMALL).select("point_id", "group_id", r6("best"), "views")


@register(f"""WITH {views.OBSERVATIONS_SQL},
o AS (SELECT instance_id, frame_id, mask_id, count(*) AS n FROM obs JOIN lab USING (point_id) WHERE instance_id > 0 GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY instance_id, frame_id) AS visible, row_number() OVER (PARTITION BY instance_id, frame_id ORDER BY n DESC, mask_id) AS rn FROM o)
SELECT instance_id, frame_id, mask_id, visible, n AS shared FROM t WHERE rn = 1 AND visible >= 5 AND n >= .5 * visible""")
def instance_dominant_mask(spark, d):
    return masks.instance_masks(views.observations(spark, d), views.part_labels(spark, d), 5, 0.5)


@register(f"""WITH {views.NAMES_SQL},
t AS (SELECT instance_id, label, count(DISTINCT frame_id) AS n FROM votes WHERE label NOT IN ('unknown', 'none', '') GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY n DESC, label DESC) AS rn, lead(n) OVER (PARTITION BY instance_id ORDER BY n DESC, label DESC) AS nx FROM t),
c AS (SELECT * FROM k WHERE rn = 1 AND n >= 2 AND n > coalesce(nx, 0))
SELECT i.instance_id, coalesce(label, 'unknown') AS name, coalesce(n, 0) AS support_frames FROM (SELECT DISTINCT instance_id FROM votes) i LEFT JOIN c USING (instance_id)""")
def name_consensus(spark, d):
    return naming.name_consensus(views.name_votes(spark, d))


@register(f"""WITH {views.OBSERVATIONS_SQL},
o AS (SELECT instance_id, frame_id, class_id, count(*) AS n, sum(CAST(round(confidence * 1000000) AS BIGINT)) AS w FROM obs JOIN lab USING (point_id) WHERE instance_id > 0 AND confidence >= .8 AND class_id > 0 GROUP BY ALL),
f AS (SELECT instance_id, frame_id, sum(n) AS n, sum(w) AS t, max(w) AS b, arg_min(class_id, (-w, class_id)) AS c FROM o GROUP BY ALL HAVING sum(n) >= 2),
v AS (SELECT instance_id, CASE WHEN 1000 * b >= 800 * t THEN c ELSE 0 END AS vote, count(*) AS k FROM f GROUP BY ALL),
z AS (SELECT instance_id, sum(k) OVER (PARTITION BY instance_id) AS frames, vote, k, row_number() OVER (PARTITION BY instance_id ORDER BY vote = 0, k DESC, vote) AS rn FROM v)
SELECT instance_id, CAST(CASE WHEN vote > 0 AND frames >= 3 AND k >= .4 * frames THEN vote ELSE 0 END AS INTEGER) AS class_id, frames, CASE WHEN vote > 0 THEN k ELSE 0 END AS votes FROM z WHERE rn = 1""")
def frame_majority_naming(spark, d):
    return naming.frame_majority(views.observations(spark, d), views.part_labels(spark, d), points=2, share=0.4)


@register("""WITH e AS (SELECT l_partkey AS instance_id, l_returnflag AS label, l_suppkey AS frame_id, l_quantity / 50 AS score, 1 - l_discount AS coverage, l_tax * 10 AS iou, l_discount AS other FROM lineitem)
SELECT instance_id, label, count(DISTINCT CASE WHEN score >= .5 AND coverage >= .5 AND iou >= .4 AND other <= .2 THEN frame_id END) AS support, count(DISTINCT frame_id) AS seen FROM e GROUP BY ALL
HAVING count(DISTINCT CASE WHEN score >= .5 AND coverage >= .5 AND iou >= .4 AND other <= .2 THEN frame_id END) >= 2""")
def grounding_confirm(spark, d):
    li = views.table(spark, d, "lineitem")
    e = li.select(F.col("l_partkey").alias("instance_id"), F.col("l_returnflag").alias("label"), F.col("l_suppkey").alias("frame_id"), (F.col("l_quantity") / 50).alias("score"), (1 - F.col("l_discount")).alias("coverage"), (F.col("l_tax") * 10).alias("iou"), F.col("l_discount").alias("other"))
    return naming.grounding_confirmed(e).drop("fraction")


# evaluation: the even points predict, shifted copies of the odd labels are the reference
EVAL_SQL = f"""{views.POINTS_SQL},
backward AS (SELECT point_id, semantic_id, instance_id, CASE WHEN point_id % 5 = 0 THEN 0 WHEN point_id % 7 = 0 THEN (semantic_id + 1) % 10 ELSE semantic_id END AS semantic, CASE WHEN point_id % 9 = 0 THEN instance_id + 1 ELSE instance_id END AS instance, point_id % 5 <> 0 AS covered FROM points)"""


def _backward(spark, d):
    p = views.map_points(spark, d)
    i = F.col("point_id")
    return p.select("point_id", "semantic_id", "instance_id", F.when(i % 5 == 0, 0).when(i % 7 == 0, (F.col("semantic_id") + 1) % 10).otherwise(F.col("semantic_id")).cast("int").alias("semantic"), F.when(i % 9 == 0, F.col("instance_id") + 1).otherwise(F.col("instance_id")).alias("instance"), (i % 5 != 0).alias("covered"))


@register(f"""WITH {EVAL_SQL} SELECT class_id, count_if(semantic_id = class_id) AS vertices, count_if(semantic_id = class_id AND covered) AS covered, count_if(semantic_id = class_id AND semantic = class_id) AS correct, round(count_if(semantic_id = class_id AND semantic = class_id) / count_if(semantic_id = class_id OR semantic = class_id), 6) AS iou
FROM backward, (SELECT DISTINCT semantic_id AS class_id FROM points WHERE semantic_id > 0) GROUP BY class_id""")
def per_class_iou(spark, d):
    return evaluation.class_iou(_backward(spark, d)).select("class_id", "vertices", "covered", "correct", r6("iou"))


MATRIX_SQL = f"""{EVAL_SQL},
cells AS (SELECT instance AS predicted, instance_id AS reference, count(*) AS overlap FROM backward GROUP BY ALL),
mx AS (SELECT predicted, reference, overlap, overlap / (p + r - overlap) AS iou, r AS reference_size FROM cells JOIN (SELECT predicted, sum(overlap) AS p FROM cells GROUP BY ALL) USING (predicted) JOIN (SELECT reference, sum(overlap) AS r FROM cells GROUP BY ALL) USING (reference) WHERE predicted > 0 AND reference > 0)"""


@register(f"""WITH {MATRIX_SQL} SELECT predicted, reference, overlap, round(iou, 6) AS iou, CAST(reference_size AS BIGINT) AS reference_size FROM mx""")
def iou_matrix(spark, d):
    return evaluation.iou_matrix(_backward(spark, d)).select("predicted", "reference", "overlap", r6("iou"), "reference_size")


@register(f"""WITH {MATRIX_SQL} SELECT reference, count(DISTINCT predicted) AS pieces FROM mx WHERE overlap >= .1 * reference_size GROUP BY ALL HAVING count(DISTINCT predicted) > 1""")
def split_merge_objects(spark, d):
    return evaluation.split_objects(evaluation.iou_matrix(_backward(spark, d))).select("reference", F.size("pieces").cast("long").alias("pieces"))


@register()
def hungarian_matching(spark, d):
    return evaluation.instance_matches(evaluation.iou_matrix(_backward(spark, d))).select("predicted", "reference", r6("iou"))


@register(f"""WITH {EVAL_SQL}, p AS (SELECT instance, instance_id, count(*) AS n FROM backward WHERE covered AND instance > 0 AND instance_id > 0 GROUP BY ALL),
i AS (SELECT instance, sum(n) AS t, max(n) AS m FROM p GROUP BY ALL HAVING sum(n) >= 2) SELECT round(sum(m) / sum(t), 6) AS purity, CAST(sum(t) AS BIGINT) AS assigned FROM i""")
def weighted_purity(spark, d):
    b = _backward(spark, d)
    f = b.select(F.col("covered").alias("near"), F.col("instance_id").alias("ref_instance"), F.col("instance").alias("instance_id"))
    return evaluation.weighted_purity(f, 2).select(r6("purity"), "assigned")


@register(f"""WITH {EVAL_SQL}, x AS (SELECT *, covered AND semantic_id > 0 AS sup, covered AND instance = instance_id AS nc, covered AND point_id % 2 = 0 AS oc FROM backward)
SELECT count_if(instance_id % 3 = 0 AND instance > 0) AS newly_owned, count_if(instance_id % 3 = 0 AND instance > 0 AND nc) AS newly_owned_correct, count_if(oc AND NOT nc) AS owner_degraded, count_if(instance_id % 3 <> 0 AND instance_id <> instance) AS owner_changed FROM x""")
def before_after_delta(spark, d):
    b = _backward(spark, d)
    old = F.when(F.col("instance_id") % 3 == 0, 0).otherwise(F.col("instance_id"))
    p = b.select(old.alias("old_instance"), F.lit(0).alias("old_semantic"), F.col("semantic").alias("semantic_id"), F.col("instance").alias("instance_id"), F.col("covered").alias("near"), F.col("semantic_id").alias("ref_semantic"), F.col("instance_id").alias("ref_instance"), (F.col("covered") & (F.col("point_id") % 2 == 0)).alias("old_correct"), (F.col("covered") & (F.col("instance") == F.col("instance_id"))).alias("new_correct"))
    return evaluation.before_after(p).select("newly_owned", "newly_owned_correct", "owner_degraded", "owner_changed")


@register(f"""WITH {views.OBSERVATIONS_SQL}, st AS (SELECT point_id, max(mask_id) AS stage FROM obs WHERE interior GROUP BY ALL)
SELECT semantic_id AS class_id, coalesce(stage, 0) AS stage, count(*) AS points FROM lab LEFT JOIN st USING (point_id) GROUP BY ALL""")
def loss_attribution(spark, d):
    o = views.observations(spark, d).where("interior").select("point_id", F.col("mask_id").alias("stage"))
    return evaluation.loss_attribution(o, views.part_labels(spark, d).select("point_id", F.col("semantic_id").alias("class_id")))


@register(f"""WITH {views.FRAMES_SQL} SELECT sequence_id, frame_id, timestamp_us, ordinal FROM frames""")
def exact_cover_join(spark, d):
    f = views.frames(spark, d)
    return temporal.exact_cover(f, f.select("sequence_id", "frame_id", "timestamp_us"))


@register(f"""WITH {views.FRAMES_SQL} SELECT sequence_id, frame_id FROM frames WHERE ordinal % 6 = 0 OR frame_id % 7 = 0""")
def missing_frames_anti(spark, d):
    f = views.frames(spark, d)
    return f.join(f.where("ordinal % 6 <> 0 and frame_id % 7 <> 0"), ["sequence_id", "frame_id"], "left_anti").select("sequence_id", "frame_id")


ANCHOR_SQL = f"""{views.FRAMES_SQL},
b AS (SELECT sequence_id, frame_id, ordinal,
  last_value(CASE WHEN ordinal % 7 = 3 THEN ordinal END IGNORE NULLS) OVER (PARTITION BY sequence_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
  first_value(CASE WHEN ordinal % 7 = 3 THEN ordinal END IGNORE NULLS) OVER (PARTITION BY sequence_id ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM frames)"""


def _anchors(f):
    return f.where("ordinal % 7 = 3").select("sequence_id", "ordinal", F.col("ordinal").alias("anchor_id"))


@register(f"""WITH {ANCHOR_SQL} SELECT sequence_id, frame_id, p AS previous_anchor, coalesce(n, p) AS next_anchor FROM b""")
def asof_bracket(spark, d):
    f = views.frames(spark, d)
    return temporal.bracket(f, _anchors(f)).select("sequence_id", "frame_id", "previous_anchor", "next_anchor")


@register(f"""WITH {ANCHOR_SQL} SELECT sequence_id, frame_id, CASE WHEN p IS NOT NULL AND (n IS NULL OR ordinal - p <= n - ordinal) THEN p ELSE n END AS anchor_id FROM b""")
def asof_nearest(spark, d):
    f = views.frames(spark, d)
    return temporal.nearest_anchor(f, _anchors(f)).select("sequence_id", "frame_id", "anchor_id")


@register(f"""WITH {views.FRAMES_SQL} SELECT sequence_id, frame_id FROM (SELECT *, max(ordinal) OVER (PARTITION BY sequence_id) AS m FROM frames) WHERE ordinal % 5 = 0 OR ordinal = m""")
def stride_keep_last(spark, d):
    return temporal.strided(views.frames(spark, d), 5).select("sequence_id", "frame_id")


@register(f"""WITH {views.FRAMES_SQL}, s AS (SELECT sequence_id, count(*) AS n FROM frames GROUP BY ALL),
w AS (SELECT DISTINCT sequence_id, CASE WHEN n <= 23 THEN i WHEN i = 22 THEN n - 1 ELSE CAST(floor(i * ((n - 1)::DOUBLE / 22.0::DOUBLE)) AS BIGINT) END AS ordinal FROM s, range(100000) t(i) WHERE i < CASE WHEN n <= 23 THEN n ELSE 23 END)
SELECT sequence_id, frame_id FROM frames JOIN w USING (sequence_id, ordinal)""")
def even_decimation(spark, d):
    return temporal.decimated(views.frames(spark, d), 23, ["ordinal"]).select("sequence_id", "frame_id")


@register(f"""WITH {views.FRAMES_SQL} SELECT sequence_id, frame_id, previous_us FROM (SELECT *, lag(timestamp_us) OVER (PARTITION BY sequence_id ORDER BY ordinal) AS previous_us FROM (SELECT * REPLACE (timestamp_us - (frame_id % 7) * 7200000000 AS timestamp_us) FROM frames)) WHERE timestamp_us < previous_us""")
def monotone_violations(spark, d):
    f = views.frames(spark, d).withColumn("timestamp_us", F.col("timestamp_us") - (F.col("frame_id") % 7) * 7_200_000_000)
    return temporal.monotone_violations(f).select("sequence_id", "frame_id", "previous_us")


@register(f"""WITH {views.OBSERVATIONS_SQL}, f AS (SELECT frame_id, lead(frame_id) OVER (ORDER BY frame_id) AS nf FROM (SELECT DISTINCT frame_id FROM obs)),
s AS (SELECT f.frame_id, nf, a.point_id, a.mask_id AS ma, b.mask_id AS mb FROM f JOIN obs a ON a.frame_id = f.frame_id JOIN obs b ON b.frame_id = nf AND b.point_id = a.point_id),
u AS (SELECT frame_id, ma AS m, point_id, 1 AS k FROM s WHERE ma > 1 UNION ALL SELECT frame_id, mb, point_id, 2 FROM s WHERE mb > 1),
p AS (SELECT frame_id, m, count_if(k = 3) AS both_, count(*) AS either FROM (SELECT frame_id, m, point_id, sum(k) AS k FROM u GROUP BY ALL) GROUP BY ALL)
SELECT round(avg(both_ / either), 6) AS mean_iou, round(sum(both_) / sum(either), 6) AS weighted_iou, count(*) AS pairs FROM p""")
def adjacent_pair_iou(spark, d):
    o = views.observations(spark, d).withColumn("sequence_id", F.lit("0"))
    pos = o.where("mask_id > 1").select("sequence_id", "frame_id", F.col("mask_id").alias("object_id"), "point_id")
    return temporal.temporal_agreement(pos, o.select("sequence_id", "frame_id", "point_id"), o.select("sequence_id", "frame_id").distinct()).select(r6("mean_iou"), r6("weighted_iou"), "pairs")


@register("""SELECT l_suppkey AS frame_id, l_orderkey * 10 + l_linenumber AS mask_id, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS rn FROM lineitem WHERE l_quantity NOT IN (10, 19) AND l_extendedprice >= 300) WHERE rn <= 8""")
def topk_per_frame(spark, d):
    li = views.table(spark, d, "lineitem")
    m = li.select(F.col("l_suppkey").alias("frame_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mask_id"), F.col("l_quantity").alias("class_id"), F.col("l_extendedprice").alias("area"), F.lit(20).alias("box_width"), F.lit(20).alias("box_height"))
    return temporal.top_crops(m).select("frame_id", "mask_id", F.col("place").cast("long").alias("place"))


@register("""SELECT event_type, CASE lower(trim(event_type)) WHEN 'fridge' THEN 'refrigerator' ELSE lower(trim(event_type)) END AS label FROM (SELECT DISTINCT event_type FROM events)""")
def label_normalise(spark, d):
    return views.table(spark, d, "events").select("event_type").distinct().select("event_type", label_key(F.col("event_type")).alias("label"))


@register("""WITH a AS (SELECT CAST(item_id AS VARCHAR) AS name, sha256(text) AS sha256 FROM benchmark), b AS (SELECT CAST(item_id AS VARCHAR) AS name, sha256(CASE WHEN item_id % 7 = 0 THEN text || '.' ELSE text END) AS found FROM benchmark WHERE item_id % 5 <> 0)
SELECT a.name, CASE WHEN found IS NULL THEN 'missing' ELSE 'digest' END AS reason FROM a LEFT JOIN b USING (name) WHERE found IS NULL OR found <> sha256""")
def hash_inventory(spark, d):
    b = views.table(spark, d, "benchmark").where("item_id % 5 <> 0")
    other = b.select(F.col("item_id").cast("string").alias("name"), F.sha2(F.when(F.col("item_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha256"))
    return provenance.mismatches(views.artifacts(spark, d), other)


@register(f"""WITH {views.POINTS_SQL}, g AS (SELECT 'class' AS kind, semantic_id::BIGINT AS id, semantic_id, count(*) AS n FROM points WHERE semantic_id > 0 GROUP BY ALL UNION ALL SELECT 'instance', instance_id, semantic_id, count(*) FROM points WHERE instance_id > 0 GROUP BY ALL)
SELECT kind, id, CAST(sum(n) AS BIGINT) AS points, arg_min(semantic_id, (-n, semantic_id)) AS majority FROM g GROUP BY kind, id""")
def catalog_grouping_sets(spark, d):
    return temporal.object_catalogue(views.map_points(spark, d))


@register("""SELECT (SELECT count(*) FROM (SELECT p_partkey % 50 AS k FROM part EXCEPT ALL SELECT p_size AS k FROM part)) AS only_left, (SELECT count(*) FROM (SELECT p_size AS k FROM part EXCEPT ALL SELECT p_partkey % 50 FROM part)) AS only_right""")
def parity_except_all(spark, d):
    p = views.table(spark, d, "part")
    return evaluation.parity(p.select((F.col("p_partkey") % 50).alias("k")), p.select(F.col("p_size").cast("long").alias("k")))


@register(f"""WITH {views.POINTS_SQL} SELECT point_id, CAST(CASE WHEN instance_id > 0 THEN 50 + instance_id * 37 % 206 ELSE 90 END AS INTEGER) AS red FROM points""")
def label_colours(spark, d):
    return views.map_points(spark, d).select("point_id", coloured(F.col("instance_id"), 37).alias("red"))


@register(f"""WITH {views.POINTS_SQL}, c AS (SELECT instance_id, semantic_id, count(*) AS n FROM points WHERE instance_id > 0 GROUP BY ALL)
SELECT instance_id, CAST(sum(n) AS BIGINT) AS points, arg_min(semantic_id, (-n, semantic_id)) AS semantic_id FROM c GROUP BY instance_id""")
def export_object_summary(spark, d):
    return sinks.object_summary(views.map_points(spark, d))


@register("""SELECT event_type, round(quantile_cont(value, .5), 6) AS median_s, round(avg(value), 6) AS mean_s, count(*) AS requests, round(list_sort(list(value))[least(CAST(floor(count(*) * .95::DOUBLE) AS BIGINT), count(*) - 1) + 1], 6) AS p95_s FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency_summary(spark, d):
    e = views.table(spark, d, "events").where("value is not null").select("event_type", F.col("value").alias("latency_s"), F.lit(1).alias("tokens"), F.lit(True).alias("ok"))
    return temporal.latency_summary(e, ["event_type"]).select("event_type", r6("median_s"), r6("mean_s"), "requests", r6("p95_s"))


@register(f"""WITH {views.POINTS_SQL} SELECT CAST(floor(x / .5) AS BIGINT) AS c0, CAST(floor(y / .5) AS BIGINT) AS c1, CAST(floor(z / .5) AS BIGINT) AS c2, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM points GROUP BY 1, 2, 3""")
def voxel_average(spark, d):
    return spatial.voxel_average(views.map_points(spark, d), 0.5).select("c0", "c1", "c2", "n", *map(r6, "xyz"))


@register(f"""WITH {views.OBSERVATIONS_SQL}, m AS (SELECT frame_id, mask_id, count(*) AS total, list(instance_id) AS l FROM obs LEFT JOIN lab USING (point_id) WHERE interior AND class_id > 0 AND confidence >= .5 GROUP BY ALL HAVING count(*) >= 20),
c AS (SELECT frame_id, mask_id, instance_id AS guide, count(*) AS n FROM obs JOIN lab USING (point_id) WHERE interior AND class_id > 0 AND confidence >= .5 AND instance_id > 0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, mask_id ORDER BY n DESC, guide) AS rn FROM c)
SELECT frame_id, mask_id, guide, n AS shared, total, round(n / total, 6) AS purity FROM k JOIN m USING (frame_id, mask_id) WHERE rn = 1""")
def mask_purity(spark, d):
    member, _ = _member(spark, d)
    return masks.mask_purity(member, views.part_labels(spark, d)).select("frame_id", "mask_id", "guide", "shared", "total", r6("purity"))


# --- order-dependent operators: rows only, tested against brute force ---


@register()
def constrained_merge(spark, d):
    edges = masks.consensus_edges(masks.dominant_masks(*_member(spark, d), DOMINANT), DOMINANT)
    key = lambda s: (F.col(f"frame_{s}") * 10 + F.col(f"mask_{s}")).cast("long")
    e = cut(edges.select(F.lit(0).alias("scene_id"), key("a").alias("a"), key("b").alias("b"), "positive", "negative"))
    nodes = e.select("scene_id", F.explode(F.array("a", "b")).alias("node")).distinct()
    return iterative.constrained_merge(e, nodes).select("node", "group_id")


@register()
def fragment_merge(spark, d):
    o, p = views.observations(spark, d), views.part_labels(spark, d).withColumn("semantic_id", (F.col("instance_id") % 3 + 1).cast("int"))
    category = masks.uniform_category(p).where("category > 0")
    counts = o.join(p.where("instance_id > 0").select("point_id", "instance_id"), "point_id").groupBy("instance_id", "frame_id", "mask_id").agg(F.count("*").alias("n")).join(category, "instance_id")
    edges = masks.fragment_edges(o, p).select("category", "a", "b", "positive", "negative")
    return iterative.fragment_merge(counts, edges, visible=5, containment=0.5)


@register(f"""WITH RECURSIVE {MATRIX_SQL}, ord AS (SELECT *, row_number() OVER (ORDER BY iou DESC, predicted, reference) AS k FROM mx),
r(k, a, b, used_a, used_b, iou) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS DOUBLE)
  UNION ALL SELECT o.k, CASE WHEN f THEN predicted END, CASE WHEN f THEN reference END, CASE WHEN f THEN list_append(used_a, predicted) ELSE used_a END, CASE WHEN f THEN list_append(used_b, reference) ELSE used_b END, o.iou
  FROM (SELECT o.*, r.used_a, r.used_b, NOT list_contains(r.used_a, predicted) AND NOT list_contains(r.used_b, reference) AS f FROM r JOIN ord o ON o.k = r.k + 1) o)
SELECT a, b, round(iou, 6) AS coverage FROM r WHERE a IS NOT NULL""")
def greedy_matching(spark, d):
    m = evaluation.iou_matrix(_backward(spark, d)).select(F.lit(0).alias("scene_id"), F.col("predicted").alias("a"), F.col("reference").alias("b"), F.col("iou").alias("coverage"))
    return iterative.greedy_matching(m).select("a", "b", r6("coverage"))


@register(f"""WITH RECURSIVE {views.SPREAD_SQL}, ord AS (SELECT semantic_id AS scene_id, point_id AS frame_id, x, y, z, row_number() OVER (PARTITION BY semantic_id ORDER BY abs(z) DESC, point_id) AS k FROM points),
r(scene_id, k, taken, ids) AS (SELECT DISTINCT scene_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(x DOUBLE, y DOUBLE, z DOUBLE)[]), CAST([] AS BIGINT[]) FROM ord
  UNION ALL SELECT scene_id, k, CASE WHEN f THEN list_append(taken, p) ELSE taken END, CASE WHEN f THEN list_append(ids, frame_id) ELSE ids END
  FROM (SELECT o.scene_id, o.k, o.frame_id, r.taken, r.ids, struct_pack(x := o.x, y := o.y, z := o.z) AS p, len(r.ids) < 10 AND len(list_filter(r.taken, lambda t: sqrt((t.x - o.x) ^ 2 + (t.y - o.y) ^ 2 + (t.z - o.z) ^ 2) < 2)) = 0 AS f
        FROM r JOIN ord o ON o.scene_id = r.scene_id AND o.k = r.k + 1)),
last AS (SELECT scene_id, ids FROM r WHERE (scene_id, k) IN (SELECT (scene_id, max(k)) FROM ord GROUP BY scene_id)),
rest AS (SELECT o.scene_id, o.frame_id, row_number() OVER (PARTITION BY o.scene_id ORDER BY o.k) AS n, len(ids) AS had FROM ord o JOIN last USING (scene_id) WHERE NOT list_contains(ids, o.frame_id))
SELECT scene_id, unnest(ids) AS frame_id, 'quality_and_pose_diversity' AS reason FROM last UNION ALL SELECT scene_id, frame_id, 'quality_budget_fallback' FROM rest WHERE n <= 10 - had""")
def greedy_diverse_topk(spark, d):
    p = views.map_points(spark, d, True)
    one, zero = F.lit(1.0), F.lit(0.0)
    pose = F.array(one, zero, zero, F.col("x"), zero, one, zero, F.col("y"), zero, zero, one, F.col("z"), zero, zero, zero, one)
    c = p.select(F.col("semantic_id").alias("scene_id"), F.col("point_id").alias("frame_id"), F.abs("z").alias("quality"), pose.alias("pose"), F.col("point_id").alias("ordinal"))
    return iterative.diverse_views(c, 10, metres=2.0)


@register()
def online_tracks(spark, d):
    o = votes.safe(views.observations(spark, d)).withColumn("stream", F.col("frame_id") % 2).withColumn("mask_id", F.col("class_id") * 10 + F.col("mask_id"))
    return iterative.online_association(o, least=5, overlap=0.1)


@register(f"""WITH RECURSIVE {MEMBER_SQL}, size AS (SELECT frame_id, mask_id, count(*) AS n, avg(confidence) AS score FROM member GROUP BY ALL),
ord AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, mask_id) AS k FROM size),
r(frame_id, k, kept, sizes) AS (SELECT DISTINCT frame_id, CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST([] AS BIGINT[]) FROM size
  UNION ALL SELECT o.frame_id, o.k, CASE WHEN len(list_filter(r.sizes, lambda x: least(x, o.n) / greatest(x, o.n) >= .8)) = 0 THEN list_append(r.kept, o.mask_id) ELSE r.kept END,
    CASE WHEN len(list_filter(r.sizes, lambda x: least(x, o.n) / greatest(x, o.n) >= .8)) = 0 THEN list_append(r.sizes, o.n) ELSE r.sizes END FROM r JOIN ord o ON o.frame_id = r.frame_id AND o.k = r.k + 1)
SELECT frame_id, CAST(unnest(kept) AS BIGINT) AS mask_id FROM r WHERE (frame_id, k) IN (SELECT (frame_id, max(k)) FROM ord GROUP BY frame_id)""")
def duplicate_mask_suppression(spark, d):
    member, _ = _member(spark, d)
    size = masks.mask_scores(member)
    a, b = size.select("frame_id", F.col("mask_id").alias("a"), F.col("size").alias("na")), size.select("frame_id", F.col("mask_id").alias("b"), F.col("size").alias("nb"))
    pairs = a.join(b, "frame_id").where("a < b").select("frame_id", "a", "b", (F.least("na", "nb") / F.greatest("na", "nb")).alias("iou"))
    return iterative.suppressed(pairs, size)


@register()
def rigid_fit(spark, d):
    p = views.map_points(spark, d)
    pairs = p.select(F.col("semantic_id").alias("pair_id"), *[F.col(c).alias(f"a_{c}") for c in "xyz"], (F.col("y") + 1).alias("b_x"), (-F.col("x")).alias("b_y"), (F.col("z") - 2).alias("b_z"))
    return iterative.rigid_fit(pairs).select("pair_id", F.transform("transform", lambda v: F.round(v, 5)).alias("transform"), F.round("rmse", 5).alias("rmse"))

def _claims(spark, d):
    o = views.observations(spark, d)
    return o.select("frame_id", (F.col("point_id") % 16).alias("u"), (F.floor(F.col("point_id") / 16) % 12).alias("v"), "class_id", "mask_id", F.col("confidence").alias("score"))


@register(f"""WITH {views.OBSERVATIONS_SQL}, c AS (SELECT frame_id, point_id % 16 AS u, point_id // 16 % 12 AS v, class_id, mask_id, confidence AS score FROM obs WHERE class_id > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY frame_id, u, v, class_id ORDER BY score DESC, mask_id) AS rn FROM c),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame_id, u, v ORDER BY score DESC, class_id) AS k, lead(score) OVER (PARTITION BY frame_id, u, v ORDER BY score DESC, class_id) AS nx FROM best WHERE rn = 1),
one AS (SELECT *, score >= .5 AND score - coalesce(nx, 0) >= .1 AS known FROM rk WHERE k = 1)
SELECT frame_id, u, v, CASE WHEN known THEN class_id ELSE 0 END AS class_id, CASE WHEN known THEN mask_id ELSE 0 END AS mask_id, CASE WHEN known THEN score ELSE 0.0 END::DOUBLE AS score FROM one""")
def pixel_claims(spark, d):
    return votes.pixel_claims(_claims(spark, d))


#: A lower score than that of real masks, so that some groups pass and some do not.
LOOSE = masks.Consensus(mask_points=20, object_score=0.51)


@register(f"""WITH {MEMBER_SQL}, g AS (SELECT DISTINCT frame_id, mask_id, mask_id + 4 * (frame_id % 2) AS group_id FROM member)
SELECT group_id, count(DISTINCT frame_id) AS frames, round(sum(confidence) / count(*), 6) AS score FROM member JOIN g USING (frame_id, mask_id) GROUP BY group_id HAVING count(DISTINCT frame_id) >= 2 AND sum(confidence) / count(*) >= .51""")
def group_scores(spark, d):
    member, _ = _member(spark, d)
    return masks.group_scores(member, _groups(member), LOOSE).select("group_id", "frames", r6("score"))


@register(f"""WITH {views.OBSERVATIONS_SQL}, steps AS (SELECT frame_id AS fa, lead(frame_id) OVER (ORDER BY frame_id) AS fb FROM (SELECT DISTINCT frame_id FROM obs)),
met AS (SELECT fa, fb, a.mask_id AS ma, b.mask_id AS mb, a.point_id FROM steps JOIN obs a ON a.frame_id = fa JOIN obs b ON b.frame_id = fb AND a.point_id = b.point_id),
na AS (SELECT fa, fb, ma, count(*) AS n FROM met GROUP BY ALL HAVING count(*) >= 5), nb AS (SELECT fa, fb, mb, count(*) AS n FROM met GROUP BY ALL HAVING count(*) >= 5),
pairs AS (SELECT fa, fb, ma, mb, count(*) AS shared FROM met GROUP BY ALL),
flow AS (SELECT pairs.* FROM pairs JOIN na USING (fa, fb, ma) JOIN nb USING (fa, fb, mb) WHERE shared >= 5 AND shared >= .5 * least(na.n, nb.n)),
k AS (SELECT fa, fb, sum(a) AS masks_a, sum(b) AS masks_b FROM (SELECT fa, fb, 1 AS a, 0 AS b FROM na UNION ALL SELECT fa, fb, 0, 1 FROM nb) GROUP BY ALL),
mg AS (SELECT fa, fb, count(*) AS n FROM (SELECT fa, fb, mb FROM flow GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL), sp AS (SELECT fa, fb, count(*) AS n FROM (SELECT fa, fb, ma FROM flow GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL)
SELECT fa AS frame_a, fb AS frame_b, CAST(masks_a AS BIGINT) AS masks_a, CAST(masks_b AS BIGINT) AS masks_b, coalesce(mg.n, 0) AS merge_like, coalesce(sp.n, 0) AS split_like FROM k LEFT JOIN mg USING (fa, fb) LEFT JOIN sp USING (fa, fb)""")
def transition_events(spark, d):
    o = views.observations(spark, d).withColumn("sequence_id", F.lit("s"))
    return measured.transition_events(o.select("sequence_id", "frame_id", "mask_id", "point_id"), o.select("sequence_id", "frame_id", "point_id"), 5).drop("sequence_id")


@register()
def temporal_matches(spark, d):
    o = views.observations(spark, d).withColumn("sequence_id", F.lit("s"))
    return measured.temporal_matches(o.select("sequence_id", "frame_id", "mask_id", "point_id"), o.select("sequence_id", "frame_id", "point_id"), 5).select("frame_a", "frame_b", "mask_a", "mask_b", r6("iou"))


@register(f"""WITH {views.POINTS_SQL}, f AS (SELECT *, point_id % 4 <> 0 AS near, CASE WHEN point_id % 4 <> 0 THEN CASE WHEN point_id % 6 = 0 THEN (semantic_id + 1) % 10 ELSE semantic_id END END AS ref FROM points), g AS (SELECT *, CASE WHEN point_id % 5 = 0 THEN 0 WHEN point_id % 7 = 0 THEN (semantic_id + 1) % 10 ELSE semantic_id END AS semantic FROM points),
a AS (SELECT count(*) AS points, count_if(near) AS near_points, count_if(near AND ref > 0) AS supported_points, count_if(near AND ref > 0 AND semantic_id > 0) AS labelled_supported_points,
  round(count_if(near AND ref > 0 AND semantic_id = ref) / count_if(near AND ref > 0), 6) AS accuracy_unknown_as_error, round(count_if(near AND ref > 0 AND semantic_id = ref) / count_if(near AND ref > 0 AND semantic_id > 0), 6) AS accuracy_labelled_only FROM f),
b AS (SELECT count(*) AS vertices, count_if(point_id % 5 <> 0) AS covered_vertices, count_if(semantic_id > 0) AS shared_class_vertices, round(count_if(semantic_id > 0 AND semantic = semantic_id) / count_if(semantic_id > 0), 6) AS reference_accuracy FROM g)
SELECT a.*, b.* FROM a, b""")
def coverage_summary(spark, d):
    p = views.map_points(spark, d)
    i = F.col("point_id")
    ref = F.when(i % 4 != 0, F.when(i % 6 == 0, (F.col("semantic_id") + 1) % 10).otherwise(F.col("semantic_id")))
    forward = p.withColumn("near", i % 4 != 0).withColumn("ref_semantic", ref)
    one = evaluation.coverage(forward, _backward(spark, d))
    return one.select(*[r6(c) if "accuracy" in c else F.col(c) for c in one.columns])


@register(f"""WITH {views.POINTS_SQL}, near AS (SELECT a.point_id, count(*) AS n FROM points a JOIN points b ON a.point_id <> b.point_id AND sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2) <= .35 GROUP BY ALL)
SELECT points.point_id, semantic_id FROM points LEFT JOIN near USING (point_id) WHERE coalesce(n, 0) < 4""")
def radius_cleanup_removed(spark, d):
    return spatial.radius_cleanup(views.map_points(spark, d), 0.35, 4)[1].select("point_id", "semantic_id")


@register(f"""WITH {views.POINTS_SQL}, per AS (SELECT semantic_id AS group_id, count(*) AS n FROM points WHERE instance_id = 0 AND semantic_id > 0 GROUP BY ALL), top AS (SELECT max(instance_id) AS top FROM points)
SELECT group_id, n, CASE WHEN n >= 5 THEN top + row_number() OVER (PARTITION BY n >= 5 ORDER BY group_id) END AS candidate_id, CASE WHEN n >= 5 THEN 'accepted' ELSE 'too_few_points' END AS reason FROM per, top""")
def unresolved_candidates(spark, d):
    p = views.map_points(spark, d)
    return naming.candidates_from_groups(p.select("point_id", F.col("semantic_id").cast("long").alias("group_id")), p, 5)


@register(f"""WITH {views.OBSERVATIONS_SQL}, bits AS (SELECT frame_id, mask_id, count(DISTINCT point_id % 192) AS area FROM obs GROUP BY ALL) SELECT * FROM bits""")
def packed_mask_areas(spark, d):
    o = views.observations(spark, d).select("frame_id", "mask_id", (F.col("point_id") % 192 % 16).alias("u"), F.floor(F.col("point_id") % 192 / 16).alias("v"))
    return measured.packed_masks(o, 16, 12, ["frame_id", "mask_id"]).select("frame_id", "mask_id", measured.packed_area(F.col("packed"), 192).alias("area"))


RELIEF_CELLS = 16
CELLS_SQL = f"""{views.RELIEF_SQL},
box AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS side FROM own),
spot AS (SELECT k, x - lx AS x, y - ly AS y, z - lz AS z, red, lx, ly, lz, side / {RELIEF_CELLS} AS s,
       least({RELIEF_CELLS - 1}, floor((x - lx) / (side / {RELIEF_CELLS})))::BIGINT * 4398046511104 + least({RELIEF_CELLS - 1}, floor((y - ly) / (side / {RELIEF_CELLS})))::BIGINT * 2097152 + least({RELIEF_CELLS - 1}, floor((z - lz) / (side / {RELIEF_CELLS})))::BIGINT AS cell FROM own, box),
trio AS (SELECT p.cell AS a, q.cell AS b, r.cell AS c FROM faces f JOIN spot p ON p.k = f.a JOIN spot q ON q.k = f.b JOIN spot r ON r.k = f.c WHERE p.cell <> q.cell AND q.cell <> r.cell AND p.cell <> r.cell),
kept AS (SELECT DISTINCT CASE WHEN a < b AND a < c THEN a WHEN b < c THEN b ELSE c END AS a, CASE WHEN a < b AND a < c THEN b WHEN b < c THEN c ELSE a END AS b, CASE WHEN a < b AND a < c THEN c WHEN b < c THEN a ELSE b END AS c FROM trio)"""


@register(f"WITH {CELLS_SQL} SELECT a, b, c FROM kept")
def surface_faces(spark, d):
    return surface.clustered(*views.relief(spark, d), RELIEF_CELLS)[1]


@register(f"""WITH {CELLS_SQL},
mean AS (SELECT cell, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(red) AS red, any_value(s) AS s, any_value(lx) AS lx, any_value(ly) AS ly, any_value(lz) AS lz FROM spot WHERE cell IN (SELECT unnest([a, b, c]) FROM kept) GROUP BY cell),
plane AS (SELECT unnest([p.cell, q.cell, r.cell]) AS cell, p.x, p.y, p.z, (q.y - p.y) * (r.z - p.z) - (q.z - p.z) * (r.y - p.y) AS nx, (q.z - p.z) * (r.x - p.x) - (q.x - p.x) * (r.z - p.z) AS ny, (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) AS nz
          FROM faces f JOIN spot p ON p.k = f.a JOIN spot q ON q.k = f.b JOIN spot r ON r.k = f.c),
sums AS (SELECT cell, sum(nx * nx) AS xx, sum(nx * ny) AS xy, sum(nx * nz) AS xz, sum(ny * ny) AS yy, sum(ny * nz) AS yz, sum(nz * nz) AS zz, sum(nx * (nx * x + ny * y + nz * z)) AS rx, sum(ny * (nx * x + ny * y + nz * z)) AS ry, sum(nz * (nx * x + ny * y + nz * z)) AS rz FROM plane GROUP BY cell),
eq AS (SELECT *, xx + w AS a, yy + w AS b, zz + w AS c, rx + w * mx AS p, ry + w * my AS q, rz + w * mz AS r FROM (SELECT *, (xx + yy + zz) * ({surface.PULL} / 3) AS w FROM sums JOIN mean USING (cell))),
sol AS (SELECT *, (p * (b * c - yz * yz) - xy * (q * c - yz * r) + xz * (q * yz - b * r)) / det AS px, (a * (q * c - yz * r) - p * (xy * c - yz * xz) + xz * (xy * r - q * xz)) / det AS py, (a * (b * r - q * yz) - xy * (xy * r - q * xz) + p * (xy * yz - b * xz)) / det AS pz
        FROM (SELECT *, a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz) AS det FROM eq))
SELECT cell, round(least(greatest(px, (cell >> 42) * s), (cell >> 42) * s + s) + lx, 4) AS x, round(least(greatest(py, ((cell >> 21) & 2097151) * s), ((cell >> 21) & 2097151) * s + s) + ly, 4) AS y,
       round(least(greatest(pz, (cell & 2097151) * s), (cell & 2097151) * s + s) + lz, 4) AS z, round(red, 4) AS red FROM sol""")
def surface_vertices(spark, d):
    return surface.clustered(*views.relief(spark, d), RELIEF_CELLS)[0].select("cell", *[F.round(c, 4).alias(c) for c in ("x", "y", "z", "red")])


@register(f"WITH {views.RELIEF_SQL} SELECT count(*) > 1000 AS larger, true AS fits, true AS whole FROM faces")
def surface_simplified(spark, d):
    """Whether the mesh had to be simplified, has no more faces than asked for, and only faces of its own vertices."""
    vertices, faces = views.relief(spark, d)
    small, kept = surface.simplified(vertices, faces, 1000)
    own = kept.select(F.explode(F.array("a", "b", "c")).alias("vertex_id")).distinct().join(small, "vertex_id", "full").agg(F.every(F.col("x").isNotNull()).alias("whole"))
    n = faces.agg((F.count("*") > 1000).alias("larger"))
    return n.crossJoin(kept.agg(F.count("*").between(1, 1000).alias("fits"))).crossJoin(own)


@register("""WITH px AS (SELECT l_suppkey AS frame_id, floor(l_extendedprice)::BIGINT % 65536 AS depth, l_quantity::INTEGER AS colour, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, floor(l_extendedprice)::BIGINT % 65536, l_quantity::INTEGER) - 1 AS k FROM lineitem),
own AS (SELECT *, k % 16 AS u, k // 16 AS v, frame_id % 3 = 0 AS turned FROM px),
size AS (SELECT frame_id, (count(*) + 15) // 16 AS h FROM px GROUP BY frame_id)
SELECT frame_id, CAST(CASE WHEN turned THEN h ELSE 16 END AS INTEGER) AS width, CAST(CASE WHEN turned THEN 16 ELSE h END AS INTEGER) AS height, CASE WHEN turned THEN 3.0 ELSE 7.5 END::DOUBLE AS cx, CASE WHEN turned THEN 7.5 ELSE 3.0 END::DOUBLE AS cy,
       CAST(count(*) FILTER (depth > 0) AS BIGINT) AS valid, CAST(sum(depth) AS BIGINT) AS depth_sum, CAST(sum(colour) AS BIGINT) AS red_sum,
       CAST(sum(depth * CASE WHEN turned THEN v ELSE u END) AS BIGINT) AS by_u, CAST(sum(depth * CASE WHEN turned THEN 15 - u ELSE v END) AS BIGINT) AS by_v
FROM own JOIN size USING (frame_id) GROUP BY frame_id, turned, h""")
def rgbd_frames(spark, d):
    frames = cut(images.aligned_frames(cut(views.depth_images(spark, d))))  # each image is made and read once
    d = F.col("depth").cast("long")
    sums = images.pixel_table(frames).groupBy("frame_id").agg(F.sum(F.col("valid").cast("long")).alias("valid"), F.sum(d).alias("depth_sum"), F.sum(F.col("red").cast("long")).alias("red_sum"), F.sum(d * F.col("u")).alias("by_u"), F.sum(d * F.col("v")).alias("by_v"))
    return frames.select("frame_id", "width", "height", "cx", "cy").join(sums, "frame_id")


@register(f"WITH {views.TOPOLOGY_SQL} SELECT * FROM topology")
def anchor_topology(spark, d):
    tables = views.refinement(spark, d)
    return anchors.source_topology(tables["sequences"], tables["anchors"])


@register(f"""WITH {views.TOPOLOGY_SQL},
lone AS (SELECT sequence_id, 3 * (ordinal // 9) + ordinal % 9 AS node, ordinal % 9 AS m FROM frames WHERE ordinal % 9 < 3),
bare AS (SELECT sequence_id, node FROM lone WHERE (m = 1 AND node % 2 = 0) OR (sequence_id = '5' AND m = 0 AND node = 6)),
fixed AS (SELECT sequence_id, count(*) AS start FROM anchors GROUP BY ALL),
used AS (SELECT DISTINCT sequence_id, unnest([previous, next]) AS node FROM topology),
swapped AS (SELECT sequence_id, ordinal, CASE WHEN sequence_id = '3' AND place IN (20, 21) THEN 41 - place ELSE place END AS place FROM topology),
own AS (SELECT sequence_id, batch, place, start + local AS target, unnest([previous, next]) AS source, previous, next FROM topology JOIN fixed USING (sequence_id)),
edge AS (SELECT * FROM own WHERE place % 113 <> 9),
wanted AS (SELECT s.sequence_id, s.place // 16 AS batch, start + s.place % 16 AS target, unnest([t.previous, t.next]) AS source FROM swapped s JOIN topology t USING (sequence_id, ordinal) JOIN fixed USING (sequence_id)),
bad AS (
  SELECT sequence_id, NULL AS batch, node AS source, NULL AS target, 'empty_anchor_used' AS reason, 0 AS step FROM bare JOIN used USING (sequence_id, node)
  UNION ALL SELECT DISTINCT s.sequence_id, s.place // 16, NULL, NULL, 'order_differs', 1 FROM swapped s JOIN topology t USING (sequence_id, ordinal) WHERE s.place <> t.place
  UNION ALL SELECT sequence_id, 1, min(node), NULL, 'empty_anchor_measured', 1 FROM bare WHERE sequence_id = '7' GROUP BY sequence_id
  UNION ALL SELECT coalesce(e.sequence_id, w.sequence_id), coalesce(e.batch, w.batch), coalesce(e.source, w.source), coalesce(e.target, w.target), CASE WHEN w.source IS NULL THEN 'edge_outside_sources' ELSE 'sources_differ' END, 1
            FROM edge e FULL JOIN wanted w ON e.sequence_id = w.sequence_id AND e.batch = w.batch AND e.source = w.source AND e.target = w.target WHERE e.source IS NULL OR w.source IS NULL
  UNION ALL SELECT e.sequence_id, batch, source, target, 'empty_source', 1 FROM edge e WHERE place % 101 = 5 OR (e.sequence_id, source) IN (SELECT (sequence_id, node) FROM bare)
  UNION ALL SELECT sequence_id, batch, source, target, 'nonfinite_targets', 1 FROM edge WHERE place % 89 = 7
  UNION ALL SELECT DISTINCT sequence_id, batch, NULL::BIGINT, target, 'target_without_weight', 1 FROM edge WHERE place % 97 = 11 OR place % 101 = 5
  UNION ALL SELECT DISTINCT sequence_id, batch, NULL::BIGINT, target, 'target_without_edges', 1 FROM own WHERE place % 113 = 9
  UNION ALL SELECT t.sequence_id, NULL, NULL, t.ordinal, 'unaudited_target', 2 FROM swapped t WHERE NOT EXISTS (SELECT 1 FROM edge e JOIN fixed USING (sequence_id) WHERE e.sequence_id = t.sequence_id AND e.batch = t.place // 16 AND e.target = start + t.place % 16)),
ordered AS (SELECT *, row_number() OVER () AS id, CASE WHEN reason IN ('empty_anchor_used', 'order_differs', 'unaudited_target') THEN -1 ELSE batch END AS call FROM bad)
SELECT sequence_id, batch::BIGINT AS batch, source::BIGINT AS source, target::BIGINT AS target, reason, (step, coalesce(batch, -1), call) IS NOT DISTINCT FROM min((step, coalesce(batch, -1), call)) OVER (PARTITION BY sequence_id) AS first FROM ordered""")
def anchor_refusals(spark, d):
    tables = views.refinement(spark, d)
    tables |= {k: cut(tables[k]) for k in ("batches", "calls", "edges", "empty")}
    return anchors.refusals(**tables).select("sequence_id", "batch", "source", "target", "reason", "first")


WORDS = sorted({x for _, rules in names.STEPS for x in rules} | {*names.PARTS, "zebra", "unclear"})
RULES_SQL = ", ".join(f"{kind}(k, v) AS (VALUES " + ", ".join(f"('{x}', '{y}')" for x, y in rules.items()) + ")" for kind, rules in names.STEPS)


@register(f"""WITH {RULES_SQL}, part_of(k) AS (VALUES {", ".join(f"('{x}')" for x in names.PARTS)}),
word AS (SELECT p_size, [{", ".join(f"'{w}'" for w in WORDS)}][p_partkey % {len(WORDS)} + 1] AS w FROM part),
a AS (SELECT coalesce(v, w) AS t, w, CASE WHEN v IS NULL THEN 'identity' ELSE 'lexical' END AS r FROM word LEFT JOIN lexical ON k = w),
b AS (SELECT coalesce(v, t) AS t, t AS fine, w, CASE WHEN v IS NULL THEN r ELSE 'lexical' END AS r FROM a LEFT JOIN spelling ON k = t),
c AS (SELECT coalesce(v, t) AS t, fine, w, CASE WHEN v IS NULL THEN r ELSE 'synonym' END AS r FROM b LEFT JOIN synonym ON k = t),
d AS (SELECT coalesce(v, t) AS t, fine, w, CASE WHEN v IS NULL THEN r ELSE 'subtype_projection' END AS r FROM c LEFT JOIN subtype ON k = t)
SELECT CASE WHEN w = 'unclear' THEN 'unknown' ELSE t END AS canonical_name, CASE WHEN w = 'unclear' THEN 'unknown' WHEN fine IN (SELECT k FROM part_of) THEN 'part' ELSE r END AS relation, count(*) AS objects FROM d GROUP BY ALL""")
def object_names(spark, d):
    """Names as models write them (articles, case, marks, ends of sentences) of parts, normalised once each."""
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("p_partkey") % len(WORDS) + 1).cast("int"))
    written = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("The "), F.upper(word), F.lit("."))).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" '"), F.replace(word, F.lit(" "), F.lit("_")), F.lit("'\t"))).otherwise(F.concat(F.lit("a  "), F.replace(word, F.lit(" "), F.lit("-"))))
    own = views.table(spark, d, "part").select(written.alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return names.normalised(own).groupBy("canonical_name", "relation").agg(F.sum("n").alias("objects"))


RANKED_SQL = """
cand AS (SELECT l_suppkey AS object_id, l_orderkey % 25 AS frame_id, row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 25 ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS mask_id, 1 - l_discount * 5 AS score, 1 - l_tax * 5 AS coverage,
         l_quantity / 50 AS purity, l_extendedprice % 100 / 100 AS iou, CAST(l_quantity * 2 AS BIGINT) AS own, floor(l_extendedprice / 10000) AS quality FROM lineitem)"""


@register(f"""WITH {RANKED_SQL}, ranked AS (SELECT *, struct_pack(q := quality, i := iou, s := score, m := -mask_id) AS r FROM cand)
SELECT object_id, frame_id, arg_max(mask_id, r) FILTER (score >= .5 AND coverage >= .5 AND purity >= .75 AND iou >= .4 AND own >= 30) AS strict, arg_max(mask_id, r) FILTER (score >= .6 AND coverage >= .8 AND purity >= .5 AND iou >= .5) AS fragment, arg_max(mask_id, r) AS best
FROM ranked GROUP BY ALL""")
def selected_masks(spark, d):
    from pyspark.sql import Window

    li = views.table(spark, d, "lineitem").withColumns({"object_id": F.col("l_suppkey"), "frame_id": F.col("l_orderkey") % 25})
    place = F.row_number().over(Window.partitionBy("object_id", "frame_id").orderBy("l_orderkey", "l_linenumber", "l_extendedprice")).cast("long")
    rows = li.select("object_id", "frame_id", place.alias("mask_id"), (1 - F.col("l_discount") * 5).alias("score"), (1 - F.col("l_tax") * 5).alias("coverage"), (F.col("l_quantity") / 50).alias("purity"), (F.col("l_extendedprice") % 100 / 100).alias("iou"), (F.col("l_quantity") * 2).cast("long").alias("own"), F.floor(F.col("l_extendedprice") / 10000).cast("double").alias("quality"))
    return naming.select_masks(rows)


@register("""WITH RECURSIVE own AS (SELECT DISTINCT l_suppkey AS frame_id, CAST(l_linenumber AS BIGINT) AS mask_id, l_partkey % 30 AS point_id FROM lineitem),
score AS (SELECT l_suppkey AS frame_id, CAST(l_linenumber AS BIGINT) AS mask_id, avg(l_quantity) AS score FROM lineitem GROUP BY ALL),
size AS (SELECT frame_id, mask_id, count(*) AS n FROM own GROUP BY ALL),
near AS (SELECT a.frame_id, a.mask_id, list(b.mask_id) AS near FROM (SELECT a.frame_id, a.mask_id AS x, b.mask_id AS y, count(*) AS k FROM own a JOIN own b USING (frame_id, point_id) WHERE a.mask_id <> b.mask_id GROUP BY ALL) p JOIN size a ON a.frame_id = p.frame_id AND a.mask_id = x JOIN size b ON b.frame_id = p.frame_id AND b.mask_id = y WHERE k / (a.n + b.n - k) >= .8 GROUP BY ALL),
ord AS (SELECT s.frame_id, s.mask_id, coalesce(near, []) AS near, row_number() OVER (PARTITION BY s.frame_id ORDER BY score DESC, s.mask_id) AS k FROM score s LEFT JOIN near USING (frame_id, mask_id)),
r(frame_id, k, kept) AS (SELECT DISTINCT frame_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM score
  UNION ALL SELECT o.frame_id, o.k, CASE WHEN list_has_any(r.kept, o.near) THEN r.kept ELSE list_append(r.kept, o.mask_id) END FROM r JOIN ord o ON o.frame_id = r.frame_id AND o.k = r.k + 1)
SELECT frame_id, unnest(kept) AS mask_id FROM r WHERE (frame_id, k) IN (SELECT (frame_id, max(k)) FROM ord GROUP BY frame_id)""")
def overlapping_mask_suppression(spark, d):
    """Masks by supplier and line number, which share parts; those too like a better one by their common parts go."""
    li = views.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("frame_id"), F.col("l_linenumber").cast("long").alias("mask_id"), (F.col("l_partkey") % 30).alias("point_id"), "l_quantity")
    own = li.select("frame_id", "mask_id", "point_id").distinct()
    size = own.groupBy("frame_id", "mask_id").agg(F.count("*").alias("n"))
    side = lambda m, n: size.select("frame_id", F.col("mask_id").alias(m), F.col("n").alias(n))
    both = own.withColumnRenamed("mask_id", "a").join(own.withColumnRenamed("mask_id", "b"), ["frame_id", "point_id"]).where("a < b").groupBy("frame_id", "a", "b").agg(F.count("*").alias("k"))
    pairs = both.join(side("a", "na"), ["frame_id", "a"]).join(side("b", "nb"), ["frame_id", "b"]).withColumn("iou", F.col("k") / (F.col("na") + F.col("nb") - F.col("k")))
    return iterative.suppressed(pairs.select("frame_id", "a", "b", "iou"), li.groupBy("frame_id", "mask_id").agg(F.avg("l_quantity").alias("score")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects near the first table of the derived scene, with their evidence."""
    g = _graph(spark, sf_dir)
    first = g.nodes.where("label = 'table'").agg(F.min("instance_id")).first()[0]
    answer = query.execute(g, plan={"conditions": [{"relation": "near", "reference": {"instance_id": first}}]})
    evidence = answer.evidence.select("instance_id", "reference_id", "relation", "aabb_gap_m")
    return answer.matches.select("instance_id", "label", "point_count", "class_share").join(evidence, "instance_id")
