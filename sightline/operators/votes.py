"""Vote aggregation with abstention: 0 is unknown and never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(score: Column) -> Column:
    """A score in whole millionths: their sums do not depend on the order of rows, so gates decide alike everywhere."""
    return F.round(score * 1_000_000).cast("long")


def clear_winner(best: Column, second: Column, total: Column, share: float, margin: float) -> Column:
    """Whether best has its share of the total and its margin over the second, in whole millionths and thousandths."""
    return (1000 * best >= round(1000 * share) * total) & (1000 * (best - second) >= round(1000 * margin) * total)


def votes(observations: DataFrame) -> DataFrame:
    """(point_id, class_id, score, votes) of known classes."""
    return observations.where("class_id > 0").groupBy("point_id", "class_id").agg((F.sum(micros(F.col("confidence"))) / 1_000_000).alias("score"), F.count("*").alias("votes"))


def argmax_margin(scores: DataFrame, key: str, item: str, score: str, support: str, min_support: int = 2, share: float = 0.65, margin: float = 0.15) -> DataFrame:
    """(key, item, best, second, total, support): the item of the highest score, or 0 if it isn't clear enough.

    Ties go to the lowest item and then mostly fail the margin. Two aggregations over one shuffle by key: the second best
    score is the maximum of all but the best row, and comes from a sorted pair, not from a window.
    """
    own = scores.select(key, item, support, micros(F.col(score)).alias("_s"))
    by = own.groupBy(key).agg(
        F.max(F.struct(F.col("_s").alias("s"), (-F.col(item)).alias("i"), F.col(support).alias("n"))).alias("b"),
        F.sum("_s").alias("total"),
        F.array_sort(F.collect_list("_s")).alias("all"),
    )
    second = F.coalesce(F.try_element_at("all", F.lit(-2)), F.lit(0))
    clear = (F.col("b.n") >= min_support) & clear_winner(F.col("b.s"), second, F.col("total"), share, margin) & (F.col("b.i") < 0)
    unit = lambda c: c / 1_000_000
    return by.select(key, F.when(clear, -F.col("b.i")).otherwise(0).cast("int").alias(item), unit(F.col("b.s")).alias("best"), unit(second).alias("second"), unit(F.col("total")).alias("total"), F.col("b.n").alias("support"))


def finalize_votes(observations: DataFrame, min_views: int = 2, share: float = 0.65, margin: float = 0.15) -> DataFrame:
    """(point_id, class_id, confidence, visible, votes): the class of each seen point, unknown where votes don't settle it.

    visible counts every observation, those of unknown class too.
    """
    known = argmax_margin(votes(observations), "point_id", "class_id", "score", "votes", min_views, share, margin)
    seen = observations.groupBy("point_id").agg(F.count("*").alias("visible"))
    out = seen.join(known, "point_id", "left")
    chosen = F.coalesce("class_id", F.lit(0))
    return out.select("point_id", chosen.alias("class_id"), F.when(chosen > 0, F.try_divide("best", "total")).otherwise(0.0).alias("confidence"), "visible", F.coalesce("support", F.lit(0)).alias("votes"))


def pixel_claims(claims: DataFrame, threshold: float = 0.5, margin: float = 0.1) -> DataFrame:
    """(frame_id, u, v, class_id, mask_id, score): each pixel's class by its best masks; the first mask wins equal scores."""
    pixel = ["frame_id", "u", "v"]
    best = claims.where("class_id > 0").groupBy(*pixel, "class_id").agg(F.max(F.struct("score", (-F.col("mask_id")).alias("m"))).alias("b"))
    top = best.groupBy(*pixel).agg(F.max(F.struct(F.col("b.score").alias("s"), (-F.col("class_id")).alias("c"), F.col("b.m").alias("m"))).alias("t"), F.array_sort(F.collect_list("b.score")).alias("all"))
    second = F.coalesce(F.try_element_at("all", F.lit(-2)), F.lit(0.0))
    known = (F.col("t.s") >= threshold) & (F.col("t.s") - second >= margin)
    return top.select(*pixel, F.when(known, -F.col("t.c")).otherwise(0).alias("class_id"), F.when(known, -F.col("t.m")).otherwise(0).alias("mask_id"), F.when(known, F.col("t.s")).otherwise(0.0).alias("score"))


def safe(observations: DataFrame, confidence: float = 0.5) -> DataFrame:
    """Observations inside their mask, of a known class and sure enough."""
    return observations.where(F.col("interior") & (F.col("class_id") > 0) & (F.col("confidence") >= confidence))


def point_maximum(observations: DataFrame) -> DataFrame:
    """(point_id, high): the highest confidence of a point's safe observations."""
    return safe(observations).groupBy("point_id").agg(F.max("confidence").alias("high"))


def single_view(observations: DataFrame, least: float = 0.9) -> DataFrame:
    """(point_id, class_id, high): points that the vote leaves unknown but that one sure vote names."""
    known = finalize_votes(observations).where("class_id > 0").select("point_id")
    one = votes(observations).groupBy("point_id").agg(F.sum("votes").alias("n"), F.max("class_id").alias("class_id")).where("n = 1")
    return one.join(point_maximum(observations).where(F.col("high") >= least), "point_id").join(known, "point_id", "left_anti").select("point_id", "class_id", "high")


def conflicts(observations: DataFrame) -> DataFrame:
    """(point_id, n_classes) of points seen as several known classes."""
    return observations.where("class_id > 0").groupBy("point_id").agg(F.count_distinct("class_id").alias("n_classes")).where("n_classes > 1")


def conflict_guard(observations: DataFrame, labels: DataFrame, policy: str = "consensus") -> DataFrame:
    """labels (point_id, semantic_id, instance_id, confidence) with what conflicting views made doubtful set to unknown.

    consensus keeps a label that the vote settled; abstain clears every point with a conflict.
    """
    if policy not in ("consensus", "abstain"):
        raise ValueError(f"unknown policy {policy}")
    doubt = conflicts(observations).select("point_id")
    if policy == "consensus":
        doubt = doubt.join(finalize_votes(observations).where("class_id > 0"), "point_id", "left_anti")
    out = labels.join(doubt.withColumn("guarded", F.lit(True)), "point_id", "left").withColumn("guarded", F.coalesce("guarded", F.lit(False)))
    clear = lambda c, zero: F.when(F.col("guarded"), F.lit(zero)).otherwise(F.col(c)).alias(c)
    return out.select("point_id", clear("semantic_id", 0), clear("instance_id", 0), clear("confidence", 0.0), "guarded")


def conflict_audit(guarded: DataFrame) -> DataFrame:
    return guarded.agg(F.count("*").alias("points"), F.count_if("guarded").alias("guarded"), F.count_if(F.col("guarded") & (F.col("semantic_id") > 0)).alias("left_known"))


#: Classes that may stand for each other, fine ones and the coarse one.
FAMILIES = ((frozenset((8, 17)), 33), (frozenset((7, 14)), 34))


def compatible(a: Column, b: Column) -> Column:
    """Whether two classes may be one object's."""
    out = a == b
    for fine, coarse in FAMILIES:
        both = [F.lit(x) for x in (*sorted(fine), coarse)]
        out = out | (a.isin(*both) & b.isin(*both) & ((a == coarse) | (b == coarse)))
    return out


def compatibility_key(c: Column) -> Column:
    """Equal for all classes that compatible() could accept: an equi-join key."""
    out = c
    for fine, coarse in FAMILIES:
        out = F.when(c.isin(*sorted(fine)), coarse).otherwise(out)
    return out


def resolve_families(points: DataFrame, fine: list[int], coarse: int, least: int = 50, share: float = 0.8) -> DataFrame:
    """(instance_id, class_id): objects of a coarse class become the fine one that most anchored points name."""
    anchored = points.where(F.col("anchor_class").isin(*fine) & (F.col("semantic_id") == coarse) & (F.col("instance_id") > 0))
    per = anchored.groupBy("instance_id", "anchor_class").count()
    top = per.groupBy("instance_id").agg(F.max(F.struct("count", (-F.col("anchor_class")).alias("c"))).alias("b"), F.sum("count").alias("n"))
    return top.where((F.col("b.count") >= least) & (F.col("b.count") >= share * F.col("n"))).select("instance_id", (-F.col("b.c")).alias("class_id"))


def best_and_second(df: DataFrame, keys: list[str], score: str, item: str) -> DataFrame:
    """The two best rows of each group with their place; equal scores by the lowest item."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), item)
    return df.withColumn("place", F.row_number().over(w)).where("place <= 2")
