"""Which anchors may stay without measured depth, and whether a refinement kept to the order and the sources that say so.

Frames between anchors (targets) are refined in batches of up to 16, each from the anchors around it. An anchor without
measured depth is permitted while no target has it as a source. A refinement is a sequence of batches and calls, each an
ordered step: a step that breaks a rule is refused with its reason, and every later step of the sequence with it.

Tables have sequence_id. sequences: frames (their number); anchors: ordinal. A node is an anchor's place among the anchors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.folders import cut
from ..schemas import refuse, refuse_duplicates
from .measured import edge_failures, target_failures

BY = "sequence_id"
#: Targets of a batch at most.
BATCH = 16


def anchor_nodes(sequences: DataFrame, anchors: DataFrame) -> DataFrame:
    """(sequence_id, ordinal, node); anchors are distinct and include a sequence's first and last frame."""
    refuse_duplicates(anchors, BY, "ordinal")
    ends = anchors.groupBy(BY).agg(F.min("ordinal").alias("low"), F.max("ordinal").alias("high"))
    refuse(sequences.join(ends, BY, "left"), F.col("low").isNull() | (F.col("low") != 0) | (F.col("high") != F.col("frames") - 1), "anchors must include the first and the last frame")
    return anchors.select(BY, "ordinal", (F.row_number().over(Window.partitionBy(BY).orderBy("ordinal")) - 1).cast("long").alias("node"))


def source_topology(sequences: DataFrame, anchors: DataFrame) -> DataFrame:
    """(sequence_id, ordinal, place, batch, local, previous, next, previous_ordinal, next_ordinal) of all targets.

    place: among the targets, from 0; batch and local: place by batches; previous, next: the nodes around a target.
    """
    nodes = anchor_nodes(sequences, anchors)
    spans = nodes.withColumns({"next": F.lead("node").over(w := Window.partitionBy(BY).orderBy("node")), "next_ordinal": F.lead("ordinal").over(w)})
    spans = spans.where("next_ordinal > ordinal + 1").withColumnsRenamed({"node": "previous", "ordinal": "previous_ordinal"})
    # before an anchor of node k stand k anchors, so the places follow from the ordinals without a window over frames
    targets = spans.withColumn("ordinal", F.explode(F.sequence(F.col("previous_ordinal") + 1, F.col("next_ordinal") - 1))).withColumn("place", F.col("ordinal") - F.col("next"))
    return targets.select(BY, "ordinal", "place", F.floor(F.col("place") / BATCH).alias("batch"), (F.col("place") % BATCH).alias("local"), "previous", "next", "previous_ordinal", "next_ordinal")


def used_nodes(topology: DataFrame) -> DataFrame:
    return topology.select(BY, F.explode(F.array("previous", "next")).alias("node")).distinct()


def permits(empty: DataFrame, topology: DataFrame) -> DataFrame:
    """empty (sequence_id, node) with permitted: whether no target has the node as a source."""
    return empty.join(used_nodes(topology).withColumn("used", F.lit(True)), [BY, "node"], "left").withColumn("permitted", F.col("used").isNull()).drop("used")


def batch_refusals(batches: DataFrame, topology: DataFrame) -> DataFrame:
    """(sequence_id, batch, reason) of batches that differ from the targets' order.

    batches: batch (from 0), local, ordinal; together they must list all targets so far, each in its place.
    """
    size = batches.groupBy(BY, "batch").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(BY).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = batches.join(size.withColumn("before", before), [BY, "batch"]).withColumn("place", F.col("before") + F.col("local"))
    met = placed.join(topology.select(BY, "place", F.col("ordinal").alias("due")), [BY, "place"], "left")
    wrong = met.groupBy(BY, "batch").agg(F.max("n").alias("n"), (~F.every(F.col("due").eqNullSafe(F.col("ordinal")))).alias("differs"))
    return wrong.where((F.col("n") > BATCH) | F.col("differs")).select(BY, "batch", F.when(F.col("n") > BATCH, "batch_too_large").otherwise("order_differs").alias("reason"))


def call_refusals(calls: DataFrame, edges: DataFrame, batches: DataFrame, sequences: DataFrame, anchors: DataFrame, empty: DataFrame, measured: DataFrame, topology: DataFrame | None = None) -> DataFrame:
    """(sequence_id, batch, call, source, target, reason) of what is wrong with calls; a target is a node past the anchors.

    calls: call, batch, start, end (the range of targets); edges: call, source, target and the counts of
    measured.support_audit; empty: node; measured: call, node of anchors that have measured depth at that call; topology:
    source_topology of the same sequences and anchors, if it is there already.
    """
    topology = source_topology(sequences, anchors) if topology is None else topology
    size = anchors.groupBy(BY).agg(F.count("*").alias("fixed"))
    count = batches.groupBy(BY, "batch").agg(F.count("*").alias("n"))
    calls = calls.join(size, BY, "left").join(count, [BY, "batch"], "left")
    none = lambda kind="long": F.lit(None).cast(kind)
    keys = [BY, "batch", "call"]
    wrong = F.when(F.col("start") != F.col("fixed"), "anchors_not_fixed").when(~(F.col("end") - F.col("start")).eqNullSafe(F.col("n")), "target_range_differs")
    ranges = calls.withColumn("reason", wrong).where("reason is not null").select(*keys, none().alias("source"), none().alias("target"), "reason")
    filled = measured.join(empty.select(BY, "node").distinct(), [BY, "node"]).join(calls.select(*keys), [BY, "call"])
    filled = filled.select(*keys, F.col("node").alias("source"), none().alias("target"), F.lit("empty_anchor_measured").alias("reason"))

    # the anchors around each target of a call's batch, each of which must have exactly one edge to it
    due = calls.join(batches, [BY, "batch"]).join(topology.select(BY, "ordinal", "previous", "next"), [BY, "ordinal"]).select(*keys, F.explode(F.array("previous", "next")).alias("source"), (F.col("start") + F.col("local")).alias("target")).distinct()
    own = cut(edges.join(calls.select(*keys, "start", "end", "fixed"), [BY, "call"]))
    seen = own.groupBy(*keys, "source", "target").agg(F.count("*").alias("k"))
    met = seen.join(due.withColumn("due", F.lit(True)), [*keys, "source", "target"], "full")
    reason = F.when(F.col("due").isNull(), "edge_outside_sources").when(~F.col("k").eqNullSafe(F.lit(1)), "sources_differ")
    topological = met.withColumn("reason", reason).where("reason is not null").select(*keys, "source", "target", "reason")

    used = used_nodes(topology).withColumn("used", F.lit(True)).withColumnRenamed("node", "source")
    bare = empty.select(BY, F.col("node").alias("source"), F.lit(True).alias("bare")).distinct()
    marked = own.join(used, [BY, "source"], "left").join(bare, [BY, "source"], "left")
    support = edge_failures(marked, F.col("start"), F.col("end")).select(*keys, "source", "target", "reason")
    nodes_due = calls.where("end > start").select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("target"))
    unsupported = target_failures(own.where("target >= start and target < end"), nodes_due, keys).select(*keys, none().alias("source"), "target", "reason")
    return ranges.unionByName(filled).unionByName(topological).unionByName(support).unionByName(unsupported)


def refusals(sequences: DataFrame, anchors: DataFrame, batches: DataFrame, calls: DataFrame, edges: DataFrame, empty: DataFrame, measured: DataFrame) -> DataFrame:
    """(sequence_id, batch, call, source, target, reason, first): all refusals, first on those of a sequence's first bad step.

    Steps go by permits (batch and call null), batches, calls of each batch, then what is left at the end (batch null, call
    null, reason unaudited_target). After the first bad step a run has stopped: later ones tell what else is wrong.
    """
    topology = cut(source_topology(sequences, anchors))
    none = lambda kind="long": F.lit(None).cast(kind)
    asked = permits(empty, topology).where(~F.col("permitted")).select(BY, none().alias("batch"), none().alias("call"), F.col("node").alias("source"), none().alias("target"), F.lit("empty_anchor_used").alias("reason"), F.lit(0).alias("step"))
    order = batch_refusals(batches, topology).select(BY, "batch", none().alias("call"), none().alias("source"), none().alias("target"), "reason", F.lit(1).alias("step"))
    called = call_refusals(calls, edges, batches, sequences, anchors, empty, measured, topology).withColumn("step", F.lit(1))
    audited = edges.select(BY, "call", "target").distinct().join(calls, [BY, "call"]).join(batches, [BY, "batch"]).where("target = start + local").select(BY, "ordinal")
    left = topology.join(audited, [BY, "ordinal"], "left_anti").select(BY, none().alias("batch"), none().alias("call"), none().alias("source"), F.col("ordinal").alias("target"), F.lit("unaudited_target").alias("reason"), F.lit(2).alias("step"))
    every = cut(asked.unionByName(order).unionByName(called).unionByName(left))
    at = F.struct("step", F.coalesce("batch", F.lit(-1)).alias("b"), F.coalesce("call", F.lit(-1)).alias("c"))
    first = every.groupBy(BY).agg(F.min(at).alias("least"))
    return every.join(first, BY).withColumn("first", at == F.col("least")).drop("least", "step")


def verdicts(sequences: DataFrame, found: DataFrame, batches: DataFrame) -> DataFrame:
    """(sequence_id, accepted, reasons, batches_done): reasons of the first bad step; batches before it were done."""
    first = found.where("first").groupBy(BY).agg(F.sort_array(F.collect_set("reason")).alias("reasons"), F.min("batch").alias("at"), F.bool_or(F.col("reason") == "empty_anchor_used").alias("barred"))
    size = batches.groupBy(BY).agg(F.countDistinct("batch").alias("all"))
    out = sequences.select(BY).join(first, BY, "left").join(size, BY, "left")
    done = F.when(F.coalesce("barred", F.lit(False)), 0).otherwise(F.coalesce("at", "all", F.lit(0))).cast("long")
    return out.select(BY, F.col("reasons").isNull().alias("accepted"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"), done.alias("batches_done"))
