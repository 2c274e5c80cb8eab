"""Numbers and components of whole tables, without a task that holds them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.folders import cut


def numbered(rows: DataFrame, order: Sequence[str], out: str = "k") -> DataFrame:
    """rows with their place, from 1 on, in the order of the columns, which must tell all rows apart.

    Rows are dealt by ranges of the order; a task numbers its own, and what the tasks before it hold is added: one row for
    each partition is collected.
    """
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    before, at = [], 0
    for r in dealt.groupBy("_part").count().orderBy("_part").collect():
        before.append((r["_part"], at))
        at += r["count"]
    offsets = F.broadcast(dealt.sparkSession.createDataFrame(before, "_part int, _before long"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(offsets, "_part").withColumn(out, (F.col("_before") + own).cast("long")).drop("_part", "_before")


def components(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, node, root) of all nodes of the edges (by, a, b): root is the smallest node that they reach.

    Alternating rounds hang every node's larger neighbours, then its smaller ones, below the smallest; each round is cut
    from the last, and their number grows with the logarithm of the longest path.
    """
    keys = [*by]
    e = edges.where("a != b").select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    alone = edges.where("a = b").select(*keys, F.col("a").alias("node"))
    e, mark = cut(e), None
    while True:
        both = e.union(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m"))
        large = both.join(low, [*keys, "u"]).where("v > u and v != m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.where("u != m").select(*keys, "u", F.col("m").alias("v"))).distinct()
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*keys, "u"]).where("v != m").select(*keys, F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = cut(small.union(least.select(*keys, "u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.expr(f"bit_xor(xxhash64({', '.join([*keys, 'u', 'v'])}))")).first())
        if now == mark:
            break
        mark = now
    rooted = e.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
    roots = rooted.select(*keys, F.col("root").alias("node")).union(alone).distinct().join(rooted, [*keys, "node"], "left_anti")
    return rooted.union(roots.select(*keys, "node", F.col("node").alias("root")))
