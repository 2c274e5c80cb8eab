"""Commands: demo, build-scene-graph, query-scene, clean-pointcloud, evaluate-semantic, export-evaluation."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import evaluation
from .operators.graph import SceneGraph, Thresholds, build_graph, validate_graph
from .operators.spatial import radius_cleanup
from .plans.folders import cut
from .plans.query import execute
from .sources.files import demo_scene, read_dictionary


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sightline")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("demo", help="questions over a scene of three boxes")
    build = commands.add_parser("build-scene-graph", help="objects and relations of a labelled point table")
    build.add_argument("points")
    build.add_argument("classes")
    build.add_argument("output")
    build.add_argument("--up", type=float, nargs=3)
    build.add_argument("--min-points", type=int, default=1)
    ask = commands.add_parser("query-scene", help="answer a question or a JSON plan over a built graph")
    ask.add_argument("graph")
    ask.add_argument("--question")
    ask.add_argument("--plan")
    ask.add_argument("--up", type=float, nargs=3)
    clean = commands.add_parser("clean-pointcloud", help="split a point table by its neighbour counts")
    clean.add_argument("points")
    clean.add_argument("output")
    clean.add_argument("--radius", type=float, default=0.06)
    clean.add_argument("--neighbours", type=int, default=4)
    judge = commands.add_parser("evaluate-semantic", help="coverage, accuracies and per-class IoU of labelled points against a reference table")
    judge.add_argument("points")
    judge.add_argument("reference")
    judge.add_argument("output")
    judge.add_argument("--distance", type=float, default=evaluation.DISTANCE)
    export = commands.add_parser("export-evaluation", help="labelled points in an evaluator's classes")
    export.add_argument("points")
    export.add_argument("mapping", help="a table of semantic_id and class_20")
    export.add_argument("output")
    o = parser.parse_args(args)
    spark = SparkSession.builder.appName("sightline").getOrCreate()

    def show(answer) -> None:
        print(json.dumps({"status": answer.status, "reason": answer.reason, "operation": answer.operation, "instance_ids": answer.ids(), "candidates": [] if answer.candidates is None else [r.asDict() for r in answer.candidates.toLocalIterator()], "count_scope": answer.count_scope}))

    if o.command == "demo":
        points, classes = demo_scene(spark)
        g = build_graph(points, classes, up=(0, 0, 1))
        for plan in ({"conditions": [{"relation": "supported_by", "reference": {"label": "table"}}]}, {"label": "chair", "conditions": [{"relation": "near", "reference": {"label": "table"}}]}):
            show(execute(g, plan=plan))
    elif o.command == "build-scene-graph":
        g = build_graph(spark.read.parquet(o.points), read_dictionary(spark, o.classes), up=o.up, t=Thresholds(min_points=o.min_points))
        g.nodes.write.mode("errorifexists").parquet(f"{o.output}/nodes")
        g.edges.write.mode("errorifexists").parquet(f"{o.output}/edges")
    elif o.command == "query-scene":
        g = SceneGraph(spark.read.parquet(f"{o.graph}/nodes"), spark.read.parquet(f"{o.graph}/edges"), o.up)
        validate_graph(g)
        show(execute(g, question=o.question, plan=json.loads(o.plan) if o.plan else None))
    elif o.command == "evaluate-semantic":
        forward, backward = evaluation.paired(spark.read.parquet(o.points), spark.read.parquet(o.reference), o.distance)
        forward, backward = cut(forward), cut(backward)
        row = evaluation.coverage(forward, backward).first()
        evaluation.class_iou(backward).write.mode("errorifexists").parquet(f"{o.output}/per_class_iou")
        evaluation.iou_matrix(backward).write.mode("errorifexists").parquet(f"{o.output}/instance_iou")
        print(json.dumps(row.asDict()))
    elif o.command == "export-evaluation":
        evaluation.label_export(spark.read.parquet(o.points), spark.read.parquet(o.mapping)).write.mode("errorifexists").parquet(o.output)
    else:
        kept, removed = radius_cleanup(spark.read.parquet(o.points), o.radius, o.neighbours)
        kept.write.mode("errorifexists").parquet(f"{o.output}/kept")
        removed.write.mode("errorifexists").parquet(f"{o.output}/removed")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
