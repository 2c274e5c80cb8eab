"""Questions and plans over made-up scenes, against an evaluator that compares every two objects."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import graph
from sightline.plans import query
from sightline.sources.files import demo_scene

UP = (0, 0, 1)
CLASSES = ("unknown", "lamp", "sofa", "bottle", "door", "bed")
CHINESE = {"lamp": "灯", "sofa": "沙发", "bottle": "瓶子", "door": "门", "bed": "床"}
PLURAL = {"lamp": "lamps", "sofa": "sofas", "bottle": "bottles", "door": "doors", "bed": "beds"}
WORDS = {"near": ("附近", "near"), "above": ("上方", "above"), "below": ("下方", "below"), "inside": ("包围盒内", "inside"), "nearest": ("最近", "nearest to")}


def boxes_of(seed, n):
    """Boxes on a coarse grid of sizes and places, so that gaps, contacts, contained boxes and ties occur; (low, high, class)."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        low = [r.choice((0.0, 0.25, 0.5, 1.0, 2.0, 3.0)) for _ in range(3)]
        if i % 4 == 1:
            low = [*out[-1][0][:2], out[-1][1][2] + r.choice((0.0, 0.03, 0.2))]
        high = [a + r.choice((0.25, 0.5, 1.0, 1.5)) for a in low]
        out.append((low, high, r.randrange(len(CLASSES))))
    return out


def scene(spark, boxes, up=UP, names=None):
    rows = []
    for i, (low, high, kind) in enumerate(boxes, 1):
        for corner in itertools.product((0, 1), repeat=3):
            rows.append((len(rows), *[float((low, high)[c][a]) for a, c in enumerate(corner)], kind, i))
    points = spark.createDataFrame(rows, "point_id long, x double, y double, z double, semantic_id int, instance_id long")
    g = graph.build_graph(points, spark.createDataFrame(list(enumerate(CLASSES)), "class_id int, name string"), names, up)
    return graph.SceneGraph(g.nodes.cache(), g.edges.cache(), up)


def gap(a, b):
    return sum(max(0.0, lo_b - hi_a, lo_a - hi_b) ** 2 for lo_a, hi_a, lo_b, hi_b in zip(a[0], a[1], b[0], b[1], strict=True)) ** 0.5


def holds(a, b):
    return a[:2] != b[:2] and all(x <= y for x, y in zip(a[0], b[0], strict=True)) and all(x >= y for x, y in zip(a[1], b[1], strict=True))


def over(a, b):
    """The gap between b's top and a's bottom if a stands above b, else None."""
    side = [max(0.0, min(a[1][k], b[1][k]) - max(a[0][k], b[0][k])) for k in (0, 1)]
    area = lambda x: (x[1][0] - x[0][0]) * (x[1][1] - x[0][1])
    between = a[0][2] - b[1][2]
    higher = a[0][2] + a[1][2] > b[0][2] + b[1][2]
    return between if higher and side[0] * side[1] >= 0.25 * min(area(a), area(b)) and between >= -0.05 else None


def stands(relation, a, b):
    """Whether a stands in the relation to b."""
    if relation == "near":
        return gap(a, b) <= 0.5
    if relation in ("above", "below"):
        return over(*((a, b) if relation == "above" else (b, a))) is not None
    if relation == "supported_by":
        return (v := over(a, b)) is not None and abs(v) <= 0.05
    return holds(*((a, b) if relation == "contains" else (b, a)))


def by_force(boxes, label, conditions):
    """Ids of the objects that a plan with references by id asks for."""
    ids = {i for i, x in enumerate(boxes, 1) if label is None or CLASSES[x[2]] == label}
    for relation, ref in conditions:
        if relation != "nearest":
            ids = {i for i in ids if i != ref and stands(relation, boxes[i - 1], boxes[ref - 1])}
    for relation, ref in conditions:
        if relation == "nearest":
            far = {i: sum((sum(boxes[i - 1][s][k] - boxes[ref - 1][s][k] for s in (0, 1)) / 2) ** 2 for k in range(3)) ** 0.5 for i in ids - {ref}}
            ids = {i for i, d in far.items() if d <= min(far.values()) + 1e-6}
    return sorted(ids)


@pytest.fixture(scope="module")
def room(spark):
    boxes = boxes_of(8, 18)
    return boxes, scene(spark, boxes)


@pytest.mark.parametrize("relation", query.RELATIONS)
def test_relations_by_force(room, relation):
    boxes, g = room
    sizes = {ref: len(by_force(boxes, None, [(relation, ref)])) for ref in range(1, len(boxes) + 1)}
    most = max(sizes, key=sizes.get)
    assert sizes[most]
    for ref, label in ((most, None), (most, "sofa"), (min(sizes, key=sizes.get), None)):
        want = by_force(boxes, label, [(relation, ref)])
        answer = query.query_graph(g, label, **({"nearest_to": ref} if relation == "nearest" else {"relation": relation, "reference_id": ref}))
        assert (answer.ids(), answer.status, answer.reason) == (want, "matched" if want else "unknown", None if want else "no_matching_object")


@pytest.mark.parametrize("seed", range(6))
def test_questions_by_force(room, seed):
    """Questions made from plans, in both languages, give what the plan gives by force."""
    boxes, g = room
    r = random.Random(seed)
    label = r.choice([None, *CLASSES[1:]])
    conditions = [(k, r.randint(1, len(boxes))) for k in r.sample(("near", "above", "below", "inside"), r.randint(1, 2))] + ([("nearest", r.randint(1, len(boxes)))] if seed % 2 else [])
    count = seed % 3 == 0
    english = ("how many " if count else r.choice(("find ", "list all ", ""))) + (PLURAL[label] if label else "objects") + (" are " if count else " ")
    english += " and ".join(f"{WORDS[k][1]} instance #{i}" for k, i in conditions) + "?"
    chinese = r.choice(("请问", "场景中", "")) + "且".join(f"{r.choice(('', '位于', '在'))}实例{i}{WORDS[k][0]}" for k, i in conditions) + ("有几个" if count else "的") + (CHINESE[label] if label else "物体")
    want = by_force(boxes, label, conditions)
    for question in (english, chinese):
        answer = query.execute(g, question=question)
        assert (answer.ids(), answer.operation) == (want, "count" if count else "find"), question
        assert answer.status == ("matched" if want or count else "unknown")


@pytest.mark.parametrize(("question", "operation", "label", "conditions"), [
    ("list the lamps", "find", "lamp", []), ("count sofas", "count", "sofa", []), ("how many beds were detected in the current map", "count", "bed", []), ("what is above the bed?", "find", None, [("above", "bed")]),
    ("bottles which are inside #4", "find", "bottle", [("inside", 4)]), ("nearest to the door", "find", None, [("nearest", "door")]), ("show all objects", "find", None, []),
    ("场景里一共有多少个瓶子", "count", "bottle", []), ("沙发的数量是多少", "count", "sofa", []), ("离门最近的是什么", "find", None, [("nearest", "door")]), ("床上方并且灯附近的瓶子", "find", "bottle", [("above", "bed"), ("near", "lamp")]),
    ("茶几旁边有哪些沙发", "find", "sofa", [("near", "茶几")]), ("实例#12的包围盒里面有什么", "find", None, [("inside", 12)]), ("列出所有门", "find", "door", []),
])
def test_plans_of_questions(question, operation, label, conditions):
    plan = query.parse_question(question)
    assert (plan.operation, plan.label, [(c.relation, c.instance_id or c.label) for c in plan.conditions]) == (operation, label and query.alias(label), [(k, x if isinstance(x, int) else query.alias(x)) for k, x in conditions])


@pytest.mark.parametrize("question", ["", " ", "?" * 9, "y" * 513, None, 5, "lamps or doors", "a red lamp", "beds not near the door", "蓝色的沙发", "为什么没有门", "lamps near", "near", "sofa and bed", "lamps near the door and beds above the sofa", "灯附近的门且床上方的瓶子", "lamps near objects", "lamps, doors", "床且灯附近"])
def test_what_is_no_question_is_refused(room, question):
    with pytest.raises(query.UnsupportedQuery):
        query.parse_question(question)
    if isinstance(question, str):
        answer = query.execute(room[1], question=question)
        assert answer.status == "unsupported" and answer.ids() == []


def test_references_that_are_many_or_none(spark):
    boxes = [([3.0 * i, 0, 0], [3.0 * i + 1, 1, 1], 5) for i in range(90)] + [([0.0, 0, 1], [1, 1, 2], 3)]
    g = scene(spark, boxes)
    answer = query.execute(g, question="bottles above the bed")
    assert (answer.status, answer.reason) == ("ambiguous", "ambiguous_reference")
    got = answer.candidates.collect()
    assert [r["instance_id"] for r in got] == list(range(1, 91)) and got[1]["label"] == "bed" and (got[1]["x"], got[1]["y"], got[1]["z"]) == (3.5, 0.5, 0.5)
    assert query.execute(g, question="bottles above the lamp").reason == "reference_not_found"
    assert query.execute(g, question="how many bottles are above #1").ids() == [91]


def test_names_count_with_two_frames_only(spark):
    boxes = [([4.0 * i, 0, 0], [4.0 * i + 1, 1, 1], 4) for i in range(5)]
    names = spark.createDataFrame([(1, "Wardrobe ", [3, 9]), (2, "wardrobe", [4]), (3, "wardrobe", [5, 5]), (4, "none", [1, 2]), (5, "sofa", [1, 2])], "instance_id long, vlm_name string, support_frames array<int>")
    g = scene(spark, boxes, names=names)
    assert query.query_graph(g, "wardrobe").ids() == [1]
    assert query.query_graph(g, "door").ids() == [1, 2, 3, 4, 5] and query.query_graph(g, " DOOR ").ids() == [1, 2, 3, 4, 5]
    assert query.query_graph(g, "sofa").ids() == [5] and query.query_graph(g, "none").ids() == []
    assert [r["instance_id"] for r in g.nodes.where("name_category_conflict").collect()] == [5]


def test_vertical_relations_need_up(spark, room):
    flat = scene(spark, room[0], up=None)
    for relation in query.VERTICAL:
        assert query.query_graph(flat, relation=relation, reference_id=1).reason == "world_up_required"
    assert query.query_graph(flat, relation="near", reference_id=1).ids() == by_force(room[0], None, [("near", 1)])


def test_nearest_comes_last_in_any_order(room):
    boxes, g = room
    for ref in (2, 5):
        conditions = [("nearest", ref), ("near", 3)]
        for order in (conditions, conditions[::-1]):
            plan = {"conditions": [{"relation": k, "reference": {"instance_id": i}} for k, i in order]}
            assert query.execute(g, plan=plan).ids() == by_force(boxes, None, conditions)


def condition(**reference):
    return {"relation": "above", "reference": reference}


@pytest.mark.parametrize("plan", [
    {"operation": "delete"}, {"schema": "other"}, {"where": "1=1"}, {"label": "\t"}, {"label": "z" * 81}, {"label": 3}, {"conditions": {}}, {"conditions": [condition()]}, {"conditions": [condition(instance_id=False)]},
    {"conditions": [condition(instance_id=0)]}, {"conditions": [condition(label="bed", instance_id=2)]}, {"conditions": [condition(name="bed")]}, {"conditions": [condition(label="bed")] * 9},
    {"conditions": [{"relation": "beside", "reference": {"label": "bed"}}]}, {"conditions": [{"relation": "nearest", "reference": {"label": x}} for x in ("bed", "door")]}, [], None,
])
def test_bad_plans(plan):
    with pytest.raises(ValueError):
        query.validate_plan(plan)


def test_asking_for_one_thing_in_one_way(room):
    g = room[1]
    for bad in ({"question": "list beds", "plan": {}}, {}):
        with pytest.raises(ValueError):
            query.execute(g, **bad)
    for bad in ({"relation": "near"}, {"reference_id": 1}, {"relation": "near", "nearest_to": 1, "reference_id": 2}, {"relation": "nearest", "reference_id": 1}, {"nearest_to": 10_000}):
        with pytest.raises(ValueError):
            query.query_graph(g, **bad)


def test_bound_context(room):
    seen = iter(["r1", "r1", "r1", "r2"])
    assert query.execute_bound(room[1], "r1", lambda: next(seen), question="list beds").ids() == by_force(room[0], "bed", [])
    with pytest.raises(query.StaleContext):  # the map changes while the question is answered
        query.execute_bound(room[1], "r1", lambda: next(seen), question="list beds")
    with pytest.raises(query.StaleContext):
        query.execute_bound(room[1], "r1", lambda: "r0", question="list beds")


def test_validation(spark, room):
    g = room[1]
    graph.validate_graph(g)
    one = g.edges.where("relation = 'above'").first()
    back = spark.createDataFrame([(one["target"], one["source"], "above", False)], "source long, target long, relation string, symmetric boolean")
    with pytest.raises(ValueError, match="cycle"):
        graph.validate_graph(graph.SceneGraph(g.nodes, g.edges.unionByName(back, allowMissingColumns=True), UP))
    with pytest.raises(ValueError, match="world_up"):
        graph.validate_graph(graph.SceneGraph(g.nodes, g.edges, None))


def test_demo(spark):
    points, names = demo_scene(spark)
    g = graph.build_graph(points, names, up=UP)
    assert query.execute(g, plan={"conditions": [{"relation": "supported_by", "reference": {"label": "table"}}]}).ids() == [2]
    assert query.execute(g, question="chairs near the table").ids() == [3]


def test_candidate_limit(spark):
    rows = [(k, float(k % 2), 0.0, 0.0, 1, k // 2 + 1) for k in range(60)]
    points = spark.createDataFrame(rows, "point_id long, x double, y double, z double, semantic_id int, instance_id long")
    with pytest.raises(ValueError, match="limit"):
        graph.build_graph(points, spark.createDataFrame([(1, "bed")], "class_id int, name string"), t=graph.Thresholds(max_candidates=10))


def test_tie_is_unknown(spark):
    rows = [(i, float(i), 0.0, 0.0, kind, own) for i, (kind, own) in enumerate([(3, 7), (3, 7), (4, 7), (4, 7), (4, 8), (4, 8), (3, 8), (2, 9)])]
    p = spark.createDataFrame(rows, "point_id long, x double, y double, z double, semantic_id int, instance_id long")
    got = {r["instance_id"]: (r["semantic_id"], r["semantic_class_tie"], dict(r["semantic_class_counts"])) for r in graph.objects(p).collect()}
    assert got == {7: (0, True, {3: 2, 4: 2}), 8: (4, False, {4: 2, 3: 1}), 9: (2, False, {2: 1})}
    assert [r[0] for r in graph.omitted(p, 2).collect()] == [9]
    assert graph.objects(p.where(F.lit(False))).count() == 0
