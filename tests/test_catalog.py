"""Registered queries against their SQL on the smallest tables, and their plans."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sightline.operators import evaluation
from sightline.plans import catalog, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in ("part", "lineitem", "events", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, values):
    out = []
    for r in values:
        out.append(tuple(round(float(x), 5) if isinstance(x, float) else x for _, x in sorted(zip(names, r, strict=True))))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    relation = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in relation.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, relation.fetchall())


def test_hungarian_is_no_worse_than_greedy(spark):
    best = catalog.hungarian_matching(spark, SF).collect()
    assert len({r["predicted"] for r in best}) == len({r["reference"] for r in best}) == len(best) > 0
    greedy = [r["coverage"] for r in catalog.greedy_matching(spark, SF).collect() if r["coverage"] >= evaluation.IOU]
    assert len(best) >= len(greedy) and sum(r["iou"] for r in best) >= sum(greedy) - 1e-6


def test_temporal_matches_are_one_to_one(spark):
    got = catalog.temporal_matches(spark, SF).collect()
    for side in ("a", "b"):
        assert len({(r["frame_a"], r[f"mask_{side}"]) for r in got}) == len(got)
    assert all(0.25 <= r["iou"] <= 1 for r in got)


def test_merges_are_partitions(spark):
    groups = [r["group_id"] for r in catalog.constrained_merge(spark, SF).collect()]
    assert sorted(set(groups)) == list(range(1, len(set(groups)) + 1))
    merged = {r["instance_id"]: r["merged_id"] for r in catalog.fragment_merge(spark, SF).collect()}
    assert merged and all(m <= i and merged[m] == m for i, m in merged.items())


def test_a_mask_has_one_track(spark):
    got = catalog.online_tracks(spark, SF).collect()
    assert got and len({(r["stream"], r["frame_id"], r["mask_id"]) for r in got}) == len(got)


def test_fits_are_rigid(spark):
    for r in catalog.rigid_fit(spark, SF).collect():
        m = np.array(r["transform"]).reshape(4, 4)
        assert np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3), atol=1e-4) and np.isclose(np.linalg.det(m[:3, :3]), 1, atol=1e-4) and r["rmse"] < 1e-3


def test_every_query_is_tested():
    by_hand = {"hungarian_matching", "temporal_matches", "constrained_merge", "fragment_merge", "online_tracks", "rigid_fit"}
    assert set(catalog.QUERIES) == set(catalog.ORACLES) | by_hand


def test_single_view_sees_every_frame(spark, monkeypatch):
    seen = [(25, 1, 1, 2, 0.95, True), (26, 1, 1, 3, 0.95, True), (26, 2, 1, 4, 0.95, True)]
    o = spark.createDataFrame(seen, "frame_id long, point_id long, mask_id int, class_id int, confidence double, interior boolean")
    monkeypatch.setattr(views, "observations", lambda spark, d: o)
    assert [tuple(r)[:2] for r in catalog.votes_single_view_whole(spark, SF).collect()] == [(2, 4)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_spatial_joins_are_equi_joins(spark):
    plan = catalog.edges_near(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_are_pruned(spark):
    plan = catalog.label_colours(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan.split("ReadSchema")[1].split(">")[0]


def test_order_of_rows_does_not_matter(spark):
    o = views.observations(spark, SF)
    from sightline.operators.votes import finalize_votes

    a = finalize_votes(o).drop("confidence")
    b = finalize_votes(o.orderBy(F.rand(1)).repartition(7)).drop("confidence")
    assert a.exceptAll(b).count() == 0
