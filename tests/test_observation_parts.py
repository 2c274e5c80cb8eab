"""Observations are made in tasks of so many lines at most, however few partitions the session asks for."""

from sightline.plans import views

SF = "/root/testdata/sf0.001"


def test_more_lines_are_more_tasks(spark, monkeypatch):
    whole = {tuple(r) for r in views.observations(spark, SF).collect()}
    monkeypatch.setattr(views, "TASK_ROWS", 200)
    parted = views.observations(spark, SF)
    lines = views.table(spark, SF, "lineitem").count()
    assert parted.rdd.getNumPartitions() >= lines / 200 > 8
    assert {tuple(r) for r in parted.collect()} == whole
