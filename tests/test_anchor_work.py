"""The frames that refinement tables come from are put in order once."""

from sightline.plans import catalog, views


def test_frames_of_refusals_are_read_once(spark, monkeypatch):
    made, count = views.frames, spark.sparkContext.accumulator(0)

    def counted(session, folder):
        rows = made(session, folder)

        def run(batches):
            for batch in batches:
                count.add(len(batch))
                yield batch

        return rows.mapInPandas(run, rows.schema)

    monkeypatch.setattr(views, "frames", counted)
    assert catalog.anchor_refusals(spark, "/root/testdata/sf0.001").count() > 0
    assert count.value == views.table(spark, "/root/testdata/sf0.001", "events").count()
