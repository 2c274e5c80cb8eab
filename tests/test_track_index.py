"""The index of single points against the parts that streams keep, and late rows without a mask."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sightline.operators.iterative import online_association
from sightline.streaming import tracks

from .test_tracks import COLUMNS, RULES, by_scan, made


def test_points_are_read_without_their_neighbours():
    """Masks of one part of ids: each reads the tracks of its own points, and the choices are those of the parts."""
    rng, one, other = random.Random(7), tracks.Indexed(3, 0.3, 0.15), tracks.Association(3, 0.3, 0.15)
    for i in range(600):
        points = np.array(sorted(rng.sample(range(2000), rng.randrange(3, 9))) if i % 3 else range(10 * (i % 60), 10 * (i % 60) + 8), np.int64)
        held, found = one.owners(points)
        assert set(held.tolist()) <= set(points.tolist())
        assert sorted(zip(held.tolist(), found.tolist())) == sorted(zip(*(x.tolist() for x in other.owners(points))))
        assert one.add_mask(1 + i % 2, points, set()) == other.add_mask(1 + i % 2, points, set())
    assert one.founded > 100


def test_classes_of_a_stream_and_a_stream_without_name(spark):
    rows = made(8, streams=("a", None), frames=20)
    want = {(s or "", f, m): k for (s, f, m), k in by_scan([(r[0] or "", *r[1:]) for r in rows], **RULES).items()}
    got = online_association(spark.createDataFrame(rows, COLUMNS), **RULES)
    assert {(r["stream"] or "", r["frame_id"], r["mask_id"]): r["track_id"] for r in got.collect()} == want
    assert got.groupBy("stream").agg((F.max("track_id") == F.count_distinct("track_id")).alias("x")).where("not x").isEmpty()


def test_late_rows_without_a_mask_are_none():
    state = tracks.TrackState(*RULES.values())

    class Kept:
        def __init__(self, x):
            self.x = x

        def exists(self):
            return self.x is not None

        def get(self):
            return self.x

        def clear(self):
            self.x = None

        put = update = lambda self, x: setattr(self, "x", x)

    state.mark, state.waiting, state.parts, state.tracks = Kept((7, 1)), Kept(None), None, None
    late = pd.DataFrame([(4, 0, 0, 1), (4, 2, 1, 1)], columns=COLUMNS[1:])
    out = pd.concat(state.handleInputRows(("a",), iter([late]), None))
    assert out[["frame_id", "mask_id", "late"]].to_numpy().tolist() == [[4, 2, True]]
