"""Images are coded a whole image at a time, and those of the registered query once."""

import zlib

import numpy as np
import pytest

from sightline.plans import catalog, views
from sightline.sources import images


@pytest.mark.parametrize("shape", [(1, 1), (38, 16), (7, 90), (5, 6, 3), (4, 3, 4)])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_lines_by_bytes_and_by_diagonals(shape, kind, monkeypatch):
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, np.iinfo(kind).max + 1, shape).astype(kind)
    for filters in (0, 1, 2, 3, 4, rng.integers(0, 5, shape[0]).tolist()):
        png = images.encode_png(pixels, filters)
        for bytes_a_diagonal in (0, 1 << 30):
            monkeypatch.setattr(images, "DIAGONAL", bytes_a_diagonal)
            assert (images.decode_png(png) == pixels).all()


def test_a_coded_line_by_hand():
    """Filters 3 and 4 as the format defines them, on two lines of two pixels."""
    body = next(b for k, b in images.png_chunks(images.encode_png(np.array([[10, 20], [40, 5]], np.uint8), [3, 4])) if k == b"IDAT")
    assert zlib.decompress(body) == bytes([3, 10, 20 - 5, 4, 30, (5 - 40) & 255])


def test_images_of_the_query_are_made_once(spark, monkeypatch):
    made, count = views.depth_images, spark.sparkContext.accumulator(0)

    def counted(session, folder):
        frames = made(session, folder)

        def run(batches):
            for batch in batches:
                count.add(len(batch))
                yield batch

        return frames.mapInPandas(run, frames.schema)

    monkeypatch.setattr(views, "depth_images", counted)
    assert catalog.rgbd_frames(spark, "/root/testdata/sf0.001").count() == count.value
