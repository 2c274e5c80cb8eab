"""Texts of a batch are Python strings a few at once."""

import tracemalloc

import pyarrow as pa

from sightline.llm import tokens


def test_few_texts_at_once():
    texts = pa.array(["some words " * 50_000, None, ""] * 40)  # 22 MB
    tracemalloc.start()
    n, most = 0, 0
    for part in tokens.text_runs(texts):
        n += len(part)
        del part
        most = max(most, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert n == len(texts) and most < 4_000_000
