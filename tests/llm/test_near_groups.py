"""Large groups of near copies that are not linked with each other become no pairs, and keep every link."""

import random

import numpy as np

from sightline.llm import jaccard


def edited(rng, words, spare, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = rng.choice(spare)
    return " ".join(out)


def test_copies_that_are_not_linked_are_no_pairs(spark, monkeypatch):
    rng = random.Random(5)
    spare = ["x", "y"]  # so few that nearly all shingles of a copy are shared with some other
    words = [f"w{i}" for i in range(150)]
    texts = [edited(rng, words, spare, 5 if i % 20 else 2) for i in range(400)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * (k := len(sets[i] & sets[j])) >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    sizes, written = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, what: sizes.setdefault(what, []).append(t := written(df, what)) or t)
    monkeypatch.setattr(jaccard, "discard", lambda *tables: None)
    got = jaccard.link_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(up)) and len(set(up)) > 200
    heads = sizes["members"][0].where("key = head").count()
    assert heads > 200 and sizes["pairs"][0].count() < heads * heads // 20


def test_parities_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        both, one, other = (rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64) for _ in range(3))
        x, y = (np.unique(np.concatenate([both, s])) for s in (one, other))
        differ = int(np.bitwise_count(jaccard.parities(x) ^ jaccard.parities(y)).sum())
        assert differ <= len(np.setxor1d(x, y))
