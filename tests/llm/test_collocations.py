"""Collocations against counting every phrase in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from sightline.llm import collocations, queries

SF = "/root/testdata/sf0.001"
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_force(rows, words=3, least=10, share=50, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(_LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            own = counts.setdefault(lang, Counter())
            for k in range(1, words + 1):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        held[p[i:j]] = max(held[p[i:j]], a)
        for p, a in candidates.items():
            if p in held and 100 * held[p] >= share * a:
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def made_rows(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "new", "york", "city", "São", "paulo", "日本", "x y", "\x1c", "don't", "-"]
    weights = [9, 3, 6, 5, 4, 4, 2, 1, 1, 1, 1, 1, 1, 1]
    text = lambda: "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!", "\r\n", " ; "]) for w in rng.choices(vocabulary, weights, k=rng.randrange(60)))
    rows = [(rng.choice(["en", "fr", None, "und"]), text()) for _ in range(n)]
    return [*rows, (None, None), ("en", ""), ("en", " \t"), ("en", ".,;:!?\n\r\x0b\x0c"), ("zz", "only here"), *[("en", "New York City stays, New York City")] * 40]


def table(spark, rows):
    return spark.createDataFrame([(a, b, 1, "x", 2) for a, b in rows], "lang string, text string, n int, phrase string, block int")


@pytest.mark.parametrize(("seed", "words", "least", "share", "top", "block", "bucket"), [(1, 3, 10, 50, 2000, collocations.BLOCK, collocations.BUCKET), (2, 3, 3, 50, 20, 200, 100), (3, 5, 2, 80, 2000, 1000, 40), (4, 2, 1, 50, 2000, 1, 50), (5, 4, 4, 1, 7, 300, 10_000)])
def test_operator(spark, seed, words, least, share, top, block, bucket):
    rows = made_rows(seed)
    df = collocations.collocations(table(spark, rows).repartition(3), words, least, share, top, block=block, bucket=bucket)
    assert df.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, df.collect())) == by_force(rows, words, least, share, top)


def test_query(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op13_collocations(spark, SF).collect()))
    assert got == by_force(rows) and got


def test_empty_tables(spark):
    for rows in ([], [(None, None)], [("en", "...")], [("en", "one two")]):
        assert collocations.collocations(table(spark, rows)).collect() == []


def test_long_texts_are_cut_between_pieces():
    text = b"one two.three four.five" + b" six" * 50 + b".seven"
    for most in range(1, len(text) + 2):
        parts = list(collocations.cut_long(text, most))
        assert b".".join(parts) == text and all(p in text.split(b".") for part in parts for p in part.split(b"."))


def test_pairs_need_two_names_that_touch():
    codes = np.array([1, 2, 0, 1, 2, 3, 1, 2], np.int32)
    out, left, right, counts = collocations.adjacent_pairs(codes, np.array([2, 1]), np.array([70, 50]))  # 3 has no name
    assert out.tolist() == [1, 0, 0, 1, 0, 0, 1] and (left.tolist(), right.tolist(), counts.tolist()) == ([50], [70], [3])
    assert [len(x) for x in collocations.adjacent_pairs(codes, np.zeros(0, int), np.zeros(0, int))] == [0, 0, 0, 0]


@pytest.mark.parametrize("x", [[], [0], [255, 256, 0], [1 << 40, 3], [(1 << 63) - 1, 0, 7], list(range(1000))])
def test_packing(x):
    assert collocations.unpacked(collocations.packed(np.array(x, np.int64))).tolist() == x
    words = [str(i).encode() for i in x]
    assert collocations.unpacked_words(collocations.packed_words(words)) == words


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_017, 5_000_000_029, 4_000_000_007
    rows = spark.createDataFrame([(a, [left, a + 1], [right, a + 2])], "a long, prefixes array<long>, suffixes array<long>")
    got = rows.selectExpr(f"{collocations.weakest_cut()} AS c").first()["c"]
    cuts = [(10**6 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate([(left, a + 2), (a + 1, right)], 1)]
    assert tuple(got) == min(cuts)
