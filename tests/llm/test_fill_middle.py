"""Fill-in-the-middle against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sightline.llm import fill_middle, queries

SF = "/root/testdata/sf0.001"
ODD = [None, "", "\n", "\n\n\n", "one line", "a\nb\nc", "a\nb\nc\n", "with <P> inside\nb", "<S>", "x<M>", "ends with <\n", "<\n<\n<P", "😀\né́\n日本", "\r\nwin\r\n", "line\n" * 50_000, "x" * 200_000, "same\ntext\n", "same\ntext\n"]


def by_force(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id\nhere\n"), (None, "no id\nhere\n"), (None, "another\none"), (3, "another text\nof the same id\n"), *[(100 + i, f"a{i}\nb <\nS>\nP>\n<{i}") for i in range(60)]]
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, form string, key int, `first_end` int")


@pytest.mark.parametrize(("seed", "rate", "spm"), [(7, 100, 50), (8, 60, 0), (9, 100, 100), (1, 0, 50)])
def test_operator(spark, docs, seed, rate, spm):
    got = fill_middle.fill_in_middle(docs, seed, rate, spm)
    assert got.columns == ["doc_id", "text", "key", "first_end", *fill_middle.RESULTS]
    rows = got.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    want = sorted(((r["doc_id"], r["text"]) + by_force(r["doc_id"], r["text"], seed, rate, spm) for r in docs.collect()), key=order)
    assert sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows), key=order) == want
    assert all(r["back"] == (r["text"] or "") for r in rows)
    assert {r["form"] for r in rows} == {(8, 60, 0): {"plain", "psm"}, (9, 100, 100): {"plain", "spm"}, (1, 0, 50): {"plain"}}.get((seed, rate, spm), {"plain", "psm", "spm"})


def test_query(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    df = queries.op12_fill_in_middle(spark, SF)
    assert df.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n, form, p, m, out = by_force(r["doc_id"], r["text"])
        want.append((r["doc_id"], n, form, p, m, sha(out), sha(r["text"] or "")))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_offsets_come_from_units(spark):
    """The first cut before all units, the second after all, and between units of other lengths than one."""
    cuts = spark.createDataFrame([(b"a", [3, 4, 5], 0, 3), (b"b", [3, 4, 5], 1, 2), (b"c", [7], 1, 1), (b"d", [2, 2], 0, 0)], "key binary, lengths array<int>, first int, second int")
    got = {bytes(r["key"]): (r["first_end"], r["second_end"]) for r in fill_middle.cut_offsets(cuts).collect()}
    assert got == {b"a": (0, 12), b"b": (3, 7), b"c": (7, 7), b"d": (0, 0)}


def test_empty_table(spark, docs):
    got = fill_middle.fill_in_middle(docs.limit(0))
    assert got.collect() == [] and got.columns[-5:] == list(fill_middle.RESULTS)
