"""The registered queries themselves, on the smallest tables with odd rows beside them, against plain Python."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from sightline.llm import queries
from tests.llm.test_operators import base_spans_by_force

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(10_001, None, None, None), (10_002, "", "en", "s"), (10_003, " \n\t", "en", None), (10_004, "123 !!", None, "s"), (10_005, "one " * 30_000, "en", "s"), (10_006, "x" * 5000 + " password=abcdef123", None, "s"), (10_007, "same text twice here", "en", "s"), (10_007, "same text twice here", "en", "s")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables of SF, with nulls, empty, long, odd and repeated rows, and columns that clash with results'."""
    out = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(*r, 0) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(odd).withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1)).repartition(3).write.parquet(f"{out}/documents.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    pages.unionByName(spark.createDataFrame([(9001, None, None), (9002, "", ""), (9002, "", ""), (9003, "x://a.net", "<p>only this")], pages.schema)).withColumn("text", F.lit(0)).write.parquet(f"{out}/pages.parquet")
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    size = len(vectors.first()["embedding"])
    vectors.unionByName(spark.createDataFrame([(9000, None), (9100, [0.0] * size), (9200, [float("nan")] * size), (9201, [1.0] * size), (9300, [1.0] * size)], vectors.schema)).write.parquet(f"{out}/embeddings.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def texts(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def fields(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def test_op1(spark, folder):
    df = queries.op1_html_extraction(spark, folder)
    assert fields(df).items() >= {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}.items()
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{folder}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sorted((r["page_id"], r["text"]) for r in rows if r["page_id"] > 9000) == [(9001, ""), (9002, ""), (9002, ""), (9003, "only this")]


def test_op2(spark, folder, texts):
    df = queries.op2_secret_scans(spark, folder)
    assert fields(df).items() >= {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}.items()
    want = []
    for i, t in texts:
        base = base_spans_by_force(t or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        want.append((i, *(sum(k == kind for *_, k in base) for kind in ("assign", "access", "hex")), hashlib.sha256(listed.encode()).hexdigest()))
    rows = df.collect()
    assert sorted((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows) == sorted(want)
    for r in rows:  # base spans stay among all spans
        kept = [x for x in r["spans"].split(",") if x and not x.startswith("auto")]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r["base_sha256"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, folder, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    rows = queries.queries()[name](spark, folder).select(*names).collect()
    # a row that repeats another's id and text is one document to SQL's joins
    assert {tuple(r) for r in rows} == set(found.fetchall())


def test_op4(spark, folder, texts):
    df = queries.op4_language_id(spark, folder)
    assert fields(df).items() >= {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}.items()
    rows = df.collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in texts)
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["lang_pred"] in {*langs.values(), "und"} for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (10_001, 10_002, 10_003, 10_004)} == {"und"}
    asked = [r for r in rows if r["held_out"] and langs.get(r["doc_id"])]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in asked) >= 0.9 * len(asked)


def test_op6_and_op9(spark, folder, texts):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    ids = [(i, t or "", library.encode(t or "", add_special_tokens=False).ids) for i, t in texts]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    df = queries.op6_bpe(spark, folder)
    assert fields(df).items() >= {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}.items()
    assert sorted(tuple(r) for r in df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted((i, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, _, x in ids)
    want, at = [], 0
    for i, _, x in sorted(ids, key=lambda r: r[0]):
        own = np.array([*x, 0], "<u4")
        want.append((i, at, len(own), zlib.crc32(own.tobytes())))
        at += len(own)
    df = queries.op9_token_files(spark, folder)
    assert fields(df).items() >= {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}.items()
    assert sorted(tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_op8(spark, folder):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    want = set()
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        near = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        want |= {(int(q), n, int(ids[k]), round(float(d[k]), 9)) for n, k in enumerate(near, 1)}
    df = queries.op8_nearest_neighbours(spark, folder)
    assert fields(df).items() >= {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}.items()
    got = {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


def test_op10(spark, folder, texts):
    df = queries.op10_quality_classifier(spark, folder)
    assert fields(df).items() >= {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}.items()
    rows = df.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in texts)
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (10_001, 10_002, 10_003)}) == 1


def test_registered_names():
    names = set(__spark_entry__.queries())
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 11)) and "pipeline" in names
