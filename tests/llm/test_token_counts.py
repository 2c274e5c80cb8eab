"""The digest cache: counts against the library, what is encoded and when, odd rows."""

import os

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sightline.llm import queries, token_counts

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPECIAL = ["<s>", "</s>", "<unk>", "<0x0A>", "▁a▁b", " a b", "a  b", "\t\n\r\x0b", "\x00", "é", "é", "ﬁ", "日本語 テキスト", "😀", " x", "​"]


@pytest.fixture(scope="module")
def by_force():
    model = SentencePieceProcessor(model_file=MODEL)
    return lambda t: len(model.encode(t or ""))


def rows_in(spark, cache):
    return spark.read.schema(token_counts.CACHE).parquet(cache).collect()


def test_query_against_the_library(spark, tmp_path, by_force):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(90_000 + i, t, None, None, None) for i, t in enumerate([None, "", *SPECIAL, "long text, " * 30_000, "x" * 20_000, "copy", "copy"])]
    docs.unionByName(spark.createDataFrame([*odd, (None, "no id", None, None, None)], docs.schema)).withColumn("n_tokens", F.lit("clash")).withColumn("content", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.op11_token_counts(spark, str(tmp_path))
    assert {f.name: f.dataType.simpleString() for f in df.schema.fields} == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    want = []
    for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect():
        n = by_force(r["text"])
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 4096))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)
    assert any(r[3] for r in want)


def test_only_misses_are_encoded(spark, tmp_path, by_force):
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "three"), (4, None), (5, "one▁two")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(first, MODEL, cache).collect()}
    assert got == {1: by_force("one two"), 2: by_force("one two"), 3: by_force("three"), 4: 0, 5: by_force("one▁two")}
    assert len(rows_in(spark, cache)) == 3  # copies, and texts of one normal form, are one content
    again = first.union(spark.createDataFrame([(6, "three"), (7, "something new")], first.schema))
    stored = token_counts.stored_counts(spark, cache, token_counts.tokenizer_version(MODEL))
    keyed = again.select(token_counts.content_digest(F.col("text"), MODEL).alias("content"), F.coalesce("text", F.lit("")).alias("text"))
    for few in (100, 0):  # both ways of leaving out what is stored
        assert [r["text"] for r in token_counts.missing_texts(keyed, stored, few).collect()] == ["something new"]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(again, MODEL, cache).collect()}
    assert got[7] == by_force("something new") and got[6] == got[3] and len(rows_in(spark, cache)) == 4


def test_counts_come_from_the_cache(spark, tmp_path):
    """A stored count is not computed again, and one of another version is not read."""
    cache, version = str(tmp_path / "cache"), token_counts.tokenizer_version(MODEL)
    docs = spark.createDataFrame([(1, "stored"), (2, "other")], "doc_id long, text string")
    rows = docs.select(F.when(F.col("doc_id") == 1, version).otherwise("v0").alias("version"), token_counts.content_digest(F.col("text"), MODEL).alias("content"), F.lit(777).cast("long").alias("n_tokens"))
    for _ in range(2):  # appended twice, as by two runs at once
        rows.write.mode("append").partitionBy("version").parquet(cache)
    got = token_counts.count_tokens(docs, MODEL, cache).collect()
    assert len(got) == 2 and {r["doc_id"]: r["n_tokens"] for r in got}[1] == 777 and {r["doc_id"]: r["n_tokens"] for r in got}[2] < 10


def test_versions(tmp_path):
    other = public_tokenizers.path("word_bpe_49k.json")
    copy = tmp_path / "a.model"
    copy.write_bytes(open(MODEL, "rb").read())
    assert token_counts.tokenizer_version(str(copy)) == token_counts.tokenizer_version(MODEL) != token_counts.tokenizer_version(other)
    copy.write_bytes(b"changed" + open(MODEL, "rb").read())
    assert token_counts.tokenizer_version(str(copy)) != token_counts.tokenizer_version(MODEL)


def test_other_library(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [None, "", *SPECIAL, "Some Words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path, str(tmp_path / "c")).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, n_tokens string")
    cache = str(tmp_path / "cache")
    for _ in range(2):
        df = token_counts.count_tokens(none, MODEL, cache)
        assert df.collect() == [] and dict(df.dtypes)["n_tokens"] == "bigint"
    assert not os.path.exists(cache) or rows_in(spark, cache) == []


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=st.sampled_from([*"ab 1.\t\n", "▁", "é", "日", "😀", " ", "<", ">", "s", "/"]), max_size=30))
def test_one_normal_form_has_one_count(text):
    """The library itself turns blanks into the stand-in, so the digest puts no two different counts together."""
    count = token_counts.counter(MODEL)
    assert count([text]) == count([text.replace(" ", token_counts.BLANK)]) or text == ""
