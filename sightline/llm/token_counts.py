"""Token counts of texts by a digest cache (operator 11).

The cache is a Parquet table of (version, content, n_tokens): version is the digest of the tokenizer's file and library,
content that of the normalised text. Counts are joined to documents by both; only contents that the cache lacks are
encoded, each once whatever its number of copies, and appended to it. An append is seen as a whole or not at all, and two
runs that append the same content at once do no harm, as its count is the same.

Null is the empty text, which has no tokens. Repeated rows have equal counts; an empty table stays empty and appends
nothing. A column of the result's name is replaced; other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.bounds import BROADCAST_ROWS
from .common import spare_name, written
from .tokens import text_runs

CACHE = "version string, content binary, n_tokens long"
#: The stand-in that this kind of model has for a blank; a text that holds it has the tokens of one with blanks.
BLANK = "▁"


def library(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def tokenizer_version(path: str) -> str:
    """A digest of what decides a text's tokens: the vocabulary file, the library and its version."""
    name = library(path)
    with open(path, "rb") as f:
        found = hashlib.file_digest(f, "sha256")
    found.update(f"{name} {importlib.import_module(name).__version__}".encode())
    return f"v{found.hexdigest()}"


def normal_form(text: Column, path: str) -> Column:
    """What is digested: texts of one normal form have the same tokens. Models of pieces see a blank as BLANK."""
    text = F.coalesce(text, F.lit(""))
    return F.replace(text, F.lit(" "), F.lit(BLANK)) if library(path) == "sentencepiece" else text


@lru_cache(maxsize=2)
def counter(path: str):
    """A function from a list of texts to the number of each one's tokens."""
    if library(path) == "sentencepiece":
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, add_bos=False, add_eos=False, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def encoded_lengths(path: str):
    """A function of a text column: the number of its tokens."""

    @F.arrow_udf(T.LongType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(path)
        for texts in batches:
            found = [np.array(count([x or "" for x in part]), np.int64) for part in text_runs(texts)]
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64())

    return run


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """(content, n_tokens) of the cache's rows of that version, each content once; None where there is no cache yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def missing_texts(keyed: DataFrame, stored: DataFrame | None, few: int = BROADCAST_ROWS) -> DataFrame:
    """(content, text): one text for each content of keyed that is not stored.

    Copies are put together by each task before texts are shuffled. Where no more than few contents are missing, rows of
    all others are left out before, so that a full cache shuffles digests only.
    """
    one = lambda rows: rows.groupBy("content").agg(F.first("text").alias("text"))
    if stored is None:
        return one(keyed)
    lacking = keyed.select("content").distinct().join(stored, "content", "left_anti")
    if (found := lacking.limit(few + 1)).count() <= few:
        return one(keyed.join(F.broadcast(found), "content", "left_semi"))
    return one(keyed).join(stored, "content", "left_anti")


def append_missing(docs: DataFrame, path: str, cache: str, text: str = "text") -> None:
    """Encodes what the cache lacks of docs and appends it."""
    spark, version = docs.sparkSession, tokenizer_version(path)
    keyed = docs.select(content_digest(F.col(text), path).alias("content"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    misses = missing_texts(keyed, stored_counts(spark, cache, version))
    rows = misses.select(F.lit(version).alias("version"), "content", encoded_lengths(path)(F.col("text")).alias("n_tokens"))
    rows.write.mode("append").partitionBy("version").parquet(cache)


def content_digest(text: Column, path: str) -> Column:
    return F.unhex(F.sha2(normal_form(text, path), 256))


def count_tokens(docs: DataFrame, path: str, cache: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of each text's tokens, read from the cache after what it lacked has been appended.

    path: a vocabulary file, of tokenizers (.json) or sentencepiece (.model); cache: a folder that driver and executors share.
    """
    append_missing(docs, path, cache, text)
    key = spare_name([*docs.columns, out], "content")
    counts = stored_counts(docs.sparkSession, cache, tokenizer_version(path))
    keyed = docs.withColumn(key, content_digest(F.col(text), path)).drop(out)
    if counts is None:  # no row has ever been counted
        return keyed.drop(key).withColumn(out, F.lit(None).cast("long"))
    # as a table, so that a content that very many documents share can be split between the tasks of the join
    counts = written(counts.select(F.col("content").alias(key), F.col("n_tokens").alias(out)), "token_counts")
    return keyed.join(counts, key, "left").drop(key)
