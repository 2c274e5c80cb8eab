"""A corpus pipeline of five stages over documents; each is written and read again before the next.

1. quality: documents that the quality classifier rejects go (score under 0.3).
2. near_duplicates: of each component of near-duplicate documents the one of smallest doc_id stays.
3. decontaminate: contaminated documents go.
4. secrets: spans of secrets in the texts are replaced.
5. encode: doc_id, its BPE ids and the text decoded from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontaminate, jaccard, quality, secrets, tokens
from sightline.llm.common import read_table, spare_name, written
from sightline.llm.queries import vocabulary

THRESHOLD = 0.3
#: No stage but the third can be expressed in SQL; tests compare each with a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the classifier, learned from the labels of docs, gives a score of THRESHOLD or more."""
    model = quality.train_quality(docs, read_table(spark, sf_dir, "labels"))
    score = spare_name(docs.columns, "score")
    return quality.score_quality(docs, model, out=score).where(F.col(score) >= THRESHOLD).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), read_table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated(F.size("hits"), F.col("n_words"))).select("row.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.learn_formats(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.bpe_round_trip(docs.select("doc_id", "text"), vocabulary()).select("doc_id", "ids", "decoded")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("secrets", secret_stage),
    ("encode", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
