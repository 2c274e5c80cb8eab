"""Each stage of the pipeline against what it should keep, and the whole run."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sightline.llm import decontaminate, quality, secrets
from tests.llm.test_operators import components_by_force, contaminated_by_force

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before)
        if k < 4:
            assert out.columns == columns
        if name == "quality":
            model = quality.train_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(after) == {r[0] for r in quality.score_quality(docs, model).where(F.col("score") >= 0.3).select("doc_id").collect()}
        elif name == "near_duplicates":
            assert set(after) == {d for d, (n, c) in components_by_force(list(before.items())).items() if d == c}
        elif name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            hit = contaminated_by_force(list(before.items()), items)
            assert set(after) == {d for d, (n, h, _) in hit.items() if not (h and 20 * len(h) >= n)}
        elif name == "secrets":
            assert set(after) == set(before) and all(after[d]["text"] != t for d, t in before.items() if secrets.base_spans(t))
        elif name == "encode":
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert all(r["decoded"] == before[d] and r["ids"] == library.encode(before[d], add_special_tokens=False).ids for d, r in after.items())
        kept = out
    whole = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in whole.select("doc_id").collect()} == {r["doc_id"] for r in kept.collect()}


def test_odd_rows(spark):
    """Null and repeated ids, null and empty texts and repeated rows pass every stage; clean rows stay."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"word{i}" for i in range(40))
    odd = [(None, long, "en", "s", 1), (900_001, None, None, None, None), (900_002, "", "en", "s", 0), (900_003, long + " more", "en", "s", 1), (900_003, "another text of that id " + long[:60], "en", "s", 1), (900_004, long, "en", "s", 1), (900_004, long, "en", "s", 1)]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema))
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.where("doc_id is null or doc_id > 900000").select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, SF)
        if name == "near_duplicates":  # 900_004 and its copy are near copies of 900_003, and the row without id stays
            assert ids(out) == [(False, 900_001), (False, 900_002), (False, 900_003), (False, 900_003), (True, 0)]
        else:
            assert ids(out) == sorted((r[0] is None, r[0] or 0) for r in odd)
    assert corpus_pipeline.quality_stage(spark, docs, SF).columns == docs.columns


def test_empty_documents(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_contamination_rule(spark):
    row = spark.range(1).select(decontaminate.contaminated(F.lit(1), F.lit(20)).alias("a"), decontaminate.contaminated(F.lit(1), F.lit(21)).alias("b"), decontaminate.contaminated(F.lit(0), F.lit(0)).alias("c")).first()
    assert tuple(row) == (True, False, False)
