"""The pipeline's stages over the smallest table."""

import corpus_pipeline
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert sorted(after.columns) == sorted(corpus_pipeline.COLUMNS)
        seen[name] = after
        docs = after
    ids = {n: {r["doc_id"] for r in df.select("doc_id").collect()} for n, df in seen.items()}
    assert ids["toxicity"] >= ids["line_dedup"] >= ids["ngram_join"] >= ids["source_mixing"] == ids["byte_bpe"]
    lines = seen["line_dedup"].select("doc_id", F.explode(F.split("text", "\n")).alias("x")).select("doc_id", F.lower(F.trim("x")).alias("x")).where("length(x) >= 10")
    assert lines.groupBy("x").agg(F.count_distinct("doc_id").alias("n")).where("n > 1").isEmpty()
    again = corpus_pipeline.ngram_join.join(seen["ngram_join"])
    assert again.where("doc_id <> component").isEmpty()
    assert seen["byte_bpe"].count() == seen["source_mixing"].count()
