"""Corpus cleaning in stages: from ``documents`` to the encoded documents of a weighted mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import byte_bpe, line_dedup, ngram_join, source_mixing, toxicity
from claimloom.llm.components import checkpoint_folder
from claimloom.llm.frames import rest
from claimloom.llm.queries import pattern, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others stay as they are."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rest(spark)  # fitting takes far more than the model has
    return toxicity.score(docs, model, carry=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; a document that loses all its lines goes with them."""
    kept = line_dedup.kept(line_dedup.build(docs), docs, carry=["lang", "source"])
    kept = kept.where((F.col("n_dropped") < F.col("n_lines")) | (F.col("n_dropped") == 0))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Rows are told apart by id and text: of equal rows one stays; different texts under one id stand or go each by its
    own links. Rows without words and rows with a null id stay.
    """
    text = F.xxhash64("text")
    found = ngram_join.join(docs, tag=text).where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).agg(F.min("component").alias("component"), F.count("*").alias("rows"))
    gone, more = found.where("__id <> component").select("__id", "__tag"), found.where("__id = component AND rows > 1").select("__id", "__tag")
    same = (F.col("doc_id") == F.col("__id")) & (text == F.col("__tag"))
    one = docs.join(more, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(gone.unionByName(more), same, "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a part taken is a text's first words."""
    mixed = source_mixing.mix(docs, carry=["lang"])
    return source_mixing.repeat(mixed).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids with its length and digests; the ids' decoding is checked to be the text."""
    return byte_bpe.round_trip(docs, tokenizer("byte_bpe_50k.tiktoken"), pattern())


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_join", keep_one_of_near_copies), ("source_mixing", mix_sources), ("byte_bpe", encode)]

#: The classifier, the seeded order and byte-pair merging are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents``; each result is written to the shared folder and read again, and removed when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    checkpoint_folder(docs)
    at, before = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{at}/{name}")
            docs = spark.read.parquet(f"{at}/{name}")
            if before:
                _remove(spark, before)
            before = f"{at}/{name}"
            rest(spark)
    return docs
