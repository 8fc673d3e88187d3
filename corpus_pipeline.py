"""From documents to token ids: five stages, each written as Parquet and read again.

Counted as part of ``pulsemill.llm``. Every stage takes (spark, docs, sf_dir) and works on
all rows that the stage before it kept; all but the last return the columns they got.
Repeated rows, null and empty texts and empty tables are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsemill.llm import decontam, files, jaccard, mixing, tokenids, toxicity
from pulsemill.llm.columns import shield


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a model of the labelled ones among them calls toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, back = shield(docs)
    return back(toxicity.grade(plain, model).where("NOT toxic"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that share ten consecutive words with a benchmark item."""
    plain, back = shield(docs)
    keyed = plain.withColumn("_key", F.md5(F.coalesce("text", F.lit(""))))
    found = decontam.overlaps(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("_key",))
    hit = found.where("contaminated").select("_key").distinct()
    return back(keyed.join(hit, "_key", "left_anti"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3 in turn: each document as often as its source is taken."""
    plain, back = shield(docs, ("doc_id", "text", "source"))
    return back(mixing.repeat(mixing.mix(plain)))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending order of doc_id; per document where its ids are, and their checksum."""
    return tokenids.read(*tokenids.write(docs, shared=False))  # leaves the memory to the stages before


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]
#: a fitted model and a tokenizer are beyond SQL: the tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = files.new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
