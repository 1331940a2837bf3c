"""Documents to training tokens: the stages of the corpus pipeline, in order.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewflow.llm import line_dedup, mixing, ngram_join, quality, unigram
from reviewflow.llm.common import documents
from reviewflow.session import stored


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay once; a document all of whose lines went goes too."""
    cleaned = line_dedup.remove_boilerplate(docs)
    left = cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8."""
    labels = ngram_join.link_documents(docs, size=5, percent=80)
    dropped = labels.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix(docs).where("copies > 0").select("doc_id", "source", "copies").distinct()
    a, b = docs.alias("a"), taken.alias("b")
    same = F.expr("a.doc_id <=> b.doc_id AND a.source <=> b.source")
    return a.join(b, same).withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("b.copies")))).select("a.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document."""
    return unigram.encode(docs)


STAGES = [
    ("quality", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Stages that train a model, or segment by Viterbi, are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
