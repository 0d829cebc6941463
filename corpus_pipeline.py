"""Corpus pipeline: documents through the training-data operators, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import bpe, langid, minhash, mixing, toxicity
from tessel.llm.catalogue import vocabulary_path
from tessel.llm.common import col, free_name, materialize, prepare, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language stays undetermined; ``source`` stands for the host."""
    model = langid.fit(docs, "doc_id", "text", "lang")
    done = langid.identify(docs, model, F.col("text"), F.col("lang"), F.lit(None).cast("string"), F.concat(F.lit("source/"), "source"))
    return done.where(col(done, done.columns[-1])["accepted"]).select(*[col(docs, c) for c in docs.columns])


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents scored 0.3 or more by a model of the table ``labels``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "score")
    return docs.withColumn(name, toxicity.score(F.col("text"), model)).where(F.col(name) < 0.3).drop(name)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each near-duplicate component (similarity 0.8)."""
    return minhash.deduplicate(docs, percent=80)


def temperature_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at 95 % of the largest entropy; a row for every epoch that takes a document."""
    return mixing.mix(docs).select(*[col(docs, c) for c in docs.columns])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every row of the mix; id count and digests per row."""
    return bpe.document_digests(docs, vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("minhash_dedup", minhash_dedup),
    ("temperature_mix", temperature_mix),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot express the trained models of the first stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
