"""A corpus pipeline: stages that each take the documents their predecessor kept and return those to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.common import materialize, read
from folioflow.llm.exact_dedup import drop_copies
from folioflow.llm.mixing import mixed
from folioflow.llm.ngram_join import drop_near_copies
from folioflow.llm.pieces import encode_repeated
from folioflow.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier does not reject, with all their columns; null texts count as empty, repeated rows fare alike (see drop_toxic)."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest doc_id, with all its columns; null and empty texts are one text, of equal rows one stays (see drop_copies)."""
    return drop_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest doc_id, with all its columns; texts without words, null ones too, stay (see drop_near_copies)."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them, with all their columns; null texts have size 0, null sources are one source (see mixed)."""
    return mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document; each repetition of a document has draws of its own; null texts count as empty (see encode_repeated)."""
    return encode_repeated(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join), ("mix_sources", mix_sources), ("sentencepiece", sentencepiece)]

#: SQL cannot express a classifier or sampling; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; what a stage keeps is a Parquet table that the next one reads."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
