"""The corpus pipeline: documents are cleaned, scored, deduplicated twice and packed, one stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airlens.llm import long_repeats, near_dup, packing, quality_classifier, quality_rules
from airlens.llm.queries import vocabulary
from airlens.llm.work import documents, labels, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go; so do documents that the base rules reject or that lose over half of their text."""
    return quality_rules.cleaned(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted 0 go; the model is fitted on labelled documents of this stage's input."""
    return quality_classifier.accepted(docs, quality_classifier.train(docs, labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of 5 words, similarity 0.8) the document of the smallest doc_id stays."""
    return near_dup.one_of_each(docs, size=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that stand earlier are cut out of the texts; every document stays, if with less text."""
    return long_repeats.trimmed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 2048)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("minhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("best-fit packing", packed),
]
#: Tokens and a trained model cannot be put in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each one's result written and read again."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs)
    return docs
