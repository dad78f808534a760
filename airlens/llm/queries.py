"""The document operators as registered queries: each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airlens.llm import conversations, language, language_model, quality_classifier, quality_rules, whitening, word_codec
from airlens.llm.fingerprints import fingerprints
from airlens.llm.long_repeats import without_repeats
from airlens.llm.near_dup import near_duplicates
from airlens.llm.packing import pack
from airlens.llm.pieces import encode_pieces
from airlens.llm.word_bpe import count_tokens
from airlens.llm.work import documents, labels

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=4, percent=80)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), 2048)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = language_model.corpus(documents(spark, sf_dir))
    return language_model.scores(texts, language_model.fit(texts))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), 2048)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.train(docs))


def op6_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_classifier.score(docs, quality_classifier.train(docs, labels(spark, sf_dir)))


def op11_bpe_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir), vocabulary("word_bpe_49k.json")
    return word_codec.round_trips(docs, path, word_codec.build(docs, path))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair(conversations.damaged(rows), rows)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whitening.scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    fit = whitening.fit(vectors)
    return whitening.whiten(vectors, fit, whitening.train(fit, 16))


_ALL = (
    op1_minhash_near_dedup,
    op2_best_fit_packing,
    op3_lm_scoring,
    op4_token_counts,
    op5_language_id,
    op6_closed_syncmers,
    op7_suffix_array_dedup,
    op8_sentencepiece,
    op9_quality_rules,
    op10_quality_classifier,
    op11_bpe_round_trips,
    op12_conversation_repair,
    op13_embedding_whitening,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op9_quality_rules": quality_rules.SQL, "op12_conversation_repair": conversations.SQL}
