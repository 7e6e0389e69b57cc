"""Registered queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.llm.common import table
from parley.llm import conversation_repair as repair
from parley.llm import decontamination as clean
from parley.llm import ngram_join
from parley.llm.language_id import language_id
from parley.llm import license_scan as licences
from parley.llm import warc
from parley.llm.periodic_runs import periodic_runs, run_digests, with_repeated_tails
from parley.llm.pii import pii
from parley.llm.pitman_yor import language_model_scores
from parley.llm.quality_classifier import quality
from parley.llm.quality_rules import quality_rules
from parley.llm.sentencepiece_codec import encode_decode
from parley.llm.toxicity import toxicity

TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.license_scan(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_repeated_tails(table(spark, sf_dir, "documents"))))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_conversations(table(spark, sf_dir, "conversations"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_language_id": op2_language_id,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_warc": op5_warc,
        "op6_decontamination": op6_decontamination,
        "op7_pii": op7_pii,
        "op8_toxicity": op8_toxicity,
        "op9_quality_rules": op9_quality_rules,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_lm_scoring": op13_lm_scoring,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licences.oracle_sql(),
        "op5_warc": warc.ORACLE_SQL,
        "op6_decontamination": clean.ORACLE_SQL,
        "op10_ngram_jaccard_join": ngram_join.ORACLE_SQL,
        "op12_conversation_repair": repair.ORACLE_SQL,
    }
