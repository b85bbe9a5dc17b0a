"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, hard_negatives, html_extract, langid, license_scan, mixing, near_dedup, pii, quality, sentencepiece_codec, spelling, token_count, token_output
from lodestrata.llm.common import table
from lodestrata.llm.oracles import ORACLES as ORACLES

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.codec_digest(table(spark, sf_dir, "documents"), PIECES)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.quality_model(docs, table(spark, sf_dir, "labels")))


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Params(shingle=3, percent=85))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), PIECES)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(langid.learning_rows(docs))
    return langid.identify(docs.withColumn("held_out", langid.held_out()), model, ["doc_id", "held_out"])


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_and_read(table(spark, sf_dir, "documents"), WORDS)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabelled)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), spelling.Params(chars=6, count=5, factor=5, typos=199))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_pii that SQL can express."""
    return op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_quality that SQL can express."""
    return quality.quality_rules(table(spark, sf_dir, "documents"), None).drop("kept", "p_good")


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_license that SQL can express."""
    return op6_license(spark, sf_dir).drop("labels", "score")


QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_decontaminate, op3_html, op4_sentencepiece, op5_quality, op6_license, op7_near_dedup, op8_token_count, op9_langid, op10_token_output, op11_mixing, op12_hard_negatives, op13_spelling, pii_counts, quality_counts, license_places)
}
