"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontaminate, langid, near_dedup, pii, sentencepiece_codec
from lodestrata.llm.common import saved, shared_dir, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: A document stays if its main language has at least this part of its letters.
MIN_LANGUAGE = 0.3
#: A shorter benchmark item may stand in any text, so a document is not thrown away for it.
MIN_ITEM_WORDS = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known; rows without a letter, rows without a main language and rows
    mostly in scripts that no labelled row uses go.

    Without a labelled row nothing can be learned, and only rows without a letter go.  Null texts go;
    null ids and repeated rows are judged row by row.
    """
    return langid.known_language(docs, langid.train(langid.learning_rows(docs)), MIN_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more.

    Rows of one id are one node: they stay or go together, and of equal ones one stays.  Rows with
    null ids or without words are in no group and stay.
    """
    return near_dedup.deduplicate(docs, near_dedup.Params(shingle=5, percent=80))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item of MIN_ITEM_WORDS words at least is found; null texts stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), min_words=MIN_ITEM_WORDS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind; n_chars follows the text; null texts stay null."""
    return pii.redact_pii(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, ids, starts (source byte of each piece, and the end), decoded (the text again); null is empty."""
    return sentencepiece_codec.encode_and_decode(docs, PIECES)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", sentencepiece_encoding),
]

#: SQL cannot express the classifier, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), folder, f"{i}-{name}")
    return docs
