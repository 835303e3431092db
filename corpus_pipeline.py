"""The corpus pipeline: language, near duplicates, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last
return the columns of ``documents``. ``run`` writes each stage's rows as Parquet in the
shared folder and hands them on as they are read back. Rows with null or empty texts have
no language and go with the first stage; repeated rows are copies of which the
second keeps one. No documents give no rows.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm import jaccard, langid, mixing, packing, pii
from pitchframe.llm.common import crc32_bucket
from pitchframe.plans.scratch import written

TOKENIZER = "word_bpe_49k.json"
#: Near duplicates: words of a shingle, and the Jaccard similarity from which on texts are linked.
SHINGLE_WORDS, PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, ``und``, go; profiles are learned from the ``lang`` of the others."""
    held_out = F.coalesce(crc32_bucket("doc_id", 4) == 2, F.lit(False))
    return langid.with_language(docs, langid.fit_on(held_out, docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest ``doc_id`` stays.

    At 80 percent parts are small: halves of them would often be empty and take twice the
    signatures. Each part is one choice, of all its smaller parts.
    """
    return jaccard.one_of_each(docs, SHINGLE_WORDS, PERCENT, parts=1, different=0)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts give way to their kind in brackets; all documents stay."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, repeats included, and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the language profiles, the random mix and the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"stage-{name}")
    return docs
