"""Documents to packed training sequences, in five stages, each an operator of finlake.llm.

Every stage is given all that the one before kept, as a table that was written
and read again, and returns the columns of documents; the last returns the
pieces of the packed sequences. Rows without a doc_id go at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finlake.llm.op5_minhash import near_dedup
from finlake.llm.op7_language import recognised
from finlake.llm.op8_mixing import mixed
from finlake.llm.op9_packing import pack_documents, public_tokenizer
from finlake.llm.op10_exact_dedup import exact_dedup
from finlake.llm.scratch import Scratch, documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or too far from every language learned from the corpus."""
    return recognised(docs).select(docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest doc_id of equal texts (A-Z lower-cased)."""
    return exact_dedup(docs).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by a similarity of 0.8 or more."""
    return near_dedup(docs).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings the sources to their target words; a document taken twice is two rows."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing", mixing),
    ("packing", packing),
]

#: Language identification is a trained model and packing needs a tokenizer; the
#: pipeline is tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result but the last is written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        if number:
            docs = scratch.save(docs, f"stage{number}")
        docs = stage(spark, docs, sf_dir)
    return docs
