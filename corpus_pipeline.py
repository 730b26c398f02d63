"""From raw documents to packed training sequences: toxic documents go, one of each group of near-duplicates stays,
passages that an earlier document has go, sources are mixed to target weights, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns documents with the same columns; the last returns a row for each packed piece.

Defined results, beside those of the operators: documents with a null or empty text are clean, no near-duplicates, nothing to cut,
of size 0 (the mix takes them as often as their source's words around them), and one end token; those with a null id stay through all
stages; repeated rows are one document of the near-duplicates stage and each other's repeats never; texts of any length count whole; an
empty table gives no rows; further columns, whatever their names, are carried along up to the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framelake.llm import minhash_forest, mixing, packing, suffix_dedup, toxicity
from framelake.llm.common import Scratch, table, temporary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; labels are learnt from as in op4. Null and empty texts stay unless all labels are toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles, the one with the smallest id. Those without words or
    without an id stay."""
    return minhash_forest.deduplicated(docs, size=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the bytes of 50-byte strings that a document with a smaller id has; n_chars is counted anew. None goes,
    even if nothing is left of it."""
    return suffix_dedup.cleaned(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; a null source is a source of its own."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences; each repetition is packed on its own."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("repeats", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the models nor the tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written and read back, and what it was made from is deleted."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        with temporary():
            docs = scratch.cut(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
