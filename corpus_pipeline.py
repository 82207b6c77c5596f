"""A corpus pipeline of five of the operators, in order; each stage works on all that the one before kept.

language ID (documents whose language is not certain go), n-gram Jaccard join (of connected similar documents that of the
smallest id stays), benchmark decontamination (documents that share a run of words with an item go), PII (identifiers are
masked), SentencePiece encoding (the token ids, with the check that they decode to the text again).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from arbolita.llm import deobfuscate, ecoc_langid, ngram_join, spm_trie, wu_manber
from arbolita.session import shared_folder, swept
from arbolita.sources.tables import table

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ecoc_langid.keep_identified(docs, ecoc_langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wu_manber.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deobfuscate.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spm_trie.encode(docs, TOKENIZER)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("sentencepiece", encoding),
]

#: Classifiers, transducers and segmentation are beyond SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = swept(spark, f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}-{name}")
            docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
