"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns a DataFrame, which is
the next one's docs; all but the last return the columns of documents.

Defined results: texts that are null or empty fail the base rule of the first stage, so no later stage sees one from
here; repeated rows of one doc_id are judged alike by the rules, count as one document with several texts for lines and
as copies for the join, where all rows of the smallest doc_id stay; rows without doc_id pass lines and join as they are;
an empty table gives an empty table with the last stage's columns; other columns are carried along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chimerant.llm import bpe, decontam, linededup, ngram_join, quality
from chimerant.llm.common import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the posterior of the voting rules rejects go."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal to an earlier line, or within one word edit of one, go, and documents that lose all their words by that."""
    return linededup.filter_documents(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages or paraphrases of benchmark items go."""
    return decontam.filter_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the digests of the ids and of their decoding."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("bpe", encode)]

#: EM, the join's closure and the alignment are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
