"""A training corpus in five stages: quality rules, near-dedup, suffix dedup, mixing, token ids.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept.  All but the last return
the columns of `documents`.  The mixing stage uses every source once at least, so it drops no document: sources with less
than their weight go out again in further permutations.  Their copies lie side by side, and the last stage encodes a text once for them.

Defined results: null and empty texts, and very short ones, go in the first stage; rows with one doc_id are one document to near-dedup,
which keeps or drops them together, and stay rows of their own afterwards, as do rows with a null doc_id; ties are broken by
doc_id; a very long text is worked on whole; an empty table stays empty; further columns of the input pass through all stages but
the last, whatever their names.  Stage folders lie in the cluster's shared folder and are the caller's to delete.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import circulant, lpf_dedup, mixing, repetition, spm_scan
from larkspur.llm.common import new_dir, small_batches, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return repetition.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return circulant.keep(docs, size=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lpf_dedup.remove(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mix(docs, entropy=0.97, max_repeats=4.0, budget_ratio=None).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    encoded = spm_scan.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "ids", F.floor(F.length("ids") / 4).cast("bigint").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("source_mixing", source_mixing),
    ("token_ids", token_ids),
]

#: Suffix arrays, MinHash and BPE are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
