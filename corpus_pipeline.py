"""A corpus pipeline of operators from brookline.llm: each stage reads what the one before it wrote.

1. toxicity: rows that the factorization machine scores 0.5 or more go.
2. exact_dedup: of equal texts the row of the largest doc_id stays.
3. simhash_dedup: of each component of near-duplicates the row of the smallest doc_id stays; near are texts whose sets of
   five-word shingles have a similarity (Jaccard) of 0.8 or more. Candidates are all pairs whose SimHash fingerprints of
   these sets differ in three bits or less (tables and comparison of op5), and, as similarity 0.8 goes beyond that
   radius, those of the minhashes of shingles.py; the sets decide both.
4. mix_sources: rows are repeated by Poisson counts, so sources come near shares by the square root of their size.
5. bpe: ids and their decoding, as digests, of every row; copies that stage 4 made each have their row.

A stage takes and returns the columns of documents; the last returns doc_id, n_tokens, ids_sha256, decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brookline.llm import bpe, exact_dedup, mixing, shingles, toxicity
from brookline.llm.common import discard, settled
from brookline.llm.queries import table, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, tagged=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies), ("mix_sources", mix), ("bpe", encode)]
#: A trained machine and linked components are beyond SQL; tests/llm/test_pipeline.py holds all rows of run() against plain
#: Python stages that share the fitted machine, which is held to held-out accuracy only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
