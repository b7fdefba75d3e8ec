"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, language, mixing, simhash, syncmers, token_counts, token_files, toxicity


def tokenizer_file(name: str) -> str:
    """A vocabulary's place: the folder of TOKENIZERS_DIR, or of the package public_tokenizers."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TRAP = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    path = tokenizer_file("byte_bpe_50k.json")
    return chat.read_digests(chat.format_conversations(turns, path), path, arranged=True).drop("n_tokens")


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edited(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return token_files.read_digests(spark, files)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "text", "copy", "n_copies", "mix_key")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_predictions(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat.GUARDED:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP1_SQL = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRAP}' UNION ALL SELECT -7, 1, 'assistant', '{TRAP}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(body) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN body ELSE '' END, '' ORDER BY turn NULLS FIRST, role, body)) AS loss_sha256,
  CAST(sum({sum(map(len, chat.CONTROL))} + length({_escaped("role")}) + length({_escaped("body")})) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
"""

OP7_SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT CAST(sum(n) AS DOUBLE) FROM counts) * sqrt(CAST(n AS DOUBLE)) / (SELECT sum(sqrt(CAST(n AS DOUBLE))) FROM counts) / n AS rate FROM counts),
poisson(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM poisson WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
),
tables AS (SELECT source, list(c ORDER BY k) AS cdf FROM poisson GROUP BY source),
drawn AS (
  SELECT d.doc_id, d.source, d.lang, d.text,
    len(list_filter(t.cdf, lambda c: c <= CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':1'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)) AS n_copies
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
),
copies AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM drawn WHERE n_copies > 0)
SELECT doc_id, source, lang, text, copy, n_copies, md5('shuffle17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(copy AS VARCHAR)) AS mix_key FROM copies
"""

OP10_SQL = """
WITH rows_ AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
ranked AS (
  SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
    row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) AS place
  FROM rows_
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM ranked
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_syncmers, op3_toxicity, op4_token_files, op5_simhash, op6_bpe_prefix, op7_mix_sources, op8_token_counts, op9_language, op10_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op7_mix_sources": OP7_SQL, "op10_exact_dedup": OP10_SQL}
