"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split at safe boundaries (units.py), new units are encoded in batches of about equal bytes, and a text's
count is the sum over its units. A single piece of over 65,536 characters, which has no safe boundary, is counted by
the linear encoder of bpe.py. Any tokenizers file (.json) and SentencePiece model (.model) can be counted; the split is
used where the file is byte-level BPE with the usual pattern, other files encode whole texts in batches, for their
rules need not have a boundary that is known to be safe.

Scale: a map without shuffle; a worker's memo is bounded in bytes, and so is a batch, whatever the length of the texts.

Defined results: null text counts as empty, with 0 bytes and 0 tokens; null doc_id is kept; repeated rows each have
their row; an empty table gives an empty result; texts of any length are counted whole; columns other than the two
named are ignored.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, unsupported
from .common import portions, sliced, vocabulary_text, whole, worker_state
from .units import ByteUnits, by_bytes

LIMIT = 512

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def splits_by_bytes(config: dict) -> bool:
    """Whether the boundaries of units.py are safe for this tokenizers file."""
    return not unsupported(config) and all(" " not in t["content"] for t in config["added_tokens"])


def _counter(key: str, text: str):
    """encode, and the memo of units if the file has safe boundaries; kept from task to task."""

    def make():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(text)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        encode = lambda group: [len(e.ids) for e in tokenizer.encode_batch(group, add_special_tokens=False)]
        config, codec = json.loads(text), []

        def single(piece: str) -> int:
            if not codec:
                codec.append(Codec(config))
            return codec[0].count(piece)

        special = tuple(t["content"] for t in config["added_tokens"])
        return encode, ByteUnits(encode, sum, lambda found: 0, single, special) if splits_by_bytes(config) else None

    return worker_state(("counts", key), make)


def _count_json(key: str, held):
    def run(batches):
        encode, units = _counter(key, held.value)

        def rows():
            for ids, texts in portions(batches, 1 << 20):
                counts = units.each(texts) if units else (n for group in by_bytes(texts) for n in encode(group))
                for doc_id, text, n in zip(ids, texts, counts):
                    yield doc_id, len(text.encode()), n

        return sliced(rows(), _OUT)

    return run


def _count_model(key: str, held):
    def run(batches):
        def make():
            import sentencepiece

            return sentencepiece.SentencePieceProcessor(model_proto=held.value)

        encode = worker_state(("counts", key), make).encode

        def rows():
            for ids, texts in portions(batches, 1 << 20):
                counts = (len(x) for group in by_bytes(texts) for x in encode(group, num_threads=1))
                for doc_id, text, n in zip(ids, texts, counts):
                    yield doc_id, len(text.encode()), n

        return sliced(rows(), _OUT)

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    if tokenizer_path.endswith(".model"):
        with open(tokenizer_path, "rb") as f:
            run = _count_model(tokenizer_path, spark.sparkContext.broadcast(f.read()))
    else:
        run = _count_json(tokenizer_path, vocabulary_text(spark, tokenizer_path))
    counted = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
