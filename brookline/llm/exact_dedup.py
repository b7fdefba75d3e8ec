"""Exact dedup by deterministic block naming.

Each text is cut into fixed-size byte blocks. Equal blocks are brought together, sorted, and numbered; a text of
several blocks is then a row of numbers, whose adjacent pairs are named in the same way, level by level, until one
number stands for the whole text. Names are given by comparing bytes, never by a hash, so no two texts share one.

Scale: only the first level moves text, once, and each map task first folds its own equal blocks into one. Only the
block and a number of the fold go to the task that names it, so a block that a third of all rows hold arrives as one
row per fold, and its rows stay dealt out by fold. Later levels move 16-byte pairs of the texts longer than a block. A
worker holds at most MEMO_BYTES of blocks. Groups are counted by partial sums and joined from a table, so that the
join of a large group can be split.

Defined results: null text counts as empty; rows of one text that also share the largest doc_id are ties, one of
which stays; null doc_id is below every other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, portions, rows_of, sliced, staged, whole, worker_state

BLOCK_BYTES = 4096
MEMO_BYTES = 16 << 20

_FOLDED = "token bigint, key binary, rid array<bigint>, pos array<int>, n array<int>, doc_id array<bigint>, sha array<binary>"
_FOLDED_ARROW = pa.schema([("token", pa.int64()), ("key", pa.binary()), ("rid", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("doc_id", pa.list_(pa.int64())), ("sha", pa.list_(pa.binary()))])
_NAMES_ARROW = pa.schema([("token", pa.int64()), ("name", pa.int64())])


def _folded(rows):
    """Rows (key, rid, pos, n, doc_id, sha) with equal keys folded while they fit the memo; each fold has a token of its own."""
    return ((token, *fold) for token, fold in enumerate(_folds(rows), TaskContext.get().partitionId() << 40))


def _folds(rows):
    memo: dict[bytes, list] = {}
    size = 0
    for key, *rest in rows:
        got = memo.get(key)
        if got is None:
            got = memo[key] = ([], [], [], [], [])
            size += len(key) + 400
        for held, x in zip(got, rest):
            held.append(x)
        size += 150
        if size > MEMO_BYTES:
            yield from ((k, *v) for k, v in memo.items())
            memo, size = {}, 0
    yield from ((k, *v) for k, v in memo.items())


def _weigh(row) -> int:
    return len(row[1]) + 80 * len(row[2])


def _cut(block_bytes: int):
    def run(batches):
        worker_state("exact dedup", lambda: True)

        def rows():
            rid = TaskContext.get().partitionId() << 40
            for ids, texts in portions(batches):
                for doc_id, text in zip(ids, texts):
                    n = max(1, -(-len(text) // block_bytes))
                    yield text[:block_bytes], rid, 0, n, doc_id, hashlib.sha256(text).digest()
                    for pos in range(1, n):
                        yield text[pos * block_bytes : (pos + 1) * block_bytes], rid, pos, n, None, None
                    rid += 1

        return sliced(_folded(rows()), _FOLDED_ARROW, _weigh)

    return run


def _fold_pairs(batches):
    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    return sliced(_folded(rows()), _FOLDED_ARROW, _weigh)


def _name(batches):
    """Numbers the sorted keys of a partition; equal keys are neighbours."""

    def rows():
        last, name = None, (TaskContext.get().partitionId() << 40) - 1
        for batch in batches:
            for key, token in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last:
                    last, name = key, name + 1
                yield token, name

    return sliced(rows(), _NAMES_ARROW)


def _named(folded: DataFrame, level: int) -> DataFrame:
    """rid, pos, n, doc_id, sha, name. Folds meet by key without their rows, and get their names back by token."""
    folded = staged(folded, f"folds{level}")
    keys = folded.select("key", "token").repartition(partitions(folded.sparkSession), "key").sortWithinPartitions("key")
    held = folded.drop("key").join(keys.mapInArrow(_name, "token bigint, name bigint"), "token")
    return staged(held.select("name", F.inline(F.arrays_zip("rid", "pos", "n", "doc_id", "sha"))), f"names{level}")


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: rid, doc_id, sha (bytes), level, name; texts are equal where (level, name) is."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).cast("binary").alias("text"))
    now = _named(source.mapInArrow(_cut(block_bytes), _FOLDED), 0)
    longest = now.agg(F.max("n")).first()[0] or 1
    done, level = now.filter("n = 1").select("rid", "doc_id", "sha", F.lit(0).alias("level"), "name"), 0
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = now.filter("n > 1").groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("at"), F.floor((F.col("n") + 1) / 2).cast("int").alias("m")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"), F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"))
        number = lambda c: F.lpad(F.hex(F.col(c)), 16, "0")
        keyed = pairs.select(F.unhex(F.concat(number("a"), number("b"))).alias("key"), "rid", F.col("at").alias("pos"), F.col("m").alias("n"), "doc_id", "sha")
        now = _named(keyed.mapInArrow(_fold_pairs, _FOLDED), level)
        done = done.unionByName(now.filter("n = 1").select("rid", "doc_id", "sha", F.lit(level).alias("level"), "name"))
    return done


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    named = block_names(docs, id_col, text_col, block_bytes)
    groups = named.groupBy("level", "name").agg(F.max(F.struct(F.col("doc_id"), F.col("rid"))).alias("best"), F.count("*").alias("group_size"))
    groups = staged(groups, "groups")
    return named.join(groups, ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that exact_duplicates drops; all columns stay. A digest only finds the rows again."""
    kept = exact_duplicates(docs, id_col, text_col, block_bytes).filter("kept").select("doc_id", "text_sha256")
    return rows_of(docs, kept, id_col, text_col)
