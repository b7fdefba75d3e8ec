"""What the operators of this subpackage share: staging, tokenizer files and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import discard, fresh_path, settled, shared_dir, staged

__all__ = ["Memo", "discard", "fresh_path", "least_hashes", "partitions", "portions", "rows_of", "settled", "shared_dir", "sliced", "staged", "to_batch", "vocabulary_text", "whole", "worker_state"]

#: What the operator that ran last in this worker keeps from task to task.
_kept: dict[Hashable, Any] = {}
#: Bytes that a memo's entry takes besides its key and value, and letters of the longest key that stays.
ENTRY_BYTES, LONG_KEY = 200, 256


def whole(text: str | Column = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id and text's SHA-256 are in kept (doc_id, text_sha256), one each; one shuffle of docs.

    Of rows that agree in both, the one of the least digest of all other columns stays, whatever the order of rows.
    """
    place = lambda ident, sha: (F.coalesce(ident, F.lit(0)).alias("__id"), ident.isNull().alias("__none"), sha.alias("__sha"))
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]), {"ignoreNullFields": "false"}), 256) if others else F.lit("")
    rows = docs.select(*place(F.col(id_col).cast("bigint"), F.sha2(whole(text_col), 256)), F.struct("*").alias("__row"), digest.alias("__digest"))
    keys = ["__id", "__none", "__sha"]
    found = rows.join(kept.select(*place(F.col("doc_id"), F.col("text_sha256"))), keys, "left_semi")
    return found.groupBy(*keys).agg(F.min_by("__row", "__digest").alias("__row")).select("__row.*")


def sliced(rows: Iterable[tuple], schema: pa.Schema, weigh=None, most_bytes: int = 4 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size; weigh gives the bytes of a row."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weigh(row) if weigh else 64
        if size >= most_bytes or len(held) >= most_rows:
            yield to_batch(held, schema)
            held, size = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def least_hashes(rows: DataFrame, by: str, ident: str, most: dict | int) -> DataFrame:
    """Of the distinct (by, ident) of rows: for each value of by (or of those in most), the most[value] (or most) of the least hash of ident.

    What is over a share of the hash's range that leaves somewhat more than enough goes where it is read, so what
    reaches the driver is a few times most, whatever the number of rows and tasks. Where a share leaves too few
    (repeated idents), a larger one is taken, up to all.
    """
    own = rows.select(F.col(by).alias(by), F.col(ident).alias(ident)).withColumn("__hash", F.xxhash64(ident))
    counts = dict(own.groupBy(by).count().collect())  # a row for each value
    if isinstance(most, int):
        most = dict.fromkeys(counts, most)
    share = {k: min(1.0, (1.2 * most[k] + 200) / n) for k, n in counts.items() if k in most}
    found: dict = {}
    wanted = list(share)
    while wanted:
        under = F.lit(False)
        for k in wanted:
            under = under | ((F.col(by) == k) & (F.lit(True) if share[k] >= 1 else F.col("__hash") < int((2 * share[k] - 1) * (1 << 63))))
        found |= {k: [] for k in wanted}
        for k, x, h in own.filter(under).distinct().collect():
            found[k].append((h, x))
        wanted = [k for k in wanted if share[k] < 1 and len(found[k]) < most[k]]
        share |= {k: min(1.0, 8 * share[k]) for k in wanted}
    chosen = [(k, x) for k, held in found.items() for _, x in sorted(held)[: most[k]]]
    return rows.sparkSession.createDataFrame(chosen, own.drop("__hash").schema)


def vocabulary_text(spark: SparkSession, path: str):
    """Broadcast of a tokenizer file (a few MB whatever the data): executors need no such path."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def portions(batches: Iterable[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[tuple[list, ...]]:
    """The columns as lists, for so many bytes of the last column at a time (one row at least)."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.columns[-1]), 0), np.int64)
        part, start = np.cumsum(sizes) // most_bytes, 0
        for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]:
            if end > start:
                yield tuple(c.to_pylist() for c in batch.slice(start, end - start).columns)
            start = end


def worker_state(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make gives, kept in this worker from task to task. It takes the place of what another operator kept, so the stages of a job do not add up."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)
        _kept[key] = make()
    return _kept[key]


class Memo(dict):
    """A dictionary for a worker's life, of at most so many bytes besides what one call adds.

    Half of the bytes are for entries of now; when these are used up they become the entries of before, which come
    back when asked for, and the former ones of before go. Long keys leave at the next call.
    """

    def __init__(self, most_bytes: int):
        super().__init__()
        self.most, self.held, self.before, self.long = most_bytes // 2, 0, {}, []

    def missing(self, keys: set) -> list:
        """The keys whose values add() is to be given; all others are there until the next call."""
        self.renew()
        return self.lacking(keys)

    def renew(self) -> None:
        """Drops long keys, and what is more than the bytes allow."""
        for k in self.long:
            self.pop(k, None)
        self.long = []
        if self.held > self.most:
            self.before, self.held = dict(self), 0
            self.clear()

    def lacking(self, keys: Iterable) -> list:
        """The keys that are not here, after those of before have come back."""
        new, before = [k for k in keys if k not in self], self.before
        back = [k for k in new if k in before]
        if back:
            self.update(zip(back, map(before.__getitem__, back)))
            self._weigh(back, 0)
            new = [k for k in new if k not in before]
        return new

    def add(self, keys: list, values: Iterable, value_bytes: int = 0) -> None:
        """value_bytes: of all values; no value is None."""
        self.update(zip(keys, values))
        long = [k for k in keys if len(k) > LONG_KEY]
        self.long += long
        self._weigh(keys if not long else [k for k in keys if len(k) <= LONG_KEY], 0 if long else value_bytes)

    def _weigh(self, keys, value_bytes: int) -> None:
        self.held += ENTRY_BYTES * len(keys) + 2 * sum(map(len, keys)) + value_bytes
