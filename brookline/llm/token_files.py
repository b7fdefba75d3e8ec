"""Token ids in length-delimited binary record files, with a separate offset index.

A shard is a sequence of frames. A frame is: 8 bytes length n of the payload, 4 bytes masked checksum of those 8
bytes, the payload, 4 bytes masked checksum of the payload, and the end byte 0x0A. All numbers are little-endian. The
payload is: 1 byte flags (bit 0: the id is null; bit 1: token ids take 4 bytes, else 2), 8 bytes document id, the token
ids. A masked checksum is crc32 rotated right by 15 bits plus 0xA282EAD8, so that checksums of data holding checksums
stay meaningful. Shards hold ascending document ids, and so do their numbers. The index (Parquet) has a row per
record: shard, file, byte offset, frame bytes, doc_id, start (token ids of all records before it), n_tokens. A reader
that goes through a shuffled index seeks to each offset and reads that frame alone (read_at, ShardReader).

Files are written by Spark's own committer as lines of the text source (the end byte is the line's end), so any file
system that Spark writes can hold them, and the frames of a task that is lost or run twice are not seen twice.

Scale: one range shuffle of the texts, which are encoded after it. A task begins a new shard where the frames at hand
would come to more than SHARD_BYTES, however its rows are dealt, so a reader's memory is bounded by a shard or by the
longest frames. The driver gets nothing that grows; one task adds up a row for each shard.

Defined results: null text counts as empty and gives a record of the end id alone; null doc_id comes first and is
kept; rows of equal id come in the order of a hash of their texts, repeated rows one after the other; an empty table
gives no records; texts of any length are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, partitions, portions, sliced, vocabulary_text, whole, worker_state
from .units import WordUnits

#: Bytes of a shard, and of the frames that are handed to its writer at a time.
SHARD_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20
END_ID = 1
_HEAD = struct.Struct("<Bq")
_FRAMES = pa.schema([("frame", pa.binary())])
_INDEX = "shard bigint, file string, offset bigint, frame_bytes bigint, doc_id bigint, start bigint, n_tokens bigint"
_INDEX_ARROW = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("frame_bytes", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_DIGESTS = pa.schema([("shard", pa.int64()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_RECORDS = pa.schema([("shard", pa.int64()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])


class CorruptRecord(ValueError):
    """A checksum, length or end byte of a record is wrong."""


def masked(data) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: array) -> bytes:
    """ids: of typecode H or I."""
    payload = _HEAD.pack((doc_id is None) | (ids.typecode == "I") << 1, doc_id or 0) + ids.tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)), b"\n"))


def walk(shard, check: bool = True):
    """offset, frame bytes, doc_id, token ids (a view) of each record in a shard's bytes."""
    view, at = memoryview(shard), 0
    while at < len(view):
        if at + 12 > len(view):
            raise CorruptRecord(f"cut off at {at}")
        n, crc = struct.unpack_from("<QI", view, at)
        if masked(view[at : at + 8]) != crc or n < _HEAD.size or at + n + 17 > len(view):
            raise CorruptRecord(f"length at {at}")
        payload = view[at + 12 : at + 12 + n]
        if view[at + 16 + n] != 10 or check and struct.unpack_from("<I", view, at + 12 + n)[0] != masked(payload):
            raise CorruptRecord(f"record at {at}")
        flags, doc_id = _HEAD.unpack_from(payload)
        yield at, n + 17, None if flags & 1 else doc_id, np.frombuffer(payload[_HEAD.size :], "<u4" if flags & 2 else "<u2")
        at += n + 17


@dataclass(frozen=True)
class TokenFiles:
    """Where the shards and the index are."""

    shards: str
    index: str


def splits_at_space(config: dict) -> bool:
    """Whether the file lower-cases, drops white space and cuts there, and has special strings without space."""
    steps = [n["type"] for n in (config.get("normalizer") or {}).get("normalizers", [])]
    first = ((config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and "<|" in t["content"] and " " not in t["content"] for t in config["added_tokens"])
    return steps == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and plain


def _word_encoder(key: str, text: str):
    def make():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(text)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        code = "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I"
        config = json.loads(text)
        encode = lambda group: [e.ids for e in tokenizer.encode_batch(group, add_special_tokens=False)]
        units, end = None, config["model"].get("end_of_word_suffix")
        if end and splits_at_space(config):
            ends = np.zeros(tokenizer.get_vocab_size(), bool)
            ends[[i for t, i in config["model"]["vocab"].items() if t.endswith(end)]] = True
            units = WordUnits(encode, ends, "<u2" if code == "H" else "<u4")
        return code, encode, units

    return worker_state(("token files", key), make)


def _chunks(frames, most: int):
    """Frames, without the last one's end byte (the line's end follows), together up to so many bytes."""
    held, size = [], 0
    for f in frames:
        if held and size + len(f) > most:
            yield (b"".join(held)[:-1],)
            held, size = [], 0
        held.append(f)
        size += len(f)
    if held:
        yield (b"".join(held)[:-1],)


def _frames(key: str, held, end_id: int, chunk_bytes: int):
    def run(batches):
        code, encode, units = _word_encoder(key, held.value)
        end = array(code, [end_id]).tobytes()

        def frames():
            for ids, texts in portions(batches, 2 << 20):
                packed = units.each(texts) if units else (array(code, encode([t])[0]).tobytes() for t in texts)
                for doc_id, p in zip(ids, packed):
                    yield frame(doc_id, array(code, p + end))

        return sliced(_chunks(frames(), chunk_bytes), _FRAMES, lambda r: len(r[0]))

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> TokenFiles:
    """Encodes the texts and writes shards and index below path (a new folder of the shared one if none)."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    out = TokenFiles(f"{path}/shards", f"{path}/index")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), -(-size // shard_bytes))
    held = vocabulary_text(spark, tokenizer_path)
    tied = F.xxhash64("text")  # splits a repeated id over ranges, whose bounds hold no texts
    ordered = source.repartitionByRange(n, F.col("doc_id"), tied).sortWithinPartitions(F.col("doc_id"), tied, F.col("text"))
    chunk = max(1, min(CHUNK_BYTES, shard_bytes // 4))
    frames = ordered.mapInArrow(_frames(tokenizer_path, held, end_id, chunk), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("compression", "none").option("maxRecordsPerFile", max(1, shard_bytes // chunk)).text(out.shards)
    _write_index(spark, out)
    return out


def _shards(spark: SparkSession, files: TokenFiles) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(files.shards).select("path", "content")


def _number(path: str) -> int:
    """A shard's number: its task's, then its place among the task's files."""
    task, place = re.search(r"part-(\d+)[^/]*-c(\d+)[^/]*\Z", path).groups()
    return int(task) << 24 | int(place)


def _buffers(batches):
    worker_state("token file reader", lambda: True)  # the encoder's memo makes room for a shard
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            yield path.as_py(), content.as_buffer()


def _write_index(spark: SparkSession, files: TokenFiles) -> None:
    def run(batches):
        def rows():
            for path, shard in _buffers(batches):
                start = 0
                for offset, size, doc_id, ids in walk(shard, check=False):
                    yield _number(path), path.rpartition("/")[2], offset, size, doc_id, start, len(ids)
                    start += len(ids)

        return sliced(rows(), _INDEX_ARROW)

    within = _shards(spark, files).mapInArrow(run, _INDEX)
    within.write.parquet(files.index + "-within")
    within = spark.read.parquet(files.index + "-within")
    sums = within.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row for each shard
    before = F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    bases = sums.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    whole_index = within.join(bases, "shard").withColumn("start", F.col("start") + F.col("before")).drop("before")
    whole_index.write.parquet(files.index)


def read_index(spark: SparkSession, files: TokenFiles) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(files.index)


def read_records(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """shard, offset, doc_id, ids of every record, checked."""

    def run(batches):
        rows = ((_number(path), offset, doc_id, ids.tolist()) for path, shard in _buffers(batches) for offset, _, doc_id, ids in walk(shard))
        return sliced(rows, _RECORDS, lambda r: 8 * len(r[3]))

    return _shards(spark, files).mapInArrow(run, "shard bigint, offset bigint, doc_id bigint, ids array<bigint>")


class ShardReader:
    """Single records by their place: seeks in a shard and reads no more than the frame. Some shards stay open."""

    def __init__(self, files: TokenFiles, most_open: int = 8):
        self._fs, self._root = FileSystem.from_uri(files.shards)
        self._open: dict = {}
        self._most = most_open

    def read(self, file: str, offset: int, frame_bytes: int) -> tuple[int | None, np.ndarray]:
        """doc_id and token ids, checked."""
        if file not in self._open:
            if len(self._open) >= self._most:
                self._open.pop(next(iter(self._open))).close()
            self._open[file] = self._fs.open_input_file(f"{self._root}/{file}")
        self._open[file].seek(offset)
        [(_, size, doc_id, ids)] = walk(self._open[file].read(frame_bytes))
        if size != frame_bytes:
            raise CorruptRecord(f"record of {size} bytes, not {frame_bytes}")
        return doc_id, ids


def read_at(files: TokenFiles, wanted: DataFrame) -> DataFrame:
    """shard, offset, doc_id, ids of the records that rows of the index name, in their order."""

    def run(batches):
        reader = ShardReader(files)

        def rows():
            for batch in batches:
                for shard, file, offset, size in zip(*(c.to_pylist() for c in batch.columns)):
                    doc_id, ids = reader.read(file, offset, size)
                    yield shard, offset, doc_id, ids.tolist()

        return sliced(rows(), _RECORDS, lambda r: 8 * len(r[3]))

    return wanted.select("shard", "file", "offset", "frame_bytes").mapInArrow(run, "shard bigint, offset bigint, doc_id bigint, ids array<bigint>")


def shuffled_reads(spark: SparkSession, files: TokenFiles, seed: int = 0) -> DataFrame:
    """The index in an order drawn by seed, for a reader that seeks from record to record."""
    return read_index(spark, files).orderBy(F.xxhash64(F.lit(seed), "shard", "offset"), "shard", "offset")


def read_digests(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers) from the files and their index."""

    def run(batches):
        def rows():
            for path, shard in _buffers(batches):
                for offset, _, doc_id, ids in walk(shard):
                    yield _number(path), offset, doc_id, len(ids), zlib.crc32(ids.astype("<u4").data)

        return sliced(rows(), _DIGESTS)

    read = _shards(spark, files).mapInArrow(run, "shard bigint, offset bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(read_index(spark, files).select("shard", "offset", "start"), ["shard", "offset"]).select("doc_id", "start", "n_tokens", "ids_crc32")
