"""BPE encoding and decoding by per-prefix dynamic programming.

The encoding of a text's prefix ends in one token only. It is found among the vocabulary entries that are suffixes of
the prefix (an automaton over the vocabulary lists them): the entry must be compatible with the last token of the
prefix before it, that is, merging the two tokens' bytes by rank gives the two tokens again. The last tokens of all
prefixes are back-pointers, and following them from the end gives the ids. Time is linear in the length of a piece
but for the few suffixes at each place; there is no queue of merges.

Pieces are those of the usual byte-level pattern, and special strings in the text become their ids, as in the
tokenizers library's default. Each distinct piece is encoded once while a worker's memo holds it (units.py). A file
whose settings mean anything else (a prefix space, a normalizer, dropout and the like) is refused.

Scale: a map without shuffle; memos are bounded in bytes, and a piece takes four bytes for each of its own.

Defined results: null text counts as empty, with no ids; null doc_id and repeated rows are kept; an empty table gives
an empty result; texts and pieces of any length are encoded whole; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, sliced, vocabulary_text, whole, worker_state
from .units import PIECES, ByteUnits

_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
#: Pairs of tokens whose compatibility is kept.
MOST_PAIRS = 300_000
#: Bytes of a piece that are searched at a time.
CHUNK = 1 << 16


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = (b for b in range(256) if b not in set(kept))
    letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}
    return [letters[b] for b in range(256)]


def unsupported(config: dict) -> list[str]:
    """Settings of a tokenizers file that this codec doesn't follow."""
    model, cut, decoder = config["model"], config.get("pre_tokenizer") or {}, config.get("decoder") or {}
    found = [f"model.{k}" for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges", "unk_token") if model.get(k)]
    found += [k for k, bad in (
        ("model.type", model.get("type", "BPE") != "BPE"), ("normalizer", config.get("normalizer")), ("pre_tokenizer.type", cut.get("type") != "ByteLevel"),
        ("pre_tokenizer.add_prefix_space", cut.get("add_prefix_space")), ("pre_tokenizer.use_regex", not cut.get("use_regex", True)), ("decoder.type", decoder.get("type") != "ByteLevel"),
    ) if bad]
    return found + [f"added_tokens.{k}" for t in config["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]


class Codec:
    """Encoder and decoder of a byte-level BPE vocabulary in the tokenizers library's file format."""

    def __init__(self, config: dict):
        if wrong := unsupported(config):
            raise ValueError(f"not a plain byte-level BPE: {', '.join(wrong)}")
        model = config["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        own = {i: bytes(map(byte_of.__getitem__, t)) for t, i in vocab.items()}
        self.bytes_of = own | {i: t.encode() for t, i in self.special.items()}
        self._length = {i: len(b) for i, b in own.items()}
        self.rank: dict[int, int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, whole_ = vocab[left], vocab[right], vocab[left + right]
            self.made.setdefault((a, b), r)
            if whole_ not in self.parts:
                self.parts[whole_], self.rank[whole_] = (a, b), r
        self._valid: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        self._suffixes = ahocorasick.Automaton()
        for i, b in own.items():
            if len(b) == 1 or i in self.parts:
                self._suffixes.add_word(b.decode("latin-1"), i)
        self._suffixes.make_automaton()

    def compatible(self, left: int, right: int, below: float = float("inf")) -> bool:
        """Whether no merge of a rank under below joins bytes across the border: merges are undone, latest first."""
        rank, made, parts = self.rank, self.made, self.parts
        while True:
            crossing = made.get((left, right))
            if crossing is not None and crossing < below:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a > b:
                below, left = a, parts[left][1]
            elif b >= 0:
                below, right = b + 1, parts[right][0]
            else:
                return True

    def stands(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        got = self._valid.get(token)
        if got is None:
            parts = self.parts.get(token)
            got = self._valid[token] = parts is None or self.stands(parts[0]) and self.stands(parts[1]) and self.compatible(*parts, self.rank[token])
        return got

    def _suffix_tokens(self, data: bytes):
        """(end, token) of every entry that ends at a place, place by place; long pieces are searched chunk by chunk."""
        found = self._suffixes.iter(data[:CHUNK].decode("latin-1"))  # a character for each byte
        yield from found
        for at in range(CHUNK, len(data), CHUNK):
            found.set(data[at : at + CHUNK].decode("latin-1"))
            yield from found

    def last_tokens(self, data: bytes) -> array:
        """Of each prefix of a piece's bytes, its last token."""
        last, pairs, length, done = array("i", bytes(4 * len(data))), self._pairs, self._length, 0
        if len(pairs) > MOST_PAIRS:
            pairs.clear()
        for end, token in self._suffix_tokens(data) if len(data) > CHUNK else self._suffixes.iter(data.decode("latin-1")):
            if done > end:
                continue
            start = end + 1 - length[token]
            if start:
                key = last[start - 1] << 32 | token
                ok = pairs.get(key)
                if ok is None:
                    ok = pairs[key] = self.stands(token) and self.compatible(last[start - 1], token)
            else:
                ok = self.stands(token)
            if ok:
                last[done] = token
                done += 1
        return last

    def piece(self, text: str) -> array:
        """Ids of one piece of the pattern."""
        last, length = self.last_tokens(text.encode()), self._length
        ids, at = array("I"), len(last)
        while at:
            token = last[at - 1]
            ids.append(token)
            at -= length[token]
        ids.reverse()
        return ids

    def count(self, text: str) -> int:
        return len(self.piece(text))

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(self._special.split(text) if self._special else [text]):
            if k % 2:
                ids.append(self.special[part])
            else:
                for p in PIECES.findall(part):
                    ids += self.piece(p)
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _packed(codec: Codec):
    """Encodes what units.ByteUnits cuts: single pieces and special strings."""
    special = {t: array("I", [i]).tobytes() for t, i in codec.special.items()}
    return lambda group: [special.get(u) or codec.piece(u).tobytes() for u in group]


def _codec(key: str, text: str) -> tuple[Codec, ByteUnits]:
    def make():
        codec = Codec(json.loads(text))
        encode = _packed(codec)
        return codec, ByteUnits(encode, b"".join, lambda found: sum(map(len, found)), lambda p: encode([p])[0], tuple(codec.special), pieces=True)

    return worker_state(("bpe", key), make)


def _encoded(batches, units: ByteUnits):
    for ids, texts in portions(batches, 1 << 20):
        yield from zip(ids, units.each(texts))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).alias("text"))


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids."""
    held = vocabulary_text(docs.sparkSession, tokenizer_path)

    def run(batches):
        _, units = _codec(tokenizer_path, held.value)
        rows = ((d, array("I", b).tolist()) for d, b in _encoded(batches, units))
        return sliced(rows, _IDS, lambda r: 4 * len(r[1]))

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text of a table (doc_id, ids)."""
    held = vocabulary_text(encoded.sparkSession, tokenizer_path)
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        codec, _ = _codec(tokenizer_path, held.value)
        rows = ((d, codec.decode(ids or ())) for b in batches for d, ids in zip(*(c.to_pylist() for c in b.columns)))
        return sliced(rows, out, lambda r: len(r[1]))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256 (of the ids decoded)."""
    held = vocabulary_text(docs.sparkSession, tokenizer_path)

    def run(batches):
        codec, units = _codec(tokenizer_path, held.value)

        def rows():
            for doc_id, packed in _encoded(batches, units):
                text = codec.decode(array("I", packed))
                yield doc_id, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

        return sliced(rows(), _DIGESTS)

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
