"""Chat formatting by assembly of token ids.

Each turn is rendered as  <s>[INST]role[/INST]text</s>.  Role and text are encoded separately, so no token spans a
border, and the four control strings are reserved ids above the vocabulary, spliced in between. A control string that
occurs in a role or text is broken by a backslash after its first character (and a backslash there is doubled), so it
can be neither read as control nor encoded to a reserved id, and is restored by unescape. The loss mask is the prefix
sum of +1 where an assistant's text begins and -1 where it ends.

Scale: one shuffle of the texts by conversation, in which rows are sorted and streamed, encoded and assembled, so a
conversation of any length takes a task no more memory than its longest turn. The result comes in order, and a reader
that gets it as it comes (arranged) needs no further shuffle. A long conversation is one task's, as its tokens are
counted through from turn to turn. Each distinct unit of text is encoded once while a worker's memo holds it (units.py).

Defined results: rows are ordered by turn, then role, then text (nulls first, as empty); repeated rows are turns of
their own; null text and role are empty; a null conversation id is one conversation; an empty table gives no rows;
texts of any length are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec
from .common import partitions, portions, sliced, vocabulary_text, whole, worker_state
from .units import ByteUnits

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = (BEGIN, END, OPEN, CLOSE)
#: Also broken in content, as the tokenizer's file knows it.
GUARDED = (*CONTROL, "<|endoftext|>")
ASSISTANT = "assistant"
_FOUND = re.compile("|".join(map(re.escape, sorted(GUARDED, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8()))])
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def escape(text: str) -> str:
    return _FOUND.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Template:
    """A byte-level BPE file's encoder and decoder, in which its own special strings are plain text, and the reserved ids above its vocabulary."""

    def __init__(self, text: str):
        config = json.loads(text)
        above = max([*config["model"]["vocab"].values(), *(t["id"] for t in config["added_tokens"])]) + 1
        self.reserved = {c: above + i for i, c in enumerate(CONTROL)}
        self.codec = Codec(config | {"added_tokens": []})
        single = lambda p: self.codec.piece(p).tobytes()
        self.units = ByteUnits(lambda group: list(map(single, group)), b"".join, lambda found: sum(map(len, found)), single, pieces=True)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, np.int32) for ids in self.units.each(texts)]

    def decode(self, ids: list[int]) -> str:
        return self.codec.decode(ids)

    def assemble(self, role_ids: np.ndarray, text_ids: np.ndarray, loss: bool) -> tuple[np.ndarray, np.ndarray]:
        """ids and loss mask of a turn."""
        r = self.reserved
        segments = [[r[BEGIN], r[OPEN]], role_ids, [r[CLOSE]], text_ids, [r[END]]]
        ends = np.cumsum([len(s) for s in segments])
        steps = np.zeros(ends[-1] + 1, np.int8)
        if loss:
            np.add.at(steps, [ends[2], ends[3]], [1, -1])
        return np.concatenate([np.asarray(x, np.int32) for x in segments]), np.cumsum(steps[:-1], dtype=np.int8)

    def text_ids(self, ids: np.ndarray) -> np.ndarray:
        """Those of a turn's text."""
        (close,) = np.flatnonzero(ids == self.reserved[CLOSE])
        return ids[close + 1 : -1]

    def parse(self, ids: np.ndarray) -> tuple[str, str, int]:
        """Escaped role and text of a turn, and its rendered characters."""
        r = self.reserved
        (close,) = np.flatnonzero(ids == r[CLOSE])
        if ids[0] != r[BEGIN] or ids[1] != r[OPEN] or ids[-1] != r[END] or (ids >= r[BEGIN]).sum() != 4:
            raise ValueError("not a turn")
        role, text = self.decode(ids[2:close].tolist()), self.decode(ids[close + 1 : -1].tolist())
        return role, text, len(role) + len(text) + sum(map(len, CONTROL))

    def render(self, ids: np.ndarray) -> str:
        role, text, _ = self.parse(ids)
        return f"{BEGIN}{OPEN}{role}{CLOSE}{text}{END}"


def _template(key: str, held) -> Template:
    return worker_state(("chat", key), lambda: Template(held.value))


def _arrays(ids: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), kind))


def format_conversations(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv_id, part (the turn's place, from 0), start (tokens before it in the conversation), ids, loss_mask; parts of a conversation follow each other."""
    held = vocabulary_text(conversations.sparkSession, tokenizer_path)

    def run(batches):
        template = _template(tokenizer_path, held)
        last, part, start = None, -1, 0
        for convs, roles, texts in portions(batches, 1 << 20):
            names = list(set(roles))
            encoded = template.encode([*map(escape, names), *map(escape, texts)])
            role_ids = dict(zip(names, encoded))
            parts, starts, ids, masks = [], [], [], []
            for conv, role, text_ids in zip(convs, roles, encoded[len(names) :]):
                if part < 0 or conv != last:
                    last, part, start = conv, 0, 0
                own, mask = template.assemble(role_ids[role], text_ids, role == ASSISTANT)
                parts.append(part)
                starts.append(start)
                ids.append(own)
                masks.append(mask)
                part, start = part + 1, start + len(own)
            columns = [pa.array(convs, pa.int64()), pa.array(parts, pa.int64()), pa.array(starts, pa.int64()), _arrays(ids, pa.int32()), _arrays(masks, pa.int8())]
            yield pa.RecordBatch.from_arrays(columns, schema=_PARTS)

    source = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), whole("role").alias("role"), whole("text").alias("text"))
    ordered = source.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, "conv_id bigint, part bigint, start bigint, ids array<int>, loss_mask array<tinyint>")


def _turns(batch, template: Template):
    """conv_id, ids and mask (arrays) of each turn of a batch whose last columns are ids and loss_mask."""
    ids, masks = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns[-2:])
    ends = np.cumsum(np.asarray(batch.column(batch.num_columns - 2).value_lengths()))
    return zip(*(c.to_pylist() for c in batch.columns[:-2]), np.split(ids, ends[:-1]), np.split(masks, ends[:-1])) if len(batch) else ()


def read_turns(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv_id, part, role, text, unescaped."""
    held = vocabulary_text(formatted.sparkSession, tokenizer_path)

    def run(batches):
        template = _template(tokenizer_path, held)

        def rows():
            for batch in batches:
                for conv, part, ids, _ in _turns(batch, template):
                    role, text, _ = template.parse(ids)
                    yield conv, part, unescape(role), unescape(text)

        return sliced(rows(), _TURNS, lambda r: len(r[3]))

    return formatted.select("conv_id", "part", "ids", "loss_mask").mapInArrow(run, "conv_id bigint, part bigint, role string, text string")


def read_digests(formatted: DataFrame, tokenizer_path: str, arranged: bool = False) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, read from ids and masks.

    arranged: the rows come as format_conversations gives them, so nothing is shuffled again.
    """
    held = vocabulary_text(formatted.sparkSession, tokenizer_path)

    def run(batches):
        template = _template(tokenizer_path, held)

        def rows():
            at = None
            for batch in batches:
                for conv, ids, mask in _turns(batch, template):
                    if at is None or at[0] != conv:
                        if at:
                            yield done(at)
                        at = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    role, text, chars = template.parse(ids)
                    plain = unescape(text)
                    marked = np.flatnonzero(mask)
                    if len(marked) and len(marked) == len(template.text_ids(ids)) and marked[0] == len(ids) - 1 - len(marked) and marked[-1] == len(ids) - 2:
                        loss = plain  # the mask is the text's ids exactly
                    else:
                        loss = unescape(template.decode(ids[marked].tolist()))
                    at[1] += 1
                    at[2].update(f"{unescape(role)}\n{plain}\n".encode())
                    at[3] += len(loss)
                    at[4].update(loss.encode())
                    at[5] += chars
                    at[6] += len(ids)
            if at:
                yield done(at)

        return sliced(rows(), _READ)

    def done(at):
        return [x.hexdigest() if hasattr(x, "hexdigest") else x for x in at]

    ordered = formatted if arranged else formatted.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint"
    return ordered.select("conv_id", "ids", "loss_mask").mapInArrow(run, schema)
