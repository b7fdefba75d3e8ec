"""Cuts texts at places where a tokenizer always cuts, so that each distinct unit is encoded once a worker.

A single space between two characters that are no white space starts a new piece in byte-level BPE (the space belongs
to what follows), and white space is dropped in the lower-case word BPE. Units between such places are looked up in a
memo of bounded bytes; only units not met before go to the encoder. Texts without such places are cut where a letter,
a number or a mark of another kind meets another kind: pieces hold one kind only. A single piece that is longer than
LONG_PIECE has no safe place at all, and is encoded by itself.
"""

from __future__ import annotations

import os
import re
import unicodedata

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import regex

from .common import Memo

#: Bytes of the memos: of units of byte-level BPE (of other pieces a quarter), and of words.
MEMO_UNITS, MEMO_WORDS = 192 << 20, 224 << 20
#: A batch of new units ends at so many bytes.
BATCH_BYTES = 1 << 20
#: Characters of a text that are cut into units at a time.
SLICE = 1 << 20
#: Units of more characters are cut where kinds meet, and pieces of more are encoded by themselves.
LONG_UNIT, LONG_PIECE = 4096, 1 << 16

_BYTE_SPLIT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = re.compile(" ")
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Letters whose class no version of Unicode changes.
_PLAIN = re.compile(r"[\x00-ɏ]*\Z")
_RUN = re.compile(r"[,.](?:(?<=[^\s\w].)|(?<=_.))")
_TWO_PIECES = re.compile(r"([a-zß-öø-ÿ]+)([!\"#$%&()*+,\-./:;=?@\[\]^`{}~]+)")
_WORD_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]{1,200})([!\"#$%&()*+,\-./:;=?@\[\]^_`{}~]{0,50})")
_ONE_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[!\"#$%&()*+,\-./:;=?@\[\]^`{}~]+")


class _Kinds(dict):
    """L, N or O (other) of a character that all versions of Unicode put there, and that neither normalization nor lower case turns into more or another kind; else ?."""

    def __missing__(self, c: int) -> str:
        if len(self) > 100_000:
            self.clear()
        char = chr(c)
        low = unicodedata.normalize("NFC", char).lower()
        kinds = {unicodedata.category(x)[0] for x in (char, low[0])} | {unicodedata.ucd_3_2_0.category(char)[0]}
        kind = self[c] = {"L": "L", "N": "N", "P": "O", "S": "O"}.get(kinds.pop(), "?") if len(kinds) == len(low) == 1 and char not in "'<|>" else "?"
        return kind


_kinds = _Kinds()
_MEET = re.compile("(?<=L)(?=[NO])|(?<=N)(?=[LO])|(?<=O)(?=[LN])")


def safe_parts(unit: str, most: int = LONG_UNIT) -> list[str]:
    """The unit in parts of most characters, or as few more as it takes to end where kinds meet."""
    if len(unit) <= most:
        return [unit]
    parts, at = [], 0
    while at < len(unit):
        end, look = None, at + most
        while end is None and look < len(unit):  # kinds of a window at a time
            window = unit[look - 1 : look + LONG_PIECE]
            found = _MEET.search(window.translate(_kinds), 1)
            end = look - 1 + found.start() if found else None
            look += LONG_PIECE
        parts.append(unit[at : end or len(unit)])
        at = end or len(unit)
    return parts


def byte_units(text: str) -> list[str]:
    """Units of byte-level BPE; all but the first have lost one leading space."""
    return _BYTE_SPLIT.split(text)


def slices(text: str, border: re.Pattern = _BYTE_SPLIT, most: int | None = None):
    """The text in slices that end where a unit does; the space in between is left out."""
    at = 0
    while (found := border.search(text, at + (most or SLICE))) is not None:
        yield text[at : found.start()]
        at = found.end()
    yield text[at:] if at else text


def word_units(text: str) -> list[str]:
    """Units of a lower-casing BPE that drops white space."""
    text = text.replace("\n", " ")
    if "<|" not in text and (text.isascii() or _PLAIN.match(text) and "\u0130" not in text):
        text = text.lower()  # as the tokenizer would, and no special string is made or unmade
        if not _RUN.search(text):
            text = text.replace(", ", " , ").replace(". ", " . ")  # pieces of their own
    return text.split(" ")


def by_bytes(units: list[str], most: int = BATCH_BYTES):
    """Lists of units of about equal bytes."""
    held, size = [], 0
    for u in units:
        held.append(u)
        size += len(u) if u.isascii() else len(u.encode())
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


class ByteUnits:
    """Values of the units of byte-level BPE.

    encode maps a list of strings to values; size gives the bytes of values. single encodes one piece of more than
    LONG_PIECE characters. special: strings that are tokens wherever they stand.
    """

    def __init__(self, encode, join, size, single, special: tuple[str, ...] = (), pieces: bool = False):
        self.encode, self.join, self.size, self.single, self.pieces_only = encode, join, size, single, pieces
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.units, self.pieces = Memo(MEMO_UNITS), Memo(MEMO_UNITS // 4)

    def each(self, texts: list[str]) -> list:
        """The value of each text."""
        cut = [byte_units(t) if len(t) <= SLICE else None for t in texts]
        short, memo = [c for c in cut if c], self.units
        memo.renew()
        heads, _ = self.learn({c[0] for c in short}, {u for c in short for u in c[1:] if u not in memo})
        done = [self.join([heads[c[0]], *map(memo.__getitem__, c[1:])]) if c else None for c in cut]
        return [d if c else self.long_text(t) for c, d, t in zip(cut, done, texts)]

    def long_text(self, text: str):
        found = []
        for k, part in enumerate(slices(text)):
            first, *rest = byte_units(part)
            self.units.renew()
            heads, memo = self.learn(set() if k else {first}, {first, *rest} if k else set(rest))
            found.append(self.join([memo[first] if k else heads[first], *map(memo.__getitem__, rest)]))
        return self.join(found)

    def learn(self, heads: set[str], rest: set[str]) -> tuple[dict, Memo]:
        """Values of the first units of texts, and of all other units without their space; the memo has been renewed.

        Most units are a word, or a word and marks: two pieces. A word's value is that of the unit that it is, so words
        are encoded once, whatever marks follow.
        """
        memo = self.units
        new, marked, other = memo.lacking(rest), [], []
        words = []
        for u in new:
            m = _WORD_MARKS.fullmatch(u)
            if m is None:
                other.append(u)
            elif m[2]:
                marked.append((u, m[1], m[2]))
            else:
                words.append(u)
        known = set(words)
        words += memo.lacking({w for _, w, _ in marked if w not in known})
        for group in by_bytes(words):
            values = self.encode([" " + w for w in group])
            memo.add(group, values, self.size(values))
        first, value = list(heads), self.pieces
        cut = [self.cut(u) for u in first] + [self.cut(" " + u) for u in other]
        wanted = value.missing({p for c in cut for p in c}.union(p for _, _, p in marked))
        for group in by_bytes([p for p in wanted if len(p) <= LONG_PIECE]):
            values = self.encode(group)
            self.pieces.add(group, values, self.size(values))
        for p in wanted:
            if len(p) > LONG_PIECE:
                self.pieces.add([p], [self.single(p)])
        done = [self.join([value[p] for p in c]) if len(c) != 1 else value[c[0]] for c in cut]
        memo.add(other, done[len(first) :], self.size(done[len(first) :]))
        both = [self.join((memo[w], value[p])) for _, w, p in marked]
        memo.add([u for u, _, _ in marked], both, self.size(both))
        return dict(zip(first, done)), memo

    def cut(self, unit: str) -> list[str]:
        """Strings whose values, joined, are the unit's."""
        if self.special and self.special.search(unit):
            return [p for k, part in enumerate(self.special.split(unit)) for p in ([part] if k % 2 else self.cut(part) if part else [])]
        if self.pieces_only or _PLAIN.match(unit):
            return PIECES.findall(unit)
        return [p for part in safe_parts(unit) for p in ([part] if len(part) <= LONG_PIECE else PIECES.findall(part))]


class WordUnits:
    """Values of the units of the word BPE, as bytes of ids.

    A unit of letters and then punctuation is two pieces. Pieces of one kind are encoded many in one text: each ends
    in a token that carries the word end, so the ids of the text fall apart into those of its pieces.
    """

    def __init__(self, encode, ends: np.ndarray, code: str):
        self.encode, self.ends, self.code, self.units = encode, ends, code, Memo(MEMO_WORDS)

    def each(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        cut = [word_units(t) if len(t) <= SLICE else None for t in texts]
        memo = self.units
        memo.renew()
        self.learn({u for c in cut if c for u in c if u not in memo})
        done = [b"".join(map(memo.__getitem__, c)) if c else None for c in cut]
        return [d if c else self.long_text(t) for c, d, t in zip(cut, done, texts)]

    def long_text(self, text: str) -> bytes:
        found = []
        for part in slices(text, _SPACE):
            units = word_units(part)
            self.units.renew()
            found.append(b"".join(map(self.learn(set(units)).__getitem__, units)))
        return b"".join(found)

    def learn(self, units: set[str]) -> Memo:
        """The memo, renewed before, with the values of these units."""
        memo = self.units
        new = memo.lacking(units)
        if not new:
            return memo
        split = {u: m.groups() for u in new if (m := _TWO_PIECES.fullmatch(u))}
        plain, other = set(), []
        for u in new:
            if u not in split:
                plain.add(u) if _ONE_PIECE.fullmatch(u) else other.append(u)
        plain.update(memo.lacking({p for pair in split.values() for p in pair}))
        size = np.dtype(self.code).itemsize
        for group in by_bytes(list(plain)):
            (ids,) = self.encode([" ".join(group)])
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group):
                raise ValueError("the tokenizer's pieces do not end in word ends")
            packed, cuts = np.asarray(ids, self.code).tobytes(), (size * cuts).tolist()
            memo.add(group, (packed[a:b] for a, b in zip([0, *cuts], cuts)), len(packed))
        parts = {u: safe_parts(u) for u in other if len(u) > LONG_UNIT and "<|" not in u}
        for group in by_bytes([u for u in other if u not in parts]):
            memo.add(group, [np.asarray(ids, self.code).tobytes() for ids in self.encode(group)], 40 * len(group))
        for u, own in parts.items():
            memo.add([u], [b"".join(np.asarray(ids, self.code).tobytes() for group in by_bytes(own) for ids in self.encode(group))])
        memo.add(list(split), [memo[a] + memo[b] for a, b in split.values()], 16 * len(split))
        return memo
