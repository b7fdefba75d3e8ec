"""Language identification in two steps: the family first, then one language of it.

A text is the sum of its words' character n-grams (with word edges), hashed to 2**15 places; directions, not lengths,
are compared, so a long text needs no more care than a short one. A linear support vector machine per family picks the
family; within it one machine for each pair of languages votes, and margins break ties. Since everything is linear,
a word's contribution to every machine is worked out once and kept in a bounded memo. A run of more than LONG letters
(text without spaces) is counted whole as well, in slices of SLICE places for the n-grams that end there, and is not
kept in the memo.

Machines are fitted on the driver from a sample of at most PER_LANGUAGE ids of each language (those of least hash, one
text for each).

Scale: a map without shuffle; the machines (2**15 numbers each) are broadcast; the ids of the sample, bounded by
PER_LANGUAGE times the number of languages, are broadcast to find its texts; a worker's memo and its table of the
words' contributions are bounded in bytes whatever the number of machines.

Defined results: null texts and texts without a letter are "und" with score 0; null lang is not learned from; of
several texts of one id and language the one of the least hash is learned from; with no row to learn from everything is
"und"; with one language every text with a letter is of it; a null doc_id is not held out and not learned from; an
empty table gives an empty result; texts of any length are read whole, PART words at a time, and their words' sums
added; repeated rows each have a row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashes, portions, sliced, worker_state

PLACES = 1 << 15
PER_LANGUAGE = 600
#: Bytes of the memo of words and of the table beside it, and words of a text that are looked up at a time.
MEMO_BYTES, TABLE_BYTES, PART = 96 << 20, 64 << 20, 100_000
MOST_GRAMS = 300_000
#: Letters of the longest word that the memo holds, and letters of a slice of longer ones.
LONG, SLICE = 80, 4096
EPOCHS = 8
FOLDS, FOLD = 3, 1
UNKNOWN = "und"
#: Families by two-letter code; a language that isn't here is a family of its own.
FAMILIES = {c: f for f, codes in {
    "germanic": "en de nl af sv da no nb nn is fy lb yi", "romance": "fr es it pt ro ca gl oc", "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv", "celtic": "ga gd cy br", "uralic": "fi et hu", "turkic": "tr az kk ky uz tk", "indic": "hi bn mr gu pa ne ur si", "dravidian": "ta te kn ml",
    "semitic": "ar he mt am", "iranian": "fa ps ku tg", "malayic": "id ms jv su tl", "sinitic": "zh", "japonic": "ja", "koreanic": "ko", "hellenic": "el",
}.items() for c in codes.split()}
_WORD = re.compile(r"[^\W\d_]+")
_SAMPLE = pa.schema([("lang", pa.string()), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.float32()))])
_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


class Grams(dict):
    """Places of n-grams, kept while they are not too many."""

    def __missing__(self, gram: str) -> int:
        if len(self) > MOST_GRAMS:
            self.clear()
        place = self[gram] = zlib.crc32(gram.encode()) % PLACES
        return place


def word_places(word: str, grams: Grams | None = None) -> list[int]:
    """Places of a word's n-grams of 1 to 4 letters."""
    w = f"<{word}>"
    grams, ends = Grams() if grams is None else grams, range(1, len(w) + 1)
    return [grams[w[i - n : i]] for i in ends for n in (1, 2, 3, 4) if n <= i]


def place_slices(word: str, grams: Grams | None = None):
    """The same by slices; n-grams belong to the slice in which they end."""
    w = f"<{word}>"
    grams = Grams() if grams is None else grams
    for at in range(0, len(w), SLICE):
        ends = range(at + 1, min(at + SLICE, len(w)) + 1)
        yield [grams[w[i - n : i]] for i in ends for n in (1, 2, 3, 4) if n <= i]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Machines:
    """names: for each column of weights what it decides: a family (family, None) or a pair (first, second)."""

    languages: list[str]
    families: list[str]
    columns: list[tuple]
    weights: np.ndarray

    def decide(self, z: np.ndarray) -> tuple[str, float]:
        """Language and certainty for the mean contributions of a text's words."""
        sure = 1.0
        family = self.families[0]
        if len(self.families) > 1:
            at = [self.columns.index((f, None)) for f in self.families]
            best = int(np.argmax(z[at]))
            family, sure = self.families[best], float(1 / (1 + np.exp(-8 * z[at[best]])))
        own = [x for x in self.languages if FAMILIES.get(x, x) == family]
        votes = {x: [0, 0.0, 1.0] for x in own}
        for a, b in combinations(own, 2):
            m = float(z[self.columns.index((a, b))])
            p = float(1 / (1 + np.exp(-8 * m)))
            for x, s, q in ((a, m, p), (b, -m, 1 - p)):
                votes[x] = [votes[x][0] + (s > 0), votes[x][1] + s, min(votes[x][2], q)]
        winner = max(own, key=lambda x: (votes[x][0], votes[x][1], x))
        return winner, sure * votes[winner][2]


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, seed: int = 0, reg: float = 1e-4) -> np.ndarray:
    """Weights of a linear support vector machine without bias, by stochastic subgradients; the last half is averaged."""
    rng = np.random.default_rng(seed)
    w, scale, total, taken, t = np.zeros(PLACES), 1.0, np.zeros(PLACES), 0, 0
    share = {s: 0.5 / max(1, (sign == s).sum()) * len(sign) for s in (1, -1)}
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            t += 1
            rate = 1 / (reg * (t + 1000))
            at, x = rows[i]
            margin = sign[i] * scale * (w[at] @ x)
            scale *= 1 - rate * reg
            if margin < 1:
                w[at] += rate * share[sign[i]] * sign[i] / scale * x
        if epoch >= EPOCHS // 2:
            total, taken = total + scale * w, taken + 1
    return total / taken


def fit_machines(langs: list[str], rows: list[tuple[np.ndarray, np.ndarray]]) -> Machines:
    languages = sorted(set(langs))
    family = np.array([FAMILIES.get(x, x) for x in langs])
    families, langs_ = sorted(set(family)), np.array(langs)
    columns, weights = [], []
    if len(families) > 1:
        for f in families:
            columns.append((f, None))
            weights.append(_svm(rows, np.where(family == f, 1, -1)))
    for f in families:
        for a, b in combinations([x for x in languages if FAMILIES.get(x, x) == f], 2):
            own = np.flatnonzero((langs_ == a) | (langs_ == b))
            columns.append((a, b))
            weights.append(_svm([rows[i] for i in own], np.where(langs_[own] == a, 1, -1)))
    return Machines(languages, [str(f) for f in families], columns, np.array(weights, np.float32).reshape(len(columns), PLACES).T)


def _featured(batches):
    grams = Grams()

    def rows():
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.zeros(PLACES)
                for w in words_of(text):
                    for places in place_slices(w, grams):
                        np.add.at(counts, places, 1)
                at = np.flatnonzero(counts)
                if len(at):
                    yield lang, at.tolist(), (counts[at] / np.linalg.norm(counts)).tolist()

    return sliced(rows(), _SAMPLE, lambda r: 12 * len(r[1]))


def held_out(id_col: str = "doc_id", folds: int = FOLDS, fold: int = FOLD) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def train_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Machines:
    known = docs.select(F.col("doc_id").cast("bigint").alias("__id"), F.col("lang").alias("__lang"), F.col("text").alias("__text")).filter(F.col("__lang").isNotNull() & F.col("__text").isNotNull() & F.col("__id").isNotNull() & ~held_out("__id"))
    sample = least_hashes(known, "__lang", "__id", per_language)  # per_language ids of each language
    texts = known.join(F.broadcast(sample), ["__id", "__lang"]).groupBy("__id", "__lang").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    table = texts.select("__lang", "__text").mapInArrow(_featured, "lang string, places array<int>, counts array<float>").toArrow()
    langs, rows = [], []
    for batch in table.to_batches():
        langs += batch.column(0).to_pylist()
        rows += [(np.asarray(p.values), np.asarray(c.values, dtype=np.float64)) for p, c in zip(batch.column(1), batch.column(2))]
    return fit_machines(langs, rows)


class Words:
    """What words contribute to every machine: a bounded table of rows, and a memo of their places in it."""

    def __init__(self, machines: Machines, memo_bytes: int = MEMO_BYTES, table_bytes: int = TABLE_BYTES):
        self.machines, self.most = machines, max(1, min(memo_bytes // 250, table_bytes // (4 * max(1, len(machines.columns)))))
        self.rows: dict[str, int] = {}
        self.grams = Grams()
        self.table = np.zeros((0, len(machines.columns)), np.float32)

    def learn(self, words: set[str]) -> None:
        """Makes room for the words, of which there may be more than the table holds otherwise, and adds those that are new."""
        new = [w for w in words if w not in self.rows]
        if not new:
            return
        if self.rows and len(self.rows) + len(new) > self.most:
            self.rows, new = {}, list(words)
        first, end = len(self.rows), len(self.rows) + len(new)
        if end > len(self.table):
            grown = np.zeros((max(end, min(self.most, 2 * end)), self.table.shape[1]), np.float32)
            grown[:first] = self.table[:first]
            self.table = grown
        places = [word_places(w, self.grams) for w in new]
        starts = np.cumsum([0] + [len(p) for p in places[:-1]])
        self.table[first:end] = np.add.reduceat(self.machines.weights[np.fromiter(chain.from_iterable(places), np.int64)], starts, axis=0)
        self.rows.update(zip(new, range(first, end)))

    def sums(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Sum of the rows of words that are known, and their letters."""
        rows = self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]
        return rows.sum(axis=0, dtype=np.float64), sum(map(len, words))

    def sums_of_all(self, words: list[str]) -> tuple[np.ndarray, int]:
        """The same of any words, PART at a time."""
        z, n = np.zeros(self.table.shape[1]), 0
        for part in (words[i : i + PART] for i in range(0, len(words), PART)):
            self.learn(set(part))
            more, letters = self.sums(part)
            z, n = z + more, n + letters
        return z, n

    def sums_of_long(self, words: list[str]) -> tuple[np.ndarray, int]:
        """The same of words that the table doesn't hold."""
        z = np.zeros(self.table.shape[1])
        for w in words:
            for places in place_slices(w, self.grams):
                z += self.machines.weights[places].sum(axis=0, dtype=np.float64)
        return z, sum(map(len, words))


def _predicted(key: str, held):
    def run(batches):
        machines: Machines = held.value
        table: Words = worker_state(("language", key), lambda: Words(machines))

        def rows():
            for ids, texts in portions(batches, 1 << 20):
                known = [t is not None and bool(machines.languages) and has_letter(t) for t in texts]
                words = [words_of(t) if k else [] for t, k in zip(texts, known)]
                runs: dict[int, list[str]] = {}
                for i, w in enumerate(words):
                    if w and max(map(len, w)) > LONG:
                        runs[i] = [x for x in w if len(x) > LONG]
                        words[i] = [x for x in w if len(x) <= LONG]
                together = sum(map(len, words)) <= 2 * PART  # else the portion is one long text
                if together:
                    table.learn(set().union(*words))
                for i, (doc_id, k, w) in enumerate(zip(ids, known, words)):
                    if k:
                        z, n = table.sums(w) if together else table.sums_of_all(w)
                        if i in runs:
                            more, letters = table.sums_of_long(runs[i])
                            z, n = z + more, n + letters
                        yield doc_id, *machines.decide(z / max(1, n) / 4)
                    else:
                        yield doc_id, UNKNOWN, 0.0

        return sliced(rows(), _OUT)

    return run


def predict_language(docs: DataFrame, machines: Machines, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(machines)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_predicted(f"{id(held)}-{hash(machines.weights.tobytes())}", held), "doc_id bigint, lang_pred string, score double")


def language_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, with machines trained on the rows that are not held out."""
    predicted = predict_language(docs, train_language(docs))
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
