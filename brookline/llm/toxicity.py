"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and their prefixes, hashed to 2**20 places. The score of a text is the
logistic of  bias + sum of weights + sum over pairs of terms of the inner product of their factors:  the pairwise part
sees an insult together with a mention, which additive weights miss. Terms enter once however often they occur, so
long texts aren't scored by their length.

The model is fitted on the driver from a sample of labelled rows, bounded by MOST_TOXIC and MOST_CLEAN (those with the
least hash of doc_id, one text for each id); terms that do not tell the classes apart in it (a G-test) get no weight.
Clean rows weigh as in all labels, so the prior is kept.

Scale: scoring is a map without shuffle; the model has a row for each term that tells the classes apart, at most
PLACES, and is broadcast; a worker's memo is bounded in bytes. The sample's ids, at most MOST_TOXIC + MOST_CLEAN, are
broadcast to find its texts.

Defined results: null and empty texts have no terms and score the bias; rows without label, or with a null one, are
not learned from; an id with labels of both classes counts as toxic; of several texts of one id the one of the least
hash is learned from; with no labelled row of one of the classes every score is the share of toxic labels (0 if none);
null doc_id is not held out and not learned from; an empty table gives an empty result; texts of any length are read
whole; repeated rows each have a row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, least_hashes, portions, sliced, whole, worker_state

PLACES = 1 << 20
PREFIXES = (4, 5, 6)
FACTORS = 8
MOST_TOXIC, MOST_CLEAN = 3000, 6000
MEMO_BYTES = 64 << 20
#: Least G statistic of a term.
LEAST_G = 12.0
EPOCHS = 30
FOLDS = 5
_WORD = re.compile(r"[^\W\d_]+")
_TERMS = pa.schema([("toxic", pa.int32()), ("terms", pa.list_(pa.int32()))])
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def word_terms(word: str) -> tuple[int, ...]:
    found = [zlib.crc32(word.encode()) % PLACES]
    found += [zlib.crc32(b"^" + word[:n].encode()) % PLACES for n in PREFIXES if len(word) >= n]
    return tuple(found)


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Machine:
    """terms: sorted places with weights w and factors v."""

    terms: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, at: np.ndarray) -> float:
        """at: rows of the terms in w and v."""
        z = self.bias
        if len(at):
            v = self.v[at]
            s = v.sum(axis=0)
            z += self.w[at].sum() + 0.5 * float((s * s - (v * v).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit_machine(labels: np.ndarray, offsets: np.ndarray, places: np.ndarray, clean_share: float, seed: int = 0) -> Machine:
    """labels 0/1 by row; places[offsets[i]:offsets[i+1]] are the row's terms. clean_share: of all labels."""
    n, toxic = len(labels), labels == 1
    none = Machine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    prior = np.clip(1 - clean_share, 1e-9, 1 - 1e-9) if n else 1e-9
    none.bias = float(np.log(prior / (1 - prior)))
    if not toxic.any() or toxic.all():
        return none
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    t, f = toxic.sum(), n - toxic.sum()
    a = np.bincount(places[toxic[row_of]], minlength=PLACES).astype(float)
    b = np.bincount(places[~toxic[row_of]], minlength=PLACES).astype(float)
    share = (a + b) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda o, e: np.where(o > 0, o * np.log(o / e), 0.0)
        g = 2 * (part(a, t * share) + part(b, f * share) + part(t - a, t * (1 - share)) + part(f - b, f * (1 - share)))
    kept = np.flatnonzero(np.nan_to_num(g) >= LEAST_G)
    at = np.searchsorted(kept, places)
    there = (at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == places) if len(kept) else np.zeros(len(places), bool)
    at, row_of = at[there], row_of[there]
    starts = np.searchsorted(row_of, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), FACTORS))
    weight = np.where(toxic, prior / (t / n), (1 - prior) / (f / n))
    bias, gb, gw, gv = none.bias, 1e-8, np.full(len(kept), 1e-8), np.full((len(kept), FACTORS), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for group in np.array_split(order, max(1, n // 64)):
            rows = [at[starts[i] : starts[i + 1]] for i in group]
            terms, of = np.concatenate(rows), np.repeat(np.arange(len(group)), [len(r) for r in rows])
            x, s = v[terms], np.zeros((len(group), FACTORS))
            np.add.at(s, of, x)
            z = bias + np.bincount(of, w[terms], len(group)) + 0.5 * ((s * s).sum(1) - np.bincount(of, (x * x).sum(1), len(group)))
            miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic[group]) * weight[group] / len(group)
            d = miss.sum()
            gb += d * d
            bias -= 0.2 * d / np.sqrt(gb)
            dw, dv = np.zeros(len(kept)), np.zeros((len(kept), FACTORS))
            np.add.at(dw, terms, miss[of])
            np.add.at(dv, terms, miss[of, None] * (s[of] - x))
            own = np.unique(terms)
            dw, dv = dw[own] + 1e-6 * w[own], dv[own] + 1e-5 * v[own]
            gw[own] += dw * dw
            gv[own] += dv * dv
            w[own] -= 0.3 * dw / np.sqrt(gw[own])
            v[own] -= 0.05 * dv / np.sqrt(gv[own])
    return Machine(kept, bias, w, v)


def held_out(id_col: str = "doc_id", folds: int = FOLDS, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def _featured(batches):
    def rows():
        for batch in batches:
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
                yield toxic, sorted({t for w in words_of(text) for t in word_terms(w)})

    return sliced(rows(), _TERMS, lambda r: 8 * len(r[1]))


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Machine:
    """A machine from the labelled rows that are not held out; labels has doc_id and toxic."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).filter(F.col("__toxic").isin(0, 1) & F.col("__id").isNotNull() & ~held_out("__id"))
    known = known.groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    counts = dict(known.groupBy("__toxic").count().collect())
    sample = least_hashes(known, "__toxic", "__id", {1: most_toxic, 0: most_clean})
    texts = docs.select(F.col(id_col).cast("bigint").alias("__id"), whole(text_col).alias("__text")).join(F.broadcast(sample), "__id")  # bounded by the two limits
    rows = texts.groupBy("__id", "__toxic").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    table = rows.select("__toxic", "__text").mapInArrow(_featured, "toxic int, terms array<int>").toArrow().combine_chunks()
    terms = table.column("terms").combine_chunks()
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.chunk(0) if terms.num_chunks else pa.array([], pa.list_(pa.int32()))
    offsets, places = np.asarray(terms.offsets), np.asarray(terms.values)
    if not len(offsets):
        offsets = np.zeros(1, np.int32)
    total = sum(counts.values())
    return fit_machine(np.asarray(table.column("toxic")), offsets - offsets[0], places[offsets[0] : offsets[-1]], counts.get(0, 0) / total if total else 1.0)


def _scored(key: str, held):
    def run(batches):
        machine = held.value
        memo, row_of = worker_state(("toxicity", key), lambda: (Memo(MEMO_BYTES), {int(t): i for i, t in enumerate(machine.terms)}))

        def rows():
            for ids, texts in portions(batches, 1 << 20):
                for doc_id, text in zip(ids, texts):
                    words = words_of(text)
                    new = memo.missing(words)
                    memo.add(new, [tuple(row_of[t] for t in word_terms(w) if t in row_of) for w in new])
                    found = {t for x in map(memo.__getitem__, words) if x for t in x}
                    yield doc_id, machine.score(np.array(sorted(found), np.int64))

        return sliced(rows(), _SCORES)

    return run


def score_toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, one row per input row."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).alias("text"))
    return source.mapInArrow(_scored(f"{id(held)}-{hash((machine.bias, machine.w.tobytes()))}", held), "doc_id bigint, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, with a machine trained on the rows that are not held out."""
    scored = score_toxicity(docs, train_toxicity(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the rows whose text scores least or more; all columns stay, and nothing is shuffled."""
    machine = train_toxicity(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(machine)
    columns = docs.columns
    text_at = columns.index("text")
    run_scores = _scored(f"{id(held)}-{hash((machine.bias, machine.w.tobytes()))}", held)

    def run(batches):
        for batch in batches:
            texts = batch.column(text_at)
            texts = texts.fill_null("") if texts.null_count else texts
            pairs = pa.RecordBatch.from_arrays([pa.array(range(len(batch)), pa.int64()), texts], names=["doc_id", "text"])
            kept = [i for b in run_scores(iter([pairs])) for i, s in zip(*(c.to_pylist() for c in b.columns)) if s < least]
            if kept:
                yield batch.take(pa.array(kept, pa.int64()))

    return docs.mapInArrow(run, docs.schema)
