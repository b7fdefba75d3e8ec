"""Toxicity and language: held-out accuracy, and the odd rows."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from brookline.llm import language, toxicity
from brookline.llm.common import least_hashes

DATA = "/root/testdata/sf0.1"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_machine_learns_an_interaction():
    """Label 1 only where both terms occur: no additive weights can do this without either alone scoring high."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(sorted({11} | ({22} if a else set()) | ({33} if b else set())))
        labels.append(int(a and b))
    offsets = np.cumsum([0] + [len(r) for r in rows])
    machine = toxicity.fit_machine(np.array(labels), offsets, np.concatenate(rows), 1 - np.mean(labels))
    at = {int(t): i for i, t in enumerate(machine.terms)}
    score = lambda *terms: machine.score(np.array([at[t] for t in terms if t in at], int))
    assert score(22, 33) > 0.7 and score(22) < 0.3 and score(33) < 0.3
    v = machine.v
    assert v[at[22]] @ v[at[33]] > 0


def test_machine_without_classes():
    empty = np.zeros(0, np.int64)
    assert toxicity.fit_machine(empty, np.zeros(1, int), empty, 1.0).score(empty) < 1e-6
    one = toxicity.fit_machine(np.ones(3, int), np.array([0, 1, 2, 3]), np.array([1, 2, 3]), 0.0)
    assert one.score(empty) > 0.99


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    n = label.sum()
    return (order[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    known = [(got[i], t) for i, t in zip(*(pq.read_table(f"{DATA}/labels.parquet").column(c).to_pylist() for c in ("doc_id", "toxic")))]
    held = [(r.score, r.predicted, t) for r, t in known if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    score, predicted, toxic = map(np.array, zip(*held))
    assert auc(score, toxic) > 0.95
    assert (predicted[toxic == 0] == 0).mean() > 0.99 and (predicted[toxic == 1] == 1).mean() > 0.8


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    rows, marks = [], []
    for i in range(300):
        toxic = i % 3 == 0
        rows.append((1000 + i, " ".join([word() for _ in range(20)] + ["vile"] * toxic), "en", "s", 0))
        marks.append((1000 + i, int(toxic)))
    return rows, marks + [(1000, None), (None, 1), (99999, 1)]


def test_odd_rows(spark, rows, clashing, none, labelled):
    more, marks = labelled
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    docs = spark.createDataFrame(rows + more, SCHEMA)
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(rows) + len(more)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert np.mean([by[i] == t for i, t in marks if t is not None and i in by]) > 0.98
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.toxicity_scores(none, labels).count() == 0
    assert toxicity.toxicity_scores(clashing, labels.limit(0)).filter("predicted = 1").count() == 0
    machine = toxicity.train_toxicity(docs, labels)
    kept = toxicity.drop_toxic(clashing, labels)
    assert kept.columns == clashing.columns and kept.count() == len(rows)
    assert len(machine.terms) <= toxicity.PLACES
    stay = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert all((i in stay) == (by[i] == 0) for i in by)


def test_sample_is_bounded(spark, labelled):
    more, marks = labelled
    docs, labels = spark.createDataFrame(more, SCHEMA), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    whole, small = toxicity.train_toxicity(docs, labels), toxicity.train_toxicity(docs, labels, most_toxic=20, most_clean=30)
    assert len(small.terms) <= len(whole.terms)


def test_scores_are_the_plain_sums(spark, rows, labelled):
    """Bias, weights and the inner product of every pair of a text's terms, in a plain loop."""
    more, marks = labelled
    docs = spark.createDataFrame(rows + more, SCHEMA)
    machine = toxicity.train_toxicity(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int"))
    row_of = {int(t): i for i, t in enumerate(machine.terms)}

    def plain(text):
        words = {w for w in re.split(r"[\W\d_]+", (text or "").lower()) if w}
        places = {zlib.crc32(w.encode()) % toxicity.PLACES for w in words} | {zlib.crc32(b"^" + w[:n].encode()) % toxicity.PLACES for w in words for n in toxicity.PREFIXES if len(w) >= n}
        own = [row_of[p] for p in places if p in row_of]
        z = machine.bias + sum(machine.w[i] for i in own) + sum(float(machine.v[i] @ machine.v[j]) for i, j in itertools.combinations(own, 2))
        return 1 / (1 + math.exp(-min(40, max(-40, z))))

    got = sorted(r.score for r in toxicity.score_toxicity(docs, machine).collect())
    assert np.allclose(got, sorted(plain(r[1]) for r in rows + more), atol=1e-9)


def test_repeated_ids_do_not_break_the_bounds(spark, labelled, monkeypatch):
    """20,000 rows of one id are one row of the sample, in labels and in documents."""
    more, marks = labelled
    many = spark.range(20_000).selectExpr("1001 as doc_id", "concat('word', id) as text", "'en' as lang", "'s' as source", "0L as n_chars")
    docs = spark.createDataFrame(more, SCHEMA).unionByName(many)
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int").unionByName(many.selectExpr("doc_id", "0 as toxic"))
    seen = []
    monkeypatch.setattr(toxicity, "fit_machine", lambda marks, *a: seen.append(len(marks)))
    toxicity.train_toxicity(docs, labels, most_toxic=50, most_clean=60)
    assert sum(seen) <= 110
    monkeypatch.setattr(language, "fit_machines", lambda langs, rows: seen.append(len(rows)))
    language.train_language(docs.withColumn("doc_id", F.col("doc_id") + 2), per_language=70)
    assert seen[-1] == 70


def test_samples_are_those_of_the_least_hashes(spark):
    rows = spark.range(40_000).selectExpr("id", "if(id % 10 = 0, 'few', 'many') as kind").withColumn("h", F.xxhash64("id"))
    for most in (50, 3_000, 9_000):
        got = {(r.kind, r.id) for r in least_hashes(rows.unionByName(rows), "kind", "id", {"few": most, "many": most}).collect()}
        want = {(k, r.id) for k in ("few", "many") for r in rows.filter(F.col("kind") == k).orderBy("h", "id").limit(most).collect()}
        assert got == want


def test_predictions_are_the_plain_sums(spark, rows):
    """The machines' sums over all n-grams of all words, in a plain loop, and the choice of family and then of language."""
    rng = random.Random(2)
    letters = {"en": "abcd", "de": "abef", "fr": "ghij", "es": "ghkl", "nl": "abmn"}
    some = [(i, " ".join("".join(rng.choice(letters[x]) for _ in range(6)) for _ in range(15)), x, "s", 0) for i in range(300) for x in [rng.choice(list(letters))]]
    machines = language.train_language(spark.createDataFrame(some, SCHEMA))
    got = {r.doc_id: r for r in language.predict_language(spark.createDataFrame(some, SCHEMA), machines).collect()}
    weights = {c: machines.weights[:, i].astype(float) for i, c in enumerate(machines.columns)}
    for doc_id, text, *_ in some:
        sums, n = dict.fromkeys(machines.columns, 0.0), 0
        for word in text.lower().split():
            n += len(word)
            w = f"<{word}>"
            for size in (1, 2, 3, 4):
                for i in range(len(w) - size + 1):
                    for c in sums:
                        sums[c] += weights[c][zlib.crc32(w[i : i + size].encode()) % language.PLACES]
        mean = {c: x / n / 4 for c, x in sums.items()}
        family = max(machines.families, key=lambda f: mean[f, None])
        own = [x for x in machines.languages if language.FAMILIES.get(x, x) == family]
        won = lambda x, y: mean[x, y] > 0 if (x, y) in mean else -mean[y, x] > 0
        margin = lambda x: sum(mean[x, y] if (x, y) in mean else -mean[y, x] for y in own if y != x)
        best = max(own, key=lambda x: (sum(won(x, y) for y in own if y != x), margin(x), x))
        assert got[doc_id].lang_pred == best


def test_small_tables_and_long_texts_give_the_same(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, SCHEMA)
    machines = language.train_language(docs)
    whole = sorted(map(repr, language.predict_language(docs, machines).collect()))
    monkeypatch.setattr(language, "PART", 7)
    words = language.Words(machines, memo_bytes=250 * 20)
    for _, text, *_ in rows:
        found = [w for w in language.words_of(text or "") if len(w) <= language.LONG]
        if found:
            z, n = words.sums_of_all(found)
            once = language.Words(machines)
            once.learn(set(found))
            other, letters = once.sums(found)
            assert np.allclose(z, other, atol=1e-3) and n == letters
    assert len(words.rows) <= 20 and whole


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = dict(zip(*(pq.read_table(f"{DATA}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "lang"))))
    got = language.language_predictions(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [truth[r.doc_id] == r.lang_pred for r in got if r.held_out]
    assert np.mean(held) > 0.98


def test_language_odd_rows(spark, rows, clashing, none):
    got = language.language_predictions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 10))
    assert all(r.lang_pred in ("en", "de", "fr", "es", "und") for r in got)
    assert by[4].lang_pred != "und" and by[8].lang_pred != "und"
    assert language.language_predictions(none).count() == 0
    assert language.language_predictions(clashing).columns == ["doc_id", "held_out", "lang_pred", "score"]
    one = spark.createDataFrame([(0, "abc", "en", "s", 3), (1, "abd", "en", "s", 3), (2, "5", "en", "s", 1), (3, None, "en", "s", 1)], SCHEMA)
    assert {r.doc_id: r.lang_pred for r in language.language_predictions(one).collect()} == {0: "en", 1: "en", 2: "und", 3: "und"}
    unknown = language.language_predictions(one.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in unknown.collect()} == {"und"}


def test_many_languages_and_families(spark):
    rng = random.Random(2)
    letters = {"en": "abcd", "de": "abef", "fr": "ghij", "es": "ghkl", "xx": "mnop"}
    rows = [(i, " ".join("".join(rng.choice(letters[x]) for _ in range(6)) for _ in range(15)), x, "s", 0) for i in range(400) for x in [rng.choice(list(letters))]]
    docs = spark.createDataFrame(rows, SCHEMA)
    machines = language.train_language(docs)
    assert set(machines.families) == {"germanic", "romance", "xx"} and ("de", "en") in machines.columns
    got = {r.doc_id: r.lang_pred for r in language.predict_language(docs, machines).collect()}
    assert np.mean([got[r[0]] == r[2] for r in rows]) > 0.97


def test_runs_of_letters_count_whole(spark, monkeypatch):
    """Text without spaces: the middle decides, though it begins and ends in the other language."""
    rng = random.Random(4)
    letters = {"aa": "abcd", "bb": "efgh"}
    run = lambda x, n: "".join(rng.choice(letters[x]) for _ in range(n))
    rows = [(i, run(x, 60), x, "s", 0) for i in range(200) for x in [rng.choice(list(letters))]]
    machines = language.train_language(spark.createDataFrame(rows, SCHEMA))
    mixed = [(0, run("aa", 40) + run("bb", 600) + run("aa", 40), None, "s", 0), (1, run("bb", 40) + run("aa", 9000) + run("bb", 40), None, "s", 0), (2, run("aa", 30) + " " + run("bb", 300), None, "s", 0)]
    got = {r.doc_id: r for r in language.predict_language(spark.createDataFrame(mixed, SCHEMA), machines).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["bb", "aa", "bb"]
    for doc_id, text, *_ in mixed:
        z = np.zeros(len(machines.columns))
        for w in text.split():
            w = f"<{w}>"
            for i in range(len(w)):
                for n in range(1, min(4, len(w) - i) + 1):
                    z += machines.weights[zlib.crc32(w[i : i + n].encode()) % language.PLACES]
        want = machines.decide(z / len(text.replace(" ", "")) / 4)
        assert got[doc_id].lang_pred == want[0] and abs(got[doc_id].score - want[1]) < 1e-5
    monkeypatch.setattr(language, "SLICE", 7)
    assert sum(language.place_slices(mixed[0][1]), []) == language.word_places(mixed[0][1])


def test_training_reads_whole_runs():
    import pyarrow as pa

    text = "".join(random.Random(5).choices("abcdefghijkl", k=9000))
    [batch] = language._featured([pa.record_batch({"lang": ["x"], "text": [text]})])
    w = f"<{text}>"
    want = {zlib.crc32(w[i : i + n].encode()) % language.PLACES for i in range(len(w)) for n in (1, 2, 3, 4) if i + n <= len(w)}
    assert set(batch.column(1)[0].as_py()) == want
