import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from brookline.llm import syncmers
from brookline.llm.syncmers import K, S, compare_edited, fingerprints


def expected(rows, spark):
    """By id, then by Spark's hash of the text."""
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in {t or "" for _, t, *_ in rows}], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    docs = sorted(((d is not None, d or 0, hashes[t or ""], t or "") for d, t, *_ in rows))
    docs = [(known, d, t) for known, d, _, t in docs]
    out = []
    for i, (known, d, t) in enumerate(docs):
        after, cut = docs[(i + 1) % len(docs)][2], len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        out.append((d if known else None, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("a_range", [256, 5])
def test_edits_and_neighbours(spark, docs, rows, monkeypatch, a_range):
    monkeypatch.setattr(syncmers, "ROWS_A_RANGE", a_range)
    monkeypatch.setattr(syncmers, "_SIDE", 3)
    got = compare_edited(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == expected(rows, spark)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    again = {r.doc_id: r.fingerprint for r in fingerprints(docs.filter("doc_id > 7")).collect()}
    assert all(again[r.doc_id] == r.fingerprint for r in got if r.doc_id in again)


def units_of(text):
    """Runs of up to 16 letters with a space before, or single characters."""
    return [x for m in re.findall(r" ?[^\W_]+|[\W_]", text) for x in ([m] if len(m.strip(" ")) <= syncmers.WORD else list(m))]


def brute(spark, text):
    """Anchors by the definition; unit hashes are Spark's."""
    units = units_of(text)
    if not units:
        return ""
    hashed = spark.createDataFrame([(u,) for u in units], "u string").select(F.hash("u")).collect() if units else []
    h = [r[0] for r in hashed]
    pair = spark.createDataFrame([(h[i], h[i + 1]) for i in range(len(h) - 1)], "a int, b int").select(F.hash(F.hash("a"), F.lit(0)), F.hash("a", "b")).collect() if len(h) > 1 else []
    s = [r[1] for r in pair]
    window = K - S + 1
    if len(s) < window:
        return None
    at = [i for i in range(len(s) - window + 1) if min(s[i], s[i + window - 1]) <= min(s[i : i + window])]
    out = []
    for i in at:
        parts = [s[i + j] for j in range(0, window - 1, S)] + [s[i + window - 1]]
        out.append(spark.range(1).select(F.hash(*[F.lit(p).cast("int") for p in parts])).first()[0] & 0xFFFFFF)
    return "".join(f"{a:06x}" for a in out)


def test_closed_syncmers_by_definition(spark):
    text = "The quick brown fox, jumps over the lazy dog 12345 times_and Über alles."
    got = fingerprints(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().fingerprint
    assert got == brute(spark, text) and len(got) >= 6


def test_passages_keep_their_anchors(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(80))
    texts = [(1, passage), (2, " ".join(word() for _ in range(40)) + ". " + passage), (3, passage + " " + " ".join(word() for _ in range(50))), (4, passage), (5, " ".join(word() for _ in range(80)))]
    got = {r.doc_id: r.fingerprint for r in fingerprints(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    cut = lambda f: [f[i : i + 6] for i in range(0, len(f), 6)]
    own = cut(got[1])
    assert got[1] == got[4]
    for other in (2, 3):
        assert len(set(own) & set(cut(got[other]))) >= len(set(own)) - 4
    assert not set(own) & set(cut(got[5]))
    assert 1 / 8 < len(own) / (len(units_of(passage))) < 1 / 2


def test_likeness(docs):
    got = {r.doc_id: r for r in compare_edited(docs.filter("doc_id >= 4").dropDuplicates(["doc_id"])).collect()}
    assert got[4].near_next > 0.95 and got[5].near_next > 0.95
    assert 0.6 < got[4].near_edited <= 1


def test_empty_one_row_and_clashing(spark, none, clashing, rows):
    assert compare_edited(none).count() == 0
    one = compare_edited(spark.createDataFrame([(1, "some words of a text that is alone")], "doc_id bigint, text string")).first()
    assert one.near_next == 1.0
    nothing = compare_edited(spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id bigint, text string"))
    assert {r.doc_id: (r.fingerprint == "", r.near_next) for r in nothing.collect()} == {1: (True, 1.0), 2: (True, 0.0), 3: (False, 0.0)}
    got = compare_edited(clashing).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == expected(rows, spark)


def test_no_python_in_the_plan(docs):
    plan = compare_edited(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop", "SinglePartition"))


def test_every_short_text_has_anchors(spark):
    """8 to 12 units are too few k-mers for one to be sure; 13 are enough."""
    rng = random.Random(9)
    unit = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(3))
    texts = [" ".join(unit() for _ in range(n)) for n in range(1, 15) for _ in range(40)]
    got = fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert all(r.fingerprint for r in got) and len({r.fingerprint for r in got}) == len(set(texts))


def test_short_texts_are_like_their_copies_only(spark):
    rng = random.Random(10)
    unit = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(3))
    base = [[unit() for _ in range(n)] for n in (8, 8, 9, 10, 11, 12) for _ in range(10)]
    rows = [(" ".join(b), " ".join(b[:-1]), " ".join(base[i - 1])) for i, b in enumerate(base)]
    near = lambda a, b: syncmers.likeness(syncmers.anchors(F.col(a)), syncmers.anchors(F.col(b)))
    got = spark.createDataFrame(rows, "own string, shorter string, other string").withColumn("empty", F.lit("")).select(near("own", "shorter"), near("own", "other"), near("own", "own"), near("own", "empty")).collect()
    assert all(r[0] >= 0.5 and r[1] < 0.2 and r[2] == 1.0 and r[3] == 0.0 for r in got)


def plain_likeness(a, b):
    x, y = ({f[i : i + 6] for i in range(0, len(f), 6)} for f in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def test_likeness_is_the_plain_share(spark, docs, rows):
    """near_edited and near_next from the fingerprints of edited and of next texts, counted plainly."""
    got = compare_edited(docs).collect()
    assert all(abs(r.near_edited - plain_likeness(r.fingerprint, r.edited_fingerprint)) < 1e-12 for r in got)
    order = sorted((d, t or "") for d, t, *_ in rows if d is not None and d > 8)
    prints = {r.doc_id: r.fingerprint for r in got}
    near = {r.doc_id: r.near_next for r in got}
    assert all(abs(near[a] - plain_likeness(prints[a], prints[b])) < 1e-12 for (a, _), (b, _) in zip(order, order[1:]))


def test_text_without_spaces_has_no_phase(spark):
    """One character in front moves the anchors at the front alone."""
    rng = random.Random(13)
    base = ["".join(rng.choice(letters) for _ in range(2000)) for letters in ("abcdefghijklmnop", "天地玄黄宇宙洪荒日月盈昃辰宿列張", "กขคงจฉชซญดตถ")]
    frame = spark.createDataFrame([(b, "x" + b, b[:700] + "y" + b[700:]) for b in base], "a string, b string, c string")
    near = lambda x, y: syncmers.likeness(syncmers.anchors(F.col(x)), syncmers.anchors(F.col(y)))
    assert all(x > 0.95 for r in frame.select(near("a", "b"), near("a", "c")).collect() for x in r)


@pytest.mark.parametrize("ident", [None, 5])
def test_a_hot_id_is_dealt_out(spark, monkeypatch, ident):
    """Three quarters of the rows share an id, half of these also the text: ranges stay even and neighbours right."""
    rng = random.Random(14)
    rows = [(ident, "the same text" if i % 2 else "".join(rng.choice("abc ") for _ in range(30))) for i in range(3000)] + [(i, f"text {i}") for i in range(10, 1010)]
    monkeypatch.setattr(syncmers, "ROWS_A_RANGE", 50)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    dealt = syncmers._in_ranges(frame.withColumn("at", syncmers._place(F.col("doc_id"), F.col("text"))), "at").groupBy("range").count().collect()
    assert max(r["count"] for r in dealt) < 350 and sum(r["count"] for r in dealt) < 1.3 * len(rows)
    got = compare_edited(frame).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == expected(rows, spark)


def test_bounds_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "_SIDE", 3)
    bounds = [f"{i:04d}" for i in range(0, 200, 2)]
    got = spark.range(-1, 201).select("id", syncmers._reached(F.lpad(F.col("id").cast("string"), 4, "0"), bounds).alias("n")).filter("id >= 0").collect()
    assert all(r.n == min(100, r.id // 2 + 1) for r in got)
