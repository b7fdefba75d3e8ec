import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from brookline.llm import shingles

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def slow(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def kept_ids(rows):
    """Smallest id of each component of all pairs of similarity 0.8 or more."""
    sets, parent = [slow(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        k = root(i)
        least[k] = min(least.get(k, (True, 0)), (r[0] is None, r[0] or 0))
    return sorted((None if none else d for none, d in least.values()), key=repr)


def edited_rows():
    """Texts with copies of which some words are replaced, from a few to too many."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(40, 160))]
        rows.append((len(rows), " ".join(base), "en", "a", 0))
        for share in (0.01, 0.02, 0.03, 0.06):
            copy = list(base)
            for i in rng.sample(range(len(copy)), max(1, int(share * len(copy)))):
                copy[i] = word()
            rows.append((len(rows), " ".join(copy), "en", "a", 0))
    return rows


@pytest.mark.parametrize("group", [None, 600])
def test_stage_against_all_pairs(spark, rows, group, monkeypatch):
    """With the small group, groups are dealt out in tiles."""
    if group:
        monkeypatch.setattr(shingles.drop_similar, "__defaults__", (*shingles.drop_similar.__defaults__[:-1], group))
    every = edited_rows() + [(None if d is None else d + 1000, *rest) for d, *rest in rows]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(every, SCHEMA).repartition(3), "")
    assert got.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    assert sorted((r.doc_id for r in got.collect()), key=repr) == kept_ids(every)


def test_shingles_over_chunks(monkeypatch):
    text = " ".join(f"Word{i % 37}" for i in range(300)).encode()
    want = shingles.shingles(text)
    monkeypatch.setattr(shingles, "CHUNK", 50)
    assert (shingles.shingles(text) == want).all() and len(want) == len(slow(text.decode()))


def test_empty_and_bounds(none):
    assert shingles.drop_similar(none).count() == 0
    a, b, c = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64), np.arange(3, 12, dtype=np.uint64)
    assert list(shingles.links_between([1, 2, 3], [a, b, c])) == [(1, 2)]  # 8 of 10, 6 of 12 and 7 of 11


def test_near_fingerprints_are_candidates_without_a_common_key(spark):
    """Pairs of similarity 0.8 that share no key of minhashes; their fingerprints differ in three bits or less."""
    rows, kept = [], []
    for name in (44191, 1741358):
        words = [f"{name}w{i}" for i in range(34)]
        a, b = " ".join(words), " ".join(words[:28])
        x, y = (shingles.shingles(t.encode()) for t in (a, b))
        assert 5 * len(np.intersect1d(x, y)) == 4 * len(np.union1d(x, y)) and not set(shingles.band_keys(x)) & set(shingles.band_keys(y))
        assert (shingles.set_fingerprint(x) ^ shingles.set_fingerprint(y)).bit_count() <= 3
        kept.append(len(rows))
        rows += [(len(rows), a, "en", "a", 0), (len(rows) + 1, b, "en", "a", 0)]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in got.collect()) == kept


def test_set_fingerprints():
    for text in ("", "one", "a b c d e f", " ".join(f"w{i % 40} w{i}" for i in range(3000))):
        h = [xxhash.xxh64_intdigest(x, 42) for x in slow(text)]
        want = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
        assert shingles.set_fingerprint(shingles.shingles(text.encode())) & (2**64 - 1) == want


def test_fingerprint_candidates_against_all_pairs(spark):
    """Names of sets with equal, near and far fingerprints."""
    rng, prints = random.Random(3), []
    for _ in range(40):
        x = rng.getrandbits(64)
        prints += [x, x] + [x ^ sum(1 << k for k in rng.sample(range(64), n)) for n in (1, 3, 4, 9)]
    frame = [(100 + i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(prints)]
    links = shingles.fingerprint_candidates(spark.createDataFrame(frame, "fp bigint, simhash bigint").repartition(3)).collect()
    assert all((prints[r.a - 100] ^ prints[r.b - 100]).bit_count() <= 3 for r in links)
    got, want = list(range(len(prints))), list(range(len(prints)))
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    for root, pairs in ((got, [(r.a - 100, r.b - 100) for r in links]), (want, near)):
        for i, j in pairs:
            old, new = root[i], root[j]
            root[:] = [new if x == old else x for x in root]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got)) < len(prints)
