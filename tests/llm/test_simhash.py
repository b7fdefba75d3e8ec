import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brookline.llm import simhash
from brookline.llm.components import connected_components


def slow(text, size=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(prints, radius=3):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def test_fingerprints(docs, rows, monkeypatch):
    got = simhash.simhash_fingerprints(docs).collect()
    want = [(d, slow(t)) for d, t, *_ in rows]
    assert sorted(((r.doc_id, r.fp & (2**64 - 1)) for r in got), key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(simhash, "CHUNK", 50)  # the same over many chunks
    assert all(simhash.fingerprint((t or "").encode()) == slow(t) for _, t, *_ in rows if len(t or "") < 6000)


@pytest.mark.parametrize("group", [simhash.GROUP, 8])
def test_links_against_all_pairs(spark, group):
    """Clusters around a few centres; with group 8 they are dealt out in tiles."""
    rng = random.Random(group)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = set()
    for _ in range(400):
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 7)):
            x ^= 1 << rng.randrange(64)
        prints.add(x - (1 << 64) if x >> 63 else x)
    prints = sorted(prints)
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), group=group).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in links)
    at = {p: i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in links:
        parent[root(at[r.a])] = root(at[r.b])
    want, got = components(prints), [root(i) for i in range(len(prints))]
    pairs = set(zip(want, got))
    assert len(pairs) == len(set(want)) == len(set(got))


def test_a_hot_key_is_split_by_the_bits_it_leaves_out(spark):
    """2,000 fingerprints that share two blocks: every near pair is still found, and rows grow by four, not by tiles."""
    rng = random.Random(12)
    base = [rng.getrandbits(32) << 32 | 0x12345678 for _ in range(2000)]
    near = [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base[:200]]
    prints = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    frame = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    links = simhash.fingerprint_links(frame, group=100).collect()
    assert all(0 < ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in links)
    at = {p: i for i, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        root[find(at[r.a])] = find(at[r.b])
    want, got = components(prints), [find(i) for i in range(len(prints))]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))
    parts = frame.select(simhash._parts(F.col("fp"), F.get(simhash._keys(F.col("fp")), 5)).alias("p"), "fp").limit(50).collect()
    for r in parts:
        fp = r.fp & (2**64 - 1)
        bits = [fp >> k & 1 for k in range(64) if not 16 <= k < 32]  # table 5: block 1, then part 1 of the rest
        bits = [b for k, b in enumerate(bits) if not 12 <= k < 24]
        assert [x & 511 for x in r.p] == [sum(b << k for k, b in enumerate(bits[9 * i : 9 * i + 9])) for i in range(4)] and [x >> 9 for x in r.p] == [0, 1, 2, 3]


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_radius(radius):
    base = 0x0123456789ABCDEF
    prints = np.array([base] + [base ^ ((1 << k) - 1) for k in range(1, 6)], np.int64)
    found = {tuple(sorted(p)) for p in simhash.links_within(np.zeros(len(prints), int), prints, radius)}
    assert all(int(a ^ b).bit_count() <= radius for a, b in found)
    assert len(set(components([int(p) for p in prints], radius))) == len(prints) - len(found)


def test_classes(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = [slow(t) for _, t, *_ in rows]
    roots = components(prints)
    least = {}
    for r, (d, *_) in zip(roots, rows):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = sorted(((d, least.get(r)) for r, (d, *_) in zip(roots, rows)), key=repr)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == want


def test_drop_keeps_one_of_each(clashing, rows):
    got = simhash.drop_near_duplicates(clashing)
    assert got.columns == clashing.columns
    roots = components([slow(t) for _, t, *_ in rows])
    found = got.collect()
    root_of = {(d, t): r for r, (d, t, *_) in zip(roots, rows)}
    assert len(found) == len({root_of[r.doc_id, r.text] for r in found}) == len(set(roots))


def test_empty(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}
