import hashlib
import math
from collections import Counter

from brookline.llm.mixing import mix_sources, source_rates


def draw(seed, doc_id, rate):
    pieces = max(1, math.ceil(rate / 200.0))
    total = 0
    for i in range(1, pieces + 1):
        u = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        mean = rate / pieces
        p = c = math.exp(-mean)
        n = 0
        while c <= u:
            n += 1
            p = p * mean / n
            c += p
        total += n
    return total


def expected(rows, rates):
    return Counter((d, t, s) for d, t, _, s, _ in rows for _ in range(draw(17, d, rates[s])))


def test_against_brute_force(docs, rows):
    rates = {r.source: r.rate for r in source_rates(docs).collect()}
    assert None in rates
    got = mix_sources(docs).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == expected(rows, rates)
    assert [r.mix_key for r in got] == sorted(r.mix_key for r in got)


def test_salted_join_gives_the_same_rows(docs):
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(mix_sources(docs)) == rows(mix_sources(docs, broadcast_sources=1))


def test_weights_zero_missing_and_large(docs, rows):
    rates = {r.source: r.rate for r in source_rates(docs, weights={"a": 0, "b": 1.0, None: 60.0}, size_factor=40).collect()}
    assert rates["a"] == rates["c"] == 0 and rates[None] > 400
    got = mix_sources(docs, weights={"a": 0, "b": 1.0, None: 60.0}, size_factor=40).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == expected(rows, rates)


def test_mean_is_the_rate(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 4 = 0, 'x', 'y') as source", "'t' as text")
    rates = {r.source: r.rate for r in source_rates(docs).collect()}
    counts = Counter(r.source for r in mix_sources(docs).collect())
    for source, n in (("x", 5000), ("y", 15000)):
        assert abs(counts[source] / n - rates[source]) < 4 * math.sqrt(rates[source] / n)


def test_empty_and_clashing(none, clashing):
    assert mix_sources(none).count() == 0
    got = mix_sources(clashing)
    assert got.columns[-3:] == ["copy", "n_copies", "mix_key"] and "kept" in got.columns
    assert got.filter("copy < 1 or copy > n_copies").count() == 0
