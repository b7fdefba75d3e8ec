import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brookline.llm.exact_dedup import drop_exact_duplicates, exact_duplicates


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr), len(groups)


@pytest.mark.parametrize("block", [4096, 7])
def test_against_brute_force(docs, rows, block):
    if block == 7:
        docs, rows = docs.filter("n_chars < 300 or n_chars is null"), [r for r in rows if r[4] is None or r[4] < 300]
    got = exact_duplicates(docs, block_bytes=block).collect()
    want, classes = expected(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == classes
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_long_texts_that_differ_late_stay_apart(spark):
    base = "ab" * 5000
    rows = [(1, base), (2, base[:-1] + "x"), (3, base + "a"), (4, base), (5, base[:4096]), (6, base[:4096])]
    got = {r.doc_id: r.keep_id for r in exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), block_bytes=64).collect()}
    assert got == {1: 4, 2: 2, 3: 3, 4: 4, 5: 6, 6: 6}


def test_drop_keeps_one_row_a_class_and_all_columns(clashing, rows):
    got = drop_exact_duplicates(clashing)
    assert got.columns == clashing.columns
    found = got.collect()
    assert len(found) == expected(rows)[1]
    assert len({r.text or "" for r in found}) == len(found)


def test_empty(none):
    assert exact_duplicates(none).count() == 0
    assert drop_exact_duplicates(none).count() == 0


def test_clashing_columns(clashing, rows):
    assert exact_duplicates(clashing).count() == len(rows)


def test_ties_are_decided_by_all_other_columns(spark):
    """Rows of one id and text: the same one stays in whatever order they come."""
    rows = [(1, "same", x) for x in "abcdef"] + [(2, "other", None), (2, "other", "z")]
    kept = set()
    for seed in range(4):
        frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").orderBy(F.rand(seed)).repartition(3)
        kept.add(tuple(sorted(map(repr, drop_exact_duplicates(frame).collect()))))
    assert len(kept) == 1 and len(next(iter(kept))) == 2
