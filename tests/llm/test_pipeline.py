"""The rows of the whole pipeline against plain Python versions of its stages; only the fitted machine is shared."""

import hashlib
import math
import os
import random
from array import array
from collections import Counter

import tokenizers
from test_mixing import draw
from test_shingles import slow

import corpus_pipeline
from brookline.llm import toxicity
from brookline.llm.queries import tokenizer_file

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def some_rows(rows):
    """Rows for every stage: toxic ones, copies and near copies of rows of each kind, and several sources."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    out, marks = list(rows), []
    for i in range(1000, 1240):
        toxic = i % 3 == 0
        words = [word() for _ in range(60)] + ["vile"] * toxic
        text, source = " ".join(words), rng.choice("aab")
        out.append((i, text, "en", source, 0))
        marks.append((i, int(toxic)))
        if i % 4 == 0:
            out.append((i + 1000, text, "en", "c", 0))
        if i % 5 == 0:
            at = 30
            out.append((i + 2000, " ".join(words[:at] + [word()] + words[at + 1 :]), "en", "c", 0))
        if i % 7 == 0:  # too far
            out.append((i + 3000, " ".join(w if k % 9 else word() for k, w in enumerate(words)), "en", "c", 0))
    return out, marks


def plain_toxic(rows, machine):
    def score(text):
        own = {t for w in toxicity.words_of(text) for t in toxicity.word_terms(w)}
        at = [i for i, t in enumerate(machine.terms.tolist()) if t in own]
        z = machine.bias + sum(machine.w[i] for i in at) + sum(float(machine.v[i] @ machine.v[j]) for k, i in enumerate(at) for j in at[:k])
        return 1 / (1 + math.exp(-max(-40, min(40, z))))

    return [r for r in rows if score(r[1] or "") < 0.5]


def plain_copies(rows):
    best = {}
    for r in rows:
        held = best.get(r[1] or "")
        if held is None or (r[0] is not None and (held[0] is None or r[0] > held[0])):
            best[r[1] or ""] = r
    return list(best.values())


def plain_near(rows):
    sets, root = [slow(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    best = {}
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())
    for r, k in zip(rows, root):
        best[k] = min(best.get(k, r), r, key=key)
    return list(best.values())


def plain_mix(rows):
    n = Counter(r[3] for r in rows)
    total = sum(map(math.sqrt, n.values()))
    return [r for r in rows for _ in range(draw(17, r[0], len(rows) * math.sqrt(n[r[3]]) / total / n[r[3]]))]


def plain_encode(rows):
    library, out = tokenizers.Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((r[0], len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return out


def test_all_rows(spark, rows, tmp_path):
    every, marks = some_rows(rows)
    spark.createDataFrame(every, SCHEMA).repartition(3).write.parquet(os.fspath(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id bigint, toxic int").write.parquet(os.fspath(tmp_path / "labels.parquet"))
    machine = toxicity.train_toxicity(*(spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "labels")))
    now, sizes = every, [len(every)]
    for stage in (lambda r: plain_toxic(r, machine), plain_copies, plain_near, plain_mix):
        now = stage(now)
        sizes.append(len(now))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] != sizes[4]
    got = corpus_pipeline.run(spark, os.fspath(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_encode(now))
