import hashlib
import random
import zlib
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brookline.llm import bpe, common, token_counts, token_files
from brookline.llm import units as units_
from brookline.llm.queries import tokenizer_file
from brookline.llm.units import WordUnits, byte_units, safe_parts, word_units

tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
texts = st.text(st.sampled_from(" \n\t'aeinstrlE0159.,!?%éüñß漢字😀Σİ_~<|>/\\x1c\\u2003") | st.characters(codec="utf-8"), max_size=60)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_library():
    return tokenizers.Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def codec():
    import json

    with open(BYTE) as f:
        return bpe.Codec(json.load(f))


@settings(max_examples=300, deadline=None)
@given(text=texts, special=st.booleans())
def test_prefix_encoding_is_the_library_s(codec, library, text, special):
    text = text + "<|endoftext|>" + text if special else text
    ids = codec.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(text=texts)
def test_units_are_safe(library, word_library, text):
    first, *rest = byte_units(text)
    cut = [first, *(" " + u for u in rest)]
    assert [i for u in cut for i in library.encode(u, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids
    cut = word_units(text)
    assert [i for u in cut for i in word_library.encode(u, add_special_tokens=False).ids] == word_library.encode(text, add_special_tokens=False).ids


def test_word_units_in_one_text(rows):
    with open(WORD) as f:
        code, encode, units = token_files._word_encoder("test", f.read())
    assert isinstance(units, WordUnits)
    some = [r[1] for r in rows if r[1]] + ["foo_. x), y. _, 3. 4, [a]. b\" it's. IT'S, ***ok%%%, Été,"]
    cut = [word_units(t) for t in some]
    memo = units.learn({u for c in cut for u in c})
    assert [b"".join(memo[u] for u in c) for c in cut] == [array(code, ids).tobytes() for ids in encode(some)]


def test_counts(docs, rows, library):
    got = token_counts.count_tokens(docs, BYTE).collect()
    want = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_counts_of_a_sentencepiece_model(docs, rows):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(docs.filter("n_chars < 1000"), path).collect()
    want = [(d, len(model.encode(t or ""))) for d, t, _, _, n in rows if n is not None and n < 1000]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(want, key=repr)


def test_memo_starts_anew_and_counts_stay(rows, library, monkeypatch):
    monkeypatch.setattr(units_, "MEMO_UNITS", 5 * 400)
    monkeypatch.setattr(units_, "SLICE", 900)
    texts = [r[1] or "" for r in rows]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    with open(BYTE) as f:
        text = f.read()
    monkeypatch.setattr(common, "_kept", {})
    _, held = token_counts._counter("tiny", text)
    monkeypatch.setattr(common, "_kept", {})
    _, packed = bpe._codec("tiny", text)
    for _ in range(2):
        assert [held.each([t])[0] for t in texts] == held.each(texts) == want
        assert [len(packed.each([t])[0]) // 4 for t in texts] == [len(x) // 4 for x in packed.each(texts)] == want
    assert len(held.units) + len(held.units.before) < 1000


def test_memo_holds_bytes():
    memo = common.Memo(100_000)
    for i in range(50):
        keys = [f"key {i} {j}" for j in range(60)] + [str(i) + "x" * 5000]
        new = memo.missing({*keys, "always"})
        memo.add(new, [len(k) for k in new])
        assert all(memo[k] == len(k) for k in keys) and memo["always"] == 6
        assert len(memo) + len(memo.before) < 800 and sum(len(k) > 256 for k in [*memo, *memo.before]) <= 2
        assert "always" not in new or i == 0


def test_worker_keeps_one_operator_s_state(monkeypatch):
    monkeypatch.setattr(common, "_kept", {})
    first = common.worker_state("a", lambda: [1])
    assert common.worker_state("a", lambda: [2]) is first
    assert common.worker_state("b", lambda: [3]) == [3] and list(common._kept) == ["b"]


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.sampled_from("aeinstrlE0159.,!?%éüß漢字仮名、。「」ไทย한국어𝒳́'’İΣ_~<|>/") | st.characters(codec="utf-8", exclude_categories=["Z", "Cc"]), max_size=80), most=st.integers(1, 9))
def test_parts_without_spaces_are_safe(library, word_library, text, most):
    parts = safe_parts(text, most)
    assert "".join(parts) == text
    for tokenizer in (library, word_library):
        assert [i for p in parts for i in tokenizer.encode(p, add_special_tokens=False).ids] == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_texts_without_spaces(library, codec, monkeypatch):
    """One run of letters, and marks between clauses: every way gives the library's ids."""
    rng = random.Random(8)
    run = "".join(rng.choice("漢字仮名語") for _ in range(3000))
    clauses = "".join(rng.choice("漢字仮名語") + rng.choice(["", "", "", "。", "、", "3"]) for _ in range(6000))
    latin = "".join(rng.choice("etaoin") for _ in range(3000))
    monkeypatch.setattr(units_, "LONG_UNIT", 50)
    monkeypatch.setattr(units_, "LONG_PIECE", 200)
    monkeypatch.setattr(common, "_kept", {})
    with open(BYTE) as f:
        _, counts = token_counts._counter("long", f.read())
    with open(WORD) as f:
        code, encode, words = token_files._word_encoder("long", f.read())
    for text in (run, clauses, latin, clauses + "<|endoftext|>" + run + " " + latin):
        want = library.encode(text, add_special_tokens=False).ids
        assert counts.each([text]) == [len(want)] and codec.encode(text) == want
        assert words.each([text]) == [array(code, encode([text])[0]).tobytes()]


def test_a_long_piece_takes_little_memory(codec):
    import tracemalloc

    text = "".join(random.Random(9).choices("etaoinshr", k=2_000_000))
    codec.piece(text[:200_000])  # pairs are known
    tracemalloc.start()
    ids = codec.piece(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert codec.decode(ids) == text and peak < 15 * len(text)


def test_other_files_are_refused(codec):
    import json

    with open(BYTE) as f:
        config = json.load(f)
    assert bpe.unsupported(config) == []
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": config["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": config["model"] | {"ignore_merges": True}}, {"added_tokens": [config["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.Codec(config | change)
    with open(WORD) as f, pytest.raises(ValueError):
        bpe.Codec(json.load(f))


def test_round_trip(docs, rows, library):
    got = bpe.round_trip_digests(docs, BYTE).collect()
    want = []
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_encode_and_decode(docs, rows):
    back = bpe.decode_ids(bpe.encode_texts(docs, BYTE), BYTE).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((d, t or "") for d, t, *_ in rows), key=repr)


def test_token_files(spark, docs, rows):
    library = tokenizers.Tokenizer.from_file(WORD)
    files = token_files.write_token_files(docs, WORD)
    got = sorted(map(tuple, token_files.read_digests(spark, files).collect()), key=lambda r: r[1])
    assert [r[0] is not None for r in got] == sorted(r[0] is not None for r in got)
    ids = [r[0] for r in got if r[0] is not None]
    assert ids == sorted(ids) and len(got) == len(rows)
    start = 0
    want = sorted(((d, zlib.crc32(array("I", library.encode(t or "", add_special_tokens=False).ids + [1]).tobytes())) for d, t, *_ in rows), key=repr)
    for _, at, n, _ in got:
        assert at == start
        start += n
    assert sorted(((r[0], r[3]) for r in got), key=repr) == want
    records = token_files.read_records(spark, files).collect()
    assert sum(len(r.ids) for r in records) == start and all(r.ids[-1] == 1 for r in records)
    order = [(r.shard, r.offset) for r in token_files.shuffled_reads(spark, files, 1).collect()]
    assert len(set(order)) == len(rows) and order != sorted(order)
    at = {(r.shard, r.offset): (r.doc_id, r.ids) for r in records}
    sought = token_files.read_at(files, token_files.shuffled_reads(spark, files, 1)).collect()
    assert [(r.shard, r.offset) for r in sought] == order and all(at[r.shard, r.offset] == (r.doc_id, r.ids) for r in sought)
    row = token_files.read_index(spark, files).filter("doc_id = 8").first()
    reader = token_files.ShardReader(files)
    assert reader.read(row.file, row.offset, row.frame_bytes)[1].tolist() == at[row.shard, row.offset][1]
    with pytest.raises(token_files.CorruptRecord):
        reader.read(row.file, row.offset + 1, row.frame_bytes)


def test_shards_are_bounded_in_bytes(spark):
    """A few long texts among many short ones: ranges of rows are uneven, shards are not."""
    rng = random.Random(11)
    long = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(2000)) for _ in range(60)]
    rows = [(i, long[i - 200] if 200 <= i < 260 else "short") for i in range(2000)]
    files = token_files.write_token_files(spark.createDataFrame(rows, "doc_id bigint, text string"), WORD, shard_bytes=40_000)
    index = token_files.read_index(spark, files)
    sizes = [r.n for r in index.groupBy("shard").agg({"frame_bytes": "sum"}).toDF("shard", "n").collect()]
    assert max(sizes) <= 40_000 and len(sizes) > 5
    got = [r.doc_id for r in index.orderBy("shard", "offset").collect()]
    assert got == list(range(2000))
    starts = index.orderBy("start").collect()
    assert [r.doc_id for r in starts] == got and all(b.start == a.start + a.n_tokens for a, b in zip(starts, starts[1:]))


def test_corrupt_records_are_found():
    good = token_files.frame(5, array("H", [1, 2, 3])) + token_files.frame(None, array("I", [70000]))
    assert [(d, list(ids)) for _, _, d, ids in token_files.walk(good)] == [(5, [1, 2, 3]), (None, [70000])]
    rng = random.Random(0)
    for _ in range(60):
        at = rng.randrange(len(good))
        bad = good[:at] + bytes([good[at] ^ (1 << rng.randrange(8))]) + good[at + 1 :]
        with pytest.raises(token_files.CorruptRecord):
            list(token_files.walk(bad))
    with pytest.raises(token_files.CorruptRecord):
        list(token_files.walk(good[:-5]))


def test_empty(spark, none):
    assert token_counts.count_tokens(none, BYTE).count() == 0
    assert bpe.round_trip_digests(none, BYTE).count() == 0
    assert token_files.read_digests(spark, token_files.write_token_files(none, WORD)).count() == 0


def test_clashing_columns(spark, clashing, rows):
    assert token_counts.count_tokens(clashing, BYTE).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert bpe.round_trip_digests(clashing, BYTE).count() == len(rows)
    assert token_files.read_digests(spark, token_files.write_token_files(clashing, WORD)).count() == len(rows)
