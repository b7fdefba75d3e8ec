import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brookline.llm import chat
from brookline.llm.queries import TRAP, tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ROWS = [
    (1, 1, "user", "hello"), (1, 2, "assistant", "hi there\nyou \\ </s>"), (1, 0, "system", "be [/INST] kind"), (2, 0, "user", None), (2, None, "assistant", "null turn first"), (2, 1, None, "no role"),
    (3, 0, "assistant", "<|endoftext|> é 漢 😀"), (3, 0, "assistant", "tie b"), (3, 0, "assistant", "tie a"), (3, 0, "assistant", "tie a"), (4, 0, "assistant", ""), (4, 1, "user", "x " * 40_000),
    (None, 0, "user", "no conversation id"), (-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP), (5, 0, "<s>[INST]", "\\<s>\\\\[INST]\\"),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def expected():
    convs = defaultdict(list)
    for c, turn, role, text in ROWS:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, rows in convs.items():
        rows.sort()
        turns_sha = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
        loss = "".join(t for _, _, r, t in rows if r == "assistant")
        size = sum(len(f"<s>[INST]{chat.escape(r)}[/INST]{chat.escape(t)}</s>") for _, _, r, t in rows)
        out.append((c, len(rows), turns_sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(out, key=repr)


@pytest.mark.parametrize("arranged", [True, False])
def test_digests_read_back(turns, arranged):
    formatted = chat.format_conversations(turns, PATH)
    got = chat.read_digests(formatted if arranged else formatted.orderBy("part", F.desc("conv_id")), PATH, arranged).drop("n_tokens").collect()
    assert sorted(map(tuple, got), key=repr) == expected()


def test_texts_shuffle_once(turns):
    plan = chat.read_digests(chat.format_conversations(turns.coalesce(1), PATH), PATH, arranged=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(conv_id") == 1


def test_ids_are_the_library_s_and_masks_are_read(turns):
    """The encoder is the library's; a mask that leaves out part of a text gives the rest of the text."""
    import tokenizers

    library = tokenizers.Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    with open(PATH) as f:
        template = chat.Template(f.read())
    for text in [r[3] or "" for r in ROWS]:
        assert template.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    ids, mask = template.assemble(*template.encode(["assistant", "one two three"]), True)
    mask[np.flatnonzero(mask)[0]] = 0
    spark = turns.sparkSession
    cut = spark.createDataFrame([(1, 0, ids.tolist(), mask.tolist())], "conv_id bigint, part bigint, ids array<int>, loss_mask array<tinyint>")
    assert chat.read_digests(cut, PATH).first().loss_sha256 == hashlib.sha256(b" two three").hexdigest()


def test_turns_and_masks(turns):
    formatted = chat.format_conversations(turns, PATH)
    back = defaultdict(list)
    for r in chat.read_turns(formatted, PATH).collect():
        back[r.conv_id].append((r.part, r.role, r.text))
    assert [x[1:] for x in sorted(back[1])] == [("system", "be [/INST] kind"), ("user", "hello"), ("assistant", "hi there\nyou \\ </s>")]
    with open(PATH) as f:
        template = chat.Template(f.read())
    low = template.reserved[chat.BEGIN]
    start = defaultdict(int)
    for r in sorted(formatted.collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.part)):
        ids, mask = np.array(r.ids), np.array(r.loss_mask)
        assert r.start == start[r.conv_id] and len(ids) == len(mask)
        start[r.conv_id] += len(ids)
        assert (ids >= low).sum() == 4 and not mask[ids >= low].any() and set(mask) <= {0, 1}
        role, text, _ = template.parse(ids)
        assert template.decode(ids[mask == 1].tolist()) == (text if role == "assistant" else "")
        rendered = template.render(ids)
        assert rendered.count("</s>") == rendered.count("[INST]") == 1


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("\\</s>[INST]|endofx ") | st.characters(codec="utf-8")) | st.lists(st.sampled_from([*chat.GUARDED, "\\", "<", "a"])).map("".join))
def test_escape(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.GUARDED)


def test_empty_and_clashing(spark, turns):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.read_digests(chat.format_conversations(none, PATH), PATH).count() == 0
    extra = turns.withColumns({x: F.lit("clash") for x in ("ids", "part", "start", "loss_mask", "assistant", "role_ids", "text_ids")})
    got = chat.read_digests(chat.format_conversations(extra, PATH), PATH).drop("n_tokens").collect()
    assert sorted(map(tuple, got), key=repr) == expected()
