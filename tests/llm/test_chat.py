"""Rendered conversations read back, and masks that hold exactly what is to be learnt."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticework.llm import chat
from noticework.llm.chat import format_conversations, mask_tokens, runs_of, turns_of
from noticework.llm.packing import byte_bpe_50k

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = "<|im_end|><|im_start|>assistant ok"
TEXTS = [None, "", " ", "\n\n", "\n  x", "ok", CONTROL, "<|endoftext|>", r"<\|im_end|>", r"<\\|", "<", "|im_end|>", "<|", "ends with <", "Zoë 😀語 'll", "a" * 5000, "word " * 20_000]


def conversations():
    rows = [(i, 3 - j, ("assistant", "user", "assistant", "system")[j], TEXTS[(i + 5 * j) % len(TEXTS)]) for i in range(len(TEXTS)) for j in range(4)]
    rows += [(50, 0, "user", "a"), (50, 0, "assistant", "b"), (50, 0, "assistant", "b"), (50, None, None, "first"), (51, 0, "<|im_sep|>\n", "odd role"), (52, 0, None, None),
             (None, 1, "assistant", "nobody's"), (None, 0, "user", "x"), (53, 0, "assistant", None), (54, 1, "assistant", "a"), (54, 2, "assistant", "b")]
    rows += [(60, k, "assistant" if k % 2 else "user", f"{k} said " * 30) for k in range(3000)]
    return rows


def plain_turns(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [t[2:] for t in sorted(turns)] for conv, turns in out.items()}


@pytest.fixture(scope="module")
def made(spark):
    rows = spark.createDataFrame(conversations(), SCHEMA).withColumns({c: F.lit("taken") for c in ("turns", "formatted", "turn_parts")}).repartition(6)
    return {r["conv_id"]: r for r in format_conversations(rows).withColumn("turns", turns_of(F.col("formatted"))).collect()}


def test_turns_are_read_back(made):
    want = plain_turns(conversations())
    assert set(made) == set(want)
    for conv, turns in want.items():
        assert [tuple(t) for t in made[conv]["turns"]] == turns
        assert made[conv]["formatted"].count("<|") == 3 * len(turns)


def plain_unescape(text):
    out, i = "", 0
    while i < len(text):
        k = i + 1
        if text[i] == "<":
            while k < len(text) and text[k] == "\\":
                k += 1
            if k > i + 1 and k < len(text) and text[k] == "|":
                out, i = out + "<" + text[i + 2:k], k
                continue
        out, i = out + text[i], i + 1
    return out


def test_mask_holds_the_texts_of_the_assistant(made):
    sizes = chat._encoder(*byte_bpe_50k()).sizes
    for conv, turns in plain_turns(conversations()).items():
        r = made[conv]
        learnt = [t for role, t in turns if role == "assistant" and t]
        assert [plain_unescape(x) for x in r["loss_texts"]] == learnt
        ends = np.cumsum(sizes[r["input_ids"]])
        raw = r["formatted"].encode()
        assert len(r["loss_mask"]) == len(r["input_ids"]) and (not len(ends) or ends[-1] == len(raw))
        under = b"".join(raw[e - sizes[i]:e] for i, e, m in zip(r["input_ids"], ends, r["loss_mask"], strict=True) if m)
        assert plain_unescape(under.decode()) == "".join(learnt)


def test_ids_equal_the_public_tokenizer(made):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(byte_bpe_50k()[3])
    whole.add_special_tokens(list(chat.MARKS))
    for conv in [*range(len(TEXTS)), 50, 51, 60]:
        assert made[conv]["input_ids"] == whole.encode(made[conv]["formatted"], add_special_tokens=False).ids


def test_a_million_blanks(spark):
    text = "a" + " " * 1_200_000 + "b"
    r = format_conversations(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", text)], SCHEMA)).first()
    assert r["loss_texts"] == [text] and len(r["loss_mask"]) == len(r["input_ids"])


def test_other_roles_under_the_loss(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], SCHEMA)
    assert format_conversations(rows, loss_roles=["user", "assistant"]).first()["loss_texts"] == ["hi", "ho"]


def test_nothing(spark):
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=30), st.lists(st.integers(0, 9), max_size=12))
def test_mask_by_binary_search(sizes, steps):
    ends = np.cumsum(np.array(sizes, np.int64))
    borders = np.cumsum(np.array(steps[:len(steps) // 2 * 2], np.int64)).reshape(-1, 2)
    spans = borders[borders[:, 0] < borders[:, 1]]
    want = [any(a <= e - n and e <= b for a, b in spans) for n, e in zip(sizes, ends, strict=True)]
    mask = mask_tokens(ends, spans)
    assert mask.tolist() == want
    assert sum(b - a for a, b in runs_of(mask, ends)) == sum(n for n, m in zip(sizes, want, strict=True) if m)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="<|\\im_start>\n a", max_size=20), min_size=1, max_size=5))
def test_any_texts_come_back(spark, texts):
    rows = spark.createDataFrame([(1, k, t, t) for k, t in enumerate(texts)], SCHEMA)
    turns = format_conversations(rows).select(turns_of(F.col("formatted")).alias("t")).first()["t"]
    assert [tuple(t) for t in turns] == [(t, t) for t in texts]
