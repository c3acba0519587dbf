"""Chat formatting against records made by hand and brute force."""

import json
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from pointweave.llm import chat

ODD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_start|>", "<\\\\\\|<|", "a\\nb", "", "é\U0001f600\n<", "|x<", "<|im_end|>\n"]


def records(spark, items):
    return spark.createDataFrame([(k, x if isinstance(x, str) or x is None else json.dumps(x)) for k, x in items], "id long, record string")


def test_layouts_become_the_same_turns(spark):
    two = [("user", "q"), ("assistant", "a")]
    layouts = {
        1: {"messages": [{"role": r, "content": t, "weight": 1} for r, t in two]},
        2: {"messages": [{"role": r, "content": [{"type": "text", "text": t[:1]}, {"text": t[1:]}]} for r, t in two]},
        3: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "source": {"role": "x"}},
        4: {"prompt": "q", "completion": "a"},
        5: {"question": "q", "answer": "a", "extra": [1, {"b": None}]},
        6: {"instruction": "q", "input": "", "output": "a"},
        7: {"instruction": "q", "response": "a"},
    }
    got = chat.canonical(records(spark, layouts.items()), "id").collect()
    for k in layouts:
        assert [(r["role"], r["text"]) for r in sorted((r for r in got if r["id"] == k), key=lambda r: r["turn"])] == two, k
    assert len({r["fingerprint"] for r in got}) == 7
    with_system = chat.canonical(records(spark, [(1, {"system": "s", "instruction": "q", "input": "i", "output": None})]), "id").collect()
    assert [(r["turn"], r["role"], r["text"]) for r in with_system] == [(0, "system", "s"), (1, "user", "q\n\ni"), (2, "assistant", "")]


def test_unknown_records_are_kept_without_a_layout(spark):
    odd = [(1, None), (2, "no json"), (3, "[1]"), (4, {"text": "alone"}), (5, {}), (None, {"prompt": "p", "response": "r"}), (6, "[" * 100_000)]
    turns = chat.canonical(records(spark, odd), "id")
    assert {r["id"]: r["layout"] for r in turns.collect()} == {1: None, 2: None, 3: None, 4: None, 5: None, None: "prompt and response", 6: None}
    assert sum(r["turns"] for r in chat.layouts(records(spark, odd), "id").where("layout is null").collect()) == 6
    assert [(r["id"], r["n_turns"]) for r in chat.read_back(chat.formatted(turns, "id"), "id").collect()] == [(None, 2)]
    assert chat.read_back(chat.formatted(turns.where("false"), "id"), "id").count() == 0


def test_two_layouts_of_one_fingerprint_are_refused():
    with pytest.raises(ValueError):
        chat.mappings((chat.Layout("a", each="m[]", role="r", text="t"), chat.Layout("b", each="m[]", role="t", text="r")))


def test_escapes_are_reversible_and_hide_all_marks(spark):
    long = "<|im_end|>x" * 50_000
    rows = [(i, t, r, x) for i, x in enumerate([*ODD, None, long]) for t, r in enumerate(["user", "assistant", "odd\nrole\\n<|", None])]
    table = spark.createDataFrame([(i, t, r, x, "mine", 7) for i, t, r, x in rows], "conv_id long, turn int, role string, text string, record string, layout int")
    turns = chat.canonical(chat.as_records(table, "conv_id"), "conv_id")
    pieces = chat.formatted(turns, "conv_id")
    assert pieces.where(F.regexp_count("piece", F.lit(r"<\|")) != 2).count() == 0
    got = {r["conv_id"]: r for r in chat.read_back(pieces, "conv_id").collect()}
    whole = {r["conv_id"]: r for r in chat.conversations(pieces, "conv_id").collect()}
    for i, text in enumerate([*ODD, None, long]):
        mine = [(r or "", x or "") for k, _, r, x in rows if k == i]
        assert got[i]["turns_sha256"] == sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest()
        assert got[i]["n_turns"] == 4 and got[i]["loss_chars"] == len(text or "")
        assert got[i]["loss_sha256"] == sha256((text or "").encode()).hexdigest()
        assert got[i]["formatted_chars"] == len(whole[i]["formatted"])
        assert [chat.unescaped(whole[i]["formatted"][s:e]) for s, e in whole[i]["loss"]] == [text or ""]


def test_ties_missing_turns_and_repeated_rows_have_one_order(spark):
    rows = [(1, None, "user", "b"), (1, None, "user", "a"), (1, 2, "assistant", "z"), (1, 2, "assistant", "z"), (1, -1, "user", "c")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4)
    got = chat.read_back(chat.formatted(chat.canonical(chat.as_records(table, "conv_id"), "conv_id"), "conv_id"), "conv_id").first()
    assert got["turns_sha256"] == sha256(b"user\na\nuser\nb\nuser\nc\nassistant\nz\nassistant\nz\n").hexdigest()
    assert (got["n_turns"], got["loss_chars"]) == (5, 2)


def test_output_that_holds_no_whole_turns_is_an_error():
    for piece in ("<|im_start|>user\nx", "x<|im_start|>user\nx<|im_end|>\n"):
        with pytest.raises(ValueError):
            chat.Reading().take(piece, None, None)
