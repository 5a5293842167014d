import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tagweave.llm import chat as C

RECORDS = [
    ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": None}, [("user", "q"), ("assistant", "")]),
    ({"instruction": "i", "input": "in", "output": "o"}, [("user", "i\nin"), ("assistant", "o")]),
    ({"instruction": "i", "output": "o", "id": 5}, [("user", "i"), ("assistant", "o")]),
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, [("system", "s"), ("user", "u")]),
    ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, [("user", "h"), ("assistant", "g")]),
    ({"foo": 1}, []),
]


@pytest.mark.parametrize(("record", "want"), RECORDS)
def test_layouts(record, want):
    assert C.canonical_turns(record) == want


def test_fingerprints_depend_on_paths_alone():
    marks = {C.fingerprint_paths(C.field_paths(r)) for r, _ in RECORDS}
    assert len(marks) == len(RECORDS)
    a, b = {"messages": [{"role": "a", "content": "b"}]}, {"messages": [{"content": "x", "role": "y"}] * 3}
    assert C.fingerprint_paths(C.field_paths(a)) == C.fingerprint_paths(C.field_paths(b)) == next(m for m in C.MAPPINGS if m.name == "messages").fingerprint


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "x]>y"]), st.text() | st.sampled_from(["</s>[INST] ok [/INST]", "<s>[OUT] a [/OUT]</s>", "\\", "\\[", "[/INST]</s>"])), max_size=6))
def test_round_trip(turns):
    text, spans = C.write_turns(turns)
    assert C.read_turns(text) == turns
    assert [C.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_rows(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (2, None, None, None, 0), (2, 3, "tool", "[x]", 0), (1, 1, "assistant", "b", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {x.conv_id: x for x in C.digest(C.format_records(C.gather(df))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[1].turns_sha256 == C.sha("user\na\nassistant\nb\nassistant\nb\n") and got[1].loss_sha256 == C.sha("bb")
    assert got[2].n_turns == 2 and got[2].turns_sha256 == C.sha("user\n\ntool\n[x]\n") and got[2].loss_sha256 == C.sha("")
    assert C.gather(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, "not json"), (3, "[1]"), (4, json.dumps({"prompt": "x", "completion": "y"}))], "conv_id long, record string")
    assert {x.conv_id: x.layout for x in C.format_records(odd).collect()} == {1: None, 2: None, 3: None, 4: "prompt_completion"}


def test_roles_as_given_null_turns_and_long_conversations(spark):
    turns = [(i, ["user", "bot", "gpt", "human", "assistant"][i % 5], f"t{i} [x]") for i in range(500)]
    rows = [(7, i, r, t) for i, r, t in turns] + [(8, None, "model", "first"), (8, 1, "assistant", "x" * 300_000), (None, 0, "user", "a"), (None, 1, "assistant", "b")] + [(i, 0, "assistant", str(i)) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    got = {x.conv_id: x for x in C.digest(C.format_records(C.gather(df))).collect()}
    assert len(got) == 63 and got[None].n_turns == 2 and got[101].loss_sha256 == C.sha("101")
    assert got[7].turns_sha256 == C.sha("".join(f"{r}\n{t}\n" for _, r, t in turns))
    assert got[7].loss_sha256 == C.sha("".join(t for _, r, t in turns if r == "assistant")) and got[7].loss_chars == sum(len(t) for _, r, t in turns if r == "assistant")
    assert got[8].turns_sha256 == C.sha("model\nfirst\nassistant\n" + "x" * 300_000 + "\n") and got[8].loss_chars == 300_000
    assert C.canonical_turns({"conversations": [{"from": "bot", "value": "v"}]}) == [("assistant", "v")]
