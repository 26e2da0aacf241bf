import hashlib
import json

import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import chat_format as chat

from .conftest import DATA


def expected(turns):
    out = {}
    for conv, turn, role, text in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    result = {}
    for conv, said in out.items():
        loss = "".join(text for role, text in said if role == "assistant")
        result[conv] = (
            len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(),
            len(loss), hashlib.sha256(loss.encode()).hexdigest(),
        )
    return result


def digested(turns):
    rows = chat.digests(chat.read_back(chat.render(chat.canonical_turns(turns)))).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}


ODD = [
    (1, 0, "user", "plain"), (1, 1, "assistant", None), (1, 1, "assistant", "tie b"), (1, 1, "assistant", "tie a"),
    (2, None, None, "null turn and role"), (2, 0, "assistant", "&lt; &amp; < [ <|im_end|>\n<|im_start|>user\nx"),
    (2, 0, "assistant", "&lt; &amp; < [ <|im_end|>\n<|im_start|>user\nx"), (None, 3, "assistant", "no id 中🙂"),
    (3, 5, "we\nird</s>role", "</s>[INST] ok [/INST] <<SYS>> <</SYS>> [[INST] <<s>"), (3, 6, "assistant", "é" * 70_000),
    (4, 0, "assistant", ""), (5, 0, "user", "\\ $1 \\1 $"),
]


def test_reads_back_what_was_rendered(spark):
    turns = spark.createDataFrame(ODD, "conv_id bigint, turn bigint, role string, text string")
    turns = turns.withColumns({c: F.lit("clash") for c in ("piece", "head", "body", "messages", "loss_start")})
    assert digested(turns) == expected(ODD)


def test_no_control_string_is_left_inside_a_text(spark):
    turns = spark.createDataFrame(ODD, "conv_id bigint, turn bigint, role string, text string")
    for row in chat.render(chat.canonical_turns(turns)).collect():
        inside = row.piece[len("<|im_start|>"):-len("<|im_end|>\n")]
        assert not any(c in inside for c in chat.CHATML.controls)
        assert 0 <= row.loss_start <= row.loss_end <= len(row.piece)


def test_given_conversations(spark):
    table = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert digested(table) == expected([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_empty_table(spark):
    assert digested(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")) == {}


RECORDS = {
    "messages": {"conv_id": 1, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]},
    "conversations": {"conv_id": 2, "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"}], "model": "m"},
    "turns": {"conv_id": 3, "turns": [{"role": "user", "text": "hi", "n": 1}, {"role": "bot", "text": "ho"}]},
    "instruction": {"conv_id": 4, "instruction": "hi", "output": "ho"},
    "instruction_input": {"conv_id": 5, "instruction": "hi", "input": None, "output": "ho", "x": {"y": [1]}},
    "prompt_completion": {"conv_id": 6, "prompt": "hi", "completion": "ho"},
    "prompt_response": {"conv_id": 7, "prompt": "hi", "response": "ho", "text": ""},
    "question_answer": {"conv_id": 8, "question": "hi", "answer": "ho"},
}


def test_mixed_records_become_the_same_turns(spark):
    rows = [json.dumps(r) for r in RECORDS.values()] + [json.dumps({"foo": 1}), "no json", None]
    turns, unmatched = chat.canonical_turns_of_records(spark.createDataFrame([(r,) for r in rows], "record string"), "record")
    got = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {i: [("user", "hi"), ("assistant", "ho")] for i in range(1, 9)}
    assert unmatched.count() == 3


@pytest.mark.parametrize("name", ["messages", "conversations", "turns", "instruction", "prompt_response"])
def test_tables_are_mapped_by_their_schema(spark, name):
    record = {k: v for k, v in RECORDS[name].items()}
    table = spark.read.json(spark.sparkContext.parallelize([json.dumps(record)]))
    turns = [(r.role, r.text) for r in chat.canonical_turns(table).orderBy("turn").collect()]
    assert turns == [("user", "hi"), ("assistant", "ho")]


def conversations_of(turns):
    found = {}
    for r in turns.orderBy("conv_key", "turn").collect():
        found.setdefault(r.conv_key, []).append((r.turn, r.role, r.text))
    return found


@pytest.mark.parametrize("as_records", [False, True])
def test_records_without_id_stay_apart(spark, as_records):
    """Each prompt keeps its answer, repeated records included."""
    pairs = [(f"q{i % 7}", f"a{i % 7}") for i in range(20)]
    table = spark.createDataFrame(pairs, "prompt string, completion string")
    if as_records:
        records = table.select(F.to_json(F.struct("*")).alias("record"))
        turns, unmatched = chat.canonical_turns_of_records(records, "record")
        assert unmatched.count() == 0
    else:
        turns = chat.canonical_turns(table)
    said = sorted(tuple(v) for v in conversations_of(turns).values())
    assert said == sorted(((0, "user", q), (1, "assistant", a)) for q, a in pairs)
    digests = chat.digests(chat.read_back(chat.render(turns))).collect()
    assert len(digests) == 20 and {r.n_turns for r in digests} == {2}


def test_text_ids_stay_text(spark):
    rows = [json.dumps({"conv_id": i, "prompt": "hi", "completion": "ho"}) for i in ("a", "b", "01", 1)]
    turns, _ = chat.canonical_turns_of_records(spark.createDataFrame([(r,) for r in rows], "record string"), "record")
    assert set(conversations_of(turns)) == {"a", "b", "01", "1"}
    table = spark.createDataFrame([("a", 0, "user", "hi"), ("b", 0, "user", "ho")], "conv_id string, turn int, role string, text string")
    assert set(conversations_of(chat.canonical_turns(table))) == {"a", "b"}


def test_every_record_is_in_turns_or_unmatched(spark):
    """Turn rows, arrays that are empty or whose first element lacks a field, and elements that are no records."""
    known = {
        "a": [{"conv_id": "a", "turn": 1, "role": "assistant", "text": "ho"}, {"conv_id": "a", "turn": 0, "role": "user", "text": "hi"}],
        "b": [{"conv_id": "b", "messages": [{"role": "user"}, {"role": "assistant", "content": "ho"}]}],
        "c": [{"conv_id": "c", "conversations": [{"value": "hi"}, {"from": "gpt", "value": "ho"}]}],
        "d": [{"conv_id": "d", "prompt": "hi", "completion": "ho"}],
    }
    unknown = [
        {"conv_id": "e", "messages": []}, {"conv_id": "f", "messages": None}, {"conv_id": "g", "messages": ["x"]}, {"foo": 1},
        {"conv_id": "h", "messages": "text"},
    ]
    rows = [json.dumps(r) for records in [*known.values(), unknown] for r in records] + ["no json", None]
    turns, unmatched = chat.canonical_turns_of_records(spark.createDataFrame([(r,) for r in rows], "record string"), "record")
    assert conversations_of(turns) == {
        "a": [(0, "user", "hi"), (1, "assistant", "ho")], "b": [(0, "user", ""), (1, "assistant", "ho")],
        "c": [(0, "", "hi"), (1, "assistant", "ho")], "d": [(0, "user", "hi"), (1, "assistant", "ho")],
    }
    left = [r.record for r in unmatched.collect()]
    assert sorted(left, key=str) == sorted([*map(json.dumps, unknown), "no json", None], key=str)


def test_every_text_is_in_turns_or_unmatched(spark):
    """System texts, histories and lists of parts are mapped; what a layout has no place for keeps its record out."""
    parts = [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}]
    known = {
        "a": ({"system": "be kind", "instruction": "hi", "output": "ho"}, [("system", "be kind"), ("user", "hi"), ("assistant", "ho")]),
        "b": ({"prompt": "and?", "completion": "ho", "history": [["q1", "a1"], ["q2", "a2"]]},
              [("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2"), ("user", "and?"), ("assistant", "ho")]),
        "c": ({"question": "hi", "answer": "ho", "system": "s", "history": [{"role": "human", "content": "q"}, {"role": "assistant", "content": "a"}]},
              [("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "hi"), ("assistant", "ho")]),
        "d": ({"messages": [{"role": "user", "content": parts}, {"role": "assistant", "content": ["x", "y"]}]}, [("user", "one\n\ntwo"), ("assistant", "x\n\ny")]),
        "e": ({"conversations": [{"from": "human", "value": "hi"}], "system": "s", "model": "m"}, [("system", "s"), ("user", "hi")]),
        "f": ({"prompt": "hi", "response": "ho", "system": None, "history": [], "x": 3, "note": ""}, [("user", "hi"), ("assistant", "ho")]),
        "g": ({"prompt": parts, "completion": "é" * 200_000}, [("user", "one\n\ntwo"), ("assistant", "é" * 200_000)]),
        "h": ({"messages": [{"role": "user", "content": None, "name": "n"}]}, [("user", "")]),
    }
    unknown = [
        {"prompt": "hi", "chosen": "ho", "rejected": "no"}, {"prompt": "hi", "response": "ho", "chosen": "x"},
        {"messages": [{"role": "user", "content": [{"type": "image_url", "image_url": "http://x"}]}]},
        {"messages": [{"role": "user", "content": "hi", "thought": "secret"}]}, {"messages": [{"role": "user", "content": "hi"}, "loose"]},
        {"instruction": "hi", "output": {"deep": "text"}}, {"prompt": "hi", "completion": "ho", "history": "text"},
        {"prompt": "hi", "completion": "ho", "history": [["q", {"a": 1}]]}, {"prompt": "hi", "completion": "ho", "extra": {"a": ["text"]}},
        {"conv_id": 1, "turn": 0, "role": "user", "text": "hi", "system": "s"}, {"prompt": "hi", "completion": "ho", "system": {"a": 1}},
    ]
    rows = [json.dumps({"conv_id": i, **r}) for i, (r, _) in known.items()] + [json.dumps(r) for r in unknown]
    turns, unmatched = chat.canonical_turns_of_records(spark.createDataFrame([(r,) for r in rows], "record string"), "record")
    found = conversations_of(turns)
    assert {k: [t[1:] for t in v] for k, v in found.items()} == {i: said for i, (_, said) in known.items()}
    assert all([t[0] for t in v] == list(range(len(v))) for v in found.values())
    assert sorted(r.record for r in unmatched.collect()) == sorted(map(json.dumps, unknown))


def test_tables_with_system_and_history(spark):
    pairs = spark.createDataFrame(
        [("s", "hi", "ho", [["q", "a"]], "x"), (None, "hi", "ho", None, "x"), ("", "hi", "ho", [], "x")],
        "system string, prompt string, completion string, history array<array<string>>, comment string",
    )
    said = sorted([t[1:] for t in v] for v in conversations_of(chat.canonical_turns(pairs)).values())
    pair = [("user", "hi"), ("assistant", "ho")]
    assert said == sorted([[("system", "s"), ("user", "q"), ("assistant", "a"), *pair], pair, pair])
    assert chat.unmapped_columns(pairs) == ["comment"]
    turns = spark.createDataFrame(
        [(1, "hi", "ho", [("human", "q")])], "conv_id int, question string, answer string, history array<struct<from:string,value:string>>",
    )
    assert conversations_of(chat.canonical_turns(turns)) == {"1": [(0, "user", "q"), (1, "user", "hi"), (2, "assistant", "ho")]}
    assert chat.unmapped_columns(turns) == []


def test_turn_numbers_that_are_none(spark):
    table = spark.createDataFrame([(1, "x", "user", "hi"), (1, "2", "assistant", "ho")], "conv_id int, turn string, role string, text string")
    assert [(r.turn, r.text) for r in chat.canonical_turns(table).orderBy("turn").collect()] == [(None, "hi"), (2, "ho")]


def test_a_very_long_turn(spark):
    said = "long <|im_end|> text 🙂 " * 200_000
    turns = [(1, 0, "user", said), (1, 1, "assistant", said)]
    assert digested(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")) == expected(turns)


def test_unknown_schema_fails(spark):
    with pytest.raises(ValueError, match="fingerprint"):
        chat.canonical_turns(spark.createDataFrame([(1,)], "foo int"))


def test_fingerprints_depend_on_the_paths_alone():
    assert chat.fingerprint(["b", "a"]) == chat.fingerprint(["a", "b", "a"])
    assert len(chat.BY_FINGERPRINT) == len(chat.LAYOUTS)
