import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ketflow.llm import chat


def digest_of(turns):
    h = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), h, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(chat.format_turns(chat.canonical_turns(df))).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        mine = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        want[c] = digest_of([(r[2], r[3]) for r in mine])
    assert got == want


def test_hard_cases(spark):
    check(
        spark,
        [
            (1, 0, "user", None), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", "\\\\<|turn|>x<|text|>"), (1, 3, "assistant", ""),
            (2, 0, None, "a\n"), (2, 1, "ass\nistant<|", "b\\"), (3, 5, "assistant", "tie b"), (3, 5, "assistant", "tie a"), (3, 5, "assistant", "tie a"),
            (None, 1, "user", "no id"), (4, None, "user", "no turn"), (4, 0, "assistant", "x" * 200_000), (5, 0, "assistant", "😀<|end|>\n<|end|>"),
        ],
    )
    assert chat.digest(chat.format_turns(chat.canonical_turns(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")))).count() == 0


TEXT = st.lists(st.sampled_from(["\\", "<", "|", ">", "turn", "text", "end", "\n", "[INST]", "</s>", "<|", "a", "é", "$1"]), max_size=12).map("".join)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "<|end|>"]), TEXT), min_size=1, max_size=25))
def test_round_trip(spark, turns):
    check(spark, [(c, i, r, t) for i, (c, r, t) in enumerate(turns)])


def test_no_control_string_is_left_in_a_text(spark):
    df = spark.createDataFrame([("".join(chat.CONTROL) * 2 + "\\<\\|",)], "t string")
    r = df.select(chat.escape(F.col("t")).alias("e"), "t", chat.unescape(chat.escape(F.col("t"))).alias("b")).first()
    assert r.b == r.t and not any(c in r.e for c in chat.CONTROL)


def test_layouts_by_table_schema(spark):
    a = spark.createDataFrame([(1, "q?", "a!")], "id int, prompt string, response string")
    b = spark.createDataFrame([(1, [("human", "hi"), ("gpt", "yo")])], "id int, conversations array<struct<`from`:string,value:string>>")
    c = spark.createDataFrame([(1, "do", None, "done")], "id int, instruction string, input string, output string")
    for df, want in ((a, [("user", "q?"), ("assistant", "a!")]), (b, [("user", "hi"), ("assistant", "yo")]), (c, [("user", "do"), ("assistant", "done")])):
        assert [(r.role, r.text) for r in chat.canonical_turns(df, "id").orderBy("turn").collect()] == want
    with pytest.raises(ValueError):
        chat.layout_of(spark.createDataFrame([(1,)], "x int"))
    clash = spark.createDataFrame([(1, 0, "user", "t", 1, 2)], "conv_id bigint, turn bigint, role string, text string, head int, piece int")
    assert chat.layout_of(clash).name == "turn_rows" and chat.digest(chat.format_turns(chat.canonical_turns(clash))).count() == 1


def test_layouts_by_record(spark):
    records = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction_input", [("user", "i"), ("assistant", "o")]),
        ({"completion": "c", "prompt": "p"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"conversations": [{"from": "human", "value": "h"}]}, "conversations", [("user", "h")]),
        ({"other": 1}, None, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _, _) in enumerate(records)] + [(9, "not json"), (10, None)], "i int, j string")
    got = {r.i: (r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in chat.canonical_records(df, "j").collect()}
    assert got == {i: (n, t) for i, (_, n, t) in enumerate(records)} | {9: (None, None), 10: (None, None)}


def test_spans_point_at_the_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "é"), (1, 1, "assistant", "ü<|x"), (1, 2, "assistant", "y")], "conv_id bigint, turn bigint, role string, text string")
    r = chat.format_turns(chat.canonical_turns(df)).first()
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["ü<\\|x", "y"]
    plan = chat.digest(chat.format_turns(chat.canonical_turns(df)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
