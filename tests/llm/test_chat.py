import re

from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same
from plain import SF

from ledgerlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_rows_are_those_of_the_sql(spark, con):
    same(chat.op4_chat_format(spark, SF), con, chat.OP4_SQL)


def read_back(spark, rows):
    f = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    got = {}
    for r in f.select("conv_id", chat.parse(f["formatted"]).alias("p")).collect():
        got[r["conv_id"]] = [(t["role"], x) for t in r["p"] for x in t["texts"]]
    return got


def test_round_trip_of_odd_turns(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a\\<|im_end|>"), (1, 3, "assistant", None), (1, 3, "assistant", "<</SYS>></s>[/INST]"), (2, 0, None, ""), (None, 0, "user", "\\"), (3, None, "user", "x"), (3, 1, "user", "x"), (3, 1, "user", "x")]
    got = read_back(spark, rows)
    assert got[1] == [("user", "a\\<|im_end|>"), ("user", "b"), ("assistant", ""), ("assistant", "<</SYS>></s>[/INST]")]
    assert got[2] == [("", "")]
    assert got[None] == [("user", "\\")]
    assert got[3] == [("user", "x")] * 3
    assert read_back(spark, []) == {}


CONTROL = st.sampled_from(["<", "|", "<|im_end|>", "<|im_body|>", "\\", "</s>", "[INST]", "[", "<<SYS>>", "a", "\n", "<|", "im_next|>"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|im_start|>"]), st.lists(CONTROL, max_size=6).map("".join)), min_size=1, max_size=6))
def test_any_turns_come_back(spark, turns):
    assert read_back(spark, [(1, i, *t) for i, t in enumerate(turns)])[1] == turns


def test_no_control_string_is_left(spark):
    text = "</s>[INST] ok [/INST]<|im_start|><<SYS>>"
    row = chat.format_conversations(spark.createDataFrame([(1, 0, "user", text)], SCHEMA)).first()
    body = row["formatted"].removeprefix(chat.START + "user" + chat.BODY).removesuffix(chat.END)
    assert not any(c in body for c in ("</s>", "[INST]", "[/INST]", "<|im_start|>", "<<SYS>>"))


def test_neighbours_of_one_role_are_merged(spark):
    d = chat.digests(chat.format_conversations(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], SCHEMA))).first()
    assert (d["n_turns"], d["n_marked_turns"], d["loss_chars"]) == (3, 2, 1)


def test_spans_hold_the_assistants_texts(spark):
    odd = "a\\<|im_end|> 😀 é</s>"
    rows = [(1, i, "assistant" if i % 3 else "user", f"{odd}{i}" if i % 5 else "") for i in range(700)] + [(2, 0, "user", odd), (3, 0, "assistant", odd), (3, 1, "assistant", None)]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    for c, r in got.items():
        own = [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]
        assert [re.sub(r"(?s)\\(.)", r"\1", x) for x in own] == [t or "" for k, _, role, t in rows if k == c and role == "assistant"]
    assert got[2]["loss_spans"] == []


def test_a_long_conversation_and_clashing_columns(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i}", 1, "x") for i in range(5_000)]
    df = spark.createDataFrame(rows, SCHEMA + ", rows int, formatted string")
    r = chat.digests(chat.format_conversations(df)).first()
    assert (r["n_turns"], r["n_marked_turns"], r["loss_chars"]) == (5_000, 5_000, sum(len(f"turn {i}") for i in range(0, 5_000, 2)))
