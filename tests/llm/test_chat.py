"""Chat formatting: what is read back, odd texts, the role machine."""

import hashlib

import pytest
from pyspark.sql import functions as F

from driftspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string"
ODD = ["", "<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_end|>", "<\\\\|", "a\\", "x <", "|>", "é\n\n", "$1 \\1 <|<|", None]


def rows_of(conv, said):
    return [(conv, i, r, t, "clash") for i, (r, t) in enumerate(said)]


def test_everything_is_read_back(spark):
    said = [("user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(ODD)]
    odd_roles = [("us\ner", "a"), ("<|im_start|>", "b"), ("\\n", "c"), (None, "d"), ("assistant", "e"), ("a\\\\|<\\|", "f")]
    turns = spark.createDataFrame(rows_of(1, said) + rows_of(2, odd_roles) + rows_of(None, [("user", "q")] * 2), SCHEMA).repartition(5)
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    assert len(got) == 3
    for conv, given in ((1, said), (2, odd_roles)):
        text = "".join(f"{r or ''}\n{t or ''}\n" for r, t in given)
        loss = "".join(t or "" for r, t in given if r == "assistant")
        assert got[conv].n_turns == len(given)
        assert got[conv].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[None].n_turns == 2 and got[None].loss_chars == 0
    assert (got[1].valid, got[2].valid) == (True, False)


@pytest.mark.parametrize("roles,valid", [("su", False), ("sua", True), ("uaua", True), ("a", False), ("uua", False), ("uata", True), ("ussa", False), ("suta", False)])
def test_role_machine(spark, roles, valid):
    names = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    turns = spark.createDataFrame(rows_of(1, [(names[r], "x") for r in roles]), SCHEMA)
    assert chat.format_conversations(turns).first().valid is valid


def test_ties_and_empty_table(spark):
    turns = spark.createDataFrame([(1, 0, "user", "b", ""), (1, 0, "user", "a", ""), (1, None, "user", "c", ""), (1, 0, "user", "a", "")], SCHEMA)
    parsed = chat.format_conversations(turns).select(chat.parse(F.col("formatted")).alias("t"))
    assert [x.text for x in parsed.first().t] == ["c", "a", "a", "b"]
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_templates_are_checked():
    for wrong in ({"start": "[INST]"}, {"end": "</s>"}, {"end": "<|im_start|>"}, {"head_end": ":"}):
        with pytest.raises(ValueError):
            chat.Template(**wrong)
    assert chat.Template(start="<|turn|>", end="<|/turn|>").after == "\n"
