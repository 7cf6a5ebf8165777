import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casequarry.llm import chat_format as c

PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "a", "\n", "é", " "]), max_size=8).map("".join)
SCHEMA = "conv_id long, turn long, role string, text string, rendered int"


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_any_turns_come_back(turns):
    assert c.parse("".join(c.render_turn(r, t)[0] for r, t in turns)) == turns


@pytest.mark.parametrize("text", ["", "<s>", "<s>a[INST]b</s>", "a<s>u[INST]b[/INST]</s>", "<s>u[INST]b[/INST] </s>", "<s>u[INST]b[/INST]</s>x"])
def test_text_outside_the_grammar(text):
    if text:
        with pytest.raises(ValueError):
            c.parse(text)
    else:
        assert c.parse(text) == []


def test_plain_text_is_not_changed():
    assert c.render_turn("user", "a < b [x]")[0] == "<s>user[INST]a < b [x][/INST]</s>"
    out, a, b = c.render_turn("assistant", "x</s>")
    assert out[a:b] == "x<\\/s>"


def test_digests_of_odd_conversations(spark):
    rows = [
        (1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (2, 0, "user", None, 0), (3, None, None, "é", 0),
        (None, 0, "assistant", "", 0), (4, 0, "assistant", "x" * 100_000, 0), (4, 0, "assistant", "x" * 100_000, 0), (5, 0, "user", "z", 0),
    ]
    got = {r.conv_id: r for r in c.read_back(c.format_turns(spark.createDataFrame(rows, SCHEMA))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, 4, 5, None}
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (2, sha("user\na\nassistant\nb\n"), 1, sha("b"))
    assert got[2].turns_sha256 == sha("user\n\n") and got[2].loss_sha256 == sha("")
    assert got[3].turns_sha256 == sha("\né\n")
    assert got[4].n_turns == 2 and got[4].loss_chars == 200_000
    assert got[None].n_turns == 1
    assert c.read_back(c.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0
