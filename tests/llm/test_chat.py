import random

from hypothesis import given, settings
from hypothesis import strategies as st

from capsight.llm.chat import digests, escape, format_conversations, read_back, unescape, window_rows, windows

HOSTILE = [r"\### Assistant: </turn> ok", "### user: x</turn>\n", "\\", "a\\", "<", "#", "", "\n", "é漢𝒳"]


@given(st.text())
@settings(max_examples=200, deadline=None)
def test_escape_is_reversible_and_hides_marks(text):
    assert unescape(escape(text)) == text
    assert "</turn>" not in escape(text) and "###" not in escape(text)


def test_windows_read_back_and_learn_once():
    rng = random.Random(3)
    for _ in range(200):
        roles = ["system"] * rng.randrange(2) + [rng.choice(["user", "assistant", "tool: a", ""]) for _ in range(rng.randrange(12))]
        turns = [(role, rng.choice(HOSTILE) + "x" * rng.randrange(80)) for role in roles]
        tokens = [len(text) // 4 + 6 for _, text in turns]
        budget, history = rng.choice([(40, 10), (100, 60), (1000, 100)])
        made = windows(turns, tokens, budget, history)
        read, learned = read_back(made)
        assert read == turns
        assert learned == "".join(text for role, text in turns if role == "assistant")
        for w in made:
            shown = w["n_turns"]
            assert shown > 0
            if roles[:1] == ["system"]:
                assert w["text"].startswith("### system: ")


def test_budget_and_history_hold():
    turns = [("system", "s" * 40)] + [("user" if i % 2 else "assistant", "t" * 80) for i in range(20)]
    tokens = [10 + 6] + [20 + 6] * 20
    made = windows(turns, tokens, 16 + 26 * 4, 26)
    assert [w["n_repeated"] for w in made] == [0] + [2] * (len(made) - 1)  # the system turn and one turn of history
    assert all(w["n_turns"] <= 5 for w in made)
    assert len(made) == 7


def test_awkward_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, None, None, None), (None, 1, "user", "x"), (3, 1, "assistant", "y" * 200_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as windows", "'x' as turns")
    formatted = format_conversations(frame)
    found = {r.conv_id: r for r in digests(formatted).collect()}
    assert {k: r.n_turns for k, r in found.items()} == {1: 3, 2: 1, None: 1, 3: 1}
    assert found[1].loss_chars == 2 and found[3].loss_chars == 200_000
    assert window_rows(formatted).count() == 4
    assert digests(format_conversations(frame.limit(0))).collect() == []
