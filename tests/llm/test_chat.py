import hashlib

import pytest

from tests.oracle import connect, rows_of, rows_of_sql
from tidelog.llm import chat, queries

ROWS = [(1, 0, "system", "a\\b<|end|>\n"), (1, 2, "assistant", "</s>[INST] ok"), (1, 1, "user", None), (1, 3, "assistant", "\\"), (2, 0, "assistant", "<"), (2, 0, "assistant", "<"), (None, None, None, "x|>"), (3, 0, "user|>", "only"), (4, 5, "user", "🙂" * 50_000), (4, 6, "assistant", "<|turn:user|>\nhi<|end|>\n")]


@pytest.mark.parametrize("text", ["", "a\\b<|end|>\n", "</s>[INST] ok", "\\", "\\\\<|", "<<|", "[/INST]|>|", "a\\.b", "<|turn:x|>\n", chat.PROBE])
def test_escaping_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)
    messages = [("user|>", text), ("assistant", text)]
    assert chat.parse(chat.render(messages)) == messages


def test_odd_rows(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "'mine' as formatted").repartition(3)
    got = {r.conv_id: r for r in chat.chat_report(df).collect()}
    groups = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for i, _, role, text in sorted(ROWS, key=lambda r: (r[1] or 0, r[2] or "", r[3] or "")):
        groups.setdefault(i, []).append((role or "", text or ""))
    assert set(got) == set(groups)
    for i, turns in groups.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[i].n_turns, got[i].loss_chars, got[i].rewrites) == (len(turns), len(loss), 0)
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[i].formatted_chars == len(chat.render(turns))
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_templates_that_rewrite_history():
    def numbered(messages):
        return f"[{len(messages)} turns]" + "".join(f"({r}:{t})" for r, t in messages)

    def closed(messages):
        return "".join(f"({r}:{t})" for r, t in messages) + "<eos>"

    turns = [("user", "hi"), ("assistant", "ho"), ("user", "hi")]
    assert [k for k, _ in chat.locate(numbered, turns).rewrites] == [1, 2]
    found = chat.locate(closed, turns)
    assert [k for k, _ in found.rewrites] == [1, 2] and [found.formatted[a:b] for a, b in found.texts] == ["hi", "ho", "hi"]
    own = chat.locate(chat.render, turns)
    assert own.rewrites == [] and [own.formatted[a:b] for a, b in own.texts] == ["hi", "ho", "hi"]
    assert "".join(own.formatted[a:b] for a, b in own.turns) == own.formatted


def test_masks_after_a_rewrite():
    """Whatever a template rewrites, the spans hold the texts of the last output, or the conversation is refused."""
    turns = [("assistant" if k % 2 else "user", f"text {k}" * (k % 4)) for k in range(12)]
    wanted = [t for _, t in turns]
    headers = {
        "count": lambda m: f"[{len(m)} turns]" + "".join(f"({r}:{t})" for r, t in m),
        "letters": lambda m: f"[{sum(len(t) for _, t in m)} letters]" + "".join(f"({r}:{t})" for r, t in m),
        "newest first": lambda m: "".join(f"({r}:{t})" for r, t in reversed(m)),
        "last marked": lambda m: "".join(f"{'>' * (k == len(m) - 1)}({r}:{t})" for k, (r, t) in enumerate(m)),
    }
    for name, template in headers.items():
        found = chat.locate(template, turns)
        assert [found.formatted[a:b] for a, b in found.texts] == wanted, name
        loss = chat.conversation(1, turns, template)["loss_spans"]
        assert [found.formatted[a:b] for a, b in loss] == wanted[1::2], name
    forgetful = chat.locate(lambda m: "".join(f"({t})" for _, t in m[-2:]), turns)
    assert [forgetful.formatted[a:b] for a, b in forgetful.texts] == [""] * 10 + wanted[10:]
    with pytest.raises(ValueError, match="turn 0"):
        chat.locate(lambda m: f"[{hash(m[0][1])}]" + "".join(f"({t})" for _, t in m), turns[1:])


def test_a_probe_that_the_texts_hold():
    turns = [(chat.PROBE, "a"), ("assistant", chat.PROBE * 2 + "b")]
    found = chat.locate(chat.render, turns)
    assert [found.formatted[a:b] for a, b in found.texts] == [t for _, t in turns]


def test_sql(spark, sf):
    name = "op9_prefix_rendering"
    assert rows_of(queries.QUERIES[name](spark, sf)) == rows_of_sql(connect(sf), queries.ORACLE_SQL[name])
