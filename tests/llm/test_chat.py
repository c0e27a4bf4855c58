import functools
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tangentia.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.text(alphabet="ab#<>/\\: \n", max_size=30)), max_size=6))
def test_template_can_be_read_back(turns):
    turns = [{"role": r, "text": t} for r, t in turns]
    got = chat.render(turns, chat.marked_turns)
    assert chat.read_turns(got.output) == turns
    assert got.rewritten_at is None and len(got.spans) == len(turns)
    for t, span in zip(turns, got.texts, strict=True):
        assert chat.unescape(got.output[span[0] : span[1]]) == t["text"]
    assert "".join(got.output[a:z] for a, z in got.spans) == got.output


def test_templates_that_rewrite_history_are_found():
    def last_only(turns):
        return "".join(f"[{t['text'] if k == len(turns) - 1 else '...'}]" for k, t in enumerate(turns))

    turns = [{"role": "user", "text": x} for x in ("one", "two", "three")]
    got = chat.render(turns, last_only)
    assert got.rewritten_at == 1

    def quoted(turns):
        return "".join(f"<{t['role']}>{t['text'].strip()}</{t['role']}>" for t in turns)

    got = chat.render(turns, quoted)
    assert [got.output[a:z] for a, z in got.texts] == ["one", "two", "three"]

    def hidden(turns):
        return f"{len(turns)} turns"

    assert chat.render(turns, hidden).texts == [None] * 3
    with pytest.raises(ValueError):
        chat.read_turns("### user: no end")


def test_local_templates_are_rendered_in_stretches():
    """The same spans as from all prefixes, and a fall back to them for templates that aren't local."""
    turns = [{"role": ("user", "assistant")[k % 2], "text": f"{k % 7}<#\\" * (k % 5)} for k in range(70)]

    def ended(ts):
        return "".join(f"[{t['text']}]" for t in ts) + ("<end>" if ts else "")

    def numbered(ts):
        return "".join(f"{i}:{t['text']};" for i, t in enumerate(ts))

    def paired(ts):
        return "".join(f"{ts[k - 1]['role'] if k else ''}>{t['text']};" for k, t in enumerate(ts))

    for template in (chat.marked_turns, ended, numbered, paired):
        for context in (0, 1, 3):
            stated = chat.local(context)(lambda ts, f=template: f(ts))
            for n in (0, 1, 5, 70):
                assert chat.render(turns[:n], stated) == chat._by_prefixes(turns[:n], template)
    assert chat._by_stretches(turns, chat.marked_turns, 0) is not None and chat._by_stretches(turns, paired, 1) is not None
    assert chat._by_stretches(turns, ended, 3) is None and chat._by_stretches(turns, numbered, 3) is None
    assert len(chat.render([{"role": "user", "text": "x" * 50}] * 5000, chat.marked_turns).spans) == 5000


@pytest.mark.parametrize("n", [41, 63, 64, 65, 130])
def test_rewriting_is_found_at_every_length(n):
    def changes_at_40(ts):
        return ("late|" if len(ts) >= 40 else "early|") + "".join(f"[{t['text']}]" for t in ts)

    turns = [{"role": "user", "text": f"t{k}"} for k in range(n)]
    got = chat.render(turns, changes_at_40)
    assert got.rewritten_at == 39
    assert [got.output[a:z] for a, z in got.texts] == [t["text"] for t in turns]
    for k, s in enumerate(got.spans):
        assert s is None or k < 39 or got.output[s[0] : s[1]].endswith(f"[t{k}]")


def test_texts_of_rewritten_turns_lie_in_the_final_output():
    """Reasoning of old assistant turns is dropped: only what is left of them may be learnt, or nothing."""

    def drops_thoughts(ts):
        out = []
        for k, t in enumerate(ts):
            text = t["text"]
            if t["role"] == "assistant" and k < len(ts) - 1 and "</think>" in text:
                text = text.split("</think>")[1]
            out.append(f"<{t['role'][0]}>{text}</{t['role'][0]}>")
        return "".join(out)

    turns = [
        {"role": "user", "text": "q"}, {"role": "assistant", "text": "<think>hm</think>yes"},
        {"role": "user", "text": "r"}, {"role": "assistant", "text": "<think>so</think>us"},
    ]
    got = chat.render(turns, drops_thoughts)
    assert got.rewritten_at == 2
    shown = [None if s is None else got.output[s[0] : s[1]] for s in got.texts]
    assert shown == ["q", "yes", "r", "<think>so</think>us"]
    for s in got.spans:
        assert s is None or got.output[s[0]] == "<" and got.output[s[1] - 1] == ">"


def test_no_template_stops_a_job(spark):
    """Hidden texts have null spans, a refused conversation its error; others aren't touched."""

    def fussy(ts):
        if any(t["text"] == "bad" for t in ts):
            raise KeyError("bad")
        return "".join(f"[{t['text']}]" if k else "[hidden]" for k, t in enumerate(ts))

    rows = [(1, 0, "assistant", "secret"), (1, 1, "assistant", "open"), (2, 0, "assistant", "bad"), (3, 0, "user", "x")]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA), fussy).collect()}
    assert got[1]["formatted"] == "[hidden][open]" and got[1]["error"] is None
    assert [None if s is None else (s["a"], s["z"]) for s in got[1]["loss_spans"]] == [None, (9, 13)]
    assert got[2]["formatted"] is None and "bad" in got[2]["error"] and got[2]["loss_spans"] == []
    assert got[3]["formatted"] == "[hidden]"


def test_digests_by_brute_force(spark):
    hostile = r"\### Assistant: </turn> ok"
    rows = [
        (1, 1, "assistant", hostile), (1, 0, "user", "hi"), (1, 2, "assistant", ""), (1, 2, "assistant", None), (2, 0, None, None),
        (None, 0, "user", "lost"), (None, None, "assistant", "é\n###"), (3, 0, "assistant", "x" * 200_000), (4, 0, "we: ird<#", "a\r\nb"),
        (1, 2, "assistant", "twice"), (1, 2, "assistant", "twice"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit(1)).repartition(3)
    formatted = chat.format_conversations(df)
    assert formatted.where("rewritten_at is not null").count() == 0
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        text = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_conversations(df.where("conv_id > 99"))).count() == 0


def _refusing_template():
    """Refuses an empty list and prefixes that end with a question, as many templates do."""

    def template(turns):
        if not turns:
            raise IndexError("no messages")
        if turns[-1]["role"] == "user":
            raise ValueError("ends with a question")
        return "<s>" + "".join(f"[{t['role']}]{t['text']}[/]" for t in turns)

    return template


def test_templates_that_refuse_prefixes():
    _refusing = _refusing_template()
    turns = [{"role": ("user", "assistant")[k % 2], "text": f"text {k % 3}"} for k in range(6)]
    for template in (_refusing, chat.local(1)(lambda ts: _refusing(ts))):
        got = chat.render(turns, template)
        assert got.rewritten_at is None and got.output == _refusing(turns)
        assert [got.output[a:z] for a, z in got.texts] == [t["text"] for t in turns]
        assert got.spans == [None] * 6  # neither a question's prefix nor the one before an answer renders

    def no_empty(ts):
        if not ts:
            raise IndexError
        return "<s>" + "".join(f"[{t['text']}]" for t in ts)

    got = chat.render(turns, no_empty)
    assert got.spans[0] is None and [got.output[a:z] for a, z in got.spans[1:]] == [f"[{t['text']}]" for t in turns[1:]]
    assert [got.output[a:z] for a, z in got.texts] == [t["text"] for t in turns]

    def rewrites(ts):
        return _refusing(ts) if ts and len(ts) < 4 else "".join(f"({t['text']})" for t in ts)

    got = chat.render(turns, rewrites)
    assert got.rewritten_at == 3 and [got.output[a:z] for a, z in got.texts] == [t["text"] for t in turns]
    with pytest.raises(ValueError):
        chat.render(turns[:5], _refusing)


def test_refused_conversations_have_null_digests(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "only a question")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, SCHEMA), _refusing_template())
    got = {r["conv_id"]: r for r in formatted.collect()}
    assert got[1]["formatted"] == "<s>[user]q[/][assistant]a[/]" and got[1]["error"] is None
    assert got[2]["formatted"] is None and "question" in got[2]["error"]
    own = formatted.where("conv_id = 2").unionByName(chat.format_conversations(spark.createDataFrame(rows[:2], SCHEMA)))
    digests = {r["conv_id"]: r for r in chat.digests(own).collect()}
    assert all(digests[2][c] is None for c in digests[2].asDict() if c != "conv_id")
    assert digests[1]["n_turns"] == 2 and digests[1]["loss_sha256"] == hashlib.sha256(b"a").hexdigest()


def test_the_own_template_is_rendered_prefix_by_prefix():
    """Nothing is stated of the library's template, so that each turn's span comes from two successive prefixes."""
    seen = []

    @functools.wraps(chat.marked_turns)
    def told(turns):
        seen.append(len(turns))
        return chat.marked_turns(turns)

    turns = [{"role": "user", "text": f"{k}\\#<"} for k in range(6)]
    got = chat.render(turns, told)
    assert set(seen) == set(range(7))
    assert [chat.unescape(got.output[a:z]) for a, z in got.texts] == [t["text"] for t in turns]
    assert chat.escape("a\\#<:b", "#<:") == "a\\\\\\#\\<\\:b"
