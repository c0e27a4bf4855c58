"""Chat formatting by incremental black-box rendering.

A template is any function from a list of ``{"role", "text"}`` turns to a
string.  Nothing is assumed of its inside: successive prefixes of a conversation
are rendered, and what each adds to the output before is that turn's span.  A
render of the same prefix with a probe in place of the last text shows where in
the span the text itself lies.  A template whose output for a prefix doesn't
begin with its output for a shorter one rewrites history, which is reported
with the first turn where it happens; texts are then found by probes in the
final output.  So are those of turns whose prefix the template refuses (many refuse an empty list, or one
that ends with a question): only the whole has to render.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Template = Callable[[list[dict]], str]

#: Stands in for a text; repeated as often as it takes not to be in the output itself.
PROBE = "\ue0f0probe\ue0f1"
_TURN = re.compile(r"### ((?:[^\\:#<]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.S)


def local(turns: int) -> Callable[[Template], Template]:
    """States of a template that what a turn adds depends on no more than ``turns`` turns before it.

    It is the caller's word, and only used to render stretches instead of whole
    prefixes, at every length alike.  If the stretches don't add up to the render
    of the whole, all prefixes are rendered.
    """

    def state(template: Template) -> Template:
        template.context = turns
        return template

    return state


def escape(text: str, chars: str = "#<") -> str:
    """Puts a backslash before every backslash and every character of ``chars``."""
    text = text.replace("\\", "\\\\")
    for c in chars:
        text = text.replace(c, "\\" + c)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def marked_turns(turns: list[dict]) -> str:
    """The library's template: ``### role: text</turn>``, one turn to a line.

    ``#`` and ``<`` are escaped in texts and roles (``:`` in roles too), so no
    text can spell a marker, and :func:`read_turns` gives back what was written.
    To the renderer it is a black box as any other: nothing is stated of it, so every prefix is rendered.
    """
    return "".join(f"### {escape(t['role'], '#<:')}: {escape(t['text'])}</turn>\n" for t in turns)


def read_turns(formatted: str) -> list[dict]:
    """Inverse of :func:`marked_turns`; ValueError for anything it doesn't write."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append({"role": unescape(m[1]), "text": unescape(m[2])})
        at = m.end()
    return out


@dataclass
class Rendered:
    """``output`` of the whole; spans hold for it and are None where they can't be told."""

    output: str
    spans: list[tuple[int, int] | None] = field(default_factory=list)  # of whole turns
    texts: list[tuple[int, int] | None] = field(default_factory=list)  # of the texts inside
    rewritten_at: int | None = None  # first turn whose render changes what came before


def render(turns: list[dict], template: Template) -> Rendered:
    """Spans of the turns and of their texts in the template's output for all ``turns``.

    Without more knowledge of the template every prefix is rendered, whose cost
    is the square of a conversation's length.  For templates declared :func:`local`, what
    a turn adds is rendered after the turns that it depends on, which is linear.
    """
    context = getattr(template, "context", None)
    if context is not None:
        got = _by_stretches(turns, template, context)
        if got is not None:
            return got
    return _by_prefixes(turns, template)


def _tried(template: Template, turns: list[dict]) -> str | None:
    """The render, None if the template refuses these turns."""
    try:
        return template(turns)
    except Exception:  # noqa: BLE001  a template is anyone's code
        return None


def _by_stretches(turns: list[dict], template: Template, context: int) -> Rendered | None:
    """None if a stretch is refused or rewrites what came before, or the additions aren't exactly the render of the whole."""
    got = Rendered(template(turns))
    start = _tried(template, [])
    if start is None or not got.output.startswith(start):
        return None
    at = len(start)
    for k in range(len(turns)):
        part = turns[max(0, k - context) : k + 1]
        before, now = _tried(template, part[:-1]), _tried(template, part)
        if before is None or now is None:
            return None
        added = now[len(before) :]
        if not now.startswith(before) or not got.output.startswith(added, at):
            return None
        text = _text_span(part, len(part) - 1, template, now, len(before))
        shift = at - len(before)
        got.spans.append((at, at + len(added)))
        got.texts.append(None if text is None else (text[0] + shift, text[1] + shift))
        at += len(added)
    return got if at == len(got.output) else None


def _probe_for(output: str) -> str:
    probe = PROBE
    while probe in output:
        probe += PROBE
    return probe


def _text_span(turns: list[dict], k: int, template: Template, now: str, least: int = 0) -> tuple[int, int] | None:
    """Where the text of turn ``k`` lies in ``now``, the render of ``turns``, by rendering a probe in its place.

    None if the template doesn't show it, not as one stretch of its own, or refuses the probe.
    """
    probe = _probe_for(now)
    probed = _tried(template, [*turns[:k], {**turns[k], "text": probe}, *turns[k + 1 :]])
    if probed is None:
        return None
    at = probed.find(probe, least)
    end = len(now) - (len(probed) - at - len(probe))
    found = at >= 0 and at <= end and now[:at] == probed[:at] and now[end:] == probed[at + len(probe) :]
    return (at, end) if found else None


def _by_prefixes(turns: list[dict], template: Template) -> Rendered:
    """Every prefix in turn.  Where one rewrites history or is refused, texts are looked for in the final output instead.

    What a turn adds is told by its own prefix and the one before, so of a refused prefix neither its last turn nor the next one has a span.
    """
    got, last = Rendered(""), _tried(template, [])
    fresh = last is not None  # whether the last render is that of the prefix before
    kept: list[int | None] = []  # how much of the output of each prefix the later ones keep
    for k in range(1, len(turns) + 1):
        now = template(turns) if k == len(turns) else _tried(template, turns[:k])
        if now is None:
            got.spans.append(None)
            got.texts.append(None)
            kept.append(None)
            fresh = False
            continue
        start = len(last or "")
        if last is None or now.startswith(last):
            got.spans.append((start, len(now)) if fresh else None)
        else:  # what this turn adds can't be told from what it changes
            start = _common(last, now)
            got.spans.append(None)
            if got.rewritten_at is None:
                got.rewritten_at = k - 1
        kept.append(start)
        got.texts.append(None if got.rewritten_at is not None else _text_span(turns[:k], k - 1, template, now, start))
        last, fresh = now, True
    got.output = last or ""
    if got.rewritten_at is not None:
        safe = len(got.output)
        for k in range(len(turns) - 1, -1, -1):  # a span that a later prefix changed is one of an output that is no more
            if got.spans[k] is not None and got.spans[k][1] > safe:
                got.spans[k] = None
            safe = safe if kept[k] is None else min(safe, kept[k])
        got.texts = [None] * len(turns)
    got.texts = [_text_span(turns, k, template, got.output) if t is None else t for k, t in enumerate(got.texts)]
    return got


def _common(a: str, b: str) -> int:
    """Length of the longest common beginning, by halves."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def format_conversations(
    conversations: DataFrame,
    template: Template = marked_turns,
    learn_roles: tuple[str, ...] = ("assistant",),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``(conv_id, n_turns, formatted, loss_spans, rewritten_at, error)``, one row for each conversation.

    ``loss_spans`` are the character ranges of the texts of ``learn_roles`` in
    ``formatted``, in order, and null for a text that the template hides or
    mixes with others; ``rewritten_at`` is the first turn whose render changes
    the output of those before it, null for a template that never does.  A
    conversation that the template refuses has null ``formatted`` and no spans, and its
    ``error``, null otherwise, tells why.  Turns stand in order
    of ``turn`` (null first), ties by role and text, and rows that repeat a turn
    are turns of their own.  Null roles and texts count as empty; rows with
    a null id are one conversation.  A conversation is one training example, so
    its turns meet in one row; no more than one is held at a time.
    """
    turns = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turns)).alias("turns"))

    @F.pandas_udf(
        "struct<n_turns: bigint, formatted: string, loss_spans: array<struct<a: bigint, z: bigint>>, rewritten_at: bigint, error: string>"
    )
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for group in batch:
                turns = [{"role": t["role"], "text": t["text"]} for t in group]
                try:
                    got = render(turns, template)
                except Exception as e:  # noqa: BLE001  a template is anyone's code
                    rows.append((len(turns), None, [], None, f"{type(e).__name__}: {e}"))
                    continue
                spans = [s for t, s in zip(turns, got.texts, strict=True) if t["role"] in learn_roles]
                found = [None if s is None else {"a": s[0], "z": s[1]} for s in spans]
                rows.append((len(turns), got.output, found, got.rewritten_at, None))
            yield pd.DataFrame(rows, columns=["n_turns", "formatted", "loss_spans", "rewritten_at", "error"]).astype(
                {"rewritten_at": "Int64", "formatted": object, "error": object}
            )

    return grouped.select("conv_id", run("turns").alias("x")).select("conv_id", "x.*")


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of what :func:`read_turns` and the loss spans give back, one row for each row of :func:`format_conversations`.

    All are null for a conversation that the template refused.
    """

    @F.pandas_udf("struct<n_turns: bigint, turns_sha256: string, loss_chars: bigint, loss_sha256: string, formatted_chars: bigint>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            rows = []
            for text, of in zip(texts, spans, strict=True):
                if text is None:
                    rows.append((None,) * 5)
                    continue
                turns = read_turns(text)
                all_turns = "".join(f"{t['role']}\n{t['text']}\n" for t in turns)
                loss = "".join(unescape(text[s["a"] : s["z"]]) for s in of if s is not None)
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in (all_turns, loss)]
                rows.append((len(turns), sha[0], len(loss), sha[1], len(text)))
            columns = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in columns[::2]})

    return formatted.select("conv_id", run("formatted", "loss_spans").alias("x")).select("conv_id", "x.*")
