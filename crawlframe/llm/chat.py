"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. Each prefix of a conversation is rendered; what a
prefix adds to the one before is that turn's span, and a prefix that doesn't begin with the one before shows
that the template rewrites history. Where a turn's own text lies in its span is found by rendering the turn
once more with a probe in place of the text. The loss mask covers the texts of the assistant's turns.

Rewriting templates are reported (``rewrites``) with the first turn at which history changed; spans are then
empty, since no turn keeps its place.

Rendering every prefix takes time with the square of the turns. Only a template that declares that it puts
turns together one by one (its attribute ``by_turn``), as the query's does, is spared that beyond LONG_TURNS
turns: there, each turn is rendered after the first turn and the one before it only, and the pieces, put
together, must equal the rendering of the whole conversation, else all prefixes are rendered after all.

Defined cases: null texts and roles are empty; rows are ordered by turn, then role, then text, null turns
first; repeated rows are turns of their own; a null conv_id is one conversation; an empty table gives no rows;
more columns of the input are left out. One conversation is one string and must fit a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]
LONG_TURNS = 128
#: Characters that no text holds unescaped stand for the probe; several, in case a text holds one.
_PROBES = ("\ue010\ue011", "\ue012\ue013\ue014", "\ue015\ue016\ue017\ue018")

# What this and other common chat templates use as control strings, after their first character.
_CONTROL = r"(?=\||/?s>|/?INST\]|/?SYS>>|bos>|eos>|/?start_of_turn>|/?end_of_turn>)"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _CONTROL)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _CONTROL)


def escape(text: str) -> str:
    """Put a backslash after the first character of every control string, and of every escaped one."""
    return _ESCAPE.sub(lambda m: f"{m[1]}\\{m[2]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _role_name(role: str) -> str:
    """A role as it stands in a header: letters, digits, _ and - as they are, others as %-escaped UTF-8."""
    if role == "end":
        return "%65nd"
    return "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "".join(f"%{b:02X}" for b in c.encode()) for c in role)


def marked(turns: Turns) -> str:
    """The template of the query: ``<|role|>``, line end, escaped text, ``<|end|>``, line end."""
    return "".join(f"<|{_role_name(role)}|>\n{escape(text)}<|end|>\n" for role, text in turns)


marked.by_turn = True


def read_marked(formatted: str) -> Turns:
    """The turns of a string that :func:`marked` made."""
    out = []
    for part in formatted.split("<|end|>\n")[:-1]:
        head, text = part.split("|>\n", 1)
        out.append((unquote(head[2:]), unescape(text)))
    return out


@dataclass(frozen=True)
class Rendered:
    formatted: str
    spans: list[tuple[int, int]]  # of each turn
    texts: list[tuple[int, int]]  # of each turn's own text
    rewrites: int  # the first turn that changed what stood before it, or -1


def _text_span(render: Template, before: Turns, turn: tuple[str, str], base: str, full: str) -> tuple[int, int] | None:
    """Where the turn's text lies in ``full``, from a rendering with a probe instead."""
    for probe in _PROBES:
        if any(probe in t for _, t in (*before, turn)):
            continue
        seen = render([*before, (turn[0], probe)])
        at = seen.find(probe, len(base))
        tail = len(seen) - at - len(probe)
        if at >= 0 and seen[:at] == full[:at] and len(full) - tail >= at and (not tail or full.endswith(seen[-tail:])):
            return at, len(full) - tail
    return None


def render_incrementally(turns: Turns, render: Template) -> Rendered:
    if len(turns) > LONG_TURNS and getattr(render, "by_turn", False) and (found := _render_long(turns, render)):
        return found
    spans, texts, last = [], [], render([])
    for k, turn in enumerate(turns):
        now = render(turns[: k + 1])
        if not now.startswith(last):
            return Rendered(render(turns), [], [], k)
        spans.append((len(last), len(now)))
        own = _text_span(render, turns[:k], turn, last, now)
        if own is None:
            return Rendered(render(turns), [], [], k)
        texts.append(own)
        last = now
    return Rendered(last, spans, texts, -1)


def _render_long(turns: Turns, render: Template) -> Rendered | None:
    spans, texts, at, parts = [], [], 0, []
    start = render([])
    parts.append(start)
    at = len(start)
    for k, turn in enumerate(turns):
        before = turns[: min(k, 1)] + turns[max(1, k - 1) : k]
        base, now = render(before), render([*before, turn])
        if not now.startswith(base):
            return None
        own = _text_span(render, before, turn, base, now)
        if own is None:
            return None
        shift = at - len(base)
        parts.append(now[len(base) :])
        spans.append((at, at + len(parts[-1])))
        texts.append((own[0] + shift, own[1] + shift))
        at += len(parts[-1])
    whole = render(turns)
    return Rendered(whole, spans, texts, -1) if whole == "".join(parts) else None


_OUT = "conv_id long, formatted string, roles array<string>, turn_spans array<array<int>>, loss_spans array<array<int>>, rewrites int"


def _formatted(render: Template, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.list_(pa.int32()))
    kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), spans, spans, pa.int32()]
    names = ["conv_id", "formatted", "roles", "turn_spans", "loss_spans", "rewrites"]
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            rows = []
            sub = batch.slice(k, 200)
            for conv, given in zip(sub.column(0).to_pylist(), sub.column(1).to_pylist(), strict=True):
                turns = [(t["role"], t["text"]) for t in given]
                r = render_incrementally(turns, render)
                loss = [list(x) for (role, _), x in zip(turns, r.texts, strict=False) if role == "assistant"]
                rows.append((conv, r.formatted, [role for role, _ in turns], [list(x) for x in r.spans], loss, r.rewrites))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def format_chats(rows: DataFrame, render: Template = marked) -> DataFrame:
    """conv_id, formatted, roles, turn_spans, loss_spans ([start, end) in code points), rewrites (-1: never)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.mapInArrow(partial(_formatted, render), _OUT)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = []
        for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turns = read_marked(text)
            whole = hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()
            loss = "".join(unescape(text[a:b]) for a, b in spans)
            rows.append((conv, len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in _DIGEST.split(", ")])


def read_back(formatted: DataFrame) -> DataFrame:
    """Write what :func:`format_chats` made with :func:`marked`, and digest what the files hold."""
    written = materialize(formatted, "chats")
    return written.select("conv_id", "formatted", "loss_spans").mapInArrow(_digested, _DIGEST)
