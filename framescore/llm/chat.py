"""Operator 4: chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string; it is never looked into. Each conversation is
rendered prefix by prefix. If the rendering of the first k turns starts with that of the first k - 1, what it adds is turn
k's span; inside it, the text is found by rendering the last turn with two probe texts and comparing the results.
If it does not start with it, the template rewrites history: the conversation is marked, and each of its texts is
found in the full rendering instead, by probing it there.

The loss mask covers the texts of assistant turns, nothing of the template.

A conversation is one training sample, so its turns meet in one row (Spark's limit for a row is 2 GB); conversations
spread over all tasks by id. Rendering every prefix costs the square of a conversation's length, which is the price of
knowing nothing about the template.

Defined cases: a null or empty text is the empty text, a null role the empty role; a null conv_id is a
conversation of its own; turns are ordered by turn, role, text, nulls first; equal rows stay and are ordered next to each other;
an empty table gives no rows; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# Strings that steer a model in common chat formats, this one's own marks among them.
OPEN, CLOSE = "<|turn|>", "<|end|>"
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
# One character at a time: a backslash, or one with which a control string begins, also inside another one. Each branch begins with
# a plain character, so that a search skips all others.
_REST = {c: "|".join(re.escape(mark[1:]) for mark in CONTROL if mark[0] == c) for c in sorted({mark[0] for mark in CONTROL})}
_ESCAPE = re.compile("|".join([r"\\", *(f"{re.escape(c)}(?={rest})" for c, rest in _REST.items())]))
_TURN = re.compile(r"<\|turn\|>((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!\|end\|>))*)<\|end\|>\n", re.S)
FORMATTED = (
    "conv_id bigint, formatted string, turns array<struct<role:string,text:string>>, "
    "spans array<struct<start:bigint,end:bigint>>, loss array<struct<start:bigint,end:bigint>>, rewrites_history boolean"
)
PROBES = ("\ue000", "\ue001")


def escape(text: str) -> str:
    """Put a backslash behind the first character of each control string, at any offset; double each backslash."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def default_template(turns: list[Turn]) -> str:
    """``<|turn|>role``, a line break, the text, ``<|end|>``, a line break; roles also escape line breaks."""
    return "".join(f"{OPEN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}{CLOSE}\n" for role, text in turns)


def read_back(formatted: str) -> list[Turn]:
    """The turns of a string that ``default_template`` made; anything else is an error."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _differ(a: str, b: str) -> int:
    """The first place at which two strings differ."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _probe(template: Template, turns: list[Turn], k: int, whole: str) -> tuple[int, int]:
    """Where the text of turn k lies in ``whole``, the rendering of ``turns``."""
    role = turns[k][0]
    with_probe = [template([*turns[:k], (role, p), *turns[k + 1 :]]) for p in PROBES]
    start = _differ(*with_probe)
    behind = len(with_probe[0]) - start - 1
    return start, len(whole) - behind


def render(template: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """(whole rendering, span of each turn, span of each turn's text, does the template rewrite history)."""
    spans, texts, before = [], [], template([])
    for k in range(len(turns)):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            whole = template(turns)
            texts = [_probe(template, turns, i, whole) for i in range(len(turns))]
            return whole, texts, texts, True
        spans.append((len(before), len(now)))
        texts.append(_probe(template, turns[: k + 1], k, now))
        before = now
    return before, spans, texts, False


def format_chats(turns: DataFrame, template: Template = default_template) -> DataFrame:
    """One row per conversation (``FORMATTED``); spans and loss count code points of ``formatted``."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(frames):
        for frame in frames:
            out = []
            for conv, own in zip(frame["conv_id"], frame["turns"]):
                pairs = [(t["role"], t["text"]) for t in own]
                whole, spans, texts, rewrites = render(template, pairs)
                loss = [s for s, (role, _) in zip(texts, pairs) if role == "assistant"]
                named = lambda x: [{"start": a, "end": b} for a, b in x]
                out.append((conv, whole, [{"role": r, "text": t} for r, t in pairs], named(spans), named(loss), rewrites))
            yield pd.DataFrame(out, columns=["conv_id", "formatted", "turns", "spans", "loss", "rewrites_history"]).astype({"conv_id": "Int64"})

    return talks.select(F.col("conv_id").cast("bigint"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")).mapInPandas(run, FORMATTED)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites_history boolean"


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted strings and their loss spans alone."""

    def run(frames):
        for frame in frames:
            out = []
            for conv, text, loss, rewrites in zip(frame["conv_id"], frame["formatted"], frame["loss"], frame["rewrites_history"]):
                turns = read_back(text)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                out.append((conv, len(turns), sha(told), len(learnt), sha(learnt), len(text), rewrites))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]).astype({"conv_id": "Int64"})

    return formatted.select("conv_id", "formatted", "loss", "rewrites_history").mapInPandas(run, DIGEST)
