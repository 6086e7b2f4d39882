"""Chat formatting into budgeted, turn-aligned windows with a loss mask.

Prefix sums of the turns' token counts choose how many turns fit a window. A leading system turn
stands in every window; a window after the first repeats up to ``history`` tokens of the turns
before it, masked. Every assistant text is a target exactly once, in the window where its turn
is new. A turn longer than the budget gets a window of its own, whole.

A turn is written ``### role: text</turn>\\n``. Inside role and text a backslash stands before
each backslash, ``#``, ``<`` and, in roles, ``:``, so no control string can occur there, and
taking the backslashes away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET, HISTORY = 1024, 256
#: Tokens that the marks of a turn count as.
OVERHEAD = 6

_TEXT_CONTROL, _ROLE_CONTROL, _ESCAPED = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]"), re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.DOTALL)

_WINDOW = pa.struct(
    [
        ("window", pa.int32()), ("first_turn", pa.int32()), ("n_turns", pa.int32()), ("n_repeated", pa.int32()),
        ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)
WINDOW_DDL = (
    "struct<window:int,first_turn:int,n_turns:int,n_repeated:int,text:string,loss:array<struct<start:int,end:int>>>"
)


def escape(text: str, control: re.Pattern = _TEXT_CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def spans(tokens: list[int], system: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """(first repeated turn, first new turn, one past the last) of each window over the turns after the system turn."""
    total = np.concatenate([[0], np.cumsum(tokens)])
    out, at = [], 0
    while at < len(tokens):
        room = budget - system
        back = int(np.searchsorted(total, total[at] - history)) if at else 0
        back = min(back, at)
        while back < at and total[at + 1] - total[back] > room:  # history gives way to the first new turn
            back += 1
        end = max(at + 1, int(np.searchsorted(total, total[back] + room, side="right")) - 1)
        out.append((back, at, end))
        at = end
    return out


def windows(turns: list[tuple[str, str]], tokens: list[int], budget: int, history: int) -> list[dict]:
    """The windows of one conversation of (role, text) turns."""
    lead = 1 if turns and turns[0][0] == "system" else 0
    chosen = spans(tokens[lead:], sum(tokens[:lead]), budget, history) or [(0, 0, 0)] * bool(turns)
    out = []
    for number, (back, new, end) in enumerate(chosen):
        parts, loss, at = [], [], 0
        shown = list(range(lead)) + list(range(lead + back, lead + end))
        for turn in shown:
            role, text = turns[turn]
            head, body = f"### {escape(role, _ROLE_CONTROL)}: ", escape(text)
            if role == "assistant" and turn >= lead + new:
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts.append(f"{head}{body}</turn>\n")
            at += len(parts[-1])
        repeated = len(shown) - (end - new) - (lead if number == 0 else 0)
        out.append({"window": number, "first_turn": 0 if number == 0 else lead + new, "n_turns": len(shown), "n_repeated": repeated, "text": "".join(parts), "loss": loss})
    return out


def read_back(found: list[dict]) -> tuple[list[tuple[str, str]], str]:
    """The turns, and all text under the loss mask, of a conversation's windows in order."""
    turns, learned = [], []
    for window in sorted(found, key=lambda w: w["window"]):
        at, inside = 0, []
        for m in _TURN.finditer(window["text"]):
            if m.start() != at:
                break
            inside.append((unescape(m[1]), unescape(m[2])))
            at = m.end()
        if at != len(window["text"]) or len(inside) != window["n_turns"]:
            raise ValueError(f"window {window['window']} does not read as {window['n_turns']} turns")
        turns += inside[window["n_repeated"] :]
        learned += [unescape(window["text"][s["start"] : s["end"]]) for s in window["loss"]]
    return turns, "".join(learned)


def _counter(tokenizer_path: str | None) -> Callable[[list[str]], list[int]]:
    if tokenizer_path is None:  # about four bytes a token
        return lambda texts: [-(-len(t.encode()) // 4) for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _format(budget: int, history: int, tokenizer_path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer_path)
        for batch in batches:
            out = []
            for turns in batch.column("turns"):
                pairs = [(t["role"], t["text"]) for t in turns.as_py()]
                tokens = [n + OVERHEAD for n in count([text for _, text in pairs])]
                out.append(windows(pairs, tokens, budget, history))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(out, pa.list_(_WINDOW))], names=["conv_id", "windows"])

    return run


def format_conversations(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer_path: str | None = None) -> DataFrame:
    """(conv_id, windows) of each conversation of ``rows`` (conv_id, turn, role, text).

    ``budget`` tokens a window, ``history`` of them at most repeated; tokens are those of the
    tokenizer file, or a quarter of the bytes. Turns go by number, equal numbers by role and text,
    null numbers first; repeated rows are turns of their own. Null roles and texts are empty; rows
    of null conv_id are one conversation. Other columns are not read. A conversation is the unit of
    work and must fit one task; conversations themselves are dealt by hash.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .mapInArrow(_format(budget, history, tokenizer_path), f"conv_id long, windows array<{WINDOW_DDL}>")
    )


def window_rows(formatted: DataFrame) -> DataFrame:
    """One row per window: conv_id, window, first_turn, n_turns, n_repeated, text, loss."""
    return formatted.select("conv_id", F.inline("windows"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for found in batch.column("windows").to_pylist():
            turns, learned = read_back(found)
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((len(turns), _sha(whole), len(learned), _sha(learned), sum(len(w["text"]) for w in found)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the windows back gives, per conversation."""
    return formatted.mapInArrow(
        _digests,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
