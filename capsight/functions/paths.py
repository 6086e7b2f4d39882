"""Paths of capture files named in free text: found by priority without overlap, and put behind placeholders."""

from __future__ import annotations

import hashlib
import posixpath
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a path may be written, first in priority first; what may end it by mistake.
PATTERNS = (
    r"""(?i)(?P<quote>['"])(?P<path>.*?\.(?:pcapng|pcap))(?P=quote)""",
    r"""(?i)(?P<path>[A-Za-z]:[\\/][^"'，。；,;!?\n]*?\.(?:pcapng|pcap))""",
    r"""(?i)(?P<path>(?:/|\.\.?/)[^"'，。；,;!?\n]*?\.(?:pcapng|pcap))""",
    r"""(?i)(?<![\w./-])(?P<path>[\w\u0080-\uffff][^"'，。；,;!?\n]*?\.(?:pcapng|pcap))""",
)
CLOSING = "。；,;!?，"
_PATTERNS = [re.compile(p) for p in PATTERNS]
_STRETCH = re.compile(r"""[^"'，。；,;!?\n]+""")
_SUFFIX = re.compile(r"(?i)\.(?:pcapng|pcap)")
_QUOTE = re.compile(r"""['"]""")

SPAN = "start int, stop int, path string, placeholder string"


def _quoted(text: str) -> Iterator[tuple[int, int]]:
    """What the first of PATTERNS finds, without going over a line once for each quote in it."""
    closing = {q: [m.end() for m in _SUFFIX.finditer(text) if text[m.end() : m.end() + 1] == q] for q in "'\""}
    lines = [m.start() for m in re.finditer("\n", text)] + [len(text)]
    done = 0
    for m in _QUOTE.finditer(text):
        start, ends = m.end(), closing[m[0]]
        if m.start() < done or (at := bisect_left(ends, start)) == len(ends) or ends[at] > lines[bisect_left(lines, start)]:
            continue
        yield start, ends[at]
        done = ends[at] + 1


def _plain(text: str, pattern: re.Pattern[str]) -> Iterator[tuple[int, int]]:
    """What another of PATTERNS finds: stretch by stretch between the signs that no such path holds past its first one, each up to its last suffix."""
    for stretch in _STRETCH.finditer(text):
        last = None
        for last in _SUFFIX.finditer(text, *stretch.span()):
            pass
        if last is not None:
            for m in pattern.finditer(text, max(0, stretch.start() - 1), last.end()):
                yield m.span("path")


def spans(text: str, base: str) -> list[tuple[int, int, str, str]]:
    """(start, stop, path, placeholder) of the paths in a text, in order; of overlapping ones the first in priority.

    Relative paths count from ``base``; equal paths have equal placeholders. Time is in proportion to the text's length.
    """
    taken: list[tuple[int, int]] = []
    found = []
    for rank, pattern in enumerate(_PATTERNS):
        for start, stop in _plain(text, pattern) if rank else _quoted(text):
            at = bisect_left(taken, (start, stop))
            # taken spans are apart from each other, so only the neighbours can overlap
            if any(start < right and stop > left for left, right in taken[max(0, at - 1) : at + 1]):
                continue
            path = text[start:stop].strip().strip("\"'").rstrip(CLOSING)
            if path.lower().endswith((".pcap", ".pcapng")):
                insort(taken, (start, stop))
                whole = path if re.match(r"[A-Za-z]:[\\/]", path) else posixpath.normpath(posixpath.join(base, path))
                found.append((start, stop, whole, f"capture_{hashlib.sha256(whole.encode()).hexdigest()[:8]}"))
    return sorted(found)


@F.udtf(returnType=SPAN)
class CapturePaths:
    """One row for each path in a text. Null and texts without a capture's name have none."""

    def eval(self, text: str, base: str) -> Iterator[tuple[int, int, str, str]]:
        if text is not None and ".pcap" in text.lower():
            yield from spans(text, base)


def capture_paths(rows: DataFrame, text: str, base: str = "/") -> DataFrame:
    """``rows`` with (start, stop, path, placeholder), a row for each path; rows without one are left out."""
    return rows.lateralJoin(CapturePaths(F.col(text).outer(), F.lit(base)))


def with_placeholders(rows: DataFrame, key: str, text: str, base: str = "/") -> DataFrame:
    """(key, text, references): all rows, paths replaced by placeholders; references: (placeholder, path) in order.

    ``key`` tells rows apart. References are for the caller alone.
    """
    found = capture_paths(rows.select(key, text), text, base).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("start", "stop", "placeholder", "path"))).alias("_spans")
    )
    joined = rows.select(key, text).join(found, key, "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, span: Column) -> Column:
        kept = F.substring(F.col(text), acc["at"] + 1, span["start"] - acc["at"])
        return F.struct(F.concat(acc["out"], kept, span["placeholder"]).alias("out"), span["stop"].alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text)))
    clean = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(F.aggregate("_spans", start, step, rest))
    none = F.array().cast("array<struct<placeholder:string,path:string>>")
    references = F.transform("_spans", lambda s: F.struct(s["placeholder"].alias("placeholder"), s["path"].alias("path")))
    return joined.select(key, clean.alias(text), F.coalesce(references, none).alias("references"))


def restored(text: Column, references: Column) -> Column:
    """The text with its placeholders back as paths."""
    return F.aggregate(references, text, lambda acc, r: F.replace(acc, r["placeholder"], r["path"]))
