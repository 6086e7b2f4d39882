"""JSON texts of any shape: sensitive parts dropped or masked at every depth, leaves as rows in key order.

The parsing of one text is a small Python function under an Arrow UDF or ``mapInArrow``; everything around it is columns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsight.functions.texts import REDACTIONS

#: Keys whose values never leave, paths that mark a value as local, bounds of a value flattened for a prompt.
SENSITIVE_KEY = (
    r"(?i)(?:api[_-]?key|authorization|token|password|secret|payload|raw[_-]?packet|pcap[_-]?path|absolute[_-]?path|log[_-]?path|"
    r"account|username|customer|client)"
)
LOCAL_PATH = dict(REDACTIONS)["PATH"]
MOST_SIGNS, MOST_ITEMS = 128, 8
#: Containers within this many others are read for a prompt or masked; deeper ones are left out there.
MOST_DEPTH = 32
#: Texts whose parsed values are held at a time.
SLICE = 256
#: Signs of leaves that are held at a time where all are asked for, 64 more counted for each leaf.
HELD_SIGNS = 1 << 22

LEAF = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("path", "kind", "value")]))
_ROW = pa.struct([(c, pa.string()) for c in ("path", "kind", "value")])
_KEY, _PATH = re.compile(SENSITIVE_KEY), re.compile(LOCAL_PATH)
_MASKS = [(kind, re.compile(pattern)) for kind, pattern in REDACTIONS]
_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{}",:])|(true|false|null)|(-?(?:0|[1-9][0-9]*))((?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?))')


def _loaded(text: str | None, whole: bool = False) -> tuple[bool, Any]:
    """(whether the text is JSON, its value). NaN and infinities are no JSON; texts beyond what ``json`` reads are, if ``whole``."""

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        return True, json.loads(text, parse_constant=refuse)
    except (json.JSONDecodeError, TypeError):
        return False, None
    except (ValueError, RecursionError):
        if not whole:
            return False, None
    try:
        return True, _parsed(text)
    except ValueError:
        return False, None


def _parsed(text: str) -> Any:
    """The value of a JSON text that is nested too deeply or has whole numbers too long for ``json``: no recursion, such numbers as decimals."""
    root, at, wanted, key = [], 0, "value", None
    held = [root]
    while wanted != "next" or len(held) > 1:
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(text[at : at + 20])
        at, here, (sign, word, digits, more) = found.end(), held[-1], found.groups()
        if wanted == "next" and sign == ",":
            wanted = "value" if isinstance(here, list) else "key"
        elif sign == ("]" if isinstance(here, list) else "}") and wanted in ("next", "first value", "first key") and len(held) > 1:
            held.pop()
            wanted = "next"
        elif wanted == "colon" and sign == ":":
            wanted = "value"
        elif wanted in ("key", "first key") and sign == '"':
            (key, at), wanted = json.decoder.scanstring(text, at), "colon"
        elif wanted in ("value", "first value") and sign not in ("]", "}", ",", ":"):
            if sign == '"':
                value, at = json.decoder.scanstring(text, at)
            elif sign or word:
                value = [] if sign == "[" else {} if sign else {"true": True, "false": False, "null": None}[word]
            else:
                value = float(digits + more) if more else int(digits) if len(digits) < 640 else Decimal(digits)
            if isinstance(here, list):
                here.append(value)
            else:
                here[key] = value
            wanted = "next"
            if sign in ("[", "{"):
                held.append(value)
                wanted = "first value" if sign == "[" else "first key"
        else:
            raise ValueError(text[at : at + 20])
    if text[at:].strip(" \t\n\r"):
        raise ValueError(text[at : at + 20])
    return root[0]


def _parts(value: dict | list, inner: bool) -> Iterator[tuple[str, Any]]:
    """(what a path goes on with, part) of an object by key, without its sensitive ones, or of a list."""
    if isinstance(value, list):
        return ((f"[{n}]", part) for n, part in enumerate(value))
    return ((f".{key}" if inner else key, value[key]) for key in sorted(value) if not _KEY.search(key))


def _scalar(value: Any) -> tuple[str, str | None]:
    """(kind, value as text) of what is no container."""
    if isinstance(value, str):
        return "string", value
    if value is None or isinstance(value, bool):
        return ("null", None) if value is None else ("boolean", "true" if value else "false")
    return "number", json.dumps(value) if isinstance(value, float) else str(value)


def leaves(value: Any) -> Iterator[tuple[str, str, str | None]]:
    """(path, kind, value) of all scalars in objects, by key, and lists, at any depth, but sensitive and local ones."""
    names, rest = [""], [_parts(value, False) if isinstance(value, dict | list) else iter(())]
    while rest:
        for names[-1], part in rest[-1]:
            if isinstance(part, dict | list):
                rest.append(_parts(part, True))
                names.append("")
                break
            if not (isinstance(part, str) and _PATH.search(part)):
                yield "".join(names), *_scalar(part)
        else:
            names.pop()
            rest.pop()


def bounded_leaves(value: Any, path: str = "", depth: int = 0) -> Iterator[tuple[str, str, str | None]]:
    """(path, kind, value) of scalars for a prompt: objects by key, lists up to MOST_ITEMS; paths keep their end, values their begin."""
    if isinstance(value, dict | list):
        if depth == MOST_DEPTH:
            return
        if isinstance(value, dict):
            parts = [(f"{path}.{name}" if path else name, value[key]) for key in sorted(value) if not _KEY.search(name := key[:MOST_SIGNS])]
        else:
            parts = [(f"{path}[{n}]", item) for n, item in enumerate(value[:MOST_ITEMS])]
        for name, part in parts:
            yield from bounded_leaves(part, name, depth + 1)
    elif path and not (isinstance(value, str) and _PATH.search(value)):
        kind = {str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
        yield path[-MOST_SIGNS:], kind, value[:MOST_SIGNS] if kind == "string" else None if value is None else json.dumps(value)


def masked(value: Any, depth: int = 0) -> Any:
    """The value without sensitive keys, its strings redacted; containers beyond MOST_DEPTH become null."""
    if isinstance(value, str):
        for kind, pattern in _MASKS:
            value = pattern.sub(lambda m, kind=kind: f"<{kind}:{hashlib.sha256(m[0].encode()).hexdigest()[:8]}>", value)
        return value
    if isinstance(value, dict | list) and depth == MOST_DEPTH:
        return None
    if isinstance(value, list):
        return [masked(item, depth + 1) for item in value]
    if isinstance(value, dict):
        return {key: masked(item, depth + 1) for key, item in value.items() if not _KEY.search(key)}
    return value


def _in_slices(texts: pa.Array, made: Callable[[list[str | None]], pa.Array], kind: pa.DataType) -> pa.Array:
    """``made`` of SLICE texts at a time, so that Python objects of few texts are held at once."""
    parts = [made(texts.slice(at, SLICE).to_pylist()) for at in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _leaf_rows(texts: list[str | None]) -> pa.Array:
    offsets, columns = [], ([], [], [])
    for text in texts:
        good, value = _loaded(text)
        offsets.append(len(columns[0]) if good else None)
        for leaf in bounded_leaves(value) if good else ():
            for column, part in zip(columns, leaf, strict=True):
                column.append(part)
    rows = pa.StructArray.from_arrays([pa.array(column, pa.string()) for column in columns], fields=list(_ROW))
    return pa.ListArray.from_arrays(pa.array([*offsets, len(columns[0])], pa.int32()), rows)


@F.arrow_udf(LEAF)
def _leaves(texts: pa.Array) -> pa.Array:
    return _in_slices(texts, _leaf_rows, pa.list_(_ROW))


@F.arrow_udf(T.StringType())
def _masked(texts: pa.Array) -> pa.Array:
    def text(raw: str | None) -> str | None:
        good, value = _loaded(raw)
        return json.dumps(masked(value), ensure_ascii=False, separators=(",", ":")) if good else None

    return _in_slices(texts, lambda some: pa.array([text(raw) for raw in some], pa.string()), pa.string())


def _portions(texts: list[str | None]) -> Iterator[list[tuple[int, str, str, str | None]]]:
    """(place of the text, path, kind, value) of all leaves of texts, about HELD_SIGNS at a time, within a text too."""
    held, signs = [], 0
    for place, text in enumerate(texts):
        good, value = _loaded(text, whole=True)
        for leaf in leaves(value) if good else ():
            held.append((place, *leaf))
            signs += 64 + len(leaf[0]) + len(leaf[2] or "")
            if signs >= HELD_SIGNS:
                yield held
                held, signs = [], 0
    if held:
        yield held


def all_leaves(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, kind, value): all leaves of JSON texts, whole, a row each; none of what is no JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                for found in _portions(batch.column(text).to_pylist()):
                    places, *columns = zip(*found, strict=True)
                    arrays = [batch.column(key).take(pa.array(places, pa.int64())), *(pa.array(column, pa.string()) for column in columns)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[key, "path", "kind", "value"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, path string, kind string, value string")


def flattened(text: Column) -> Column:
    """array of (path, kind, value) of a JSON text's leaves within the bounds of a prompt; null for what is no JSON."""
    return _leaves(text)


def redacted_json(text: Column) -> Column:
    """A JSON text without its sensitive keys and with redacted strings, keys in their order; null for what is no JSON."""
    return _masked(text)


def short_features(leaves_: Column, most: int = 64) -> Column:
    """The first value of each last key among flattened leaves, at most ``most``, as a map."""
    named = F.transform(leaves_, lambda x: F.struct(F.regexp_extract(x["path"], r"([^.\[]*)(?:\[[0-9]+\])*$", 1).alias("k"), x["value"].alias("v")))
    keys = F.slice(F.array_distinct(F.transform(named, lambda x: x["k"])), 1, most)
    first = lambda k: F.get(F.filter(named, lambda x: x["k"] == k), F.lit(0))["v"]
    return F.map_from_arrays(keys, F.transform(keys, first))
