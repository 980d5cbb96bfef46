"""Strict parsing rules of the text formats, as plain Python: what executors run at the edge, and nothing else.

Nothing in the input is ever evaluated. A line or value that breaks a rule is a reject with its reason; it never
raises.
"""

from __future__ import annotations

import csv
import json
import math
import re
import shlex
from collections.abc import Iterable, Iterator
from datetime import datetime
from typing import Any, NamedTuple

FORMATS = ("json", "jsonl", "csv", "tsv", "whitespace", "keyvalue", "stream")
LINE_FORMATS = ("jsonl", "whitespace", "keyvalue", "stream")
#: Limits of one record: fields, bytes of a name, bytes of all names, characters of a CSV field or pending JSON value.
MAX_FIELDS, MAX_NAME, MAX_NAMES, MAX_VALUE = 1000, 1024, 65_536, 16 << 20
EXACT = 1 << 53
INTEGER = re.compile(r"-?(?:0|[1-9]\d*)", re.ASCII)
REAL = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", re.ASCII)
ZONE = re.compile(r"(?:[Zz]|[+-]\d\d:?\d\d(?::?\d\d)?)\Z")


class Parsed(NamedTuple):
    """A record, or the reason why there is none."""

    record: dict[str, Any] | None
    error: str | None = None


class Rejected(ValueError):
    """A rule that the input breaks."""


def scalar(value: str) -> Any:
    """null for empty text, true and false, canonical integers, canonical finite floats; else the stripped text."""
    text = value.strip()
    if text == "":
        return None
    if text in ("true", "false"):
        return text == "true"
    if INTEGER.fullmatch(text) and len(text) < 4000:
        return int(text)
    if REAL.fullmatch(text) and math.isfinite(number := float(text)):
        return number
    return text


def _pairs(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    found: dict[str, Any] = {}
    for k, v in pairs:
        if k in found:
            raise Rejected(f"duplicate JSON key: {k}")
        found[k] = v
    return found


def _constant(name: str) -> Any:
    raise Rejected(f"non-finite JSON number: {name}")


def decoder() -> json.JSONDecoder:
    """Strict JSON; made where it is used, since a decoder cannot be shipped."""
    return json.JSONDecoder(object_pairs_hook=_pairs, parse_constant=_constant)


def _finite(value: Any, path: str) -> None:
    stack = [(value, path)]
    while stack:
        v, at = stack.pop()
        if isinstance(v, float) and not math.isfinite(v):
            raise Rejected(f"non-finite number at {at}")
        if isinstance(v, dict):
            stack += [(x, f"{at}.{k}") for k, x in v.items()]
        elif isinstance(v, list):
            stack += [(x, f"{at}[{n}]") for n, x in enumerate(v)]


def checked(record: Any, max_fields: int = MAX_FIELDS) -> Parsed:
    """The record if it keeps the limits and holds finite numbers only."""
    if not isinstance(record, dict):
        return Parsed(None, "record must be a JSON object")
    if len(record) > max_fields:
        return Parsed(None, f"record has {len(record)} fields; at most {max_fields} are allowed")
    sizes = [len(k.encode("utf-8", "surrogatepass")) for k in record]
    if any(n > MAX_NAME for n in sizes) or sum(sizes) > MAX_NAMES:
        return Parsed(None, "field names are too long")
    try:
        _finite(record, "$")
        json.dumps(record, ensure_ascii=False).encode()
    except (Rejected, UnicodeError, RecursionError) as why:
        return Parsed(None, str(why) or "value is nested too deeply")
    return Parsed(record)


def _json_line(line: str) -> Any:
    return decoder().decode(line)


def _key_values(line: str) -> dict[str, Any]:
    found: dict[str, Any] = {}
    for part in shlex.split(line):
        key, equals, value = part.partition("=")
        if not equals or not key:
            raise Rejected(f"expected key=value: {part[:80]}")
        if key in found:
            raise Rejected(f"duplicate key: {key}")
        found[key] = scalar(value)
    return found


def _numbered(parts: Iterable[str]) -> dict[str, Any]:
    return {f"field_{n}": scalar(p) for n, p in enumerate(parts, 1)}


def _stream_line(line: str) -> dict[str, Any]:
    rows = list(csv.reader([line], strict=True))
    if len(rows) != 1:
        raise Rejected("expected one row on a line")
    return _numbered(rows[0])


PARSE_LINE = {"jsonl": _json_line, "keyvalue": _key_values, "whitespace": lambda x: _numbered(x.split()), "stream": _stream_line}


def parse_line(line: str, kind: str, max_fields: int = MAX_FIELDS) -> Parsed:
    """One line of a line format."""
    text = line.rstrip("\r\n")
    if not text.strip():
        return Parsed(None, "empty line")
    try:
        return checked(PARSE_LINE[kind](text), max_fields)
    except (ValueError, csv.Error, RecursionError) as why:
        return Parsed(None, str(why) or "malformed line")


def without_bom(lines: Iterable[str]) -> Iterator[str]:
    for n, line in enumerate(lines):
        yield line.lstrip("﻿") if n == 0 else line


def _delimited(lines: Iterator[str], delimiter: str, max_fields: int) -> Iterator[Parsed]:
    csv.field_size_limit(MAX_VALUE)
    reader = csv.reader(lines, delimiter=delimiter, strict=True)
    try:
        header = next(reader, None)
        if header is None:
            return
        names = [h.strip() for h in header]
        if not all(names) or len(set(names)) != len(names):
            yield Parsed(None, "header names must be non-empty and unique")
            return
        for row in reader:
            if len(row) != len(names):
                yield Parsed(None, f"row has {len(row)} fields; expected {len(names)}")
            else:
                yield checked({k: scalar(v) for k, v in zip(names, row, strict=True)}, max_fields)
    except csv.Error as why:
        yield Parsed(None, f"malformed row, parsing stopped: {why}")


def _array(chunks: Iterator[str], max_fields: int) -> Iterator[Parsed]:
    """A JSON array, item by item: a syntax error stops it, earlier items stay valid."""
    held, at, started, after_comma, decode = "", 0, False, False, decoder().raw_decode
    ended = False

    def more() -> bool:
        nonlocal held, at, ended
        chunk = next(chunks, None)
        if chunk is None:
            ended = True
            return False
        held, at = held[at:] + chunk, 0
        return True

    def skip() -> str:
        nonlocal at
        while True:
            while at < len(held) and held[at] in " \t\r\n":
                at += 1
            if at < len(held) or not more():
                return held[at : at + 1]

    if skip() != "[":
        yield Parsed(None, "expected a JSON array")
        return
    at += 1
    while True:
        c = skip()
        if c == "]" and not after_comma:
            at += 1
            if skip():
                yield Parsed(None, "content after the JSON array")
            return
        if started and not after_comma:
            if c != ",":
                yield Parsed(None, "expected , or ] in the JSON array" if c else "the JSON array does not end")
                return
            at += 1
            after_comma = True
            continue
        while True:
            try:
                value, end = decode(held, at)
                if end < len(held) or ended or not more():
                    break
            except Rejected as why:
                value, end = why, None
                break
            except (ValueError, RecursionError) as why:
                if len(held) - at > MAX_VALUE:
                    yield Parsed(None, "a JSON value is too long")
                    return
                if not more():
                    yield Parsed(None, f"malformed JSON, parsing stopped: {why}")
                    return
        if end is None:
            yield Parsed(None, str(value))
            return
        at, started, after_comma = end, True, False
        yield checked(value, max_fields)


def parse_lines(lines: Iterable[str], kind: str, max_fields: int = MAX_FIELDS) -> Iterator[Parsed]:
    """One result for each logical record, lazily and in order."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format: {kind}")
    source = without_bom(lines)
    if kind in LINE_FORMATS:
        for line in source:
            yield parse_line(line, kind, max_fields)
    elif kind == "json":
        yield from _array(source, max_fields)
    else:
        yield from _delimited(source, "," if kind == "csv" else "\t", max_fields)


def canonical(record: dict[str, Any]) -> str:
    """Sorted keys and no spaces: equal records have equal payloads, and 1 differs from 1.0."""
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def epoch(value: Any) -> float | None:
    """Seconds of a finite number, or of an ISO-8601 time with an offset."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return float(value) if abs(value) <= EXACT or isinstance(value, float) else None
    if isinstance(value, str) and ZONE.search(value):
        try:
            return datetime.fromisoformat(value).timestamp()
        except ValueError:
            return None
    return None


def cell(value: Any) -> tuple[str, str | None, float | None]:
    """kind, text and number of a value."""
    if value is None:
        return "null", None, None
    if isinstance(value, bool):
        return "bool", "true" if value else "false", None
    if isinstance(value, int):
        return "int", str(value), float(value) if abs(value) <= EXACT else None
    if isinstance(value, float):
        return "float", repr(value), value
    if isinstance(value, str):
        return "str", value, None
    return ("list" if isinstance(value, list) else "dict"), canonical(value), None


class AmbiguousFormat(ValueError):
    """The sample fits no format, or more than one."""


def _is_number(text: str) -> bool:
    try:
        float(text)
        return True
    except ValueError:
        return False


PAIR = re.compile(r"""\s*[^\s=]+=(?:"[^"]*"|'[^']*'|\S*)(?:\s+[^\s=]+=(?:"[^"]*"|'[^']*'|\S*))*\s*\Z""")


def detect_format(sample: str, filename: str | None = None) -> str:
    """The format of a sample's first 20 lines; raises ``AmbiguousFormat`` rather than guess."""
    text = sample.lstrip("﻿")
    lines = [x for x in text.splitlines() if x.strip()][:20]
    if not lines:
        raise AmbiguousFormat("the sample is empty")
    if text.lstrip().startswith("["):
        return "json"

    def is_object(line: str) -> bool:
        try:
            return isinstance(json.loads(line), dict)
        except ValueError:
            return False

    if all(map(is_object, lines)):
        return "jsonl"
    if all(PAIR.match(x) for x in lines[:10]):
        return "keyvalue"
    for kind, delimiter in (("tsv", "\t"), ("csv", ",")):
        if delimiter not in lines[0]:
            continue
        try:
            rows = list(csv.reader(lines, delimiter=delimiter, strict=True))
        except csv.Error:
            continue
        header = [h.strip() for h in rows[0]]
        if len(header) > 1 and all(header) and len(set(header)) == len(header) and not any(map(_is_number, header)) and len(rows) > 1:
            return kind
    suffix = (filename or "").rpartition(".")[2].lower()
    if suffix in ("jsonl", "ndjson") and any(map(is_object, lines)):
        return "jsonl"
    parts = [x.split() for x in lines]
    if len(parts[0]) > 1 and all(len(p) == len(parts[0]) and all(map(_is_number, p)) for p in parts):
        return "whitespace"
    raise AmbiguousFormat("name the format: the sample fits none of them without doubt")
