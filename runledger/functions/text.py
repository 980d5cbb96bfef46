"""Driver-side text safety: names, paths, terminals and Markdown."""

from __future__ import annotations

import os
import re

RESERVED = {"con", "prn", "aux", "nul", *(f"com{n}" for n in range(1, 10)), *(f"lpt{n}" for n in range(1, 10))}


def safe_name(name: str) -> str:
    """A session's name if it is one path component of at most 120 characters that every system can hold."""
    if not name or name != name.strip() or len(name) > 120 or name in (".", "..") or re.search(r'[\x00-\x1f/\\:*?"<>|]', name) or name.endswith(".") or name.split(".")[0].lower() in RESERVED:
        raise ValueError(f"unsafe name: {terminal_safe(name)!r}")
    return name


def safe_output(base: str, wanted: str) -> str:
    """The path of ``wanted`` if it stays below ``base``, links resolved."""
    root, path = os.path.realpath(base), os.path.realpath(os.path.join(base, wanted))
    if os.path.commonpath([root, path]) != root or path == root:
        raise ValueError(f"path leaves its folder: {terminal_safe(wanted)!r}")
    return path


def terminal_safe(value: object, most: int = 4096) -> str:
    """Text without control characters, cut with an ellipsis."""
    text = re.sub(r"[\x00-\x1f\x7f-\x9f]", lambda m: f"\\x{ord(m[0]):02x}", str(value))
    return text if len(text) <= most else text[: most - 1] + "…"


def markdown_safe(value: object) -> str:
    """One line without Markdown or HTML meaning."""
    text = re.sub(r"[\r\n]+", " ", str(value)).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return re.sub(r"([\\`*_{}\[\]()#+\-.!|])", r"\\\1", text)


def code_span(value: object) -> str:
    """A code span whose fence is longer than any run of backticks in it."""
    text = re.sub(r"[\r\n]+", " ", str(value))
    fence = "`" * (max(map(len, re.findall(r"`+", text)), default=0) + 1)
    return f"{fence} {text} {fence}" if "`" in text else f"{fence}{text}{fence}"


def csv_safe(value: object) -> object:
    """Text that no spreadsheet takes for a formula; numbers stay."""
    if isinstance(value, str) and value.lstrip()[:1] in ("=", "+", "-", "@"):
        return "'" + value
    return value


def key_values(items: list[str]) -> dict[str, str]:
    """KEY=VALUE options; of equal keys the last one holds."""
    found = {}
    for item in items:
        key, equals, value = item.partition("=")
        if not equals or not 0 < len(key) <= 120 or len(value) > 4096:
            raise ValueError(f"expected KEY=VALUE: {terminal_safe(item, 80)}")
        found[key] = value
    return found


def sparkline(values: list[float], ascii_only: bool = False) -> str:
    glyphs = "_.-~=+*#" if ascii_only else "▁▂▃▄▅▆▇█"
    if not values:
        return ""
    lo, hi = min(values), max(values)
    return "".join(glyphs[round((v - lo) / (hi - lo) * 7) if hi > lo else 3] for v in values)
