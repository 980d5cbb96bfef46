"""Column expressions for scalar coercion, times, and safe text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = r"^-?(?:0|[1-9][0-9]*)\z"
FLOAT = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"
ZONED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})\z"


def coerce(text: Column) -> dict[str, Column]:
    """kind, text and num of a delimited value: empty is null, true and false, canonical integers and finite floats; all else is the stripped text."""
    t = F.regexp_replace(text, r"^\s+|\s+\z", "")
    whole, real = t.rlike(INTEGER), t.rlike(FLOAT)
    value = F.try_cast(t, "double") if hasattr(F, "try_cast") else t.try_cast("double")
    finite = real & (F.abs(value) < float("inf"))
    kind = F.when(t.isNull() | (t == ""), "null").when(t.isin("true", "false"), "bool").when(whole, "int").when(finite, "float").otherwise("str")
    exact = F.abs(t.try_cast("decimal(38,0)")) <= (1 << 53)
    num = F.when(kind == "float", value).when((kind == "int") & exact, value)
    return {"kind": kind, "text": F.when(kind != "null", t), "num": num}


def temporal(kind: Column, text: Column, num: Column) -> Column:
    """Epoch seconds: a finite number, or an ISO-8601 time with an offset; a time without one is null."""
    t = F.when((kind == "str") & text.rlike(ZONED), F.unix_micros(text.try_cast("timestamp")) / F.lit(1e6))
    return F.when(kind.isin("int", "float"), num).otherwise(t)


def csv_safe(text: Column) -> Column:
    """Text that a spreadsheet will not take for a formula: an apostrophe before a first = + - or @."""
    return F.when(text.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


#: Characters that markdown_safe escapes with a backslash.
MARKDOWN = "\\`*_{}[]()#+-.!|"


def markdown_safe(text: Column) -> Column:
    """One line of text without Markdown or HTML meaning."""
    out = F.regexp_replace(text, r"[\r\n]+", " ")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    return F.regexp_replace(out, r"([\\`*_{}\[\]()#+\-.!|])", r"\\$1")


def sparkline(values: Column, ascii_only: bool = False) -> Column:
    """A glyph of eight levels for each value; a flat series shows the middle level."""
    glyphs = F.array(*map(F.lit, "_.-~=+*#" if ascii_only else "▁▂▃▄▅▆▇█"))
    lo, hi = F.array_min(values), F.array_max(values)
    level = lambda v: F.when(hi > lo, F.rint((v - lo) / (hi - lo) * 7)).otherwise(F.lit(3)).cast("int")
    return F.array_join(F.transform(values, lambda v: F.get(glyphs, level(v))), "")
