import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runledger.sources.parsers import FORMATS, AmbiguousFormat, detect_format, epoch, parse_lines, scalar


def records(text, kind, **how):
    return list(parse_lines(text.splitlines(keepends=True), kind, **how))


READ = {
    "stream": [("7,-3,0.25,x", {"field_1": 7, "field_2": -3, "field_3": 0.25, "field_4": "x"}), ('"p, q",,true', {"field_1": "p, q", "field_2": None, "field_3": True}), ("08,-0,1E-2", {"field_1": "08", "field_2": 0, "field_3": 0.01})],
    "keyvalue": [("speed=12.5 name='left wheel' ok=false", {"speed": 12.5, "name": "left wheel", "ok": False}), ("a==b c=", {"a": "=b", "c": None})],
    "whitespace": [("  4\t5.5   six ", {"field_1": 4, "field_2": 5.5, "field_3": "six"})],
    "jsonl": [('{"k":[1,{"m":null}],"n":-2e3}', {"k": [1, {"m": None}], "n": -2000.0})],
    "json": [('[ {"k": "v"} ]', {"k": "v"})],
    "tsv": [('col\tother\n"a\tb"\t', {"col": "a\tb", "other": None})],
    "csv": [("x, y\n1, 2", {"x": 1, "y": 2}), ('x,y\n"say ""hi""",+5', {"x": 'say "hi"', "y": "+5"}), ('﻿﻿x\n"first\nsecond"', {"x": "first\nsecond"})],
}


@pytest.mark.parametrize("kind", READ)
def test_one_record_of_each_kind(kind):
    for text, want in READ[kind]:
        (got,) = records(f"{text}\n", kind)
        assert got.record == want and got.error is None


@pytest.mark.parametrize(
    "kind, text, reason",
    [
        ("csv", "a,b\n1\n", "expected 2"),
        ("csv", "a,a\n1,2\n", "unique"),
        ("jsonl", '{"a":NaN}\n', "non-finite"),
        ("jsonl", '{"a":1e999}\n', "non-finite"),
        ("jsonl", '{"a":1,"a":2}\n', "duplicate"),
        ("jsonl", '{"x":{"a":1,"a":2}}\n', "duplicate"),
        ("jsonl", "[1]\n", "JSON object"),
        ("jsonl", "\n", "empty line"),
        ("keyvalue", "a=1 b\n", "key=value"),
        ("keyvalue", "a=1 a=2\n", "duplicate"),
    ],
)
def test_rejects(kind, text, reason):
    (found,) = records(text, kind)
    assert found.record is None and reason in found.error


def test_names_and_numbers_of_fields_are_limited():
    wide = "{" + ",".join(f'"f{k}":{k}' for k in range(6)) + "}\n"
    assert records(wide, "jsonl", max_fields=6)[0].record and "at most 5" in records(wide, "jsonl", max_fields=5)[0].error
    long = "long" * 256
    assert records(f'{{"{long}":0}}\n', "jsonl")[0].record and records(f'{{"{long}s":0}}\n', "jsonl")[0].error == "field names are too long"


def test_an_array_is_read_up_to_what_is_wrong_with_it():
    assert [(r.record, bool(r.error)) for r in records('[{"k":1},{"k":2}; {"k":3}]', "json")] == [({"k": 1}, False), ({"k": 2}, False), (None, True)]
    assert "trailing" not in str(records('[{"k":1},]', "json")[0]) and records('[{"k":1},]', "json")[-1].record is None
    assert records('[{"k":1}]\n[]', "json")[-1].error == "content after the JSON array"
    assert records("[ ]", "json") == [] and records('{"k":1}', "json")[0].error == "expected a JSON array"
    assert [r.record["k"] for r in records('[{"k":\n4},\n\n{"k"\n:5}]', "json")] == [4, 5]


def test_parsing_is_lazy():
    def lines():
        yield '{"a":1}\n'
        raise AssertionError("read ahead")

    assert next(parse_lines(lines(), "jsonl")).record == {"a": 1}


def test_hostile_text_is_inert():
    r = random.Random(7)
    bad = ["__import__('os').system('x')", "$(touch x)", "=cmd|' /C calc'!A0", *("".join(chr(r.randrange(1, 300)) for _ in range(r.randrange(60))) for _ in range(250))]
    for kind in FORMATS:
        for text in bad:
            for found in parse_lines([text], kind):
                assert (found.record is None) != (found.error is None)


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_scalar_keeps_or_coerces(text):
    v = scalar(text)
    assert v is None or isinstance(v, (bool, int, float)) or v == text.strip()


@pytest.mark.parametrize("text, kind", [('[{"a":1}]', "json"), ('{"a":1}\n{"b":2}', "jsonl"), ("a,b\n1,2", "csv"), ("a\tb\n1\t2", "tsv"), ("a=1 b=2", "keyvalue"), ("1 2\n3 4", "whitespace")])
def test_detection(text, kind):
    assert detect_format(text) == kind


@pytest.mark.parametrize("text", ["", "1,2\n3,4", "hello"])
def test_detection_does_not_guess(text):
    with pytest.raises(AmbiguousFormat):
        detect_format(text, "x.csv")


def test_epoch():
    assert epoch("1970-01-01T00:00:01Z") == 1 and epoch("1970-01-01T01:00:00+01:00") == 0
    assert epoch("1970-01-01T00:00:01") is None and epoch("x") is None and epoch(True) is None and epoch(2.5) == 2.5
