import json
import os

import pytest
from pyspark.sql import functions as F

from runledger.functions import scalars, text
from runledger.operators.downsample import downsample, missing_markers
from runledger.operators.replay import replay
from runledger.plans import render, sessions
from runledger.plans.inspect import compare_sessions, inspect_source
from runledger.sources.generate import PROFILES, generate
from runledger.sources.text import cells_from, parse_source, records_of, rejects_of


def write(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body, encoding="utf-8", newline="")
    return str(p)


def options(tmp_path, **how):
    return sessions.RecordOptions(**({"name": "demo", "workspace": str(tmp_path / "ws")} | how))


def test_record_verify_tamper_and_names(spark, tmp_path):
    source = write(tmp_path, "a.jsonl", '{"t":0,"x":1}\nbad\n{"t":1,"x":2}\n')
    s = sessions.record(spark, source, options(tmp_path, input_format="jsonl", roles={"time": "t"}, units={"x": "m"}))
    assert (s.manifest["valid_record_count"], s.manifest["invalid_record_count"]) == (2, 1) and s.verify(spark) == []
    assert [r.record for r in s.rejects(spark).collect()] == [2]
    assert sessions.record(spark, source, options(tmp_path, input_format="jsonl")).name == "demo-2"
    again = write(tmp_path, "b.jsonl", '{"t":0,"x":3}\n')
    assert sessions.record(spark, again, options(tmp_path, input_format="jsonl", overwrite=True)).manifest["record_count"] == 1
    assert [x.name for x in sessions.list_sessions(str(tmp_path / "ws"))] == ["demo", "demo-2"]
    raw = next(p for p in (tmp_path / "ws/demo-2/raw").iterdir() if p.name.startswith("part"))
    os.remove(raw.parent / f".{raw.name}.crc") if (raw.parent / f".{raw.name}.crc").exists() else None
    raw.write_text("changed\n")
    assert any(w.startswith("hash mismatch: raw/") for w in sessions.Session.open(str(tmp_path / "ws/demo-2")).verify(spark))
    report = sessions.report(spark, sessions.Session.open(str(tmp_path / "ws/demo-2")))
    assert "FAILED" in report


def test_nothing_is_published_on_failure(spark, tmp_path):
    source = write(tmp_path, "long.jsonl", '{"a":"' + "x" * 100 + '"}\n')
    with pytest.raises(Exception, match="longer than 32"):
        sessions.record(spark, source, options(tmp_path, input_format="jsonl", max_line_bytes=32))
    assert [n for n in os.listdir(tmp_path / "ws")] == []
    with pytest.raises(ValueError, match="unknown fields"):
        sessions.record(spark, write(tmp_path, "c.jsonl", '{"a":1}\n'), options(tmp_path, input_format="jsonl", units={"b": "m"}))
    with pytest.raises(ValueError, match="needs"):
        sessions.record(spark, source, options(tmp_path, roles={"target": "a"}))


def test_manifest_rules(tmp_path):
    folder = tmp_path / "s"
    folder.mkdir()
    (folder / "manifest.json").write_text(json.dumps({"session_format_version": 9}))
    with pytest.raises(ValueError, match="format"):
        sessions.Session.open(str(folder))
    for name in ("../x", "a/b", "", "con", "x" * 121, " a"):
        with pytest.raises(ValueError):
            text.safe_name(name)
    with pytest.raises(ValueError):
        text.safe_output(str(tmp_path), "../out.svg")
    os.symlink(folder, tmp_path / "link")
    with pytest.raises(ValueError, match="links"):
        sessions.Session.open(str(tmp_path / "link"))


def test_compare(spark, tmp_path):
    a = write(tmp_path, "a.jsonl", '{"x":2}\n{"x":4}\n')
    b = write(tmp_path, "b.jsonl", '{"x":1}\n{"x":2}\n')
    c = compare_sessions([a, b], goal="lower:x", spark=spark)
    assert c.fields["x"]["improvement_percent"]["b.jsonl"] == 50
    c = compare_sessions([a, a], spark=spark)
    assert c.sources == ["a.jsonl", "a.jsonl#2"] and "improvement_percent" not in c.fields["x"]
    for kind in ("terminal", "json", "markdown", "csv"):
        assert "x" in render.comparison_text(c, kind)
    with pytest.raises(ValueError):
        compare_sessions([a], spark=spark)


def test_compare_units_and_rates(spark, tmp_path):
    def make(name, unit, step, n):
        source = write(tmp_path, f"{name}.jsonl", "".join(f'{{"t":{i * step},"x":1}}\n' for i in range(n)))
        return sessions.record(spark, source, options(tmp_path, name=name, input_format="jsonl", roles={"time": "t"}, units={"x": unit})).path

    a, b, c = make("a", "m", 1, 3), make("b", "s", 1, 3), make("c", "m", 0.5, 5)
    assert not compare_sessions([a, b], goal="lower:x", spark=spark).fields["x"]["comparable"]
    found = compare_sessions([a, c], spark=spark)
    assert not found.fields["x"]["comparable"] and found.timing["shared_relative_range"] == [0, 2]


def test_convert_and_csv_safety(spark, tmp_path):
    source = write(tmp_path, "a.csv", 'a,b\n"two\nlines",1\nbroken\n=2+2,2\n')
    out = str(tmp_path / "out.csv")
    assert sessions.convert(spark, source, out, "csv", "csv") == (2, 1)
    body = "".join(p.read_text() for p in (tmp_path / "out.csv").iterdir() if p.name.startswith("part"))
    assert body.splitlines()[0] == "a,b" and "'=2+2" in body
    with pytest.raises(FileExistsError):
        sessions.convert(spark, source, out, "csv", "csv")
    assert sessions.convert(spark, source, out, "jsonl", "csv", overwrite=True) == (2, 1)
    assert text.csv_safe(" @SUM(A:A)") == "' @SUM(A:A)" and text.csv_safe("ordinary") == "ordinary" and text.csv_safe(-1) == -1


def test_text_safety(spark):
    assert text.terminal_safe("a\x1b[0m") == "a\\x1b[0m" and len(text.terminal_safe("x" * 5000)) == 4096
    assert text.markdown_safe("<b>*x*\n") == "&lt;b&gt;\\*x\\* " and text.code_span("a``b") == "``` a``b ```"
    row = spark.createDataFrame([("<b>*x*\n", " =1")], "a string, b string").select(scalars.markdown_safe(F.col("a")), scalars.csv_safe(F.col("b"))).first()
    assert tuple(row) == ("&lt;b&gt;\\*x\\* ", "' =1")
    assert text.sparkline([0, 7]) == "▁█" and text.sparkline([1, 1], True) == "~~"
    assert text.key_values(["a=1", "a=2"]) == {"a": "2"}


def test_files_keep_their_order(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k in range(3):
        write(tmp_path / "d", f"{k}.jsonl", "".join(f'{{"n":{k * 100 + i}}}\n' for i in range(100)) + ("\n" if k == 1 else ""))
    parsed = parse_source(spark, str(tmp_path / "d"), "jsonl")
    cells = cells_from(records_of(parsed)).orderBy("record_index").collect()
    assert [c.num for c in cells] == list(range(300)) and [c.record_index for c in cells] == list(range(300))
    assert [(r.record, r.reason) for r in rejects_of(parsed).collect()] == [(201, "empty line")]


def test_empty_source(spark, tmp_path):
    found = inspect_source(write(tmp_path, "e.jsonl", ""), spark=spark, input_format="jsonl")
    assert found.record_count == 0 and [f["check_id"] for f in found.quality] == ["empty-data"]


def test_downsample_keeps_extrema(spark):
    rows = [("s", "x", i, float(i), -500.0 if i == 100 else 9999.0 if i == 700 else float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "session_id string, field string, record_index long, x double, y double")
    got = downsample(df, 50).collect()
    assert len(got) <= 54 and {-500.0, 9999.0} <= {r.y for r in got} and {0, 999} <= {r.record_index for r in got}
    gaps = df.withColumn("y", F.when(F.col("record_index") % 17 != 0, F.col("y")))
    assert 0 < missing_markers(gaps, 40).count() <= 40


def test_replay(spark):
    df = spark.createDataFrame([("s", 0, 0.0), ("s", 1, 2.0), ("s", 2, None)], "session_id string, record_index long, t double")
    slept = []
    assert len(list(replay(df, 2.0, sleep=slept.append))) == 3 and slept == [1.0]
    with pytest.raises(ValueError):
        list(replay(df, 0))


def test_generators(spark):
    for p in PROFILES:
        a = generate(spark, p, seed=1, noise=0.1).orderBy("record_index").collect()
        assert a == generate(spark, p, seed=1, noise=0.1).repartition(3).orderBy("record_index").collect()
        assert len(a) > 101 if p == "duplicate-samples" else len(a) < 101 if p in ("missing-samples", "packet-loss") else len(a) == 101
    at = lambda profile, **how: [round(r.timestamp * 10) for r in generate(spark, profile, **how).orderBy("record_index").collect()]
    whole = list(range(101))
    assert at("missing-samples", missing_rate=0) == at("duplicate-samples", duplicate_rate=0) == at("sine") == whole
    assert at("missing-samples", missing_rate=1) == at("packet-loss", missing_rate=1) == [0], "the first record is never dropped"
    assert at("missing-samples", missing_rate=1e-9) == at("duplicate-samples", duplicate_rate=1e-9) == whole, "only default rates hit the middle for sure"
    assert at("sine", duplicate_rate=1) == sorted([*whole, *whole[:-1]]), "the record before comes twice: the first can, the last cannot"
    both = at("packet-loss", seed=4, missing_rate=0.5, duplicate_rate=1)
    kept = sorted(set(both))
    assert both == sorted([*kept, *kept[:-1]]) and 20 < len(kept) < 80
    emptied = [r.value for r in generate(spark, "noisy-sensor", missing_rate=0.5).collect()]
    assert len(emptied) == 101 and 20 < sum(v is None for v in emptied) < 80
    for bad in ({"sample_rate": 0}, {"noise": -1}, {"missing_rate": 2}, {"duration": 1e12}):
        with pytest.raises(ValueError):
            generate(spark, "sine", **bad)


def test_plot(spark, tmp_path, cells):
    out = str(tmp_path / "p.svg")
    meta = render.plot(cells([{"x": float(i % 7)} for i in range(300)]), ["x"], out, most=50)
    assert meta["fields"]["x"]["preserved_global_extrema"] and meta["fields"]["x"]["plotted"] <= 50 and os.path.exists(out + ".meta.json")
    few = cells([{"x": 1.0}, {"x": "none"}, {"x": 2.0}, {}])
    for kind in ("scatter", "step", "histogram"):
        meta = render.plot(few, ["x"], out, kind=kind, overwrite=True)
        assert (meta["fields"]["x"]["original_points"], meta["fields"]["x"]["missing_markers"]) == (3, 0 if kind == "histogram" else 1)
    with pytest.raises(FileExistsError):
        render.plot(few, ["x"], out)
    for bad in ({"kind": "pie"}, {"most": 1}):
        with pytest.raises(ValueError):
            render.plot(few, ["x"], str(tmp_path / "q.svg"), **bad)
    with pytest.raises(ValueError, match="no number"):
        render.plot(cells([{"x": "text"}]), ["y"], str(tmp_path / "q.svg"))
    render.plot(few, ["x"], str(tmp_path / "p.png"))
    assert (tmp_path / "p.png").read_bytes().startswith(b"\x89PNG")


def test_large_sessions_have_several_csv_files(spark, tmp_path):
    source = write(tmp_path, "a.jsonl", "".join(f'{{"x":{k}}}\n' for k in range(100)))
    records = records_of(parse_source(spark, source, "jsonl"))
    sessions.write_csv(records, ["x"], f"file://{tmp_path}/data", most_rows=30)
    parts = sorted((tmp_path / "data").glob("*.csv"))
    lines = [x for p in parts for x in p.read_text().splitlines()[1:]]
    assert len(parts) > 1 and lines == [str(k) for k in range(100)]


def test_raw_files_are_kept_byte_for_byte(spark, tmp_path):
    body = '{"x":1}\r\n{"x":2}\r\n{"x":3}'
    s = sessions.record(spark, write(tmp_path, "a.jsonl", body), options(tmp_path, input_format="jsonl"))
    (raw,) = [p for p in (tmp_path / "ws/demo/raw").iterdir() if p.name.startswith("part")]
    assert raw.read_bytes() == body.encode() and s.manifest["valid_record_count"] == 3 and s.verify(spark) == []


def test_a_session_without_a_valid_record(spark, tmp_path):
    s = sessions.record(spark, write(tmp_path, "a.jsonl", "broken\n"), options(tmp_path, input_format="jsonl"))
    assert s.manifest["invalid_record_count"] == 1 and s.verify(spark) == []
