"""Queries over what users call: sessions written and read back, conversion, reports, comparison, plots, the command line and detection.

Each writes the driver's tables as text below the session's shared folder, runs the user's function on it, and returns what came out,
so that it can be held against SQL over the same tables.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators.written import gone_at_exit, shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def workspace(spark: SparkSession) -> str:
    """A local folder that driver and executors share, as sessions need."""
    folder = f"{shared_dir(spark)}/user-{uuid.uuid4().hex}"
    gone_at_exit(spark, folder)
    path = folder.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError("sessions need a shared folder with a local path")
    os.makedirs(path)
    return path


def as_text(spark: SparkSession, rows: DataFrame, folder: str, name: str) -> str:
    """One text file of the column ``value`` in the order of ``at``."""
    path = f"{folder}/{name}"
    rows.repartition(1).sortWithinPartitions("at").select("value").write.option("lineSep", "\n").text(f"file://{path}.parts")
    part = next(p for p in os.listdir(f"{path}.parts") if p.startswith("part-"))
    os.rename(f"{path}.parts/{part}", path)
    return path


def nations(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of events in order; every tenth line is broken."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "value")
    line = F.when(F.col("event_id") % 10 == 7, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("event_id", "event_type", "value")))
    return rows.select(F.col("event_id").alias("at"), line.alias("value"))


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def fields_of(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    from runledger.sources.text import cells_from, parse_source, records_of

    cells = cells_from(records_of(parse_source(spark, path, kind)))
    return cells.groupBy("field", "kind").agg(F.count("*").alias("n"), F.sum("num").alias("total"), F.max("text").alias("largest"))


NATION_FIELDS = "select 'n_name' as field, 'str' as kind, count(*) as n, cast(null as double) as total, max(n_name) as largest from nation union all select 'n_nationkey', 'int', count(*), cast(sum(n_nationkey) as double), max(cast(n_nationkey as varchar)) from nation"


def _delimited(spark: SparkSession, d: str, sep: str, name: str, before: str = "") -> str:
    rows = nations(spark, d).select(F.col("n_nationkey").alias("at"), F.concat(F.lit('"'), "n_name", F.lit(f'"{sep}'), F.col("n_nationkey").cast("string")).alias("value"))
    head = spark.createDataFrame([(-1, f"{before}n_name{sep}n_nationkey")], "at int, value string")
    return as_text(spark, rows.unionByName(head), workspace(spark), name)


@query("s_tsv_document", NATION_FIELDS)
def s_tsv_document(spark, d):
    return fields_of(spark, _delimited(spark, d, "\t", "nations.tsv"), "tsv")


@query("s_bom", NATION_FIELDS)
def s_bom(spark, d):
    """Marks at the start of a file are no part of the first name, however many there are."""
    return fields_of(spark, _delimited(spark, d, ",", "nations.csv", "﻿﻿"), "csv")


@query("s_json_document", NATION_FIELDS)
def s_json_document(spark, d):
    """A JSON array over several lines."""
    rows = nations(spark, d).select(F.col("n_nationkey").alias("at"), F.concat(F.to_json(F.struct("n_name", "n_nationkey")), F.lit(",")).alias("value"))
    last = nations(spark, d).agg(F.max("n_nationkey")).first()[0]
    rows = rows.withColumn("value", F.when(F.col("at") == last, F.rtrim(F.regexp_replace("value", ",$", "\n"))).otherwise(F.col("value")))
    ends = spark.createDataFrame([(-1, "["), (1 << 30, "]")], "at int, value string")
    return fields_of(spark, as_text(spark, rows.unionByName(ends), workspace(spark), "nations.json"), "json")


@query("s_line_limit", "select cast(max(strlen(n_name)) as integer) as most, true as taken, true as refused from nation")
def s_line_limit(spark, d):
    """A limit that the longest line keeps, and one that it breaks by a byte."""
    from runledger.sources.text import parse_source

    path = as_text(spark, nations(spark, d).select(F.col("n_nationkey").alias("at"), F.col("n_name").alias("value")), workspace(spark), "lines.txt")
    most = nations(spark, d).agg(F.max(F.octet_length("n_name"))).first()[0]
    taken = parse_source(spark, path, "whitespace", max_line_bytes=most).count() > 0
    try:
        parse_source(spark, path, "whitespace", max_line_bytes=most - 1).count()
        refused = False
    except Exception as why:
        refused = "longer than" in str(why)
    return frame(spark, [(most, taken, refused)], "most int, taken boolean, refused boolean")


DETECT = {"jsonl": '{"a":1}\n{"b":2}', "keyvalue": "a=1 b=two\na=2 b='x y'", "whitespace": "1 2.5 3\n4 5 6", "csv": "a,b\n1,two", "tsv": "a\tb\n1\ttwo", "json": '[{"a":1},\n{"a":2}]', "ambiguous": "hello\nworld", "numbers": "1,2\n3,4"}


@query("s_detect", "select * from (values " + ", ".join(f"('{k}', '{'refused' if k in ('ambiguous', 'numbers') else k}')" for k in DETECT) + ") v(sample, detected)")
def s_detect(spark, d):
    """The detected format of a written text of each format; what fits none of them is refused."""
    from runledger.sources.parsers import AmbiguousFormat
    from runledger.sources.text import detect

    folder, found = workspace(spark), []
    for name, text in DETECT.items():
        path = f"{folder}/{name}.txt"
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(text + "\n")
        try:
            found.append((name, detect(spark, path)))
        except AmbiguousFormat:
            found.append((name, "refused"))
    return frame(spark, found, "sample string, detected string")


def recorded(spark: SparkSession, d: str, name: str = "events", **how):
    from runledger.plans.sessions import RecordOptions, record

    folder = workspace(spark)
    path = as_text(spark, event_lines(spark, d), folder, "events.jsonl")
    return record(spark, path, RecordOptions(name, f"{folder}/ws", "jsonl", **how)), path


GOOD, BAD = "event_id % 10 <> 7", "event_id % 10 = 7"
SIG = "(case when ({0}) is null or ({0}) = 0 then ({0}) else round(({0}) * pow(10, 8 - floor(log10(abs({0}))))) / pow(10, 8 - floor(log10(abs({0})))) end)"


@query("k_session", f"""select 'raw' as part, count(*) as n, cast(sum(event_id) as double) as total from events union all select 'records', count(*), cast(sum(event_id) as double) from events where {GOOD}
union all select 'rejects', count(*), cast(sum(event_id + 1) as double) from events where {BAD} union all select 'data', count(*), cast(sum(event_id) as double) from events where {GOOD}
union all select 'manifest', count(*), cast(count(*) filter ({GOOD}) as double) from events union all select 'metrics', count(value) filter ({GOOD}), {SIG.format(f"avg(value) filter ({GOOD})")} from events union all select 'verify', 0, 0""")
def k_session(spark, d):
    """A recorded session: raw lines, records, rejects with their places, CSV data, the manifest's counts, metrics, and nothing that verification finds."""
    s, source = recorded(spark, d)
    uri = f"file://{s.path}"
    raw = spark.read.text(f"{uri}/raw").select(F.regexp_extract("value", r"(?:broken |\"event_id\":)(\d+)", 1).cast("double").alias("e")).agg(F.count("*").alias("n"), F.sum("e").alias("total")).select(F.lit("raw").alias("part"), "n", "total")
    cells = s.records(spark).select(F.explode("cells").alias("c")).filter("c.field = 'event_id'").agg(F.count("*").alias("n"), F.sum("c.num").alias("total")).select(F.lit("records").alias("part"), "n", "total")
    rejects = s.rejects(spark).agg(F.count("*").alias("n"), F.sum("record").cast("double").alias("total")).select(F.lit("rejects").alias("part"), "n", "total")
    data = spark.read.option("header", True).csv(f"{uri}/data").agg(F.count("*").alias("n"), F.sum(F.col("event_id").cast("double")).alias("total")).select(F.lit("data").alias("part"), "n", "total")
    with open(f"{s.path}/metrics.json", encoding="utf-8") as f:
        value = json.load(f)["fields"]["value"]
    few = [("manifest", s.manifest["record_count"], float(s.manifest["valid_record_count"])), ("verify", len(s.verify(spark)), 0.0)]
    metrics = frame(spark, [("metrics", value["valid_count"], value["mean"])], "part string, n long, total double").withColumn("total", F.expr(SIG.format("total")))
    return raw.unionByName(cells).unionByName(rejects).unionByName(data).unionByName(frame(spark, few, "part string, n long, total double")).unionByName(metrics)


@query("f_sha256_files", "select 'raw' as part, sha256(string_agg(line, chr(10) order by event_id) || chr(10)) as sha from (select event_id, case when event_id % 10 = 7 then 'broken ' || event_id else '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"value\":' || 'V}' end as line from events where event_id < 0 or event_id % 10 = 7)")
def f_sha256_files(spark, d):
    """The digest of a raw file as the manifest has it: the bytes that were recorded, hashed as a stream."""
    from runledger.plans.sessions import RecordOptions, record

    folder = workspace(spark)
    path = as_text(spark, event_lines(spark, d).filter(F.col("at") % 10 == 7), folder, "broken.txt")
    s = record(spark, path, RecordOptions("broken", f"{folder}/ws", "jsonl"))
    return frame(spark, [("raw", sha) for name, sha in s.manifest["hashes"].items() if name.startswith("raw/")], "part string, sha string")


@query("l_verify", "select * from (values ('changed', 'hash mismatch: raw/'), ('missing', 'missing: notes.md'), ('extra', 'not in the manifest: extra.json'), ('manifest', 'hash mismatch: manifest.json'), ('whole', '')) v(done, found)")
def l_verify(spark, d):
    """What verification says of a session that was tampered with."""
    from runledger.plans.sessions import Session

    s, _ = recorded(spark, d)
    found = [("whole", "; ".join(s.verify(spark)))]

    def after(name: str, starts: str) -> None:
        wrong = Session.open(s.path).verify(spark)
        found.append((name, next((starts for w in wrong if w.startswith(starts)), "; ".join(wrong))))

    raw = next(x for x in os.listdir(f"{s.path}/raw") if x.startswith("part-"))
    with open(f"{s.path}/raw/{raw}", "ab") as f:
        f.write(b"one more\n")
    after("changed", "hash mismatch: raw/")
    os.remove(f"{s.path}/notes.md")
    after("missing", "missing: notes.md")
    with open(f"{s.path}/extra.json", "w") as f:
        f.write("{}")
    after("extra", "not in the manifest: extra.json")
    with open(f"{s.path}/manifest.json", "a") as f:
        f.write(" ")
    after("manifest", "hash mismatch: manifest.json")
    return frame(spark, found, "done string, found string")


@query("k_convert", f"select format, n, total, bad from (select unnest(['csv', 'jsonl']) as format), (select count(*) as n, cast(sum(event_id) as double) as total from events where {GOOD}), (select count(*) as bad from events where {BAD})")
def k_convert(spark, d):
    """Events as JSON lines, converted to CSV and to JSON lines, and read back; rejects stand beside them."""
    from runledger.plans.sessions import convert

    folder, out = workspace(spark), None
    path = as_text(spark, event_lines(spark, d), folder, "events.jsonl")
    for to in ("csv", "jsonl"):
        convert(spark, path, f"{folder}/out.{to}", to, "jsonl")
        back = fields_of(spark, f"{folder}/out.{to}", to).filter("field = 'event_id'").select(F.lit(to).alias("format"), "n", "total")
        bad = spark.read.json(f"file://{folder}/out.{to}.invalid").agg(F.count("*").alias("bad"))
        row = back.join(F.broadcast(bad))
        out = row if out is None else out.unionByName(row)
    return out


@query("k_report", f"select field, n, {SIG.format('mean')} as mean, true as verified, true as in_markdown from (select 'event_id' as field, count(*) as n, avg(event_id) as mean from events where {GOOD} union all select 'value', count(value), avg(value) from events where {GOOD})")
def k_report(spark, d):
    """The numeric fields of a report as JSON, and whether the Markdown report has a row for each."""
    from runledger.plans.sessions import report

    s, _ = recorded(spark, d)
    data, text = json.loads(report(spark, s, "json")), report(spark, s)
    rows = [(f, m["valid_count"], float(m["mean"]), not data["integrity"] and "Integrity: verified" in text, f"| {f.replace('_', chr(92) + '_')} |" in text) for f, m in data["inspection"]["metrics"].items()]
    return frame(spark, rows, "field string, n long, mean double, verified boolean, in_markdown boolean").withColumn("mean", F.expr(SIG.format("mean")))


HALVES = "h as (select event_id % 2 as half, value from events), m as (select avg(value) filter (half = 0) as a, avg(value) filter (half = 1) as b, count(value) filter (half = 0) as n, count(value) filter (half = 1) as k from h)"


@query("x_compare_sources", f"with {HALVES} select unnest(['even.jsonl', 'odd.jsonl']) as source, {SIG.format('unnest([a, b])')} as mean, unnest([n, k]) as valid_count, true as comparable, {SIG.format('unnest([0.0, (a - b) / abs(a) * 100])')} as improvement_percent from m")
def x_compare_sources(spark, d):
    """Two text files as users compare them, with a goal."""
    from runledger.plans.inspect import compare_sessions

    folder, paths = workspace(spark), []
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value")
    for k, name in enumerate(("even", "odd")):
        paths.append(as_text(spark, rows.filter(F.col("event_id") % 2 == k).select(F.col("event_id").alias("at"), F.to_json(F.struct("value")).alias("value")), folder, f"{name}.jsonl"))
    c = compare_sessions(paths, goal="lower:value", spark=spark)
    x = c.fields["value"]
    found = [(k, x["means"][k], x["statistics_by_source"][k]["valid_count"], x["comparable"], float(x["improvement_percent"][k])) for k in c.sources]
    out = frame(spark, found, "source string, mean double, valid_count long, comparable boolean, improvement_percent double")
    return out.withColumns({c: F.expr(SIG.format(c)) for c in ("mean", "improvement_percent")})


@query("x_compare_rules", "select * from (values ('units', true), ('rates', true), ('zero baseline', true), ('field', true), ('no goal', true), ('one source', true), ('bad goal', true), ('disjoint', true), ('json', true), ('csv', true), ('markdown', true), ('labels', true)) v(rule, holds)")
def x_compare_rules(spark, d):
    """The rules of comparison, each on files made for it."""
    from runledger.plans.inspect import compare_sessions
    from runledger.plans.render import comparison_text
    from runledger.plans.sessions import RecordOptions, record

    folder = workspace(spark)

    def made(name: str, rows: list[dict], **how) -> str:
        path = f"{folder}/{name}.jsonl"
        with open(path, "w", encoding="utf-8") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows))
        return record(spark, path, RecordOptions(name, f"{folder}/ws", "jsonl", **how)).path if how else path

    a = made("a", [{"t": k, "x": k % 3} for k in range(6)], roles={"time": "t"}, units={"x": "m"})
    b = made("b", [{"t": 100 + 2 * k, "x": k % 3 + 1} for k in range(6)], roles={"time": "t"}, units={"x": "s"})
    zero = made("zero", [{"x": 0}, {"x": 0}])
    both, none = compare_sessions([a, b], spark=spark), compare_sessions([zero, zero], ["x", "y"], "higher:x", spark=spark)

    def refused(*args, **how) -> bool:
        try:
            compare_sessions(*args, spark=spark, **how)
        except ValueError:
            return True
        return False

    table = json.loads(comparison_text(both, "json"))
    found = [
        ("units", any("units differ for x" in w for w in both.warnings) and not both.fields["x"]["comparable"]), ("rates", any("sampling rates" in w for w in both.warnings)), ("disjoint", both.timing["shared_range"] is None and both.timing["shared_relative_range"] == [0.0, 5.0]),
        ("zero baseline", any("zero baseline" in w for w in none.warnings) and "improvement_percent" not in none.fields["x"]), ("field", any("y" in w and "every source" in w for w in none.warnings)), ("no goal", any("no goal" in w for w in both.warnings)),
        ("one source", refused([a])), ("bad goal", refused([a, b], goal="best:x")), ("json", set(table["fields"]) == {"t", "x"}), ("csv", comparison_text(both, "csv").startswith("field,source,mean")), ("markdown", "| field |" in comparison_text(both, "markdown")),
        ("labels", none.sources == ["zero.jsonl", "zero.jsonl#2"]),
    ]
    return frame(spark, found, "rule string, holds boolean")


PLOT_KINDS = ("line", "scatter", "step", "histogram")


@query("k_plot", "select unnest(['line', 'scatter', 'step', 'histogram']) as kind, count(*) as original, true as within, true as extrema, {0} as lo, {1} as hi, true as drawn from events".format("min(value)", "max(value)"))
def k_plot(spark, d):
    """What the metadata of each kind of plot says of its series, and that its file is an image."""
    from runledger.operators.cells import cells_of
    from runledger.operators.ordered import positions
    from runledger.plans.render import plot

    rows = positions(spark.read.parquet(f"{d}/events.parquet").select(F.lit("s").alias("session_id"), "event_id", "value"), ["session_id"], "event_id", "record_index")
    cells, folder, found = cells_of(rows, {"value": "float"}), workspace(spark), []
    for k, kind in enumerate(PLOT_KINDS):
        path = f"{folder}/{kind}.{'png' if k % 2 else 'svg'}"
        meta = plot(cells, ["value"], path, kind=kind, most=200)["fields"]["value"]
        with open(path, "rb") as f:
            head = f.read(8)
        found.append((kind, meta["original_points"], meta["plotted"] <= 200, meta["preserved_global_extrema"], meta["minimum"], meta["maximum"], head == b"\x89PNG\r\n\x1a\n" if k % 2 else head.startswith(b"<svg")))
    return frame(spark, found, "kind string, original long, within boolean, extrema boolean, lo double, hi double, drawn boolean")


@query("o_session_listing", "select row_number() over (order by lower(n_name)) - 1 as place, n_name as name from nation where n_nationkey < 4 union all select 4, 'z'")
def o_session_listing(spark, d):
    """Sessions are listed by name, whatever its case; folders that are none are left out."""
    from runledger.plans.sessions import RecordOptions, list_sessions, record

    folder = workspace(spark)
    names = [r.n_name for r in nations(spark, d).filter("n_nationkey < 4").orderBy("n_nationkey").collect()]
    with open(f"{folder}/x.jsonl", "w") as f:
        f.write('{"x":1}\n')
    first = record(spark, f"{folder}/x.jsonl", RecordOptions("z", f"{folder}/ws", "jsonl"))
    for n in reversed(names):  # copies of it under other names
        shutil.copytree(first.path, f"{folder}/ws/{n}")
        with open(f"{folder}/ws/{n}/manifest.json", "w", encoding="utf-8") as f:
            json.dump(first.manifest | {"session_name": n}, f)
    os.makedirs(f"{folder}/ws/none")
    return frame(spark, [(k, s.name) for k, s in enumerate(list_sessions(f"{folder}/ws"))], "place long, name string")


@query("p_option_rules", "select * from (values ('target alone', true), ('sequence alone', true), ('bytes alone', true), ('unknown role', true), ('unknown unit', true), ('bad name', true), ('key=value', true), ('last wins', true), ('collision', true), ('overwrite', true), ('private path', true)) v(rule, holds)")
def p_option_rules(spark, d):
    """Rules of recording options, and what happens to a name that is taken."""
    from runledger.functions.text import key_values
    from runledger.plans.sessions import RecordOptions, record

    folder = workspace(spark)
    with open(f"{folder}/x.jsonl", "w") as f:
        f.write('{"x":1,"y":2}\n')
    ws = f"{folder}/ws"
    made = lambda name="s", **how: record(spark, f"{folder}/x.jsonl", RecordOptions(name, ws, "jsonl", **how))

    def refused(f, *a, **how) -> bool:
        try:
            f(*a, **how)
        except ValueError:
            return True
        return False

    first, second, third = made(), made(include_path=True), made(overwrite=True)
    found = [
        ("target alone", refused(made, roles={"target": "x"})), ("sequence alone", refused(made, roles={"sequence": "x"})), ("bytes alone", refused(made, roles={"bytes": "x"})), ("unknown role", refused(made, roles={"time": "z"})),
        ("unknown unit", refused(made, units={"z": "m"})), ("bad name", refused(made, "../s")), ("key=value", refused(key_values, ["=x"])), ("last wins", key_values(["a=1", "a=2"]) == {"a": "2"}), ("collision", (first.name, second.name) == ("s", "s-2")),
        ("overwrite", third.name == "s" and sorted(os.listdir(ws)) == ["s", "s-2"]), ("private path", third.manifest["working_directory"] is None and second.manifest["working_directory"] is not None),
    ]
    return frame(spark, found, "rule string, holds boolean")


@query("l_command_line", "select * from (values ('record', 0), ('inspect', 0), ('report', 0), ('convert', 0), ('convert again', 2), ('replay', 0), ('generate', 0), ('generate csv', 0), ('sessions', 0), ('doctor', 0), ('no source', 2), ('tampered', 1)) v(verb, code)")
def l_command_line(spark, d):
    """Exit codes of the verbs on a recorded session: 0, 2 for an error, 1 for a check that fails."""
    from runledger import cli

    folder = workspace(spark)
    path = as_text(spark, event_lines(spark, d).filter("at < 50"), folder, "few.jsonl")
    ws, found = ["--workspace", f"{folder}/ws"], []

    def run(name: str, *args: str) -> None:
        with contextlib.redirect_stdout(io.StringIO()) as out, contextlib.redirect_stderr(io.StringIO()):
            code = cli.main([*ws, *args])
        says = {"inspect": '"record_count": 50', "replay": '"event_id": 49', "sessions": "few  50 records", "generate csv": "timestamp,value", "report": "Integrity: verified"}.get(name, "")
        found.append((name, code if says in out.getvalue() else -1))

    run("record", "record", "few", "--format", "jsonl", "--input", path)
    here = os.getcwd()
    try:
        os.chdir(folder)
        run("inspect", "inspect", "few", "--json", "--plot", "value", "--plot-format", "png")
    finally:
        os.chdir(here)
    run("report", "report", "few")
    run("convert", "convert", "few", "--to", "csv", "--output", f"{folder}/few.csv")
    run("convert again", "convert", "few", "--to", "csv", "--output", f"{folder}/few.csv")
    run("replay", "replay", "few", "--no-timing")
    run("generate", "generate", "sine", "--duration", "1", "--output", f"{folder}/sine.jsonl")
    run("generate csv", "generate", "sine", "--duration", "1", "--format", "csv", "--real-time", "--sample-rate", "1000")
    run("sessions", "sessions")
    run("doctor", "doctor")
    run("no source", "inspect", f"{folder}/none.jsonl")
    with open(f"{folder}/ws/few/metrics.json", "a") as f:
        f.write(" ")
    run("tampered", "doctor")
    return frame(spark, found, "verb string, code int")


TEXTS = ["plain", "a_b*c", "<x> & y", "two\nlines", "`one` ``two``", "\x1b[31mred", "=1+1", "tab\there"]


@query("f_text_safety", "select * from (values ('code', '```` `one` ``two`` ````'), ('plain code', '`plain`'), ('terminal', '\\x1b[31mred'), ('tab', 'tab\\x09here'), ('cut', 'xxx…'), ('markdown', 'a\\_b\\*c'), ('html', '&lt;x&gt; &amp; y'), ('lines', 'two lines'), ('cell', '''=1+1'), ('number', '-1')) v(case_, result)".replace("````", "```"))
def f_text_safety(spark, d):
    """Text made safe for terminals, Markdown, code spans and spreadsheets."""
    from runledger.functions import text as t

    plain, marks, tags, lines, ticks, control, formula, tab = TEXTS
    found = [("code", t.code_span(ticks)), ("plain code", t.code_span(plain)), ("terminal", t.terminal_safe(control)), ("tab", t.terminal_safe(tab)), ("cut", t.terminal_safe("x" * 9, 4)), ("markdown", t.markdown_safe(marks)), ("html", t.markdown_safe(tags)), ("lines", t.markdown_safe(lines)), ("cell", t.csv_safe(formula)), ("number", str(t.csv_safe(-1)))]
    return frame(spark, found, "case_ string, result string")


GLYPHS = "_.-~=+*#"


@query("f_sparkline", f"""with e as (select event_type, value, row_number() over (partition by event_type order by event_id) as i from events), f as (select * from e where i <= 30), l as (select event_type, min(value) as lo, max(value) as hi from f group by all)
select event_type, string_agg('{GLYPHS}'[1 + cast(case when hi > lo then round_even((value - lo) / (hi - lo) * 7, 0) else 3 end as integer)], '' order by i) as line from f join l using (event_type) group by event_type""")
def f_sparkline(spark, d):
    """Sparklines of the first values of each type, in ASCII; the driver's function and the column expression agree."""
    from runledger.functions import scalars
    from runledger.functions.text import sparkline

    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("event_id", "value"))), 1, 30), lambda s: s["value"])
    rows = spark.read.parquet(f"{d}/events.parquet").filter("event_id < 3000").groupBy("event_type").agg(first.alias("v"))
    made = rows.select("event_type", "v", scalars.sparkline(F.col("v"), True).alias("line")).collect()
    return frame(spark, [(r.event_type, r.line if r.line == sparkline(r.v, True) else "differ") for r in made], "event_type string, line string")


@query("p_epoch_of_text", "select n_nationkey as k, case when n_nationkey % 4 = 0 then n_nationkey::double when n_nationkey % 4 = 1 then n_nationkey * 3600.0 - 7200 when n_nationkey % 4 = 3 then n_nationkey * 3600.0 end as t from nation")
def p_epoch_of_text(spark, d):
    """Times as ingest reads them: numbers, times with an offset or a Z, and times without one, which are none."""
    from runledger.sources.text import cells_from, parse_source, records_of

    k = F.col("n_nationkey")
    stamp = F.concat(F.date_format(F.timestamp_seconds(k * 3600), "yyyy-MM-dd'T'HH:mm:ss"))
    utc = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        value = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(F.lit('"'), stamp, F.lit('+02:00"'))).when(k % 4 == 2, F.concat(F.lit('"'), stamp, F.lit('"'))).otherwise(F.concat(F.lit('"'), stamp, F.lit('Z"')))
        path = as_text(spark, nations(spark, d).select(k.alias("at"), F.concat(F.lit('{"k":'), k.cast("string"), F.lit(',"t":'), value, F.lit("}")).alias("value")), workspace(spark), "times.jsonl")
    finally:
        spark.conf.set("spark.sql.session.timeZone", utc)
    cells = cells_from(records_of(parse_source(spark, path, "jsonl")))
    at = lambda name: F.max(F.when(F.col("field") == name, F.col("t")))
    return cells.groupBy("record_index").agg(at("k").cast("int").alias("k"), at("t").alias("t")).drop("record_index")


@query("p_payload_schema", "select '{\"a\":[1,{\"x\":2.0}],\"b\":\"' || n_name || '\"}' as payload, 'a,b' as schema_key, 2 as field_count from nation")
def p_payload_schema(spark, d):
    """Canonical payloads (sorted keys, no spaces), sorted schema keys and numbers of fields of lines with keys out of order."""
    from runledger.sources.text import parse_source, records_of

    lines = nations(spark, d).select(F.col("n_nationkey").alias("at"), F.concat(F.lit('{ "b" : "'), "n_name", F.lit('", "a" : [1, {"x": 2.0}]}')).alias("value"))
    records = records_of(parse_source(spark, as_text(spark, lines, workspace(spark), "x.jsonl"), "jsonl"))
    return records.select("payload", F.array_join("schema_key", ",").alias("schema_key"), "field_count")


@query("x_capture_stops", "select count(*) as landed, count(*) filter (event_id % 10 <> 7) as valid, count(*) filter (event_id % 10 = 7) as rejects from events")
def x_capture_stops(spark, d):
    """A live capture that is stopped: what has landed is whole, and what could not be parsed is kept raw."""
    from runledger.sources.text import records_of, rejects_of
    from runledger.streaming.capture import landed, start

    folder = workspace(spark)
    event_lines(spark, d).select("value").repartition(4).write.text(f"file://{folder}/in")
    q = start(spark, f"file://{folder}/in", "jsonl", "live", f"file://{folder}/out", once=False)
    q.processAllAvailable()
    q.stop()
    found = landed(spark, f"file://{folder}/out")
    raw = spark.read.parquet(f"file://{folder}/out/raw").count()
    return records_of(found).agg(F.count("*").alias("valid")).join(rejects_of(found).agg(F.count("*").alias("rejects"))).select(F.lit(raw).cast("long").alias("landed"), "valid", "rejects")
