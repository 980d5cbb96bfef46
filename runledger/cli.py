"""Command line: record, inspect, compare, replay, report, generate, convert, sessions and doctor."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
import time

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from runledger import __version__
from runledger.functions.text import csv_safe, key_values, safe_output
from runledger.operators.replay import replay
from runledger.plans import render, sessions
from runledger.plans.inspect import compare_sessions, inspect_source
from runledger.sources import generate as gen
from runledger.sources.text import cells_from, parse_source, records_of

ROLE_FLAGS = ("time", "target", "response", "sequence", "latency", "bytes")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="runledger")
    p.add_argument("--workspace", default=os.environ.get("RUNLEDGER_WORKSPACE") or os.path.join(os.getcwd(), "sessions"))
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="verb", required=True)

    def roles(c):
        for r in ROLE_FLAGS:
            c.add_argument(f"--{r}-field")

    c = sub.add_parser("record")
    c.add_argument("name")
    c.add_argument("--format")
    roles(c)
    c.add_argument("--param", action="append", default=[])
    c.add_argument("--unit", action="append", default=[])
    c.add_argument("--command")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--include-path", action="store_true")
    c.add_argument("--max-line-bytes", type=int, default=1 << 20)
    c.add_argument("--max-fields", type=int, default=1000)
    c.add_argument("--input", help="text files; standard input if not given")
    c = sub.add_parser("inspect")
    c.add_argument("source")
    c.add_argument("--format")
    roles(c)
    c.add_argument("--field", action="append")
    c.add_argument("--quality", action="store_true")
    c.add_argument("--monotonic-field", action="append", default=[])
    c.add_argument("--counter-field", action="append", default=[])
    c.add_argument("--plot")
    c.add_argument("--plot-output", help="a file below the current folder; plot.png or plot.svg if not given")
    c.add_argument("--plot-format", default="png", choices=("png", "svg"))
    c.add_argument("--plot-kind", default="line", choices=render.KINDS)
    c.add_argument("--plot-max-points", type=int, default=5000)
    c.add_argument("--overwrite-plot", action="store_true")
    c.add_argument("--json", action="store_true")
    c = sub.add_parser("compare")
    c.add_argument("sources", nargs="+")
    c.add_argument("--field", action="append")
    c.add_argument("--goal")
    c.add_argument("--report")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--format", default="terminal", choices=("terminal", "json", "markdown", "csv"))
    c = sub.add_parser("replay")
    c.add_argument("session")
    c.add_argument("--speed", type=float, default=1.0)
    c.add_argument("--loop", action="store_true")
    c.add_argument("--format", default="jsonl", choices=("jsonl", "csv"))
    c.add_argument("--no-timing", action="store_true")
    c = sub.add_parser("report")
    c.add_argument("session")
    c.add_argument("--format", default="markdown", choices=("markdown", "json"))
    c.add_argument("--output")
    c.add_argument("--overwrite", action="store_true")
    c = sub.add_parser("generate")
    c.add_argument("profile", choices=gen.PROFILES)
    for name, kind, default in (("seed", int, 0), ("duration", float, 10.0), ("sample-rate", float, 10.0), ("noise", float, 0.05), ("missing-rate", float, None), ("duplicate-rate", float, None)):
        c.add_argument(f"--{name}", type=kind, default=default)
    c.add_argument("--format", default="jsonl", choices=("jsonl", "csv"))
    c.add_argument("--output")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--real-time", action="store_true")
    c = sub.add_parser("convert")
    c.add_argument("source")
    c.add_argument("--to", required=True, choices=("csv", "jsonl"))
    c.add_argument("--format")
    c.add_argument("--output", required=True)
    c.add_argument("--overwrite", action="store_true")
    sub.add_parser("sessions")
    c = sub.add_parser("doctor")
    c.add_argument("--json", action="store_true")
    return p


def spark_session() -> SparkSession:
    spark = SparkSession.builder.appName("runledger").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _resolve(source: str, workspace: str) -> str:
    child = os.path.join(workspace, source)
    return source if os.path.exists(source) or not sessions.is_session(child) else child


def _write(text: str, output: str | None, overwrite: bool) -> None:
    if output is None:
        sys.stdout.write(text)
    elif os.path.exists(output) and not overwrite:
        raise FileExistsError(f"{output} exists")
    else:
        with open(f"{output}.part", "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
        os.replace(f"{output}.part", output)


def _emit(rows, fields: list[str], kind: str, out) -> None:
    if kind == "csv":
        out.write(",".join(render.csv_cell(csv_safe(f)) for f in fields) + "\n")
    for row in rows:
        values = row if isinstance(row, dict) else row.asDict()
        out.write((",".join(render.csv_cell(values.get(f)) for f in fields) if kind == "csv" else json.dumps({f: values[f] for f in fields if f in values}, ensure_ascii=False)) + "\n")
        out.flush()


def dispatch(a: argparse.Namespace) -> int:
    roles = {r: getattr(a, f"{r}_field", None) for r in ROLE_FLAGS}
    if a.verb == "record":
        source, interrupted = a.input, False
        if source is None:
            os.makedirs(a.workspace, exist_ok=True)
            landing = tempfile.NamedTemporaryFile("w", dir=a.workspace, prefix=".landing-", suffix=".txt", delete=False)
            source = landing.name
            try:
                for line in sys.stdin:
                    landing.write(line)
            except KeyboardInterrupt:
                interrupted = True
            landing.close()
        options = sessions.RecordOptions(a.name, a.workspace, a.format, roles, key_values(a.param), key_values(a.unit), a.command, a.overwrite, a.include_path, a.max_line_bytes, a.max_fields, interrupted)
        try:
            done = sessions.record(spark_session(), source, options)
        finally:
            if a.input is None:
                os.remove(source)
        print(f"{done.name}: {done.manifest['valid_record_count']} valid, {done.manifest['invalid_record_count']} invalid")
        return 130 if interrupted else 0
    if a.verb == "inspect":
        source = _resolve(a.source, a.workspace)
        found = inspect_source(source, spark=spark_session(), input_format=a.format, monotonic_fields=a.monotonic_field, counter_fields=a.counter_field, **{f"{r}_field": v for r, v in roles.items()})
        print(json.dumps(found.to_dict(), ensure_ascii=False, indent=2, sort_keys=True, default=str) if a.json else render.inspection_text(found, a.field, a.quality), end="" if not a.json else "\n")
        if a.plot:
            spark = spark_session()
            records = sessions.Session.open(source).records(spark) if sessions.is_session(source) else records_of(parse_source(spark, source, a.format))
            render.plot(cells_from(records), [f.strip() for f in a.plot.split(",") if f.strip()], safe_output(os.getcwd(), a.plot_output or f"plot.{a.plot_format}"), roles["time"], a.plot_kind, a.plot_max_points, a.overwrite_plot)
        return 0
    if a.verb == "compare":
        found = compare_sessions([_resolve(s, a.workspace) for s in a.sources], a.field, a.goal, spark=spark_session())
        _write(render.comparison_text(found, a.format), a.report, a.overwrite)
        return 0
    if a.verb == "replay":
        session = sessions.Session.open(_resolve(a.session, a.workspace))
        spark = spark_session()
        records, at = session.records(spark), session.manifest["field_roles"].get("time")
        t = F.get(F.filter("cells", lambda c: c["field"] == F.lit(at)), F.lit(0))["t"] if at else F.lit(None).cast("double")
        timed = records.select("session_id", "record_index", "original", t.alias("t"))
        while True:
            _emit((json.loads(r.original) for r in replay(timed, a.speed, not a.no_timing)), sorted(session.manifest["fields"]), a.format, sys.stdout)
            if not a.loop:
                return 0
    if a.verb == "report":
        text = sessions.report(spark_session(), sessions.Session.open(_resolve(a.session, a.workspace)), a.format)
        _write(text, a.output, a.overwrite)
        return 0
    if a.verb == "generate":
        made = gen.generate(spark_session(), a.profile, a.seed, a.duration, a.sample_rate, a.noise, a.missing_rate, a.duplicate_rate)
        rows = made.orderBy("record_index").drop("record_index").toLocalIterator()
        if a.real_time:
            rows = _paced(rows, a.sample_rate)
        if a.output and os.path.exists(a.output) and not a.overwrite:
            raise FileExistsError(f"{a.output} exists")
        if a.output:
            with open(f"{a.output}.part", "w", encoding="utf-8", newline="\n") as f:
                _emit(rows, made.columns[1:], a.format, f)
            os.replace(f"{a.output}.part", a.output)
        else:
            _emit(rows, made.columns[1:], a.format, sys.stdout)
        return 0
    if a.verb == "convert":
        good, bad = sessions.convert(spark_session(), _resolve(a.source, a.workspace), a.output, a.to, a.format, a.overwrite)
        print(f"{good} valid, {bad} invalid")
        return 0
    if a.verb == "sessions":
        for s in sessions.list_sessions(a.workspace):
            print(f"{s.name}  {s.manifest['record_count']} records  {s.manifest['started_at']}")
        return 0
    checks = sessions.doctor(a.workspace, spark_session() if sessions.list_sessions(a.workspace) else None)
    print(json.dumps(checks, indent=2) if a.json else "\n".join(f"{'ok' if c['ok'] else 'FAILED' if c['required'] else 'absent'}  {c['check']}  {c['detail']}" for c in checks))
    return int(any(c["required"] and not c["ok"] for c in checks))


def _paced(rows, rate: float):
    for row in rows:
        yield row
        time.sleep(1 / rate)


def main(argv: list[str] | None = None) -> int:
    """0: done, 1: a required check failed, 2: an error, 130: interrupted. A closed pipe is no error."""
    try:
        return dispatch(parser().parse_args(argv))
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return 0
    except KeyboardInterrupt:
        return 130
    except (ValueError, OSError, PySparkException) as why:
        print(f"error: {why}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
