"""Sessions: recorded runs as folders, published whole and verifiable.

A folder holds ``raw`` (text), ``records`` and ``rejects`` (Parquet), ``data`` (CSV), ``metrics.json``, ``quality.json``,
``notes.md``, ``manifest.json`` and ``manifest.sha256``. It is staged beside its place and moved there by one rename; the
folder must be on a file system that driver and executors share and that renames at once.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import shutil
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import __version__
from runledger.functions import scalars
from runledger.functions.text import code_span, markdown_safe, safe_name, terminal_safe
from runledger.plans.inspect import ROLES, analyse, check_fields, check_roles, inspect_source
from runledger.sources.text import MAX_LINE_BYTES, cells_from, detect, parse_source, records_of, rejects_of

VERSION = 2
MANIFEST_BYTES = 1 << 20
#: Records of one CSV file.
CSV_ROWS = 1_000_000
REQUIRED = ("raw", "records", "rejects", "data", "metrics.json", "quality.json", "notes.md")
KEYS = ("session_format_version", "session_name", "started_at", "ended_at", "input_format", "fields", "record_count", "valid_record_count", "invalid_record_count", "field_roles", "units", "parameters", "hashes")


@dataclass(frozen=True)
class RecordOptions:
    """What to record under which name, and what is known about its fields."""

    name: str
    workspace: str
    input_format: str | None = None
    roles: dict[str, str | None] = field(default_factory=dict)
    parameters: dict[str, str] = field(default_factory=dict)
    units: dict[str, str] = field(default_factory=dict)
    command: str | None = None
    overwrite: bool = False
    include_path: bool = False
    max_line_bytes: int = MAX_LINE_BYTES
    max_fields: int = 1000
    interrupted: bool = False


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def write_json(path: str, value: Any) -> None:
    """Writes beside the file and replaces it at once."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8", newline="\n") as f:
        f.write(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False) + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            with open(path, "rb") as f:
                found.append(hashlib.file_digest(f, "sha256").hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(found, pa.string())], names=["name", "sha"])


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for source, target in zip(batch.column("path").to_pylist(), batch.column("name").to_pylist(), strict=True):
            part = f"{target}.{uuid.uuid4().hex}"  # a task that runs twice replaces its own copy
            shutil.copyfile(source, part)
            os.replace(part, target)
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("path")], names=["name", "sha"])


def _by_file(spark: SparkSession, files: list[tuple[str, str]], run) -> list:
    """``run`` over (path, name) rows, a task a file: files are read as streams, whatever their size."""
    if not files:
        return []
    rows = spark.createDataFrame(files, "path string, name string").repartition(min(len(files), 1000), "path")
    return rows.mapInArrow(run, "name string, sha string").collect()


def hashes(spark: SparkSession, folder: str) -> dict[str, str]:
    """SHA-256 of the session's files: executors hash the data, the driver gets a line a file."""
    found = {n: sha256_file(f"{folder}/{n}") for n in sorted(os.listdir(folder)) if n.endswith((".json", ".md")) and n != "manifest.json"}
    files = [(f"{os.path.abspath(folder)}/{n}/{x}", f"{n}/{x}") for n in ("raw", "records", "rejects", "data") if os.path.isdir(f"{folder}/{n}") for x in sorted(os.listdir(f"{folder}/{n}")) if not x.startswith(("_", "."))]
    return found | {r.name: r.sha for r in _by_file(spark, files, _digests)}


def keep_raw(spark: SparkSession, source: str, folder: str) -> None:
    """The source's files as they are, byte for byte; of a source that is no local path, its lines."""
    path = source.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        spark.read.option("lineSep", "\n").text(source).write.option("lineSep", "\n").text(f"file://{folder}")
        return
    files = [path] if os.path.isfile(path) else sorted(f for f in glob.glob(f"{path}/**" if os.path.isdir(path) else path, recursive=True) if os.path.isfile(f) and not os.path.basename(f).startswith(("_", ".")))
    os.makedirs(folder)
    _by_file(spark, [(os.path.abspath(f), f"{folder}/part-{k:05d}-{os.path.basename(f)}"[:4000]) for k, f in enumerate(files)], _copies)


def wide(records: DataFrame, fields: list[str]) -> DataFrame:
    """Records as text columns in the order of ``fields``, strings safe for spreadsheets."""

    def shown(name: str):
        found = F.get(F.filter("cells", lambda c: c["field"] == F.lit(name)), F.lit(0))
        return F.when(found["kind"] == "str", scalars.csv_safe(found["text"])).otherwise(found["text"])

    return records.select("record_index", *[shown(n).alias(f"c{k}") for k, n in enumerate(fields)])


def write_csv(records: DataFrame, fields: list[str], path: str, most_rows: int = CSV_ROWS) -> None:
    """CSV with LF line ends and safe header cells: one file, or beyond ``most_rows`` records as many in order, each with the header."""
    from runledger.functions.text import csv_safe

    if not fields:  # no valid record: a file without columns
        os.makedirs(folder := path.removeprefix("file://"))
        with open(f"{folder}/part-00000.csv", "w"):
            return
    files = max(1, -(-records.count() // most_rows))
    rows = wide(records, fields)
    rows = (rows.repartitionByRange(files, "record_index") if files > 1 else rows.coalesce(1)).sortWithinPartitions("record_index").drop("record_index")
    rows.toDF(*[str(csv_safe(f)) for f in fields]).write.option("header", True).option("lineSep", "\n").option("quoteAll", False).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def _place(options: RecordOptions) -> str:
    base = os.path.join(options.workspace, safe_name(options.name))
    if options.overwrite or not os.path.exists(base):
        return base
    n = 2
    while os.path.exists(f"{base}-{n}"):
        n += 1
    return f"{base}-{n}"


def _publish(stage: str, final: str) -> None:
    """Moves the stage to its place; a session that was there is put back if that fails."""
    backup = f"{final}.backup-{uuid.uuid4().hex}" if os.path.exists(final) else None
    if backup:
        os.rename(final, backup)
    try:
        os.rename(stage, final)
    except OSError:
        if backup:
            os.rename(backup, final)
        raise
    if backup:
        shutil.rmtree(backup)


def _validate(options: RecordOptions) -> None:
    safe_name(options.name)
    check_roles(options.roles)
    for what in (options.parameters, options.units):
        if len(what) > 1000 or any(not 0 < len(k) <= 120 or len(v) > 4096 for k, v in what.items()):
            raise ValueError("at most 1000 parameters or units, of short keys and values")
    if options.command and len(options.command) > 16_384:
        raise ValueError("the command is too long")
    if options.max_line_bytes < 1 or options.max_fields < 1:
        raise ValueError("limits must be above 0")


def record(spark: SparkSession, source: str, options: RecordOptions) -> Session:
    """Records the text files at ``source`` as a session. Raw lines are kept before anything is parsed; on failure nothing is published."""
    _validate(options)
    os.makedirs(options.workspace, exist_ok=True)
    started, final = now(), _place(options)
    stage = os.path.join(options.workspace, f".stage-{uuid.uuid4().hex}")
    os.makedirs(stage)
    try:
        uri = f"file://{os.path.abspath(stage)}"
        keep_raw(spark, source, f"{os.path.abspath(stage)}/raw")
        kind = options.input_format or detect(spark, source)
        parsed = parse_source(spark, source, kind, os.path.basename(final), options.max_fields, options.max_line_bytes)
        valid = records_of(parsed)
        valid.write.parquet(f"{uri}/records")
        rejects_of(parsed).write.parquet(f"{uri}/rejects")
        records, rejects = spark.read.parquet(f"{uri}/records"), spark.read.parquet(f"{uri}/rejects")
        types, metrics, timing, quality, engineering = analyse(records, options.roles)
        check_fields(options.units, types)
        write_csv(records, sorted(types), f"{uri}/data")
        write_json(f"{stage}/metrics.json", {"fields": metrics, "timing": timing, **engineering})
        write_json(f"{stage}/quality.json", quality)
        with open(f"{stage}/notes.md", "w", encoding="utf-8") as f:
            f.write(f"# {markdown_safe(options.name)}\n")
        good, bad = records.count(), rejects.count()
        warnings = [f"record {r.record}: {r.reason}" for r in rejects.orderBy("record").limit(100).collect()]
        manifest = {
            "runledger_version": __version__, "session_format_version": VERSION, "session_name": os.path.basename(final), "started_at": started, "ended_at": now(), "original_command": options.command,
            "working_directory": os.getcwd() if options.include_path else None, "parameters": options.parameters, "input_format": kind, "parser_policy": "strict", "fields": types, "record_count": good + bad,
            "valid_record_count": good, "invalid_record_count": bad, "time_field": options.roles.get("time"), "field_roles": {r: options.roles.get(r) for r in ROLES}, "sampling": timing, "units": options.units,
            "parser_warnings": warnings, "interrupted": options.interrupted, "hashes": hashes(spark, stage), "integrity_scope": "accidental corruption", "commands": [], "command_context": None,
        }
        write_json(f"{stage}/manifest.json", manifest)
        with open(f"{stage}/manifest.sha256", "w", encoding="ascii") as f:
            f.write(f"{sha256_file(f'{stage}/manifest.json')}  manifest.json\n")
        _publish(stage, final)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise
    return Session.open(final)


def is_session(path: str) -> bool:
    return os.path.isfile(os.path.join(path, "manifest.json"))


@dataclass(frozen=True)
class Session:
    """A published session: its folder and its manifest."""

    path: str
    manifest: dict[str, Any]

    @property
    def name(self) -> str:
        return self.manifest["session_name"]

    @classmethod
    def open(cls, source: str, workspace: str | None = None) -> Session:
        """Opens a folder, or a name in a workspace; refuses links and manifests that lack or break required entries."""
        path = source if is_session(source) or workspace is None else os.path.join(workspace, safe_name(source))
        if os.path.islink(path) or any(os.path.islink(os.path.join(path, n)) for n in (os.listdir(path) if os.path.isdir(path) else [])):
            raise ValueError("a session may not hold links")
        file = os.path.join(path, "manifest.json")
        if not os.path.isfile(file) or os.path.getsize(file) > MANIFEST_BYTES:
            raise ValueError(f"no session: {terminal_safe(source)}")
        with open(file, encoding="utf-8") as f:
            manifest = json.load(f)
        if not isinstance(manifest, dict) or manifest.get("session_format_version") not in (1, 2):
            raise ValueError("unknown session format")
        if missing := [k for k in KEYS if k not in manifest]:
            raise ValueError(f"the manifest lacks {', '.join(missing)}")
        counts = [manifest[k] for k in ("record_count", "valid_record_count", "invalid_record_count")]
        if any(not isinstance(c, int) or isinstance(c, bool) or c < 0 for c in counts) or counts[0] != counts[1] + counts[2]:
            raise ValueError("the manifest's counts do not add up")
        for k in ("started_at", "ended_at"):
            if datetime.fromisoformat(manifest[k]).tzinfo is None:
                raise ValueError(f"{k} has no time zone")
        if any(".." in n.split("/") or n.startswith("/") for n in manifest["hashes"]):
            raise ValueError("the manifest names a path outside the session")
        return cls(os.path.abspath(path), manifest)

    def records(self, spark: SparkSession | None = None) -> DataFrame:
        return (spark or SparkSession.builder.getOrCreate()).read.parquet(f"file://{self.path}/records")

    def rejects(self, spark: SparkSession | None = None) -> DataFrame:
        return (spark or SparkSession.builder.getOrCreate()).read.parquet(f"file://{self.path}/rejects")

    def verify(self, spark: SparkSession | None = None) -> list[str]:
        """What is wrong: the manifest's digest, missing, changed and extra files, and counts. Nothing if all is well."""
        spark = spark or SparkSession.builder.getOrCreate()
        wrong = []
        if self.manifest["session_format_version"] >= 2:
            try:
                with open(f"{self.path}/manifest.sha256", encoding="ascii") as f:
                    if f.read().split()[:1] != [sha256_file(f"{self.path}/manifest.json")]:
                        wrong.append("hash mismatch: manifest.json")
            except OSError:
                wrong.append("missing: manifest.sha256")
        wrong += [f"missing: {n}" for n in REQUIRED if not os.path.exists(f"{self.path}/{n}")]
        expected, found = self.manifest["hashes"], hashes(spark, self.path)
        wrong += [f"missing: {n}" for n in sorted(set(expected) - set(found))]
        wrong += [f"not in the manifest: {n}" for n in sorted(set(found) - set(expected))]
        changed = [n for n in sorted(set(found) & set(expected)) if found[n] != expected[n]]
        wrong += [f"hash mismatch: {n}" for n in changed]
        if not changed and not any(w.startswith("missing") for w in wrong):
            for what, df in (("valid", self.records(spark)), ("invalid", self.rejects(spark))):
                if df.count() != self.manifest[f"{what}_record_count"]:
                    wrong.append(f"count mismatch: {what} records")
        return wrong


def list_sessions(workspace: str) -> list[Session]:
    """The workspace's sessions by name, without regard to case; folders that are none are left out."""
    found = []
    for n in sorted(os.listdir(workspace), key=str.casefold) if os.path.isdir(workspace) else []:
        if not n.startswith(".") and is_session(os.path.join(workspace, n)):
            try:
                found.append(Session.open(os.path.join(workspace, n)))
            except ValueError:
                continue
    return found


def convert(spark: SparkSession, source: str, output: str, to: str, input_format: str | None = None, overwrite: bool = False) -> tuple[int, int]:
    """Writes a source as csv or jsonl files under ``output``, and its rejects beside them; returns valid and invalid counts."""
    if to not in ("csv", "jsonl"):
        raise ValueError("convert to csv or jsonl")
    if os.path.exists(output) and not overwrite:
        raise FileExistsError(f"{output} exists")
    if is_session(source):
        session = Session.open(source)
        records, rejects = session.records(spark), session.rejects(spark)
    else:
        parsed = parse_source(spark, source, input_format)
        records, rejects = records_of(parsed), rejects_of(parsed)
    part = f"{output}.{uuid.uuid4().hex}"
    uri = f"file://{os.path.abspath(part)}"
    try:
        if to == "csv":
            names = [r.field for r in cells_from(records).select("field").distinct().orderBy("field").collect()]
            write_csv(records, names, uri)
        else:
            records.orderBy("record_index").select("original").write.option("lineSep", "\n").text(uri)
        if os.path.exists(output):
            shutil.rmtree(output) if os.path.isdir(output) else os.remove(output)
        os.rename(part, output)
    except BaseException:
        shutil.rmtree(part, ignore_errors=True)
        raise
    n = records.count()
    bad = rejects.count()
    side = f"{output}.invalid"
    shutil.rmtree(side, ignore_errors=True)
    rejects.orderBy("record").select("record", "reason").write.json(f"file://{os.path.abspath(side)}")
    return n, bad


def report(spark: SparkSession, session: Session, kind: str = "markdown") -> str:
    """A report as Markdown or JSON; everything is computed anew from the records."""
    data = {"inspection": inspect_source(session.path, spark=spark).to_dict(), "manifest": session.manifest, "integrity": session.verify(spark)}
    if kind == "json":
        return json.dumps(data, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n"
    if kind != "markdown":
        raise ValueError("a report is markdown or json")
    i, m = data["inspection"], session.manifest
    out = [f"# {markdown_safe(session.name)}", "", f"Integrity: {'FAILED' if data['integrity'] else 'verified'}", *[f"- {markdown_safe(w)}" for w in data["integrity"]], ""]
    out += [f"- Records: {i['record_count']} ({i['valid_record_count']} valid, {i['invalid_record_count']} invalid)", f"- Format: {code_span(i['format'])}", f"- Recorded: {markdown_safe(m['started_at'])} to {markdown_safe(m['ended_at'])}", ""]
    out += ["## Fields", "", "| Field | Type | Unit | Valid | Mean | Median | Deviation | Minimum | Maximum |", "|-|-|-|-|-|-|-|-|-|"]
    for name, kind_ in i["fields"].items():
        x = i["metrics"].get(name, {})
        cells = [markdown_safe(name), kind_, markdown_safe(i["units"].get(name, "")), x.get("valid_count", 0), *(f"{x[k]:.6g}" if x.get(k) is not None else "" for k in ("mean", "median", "standard_deviation", "minimum", "maximum"))]
        out.append(f"| {' | '.join(map(str, cells))} |")
    for title, values in (("Timing", i["timing"]), *((k.capitalize(), v) for k, v in i["engineering"].items())):
        if values:
            out += ["", f"## {title}", "", *[f"- {markdown_safe(k)}: {markdown_safe(v)}" for k, v in values.items()]]
    out += ["", "## Findings", ""]
    out += [f"- {f['severity']}: {code_span(f['check_id'])} {markdown_safe(f['field'] or '')} ({markdown_safe(f['affected'])}): {markdown_safe(f['explanation'])}" for f in i["quality"]] or ["None."]
    return "\n".join(out) + "\n"


def doctor(workspace: str, spark: SparkSession | None = None) -> list[dict[str, Any]]:
    """Checks of the surroundings: Python, the workspace, optional plotting, and every session's integrity."""
    checks = [{"check": "python", "required": True, "ok": sys.version_info >= (3, 9), "detail": sys.version.split()[0]}]
    try:
        os.makedirs(workspace, exist_ok=True)
        probe = os.path.join(workspace, f".probe-{uuid.uuid4().hex}")
        with open(probe, "w"):
            pass
        os.remove(probe)
        ok, detail = True, workspace
    except OSError as why:
        ok, detail = False, str(why)
    checks.append({"check": "workspace", "required": True, "ok": ok, "detail": detail})
    try:
        import matplotlib

        checks.append({"check": "png plots", "required": False, "ok": True, "detail": matplotlib.__version__})
    except ImportError:
        checks.append({"check": "png plots", "required": False, "ok": False, "detail": "matplotlib is not installed; SVG needs nothing"})
    if spark is not None:
        for s in list_sessions(workspace):
            wrong = s.verify(spark)
            checks.append({"check": f"session {s.name}", "required": True, "ok": not wrong, "detail": "; ".join(wrong)})
    return checks
