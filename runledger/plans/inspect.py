"""Inspection and comparison of sources: DataFrames of metrics and findings, and small results as plain values."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators import compare
from runledger.operators.cells import infer_types
from runledger.operators.engineering import control_metrics, network_metrics
from runledger.operators.findings import all_findings, in_order
from runledger.operators.stats import numeric_summary
from runledger.operators.timing import timing_metrics
from runledger.operators.written import shared_dir, written
from runledger.sources.text import cells_from, detect, parse_source, records_of, rejects_of

STATISTICS = ("valid_count", "minimum", "maximum", "mean", "median", "standard_deviation")
ROLES = ("time", "target", "response", "sequence", "latency", "bytes")


def scratch_text(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """Writes a table of one text column as text files and returns their folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def check_roles(roles: dict[str, str | None]) -> None:
    """A target needs a response and a time, a sequence a latency and the reverse, bytes need a sequence."""
    has = {r for r in ROLES if roles.get(r)}
    for role, needs in (("target", "response"), ("response", "target"), ("target", "time"), ("sequence", "latency"), ("latency", "sequence"), ("bytes", "sequence")):
        if role in has and needs not in has:
            raise ValueError(f"a {role} field needs a {needs} field")


def check_fields(names: Iterable[str | None], known: Iterable[str]) -> None:
    if unknown := sorted({n for n in names if n} - set(known)):
        raise ValueError(f"unknown fields: {', '.join(unknown)}")


@dataclass
class Inspection:
    """What a source holds; every value is as small as its fields are few."""

    source: str
    format: str
    record_count: int
    valid_record_count: int
    invalid_record_count: int
    fields: dict[str, str]
    metrics: dict[str, dict[str, Any]]
    timing: dict[str, Any]
    quality: list[dict[str, Any]]
    engineering: dict[str, dict[str, Any]] = field(default_factory=dict)
    units: dict[str, str] = field(default_factory=dict)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def series(cells: DataFrame, name: str, column: str, value: str = "num") -> DataFrame:
    return cells.filter(F.col("field") == name).select("session_id", "record_index", F.col(value).alias(column))


def by_role(cells: DataFrame, roles: dict[str, str | None]) -> DataFrame:
    """(session_id, record_index, and a column for each role), in one pass over the cells of the named fields."""
    at = lambda name, value: F.max(F.when(F.col("field") == F.lit(name), F.col(value))) if name else F.lit(None).cast("double")
    named = [n for n in roles.values() if n]
    columns = [at(roles.get(r), "t" if r == "time" else "num").alias({"time": "t", "sequence": "seq"}.get(r, r)) for r in ROLES]
    return cells.filter(F.col("field").isin(*named)).groupBy("session_id", "record_index").agg(*columns)


def _one(df: DataFrame) -> dict[str, Any]:
    row = df.first()
    return {} if row is None else {k: v for k, v in row.asDict(recursive=True).items() if k != "session_id"}


def analyse(records: DataFrame, roles: dict[str, str | None], monotonic: Iterable[str] = (), counters: Iterable[str] = ()) -> tuple[dict, dict, dict, list, dict]:
    """Types, metrics, timing, findings and engineering metrics of one session's records."""
    spark, n = records.sparkSession, records.count()
    cells = cells_from(records)
    types = {r.field: r.type for r in infer_types(cells).orderBy("field").collect()}
    check_fields([*roles.values(), *monotonic, *counters], types)
    metrics = {r.field: {k: v for k, v in r.asDict().items() if k not in ("session_id", "field")} for r in numeric_summary(cells, records, sparkline=40, most_rows=n).orderBy("field").collect()}
    times = series(cells, roles["time"], "t", "t") if roles.get("time") else None
    sequences = series(cells, roles["sequence"], "seq") if roles.get("sequence") else None
    timing = _one(timing_metrics(times, n)) if times is not None else {}
    sessions = records.select("session_id").limit(1)
    if not n:
        sessions = spark.createDataFrame([("session",)], "session_id string")
    found = all_findings(sessions, records, cells, times, roles.get("time"), sequences, roles.get("sequence"), monotonic, counters, n)
    quality = [{k: json.loads(v) if k in ("evidence", "threshold") else v for k, v in r.asDict().items() if k not in ("session_id", "n")} for r in in_order(found).collect()]
    engineering = {}
    if roles.get("target"):
        engineering["control"] = _one(control_metrics(by_role(cells, roles)))
    if roles.get("sequence"):
        engineering["network"] = _one(network_metrics(by_role(cells, roles), n))
    return types, metrics, timing, quality, engineering


def inspect_source(source: str, *, spark: SparkSession | None = None, input_format: str | None = None, time_field: str | None = None, monotonic_fields: Iterable[str] = (), counter_fields: Iterable[str] = (), target_field: str | None = None, response_field: str | None = None, sequence_field: str | None = None, latency_field: str | None = None, bytes_field: str | None = None) -> Inspection:
    """Inspects a session's folder, or text files of any format."""
    from runledger.plans.sessions import Session, is_session

    spark = spark or SparkSession.builder.getOrCreate()
    given = dict(zip(ROLES, (time_field, target_field, response_field, sequence_field, latency_field, bytes_field), strict=True))
    units: dict[str, str] = {}
    if is_session(source):
        session = Session.open(source)
        kept = session.manifest.get("field_roles", {})
        roles = {r: given[r] or kept.get(r) for r in ROLES}
        units = dict(session.manifest.get("units", {}))
        kind, records = session.manifest["input_format"], session.records(spark)
        valid, invalid = session.manifest["valid_record_count"], session.manifest["invalid_record_count"]
    else:
        roles, kind = given, input_format or detect(spark, source)
        parsed = parse_source(spark, source, kind)
        # Written once: every metric and check reads the records from there.
        records, invalid = written(records_of(parsed), "records"), rejects_of(parsed).count()
        valid = records.count()
    check_roles(roles)
    types, metrics, timing, quality, engineering = analyse(records, roles, list(monotonic_fields), list(counter_fields))
    return Inspection(source, kind, valid + invalid, valid, invalid, types, metrics, timing, quality, engineering, units)


@dataclass
class Comparison:
    """Sources side by side; the first is the baseline. Without a goal nothing is better than anything."""

    sources: list[str]
    fields: dict[str, dict[str, Any]]
    warnings: list[str]
    goal: dict[str, str] | None
    timing: dict[str, Any]

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def parse_goal(goal: str | None) -> tuple[str | None, bool]:
    """``lower:FIELD`` or ``higher:FIELD``."""
    if goal is None:
        return None, True
    way, colon, name = goal.partition(":")
    if way not in ("lower", "higher") or not name:
        raise ValueError("a goal is lower:FIELD or higher:FIELD")
    return name, way == "lower"


def compare_sessions(sources: list[str], fields: Iterable[str] | None = None, goal: str | None = None, *, spark: SparkSession | None = None) -> Comparison:
    """Compares two sources or more by the numeric fields that all have; the rules are those of ``operators.compare``."""
    if len(sources) < 2:
        raise ValueError("a comparison needs two sources or more")
    goal_field, lower = parse_goal(goal)
    spark = spark or SparkSession.builder.getOrCreate()
    found = [inspect_source(s, spark=spark) for s in sources]
    names = [(s.rstrip("/").rpartition("/")[2], n) for n, s in enumerate(sources)]
    labels = [r.label for r in compare.unique_labels(spark.createDataFrame(names, "label string, position int")).orderBy("position").collect()]
    stats = [(k, f, *(x.metrics[f][c] for c in STATISTICS)) for k, x in zip(labels, found, strict=True) for f in x.metrics]
    rows = spark.createDataFrame(stats, f"session_id string, field string, valid_count long, {', '.join(f'{c} double' for c in STATISTICS[1:])}")
    shared = {r.field for r in compare.shared_fields(rows).collect()}
    wanted = shared if fields is None else shared & set(fields)
    warnings = {f"not a numeric field of every source: {f}" for f in set(fields or ()) - shared}
    if goal_field is None:
        warnings.add("no goal is given; nothing is called better")
    elif goal_field not in wanted:
        warnings.add(f"the goal's field is not shared: {goal_field}")
    units = spark.createDataFrame([(k, f, x.units.get(f)) for k, x in zip(labels, found, strict=True) for f in x.metrics], "session_id string, field string, unit string")
    timed = [(k, x.timing.get("start"), x.timing.get("end"), x.timing.get("effective_sample_rate")) for k, x in zip(labels, found, strict=True) if x.timing]
    times = spark.createDataFrame(timed, "session_id string, start double, end double, effective_sample_rate double")
    all_timed = len(timed) == len(found)
    if not all_timed:
        warnings.add("no comparable time field in every source")
    judged = compare.compare(rows, labels[0], goal_field, lower, units, times if all_timed else None)
    out: dict[str, dict[str, Any]] = {}
    for r in sorted(judged.filter(F.col("field").isin(*wanted)).collect(), key=lambda r: (r.field, labels.index(r.session_id))) if wanted else []:
        detail = out.setdefault(r.field, {"means": {}, "statistics_by_source": {}, "units": {}, "comparable": r.comparable})
        source = found[labels.index(r.session_id)]
        detail["means"][r.session_id], detail["units"][r.session_id] = r.mean, source.units.get(r.field)
        detail["statistics_by_source"][r.session_id] = {c: source.metrics[r.field][c] for c in STATISTICS}
        if r.field == goal_field and r.comparable and r.improvement_percent is not None:
            detail.setdefault("improvement_percent", {})[r.session_id] = r.improvement_percent
        warnings |= set(r.warnings)
    timing: dict[str, Any] = {}
    if all_timed:
        c = compare.timing_context(times).first()
        timing = {
            "rates": {k: rate for k, _, _, rate in timed}, "ranges": {k: [a, b] for k, a, b, _ in timed}, "relative_ranges": {k: [0.0, max(0.0, b - a)] for k, a, b, _ in timed},
            "shared_range": None if c.shared_start is None else [c.shared_start, c.shared_end], "shared_relative_range": [c.relative_start, c.relative_end],
        }
        warnings.add("sources have no time in common" if c.shared_start is None else "time ranges are told, but nothing is resampled")
    return Comparison(labels, out, sorted(warnings), {"field": goal_field, "direction": "lower" if lower else "higher"} if goal_field else None, timing)
