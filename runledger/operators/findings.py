"""Data-quality findings: one rule a function, all as rows of one schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.operators.cells import SERIES, is_missing
from runledger.operators.ordered import affected, percentiles, previous, runs_of
from runledger.operators.timing import intervals
from runledger.operators.written import written

COLUMNS = ["session_id", "check_id", "severity", "field", "n", "affected", "evidence", "threshold", "explanation", "assumptions", "suggested_investigation"]

#: check -> (severity, explanation, what to look at next)
CHECKS = {
    "empty-data": ("warning", "The session has no valid record.", "See whether the producer wrote anything and why rows were rejected."),
    "duplicate-rows": ("warning", "Whole records occur more than once.", "See whether the producer or the transport repeats records."),
    "record-shape-change": ("warning", "Records differ in their sets of field names.", "See which producer version or branch writes which fields."),
    "record-length-change": ("warning", "Records differ in their number of fields.", "See where fields are added or dropped."),
    "missing-values": ("warning", "The field is absent, null or empty in some records.", "See what these records have in common."),
    "type-change": ("warning", "The field holds values of several types.", "See how the producer formats this field."),
    "non-finite": ("error", "The field holds values that are not finite numbers.", "See which computation yields NaN or an infinity."),
    "invalid-values": ("warning", "The field holds values that cannot be used as exact numbers.", "See whether these are identifiers or faults."),
    "monotonicity-violation": ("warning", "The field was expected never to decrease, and does.", "See what happens at the first decrease."),
    "counter-reset": ("warning", "The counter falls.", "See whether the device restarted."),
    "constant-signal": ("info", "All values are equal.", "See whether the input is connected."),
    "frozen-values": ("warning", "The value stays the same for five records or more.", "See whether the sensor or the link stopped."),
    "outliers": ("warning", "Values lie more than six median absolute deviations from the median.", "See whether these are events or faults."),
    "sudden-spikes": ("warning", "A step is more than ten times the median step.", "See the records before and after the step."),
    "high-noise": ("info", "The standard deviation is more than half of the mean.", "See whether this spread is expected."),
    "duplicate-timestamps": ("warning", "A time occurs more than once.", "See the clock's resolution and repeated records."),
    "timestamps-backwards": ("error", "Time goes back between records.", "See clock changes and merged sources."),
    "irregular-timing": ("warning", "Intervals differ from the median by more than a fifth.", "See how the producer paces its records."),
    "large-timing-gaps": ("warning", "Intervals are more than twice the median.", "See what stopped the producer."),
    "packet-loss": ("warning", "Sequence numbers are missing.", "See the link and the receiver's buffers."),
}


def _rows(df: DataFrame, check: str, n: Column, span: Column, evidence: dict[str, Column], threshold: dict[str, object] | None = None, field: Column | None = None, assumptions: Iterable[str] = ()) -> DataFrame:
    severity, said, look = CHECKS[check]
    as_json = lambda items: F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in items.items()])) if items else F.lit("{}")
    return df.select(
        "session_id", F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), (field if field is not None else F.lit(None).cast("string")).alias("field"), n.cast("long").alias("n"), span.alias("affected"),
        as_json(evidence).alias("evidence"), as_json(threshold or {}).alias("threshold"), F.lit(said).alias("explanation"), F.array(*map(F.lit, assumptions)).cast("array<string>").alias("assumptions"), F.lit(look).alias("suggested_investigation"),
    )


def _whole() -> Column:
    return F.lit("dataset")


def empty_data(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """``sessions`` (session_id) without a record."""
    none = sessions.select("session_id").distinct().join(records.select("session_id").distinct(), "session_id", "left_anti")
    return _rows(none, "empty-data", F.lit(0), _whole(), {"records": F.lit(0)})


def duplicate_rows(records: DataFrame) -> DataFrame:
    again = records.groupBy("session_id", "payload").count().filter("count > 1").groupBy("session_id").agg(F.sum(F.col("count") - 1).alias("n"))
    return _rows(again, "duplicate-rows", F.col("n"), _whole(), {"duplicates": F.col("n")})


def shape_change(records: DataFrame) -> DataFrame:
    shapes = records.groupBy("session_id").agg(F.array_sort(F.collect_set(F.to_json("schema_key"))).alias("shapes")).filter("size(shapes) > 1")
    return _rows(shapes, "record-shape-change", F.size("shapes"), _whole(), {"shapes": F.col("shapes")})


def length_change(records: DataFrame) -> DataFrame:
    sizes = records.groupBy("session_id").agg(F.array_sort(F.collect_set("field_count")).alias("lengths")).filter("size(lengths) > 1")
    return _rows(sizes, "record-length-change", F.size("lengths"), _whole(), {"lengths": F.col("lengths")})


def missing_values(cells: DataFrame, records: DataFrame) -> DataFrame:
    """Absent, null and empty. record_index is gapless, so absent records show as gaps between present ones: no grid is made."""
    totals = records.groupBy("session_id").agg(F.count("*").alias("total"))
    present = cells.filter(~is_missing()).select(*SERIES, "record_index")
    near = previous(present, SERIES, "record_index", [])
    i, before = F.col("record_index"), F.col("prev.record_index")
    gap = i - before > 1
    held = near.groupBy(*SERIES).agg(F.count("*").alias("held"), F.min(i).alias("lo"), F.max(i).alias("hi"), F.min(F.when(gap, before + 1)).alias("g1"), F.max(F.when(gap, i - 1)).alias("g2"))
    found = cells.select(*SERIES).distinct().join(totals, "session_id").join(held, SERIES, "left").withColumn("n", F.col("total") - F.coalesce("held", F.lit(0))).filter("n > 0")
    end = F.col("total") - 1
    first = F.when(F.col("held").isNull() | (F.col("lo") > 0), F.lit(0)).otherwise(F.coalesce("g1", F.col("hi") + 1))
    last = F.when(F.col("held").isNull() | (F.col("hi") < end), end).otherwise(F.coalesce("g2", F.col("lo") - 1))
    return _rows(found, "missing-values", F.col("n"), affected(first.cast("long"), last.cast("long")), {"missing": F.col("n"), "records": F.col("total")}, field=F.col("field"))


def type_change(cells: DataFrame) -> DataFrame:
    kinds = cells.filter("kind <> 'null'").groupBy(*SERIES).agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.min("record_index").alias("a"), F.max("record_index").alias("z"), F.count("*").alias("n"))
    mixed = kinds.filter((F.size("kinds") > 1) & (F.size(F.array_except("kinds", F.array(F.lit("int"), F.lit("float")))) > 0))
    return _rows(mixed, "type-change", F.size("kinds"), affected(F.col("a"), F.col("z")), {"types": F.col("kinds")}, field=F.col("field"))


def _where(rows: DataFrame, check: str, condition: Column, threshold: dict | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """A finding a series with rows where ``condition`` holds, with their number, first and last."""
    hit = F.when(condition, F.col("record_index"))
    keys = [k for k in SERIES if k in rows.columns]
    found = rows.groupBy(*keys).agg(F.count(hit).alias("n"), F.min(hit).alias("a"), F.max(hit).alias("z"), *[F.first(c).alias(k) for k, c in (extra or {}).items()]).filter("n > 0")
    return _rows(found, check, F.col("n"), affected(F.col("a"), F.col("z")), {"count": F.col("n"), **{k: F.col(k) for k in extra or {}}}, threshold, field=F.col("field") if "field" in keys else None)


def non_finite(typed: DataFrame) -> DataFrame:
    """``typed``: session_id, record_index, field, value double, which may hold NaN and infinities."""
    return _where(typed, "non-finite", F.isnan("value") | (F.abs("value") == float("inf")))


def large_integers(cells: DataFrame) -> DataFrame:
    return _where(cells, "invalid-values", (F.col("kind") == "int") & F.col("num").isNull(), {"exact_up_to": 1 << 53})


def _numeric(cells: DataFrame, skip: Iterable[str] = ()) -> DataFrame:
    kept = cells.filter("num is not null").select(*SERIES, "record_index", "num")
    return kept.filter(~F.col("field").isin(*skip)) if (skip := list(skip)) else kept


def near(cells: DataFrame, skip: Iterable[str] = ()) -> DataFrame:
    """The numeric cells with the value before: what all checks of values read."""
    return previous(_numeric(cells, skip), SERIES, "record_index", ["num"], "before")


def profile(steps: DataFrame, medians: bool = True, most_rows: int | None = None) -> DataFrame:
    """A row a series of ``near``: number, extremes, mean, deviation, first and last record, descents, and the medians of values, steps and deviations."""
    i, fell = F.col("record_index"), F.when(F.col("num") < F.col("before.num"), F.col("record_index"))
    one = steps.groupBy(*SERIES).agg(
        F.count("*").alias("n"), F.min("num").alias("lo"), F.max("num").alias("hi"), F.avg("num").alias("mean"), F.stddev_samp("num").alias("sd"), F.min(i).alias("a"), F.max(i).alias("z"),
        F.count(fell).alias("falls"), F.min(fell).alias("fall_a"), F.max(fell).alias("fall_z"),
    )
    if not medians:
        return one
    step = steps.select(*SERIES, F.abs(F.col("num") - F.col("before.num")).alias("step")).filter("step is not null")
    middle = _with_medians(steps, "num", "median", most_rows)
    away = steps.join(middle, SERIES).withColumn("dev", F.abs(F.col("num") - F.col("median")))
    return one.join(middle, SERIES).join(_with_medians(away, "dev", "mad", most_rows), SERIES).join(_with_medians(step, "step", "base", most_rows), SERIES, "left")


def descents(cells: DataFrame, fields: Iterable[str], check: str, of: DataFrame | None = None) -> DataFrame:
    """monotonicity-violation or counter-reset of the named fields. Here and below ``of`` is the profile, where it is made already."""
    of = profile(near(cells), False) if of is None else of
    found = of.filter(F.col("field").isin(*fields) & (F.col("falls") > 0))
    return _rows(found, check, F.col("falls"), affected(F.col("fall_a"), F.col("fall_z")), {"count": F.col("falls")}, field=F.col("field"))


def constant_signal(cells: DataFrame, skip: Iterable[str] = (), of: DataFrame | None = None) -> DataFrame:
    flat = (profile(near(cells, skip), False) if of is None else of).filter("n >= 2 and lo = hi")
    return _rows(flat, "constant-signal", F.col("n"), affected(F.col("a"), F.col("z")), {"value": F.col("lo")}, field=F.col("field"))


def frozen_values(cells: DataFrame, skip: Iterable[str] = (), least: int = 5, steps: DataFrame | None = None) -> DataFrame:
    steps = near(cells, skip) if steps is None else steps
    longest = runs_of(steps, SERIES, "record_index", "num", "before").groupBy(*SERIES).agg(F.min_by(F.struct("start", "end", "length"), F.struct(-F.col("length"), "start")).alias("r"))
    sized = longest.join(steps.groupBy(*SERIES).agg(F.count("*").alias("n")), SERIES).filter((F.col("r.length") >= least) & (F.col("r.length") < F.col("n")))
    return _rows(sized, "frozen-values", F.col("r.length"), affected(F.col("r.start"), F.col("r.end")), {"length": F.col("r.length")}, {"least": least}, field=F.col("field"))


def _with_medians(values: DataFrame, column: str, name: str, most_rows: int | None) -> DataFrame:
    return percentiles(values, SERIES, column, [0.5], "_m", most_rows=most_rows).select(*SERIES, F.get("_m", F.lit(0)).alias(name))


def judged(steps: DataFrame, of: DataFrame) -> DataFrame:
    """A row a series with its outliers and spikes, in one pass: their numbers, first and last records."""
    row = steps.join(of.filter("n >= 5").select(*SERIES, "median", "mad", "base"), SERIES)
    step = F.abs(F.col("num") - F.col("before.num"))
    out = F.when(F.col("mad") > 0, F.abs(F.col("num") - F.col("median")) > 6 * F.col("mad")).otherwise(F.col("num") != F.col("median"))
    spike = F.when(F.col("base") > 0, step > 10 * F.col("base")).otherwise(step > 0)
    parts = [F.first(c).alias(c) for c in ("median", "mad", "base")]
    for name, c in (("out", out), ("spike", spike)):
        hit = F.when(c, F.col("record_index"))
        parts += [F.count(hit).alias(f"{name}_n"), F.min(hit).alias(f"{name}_a"), F.max(hit).alias(f"{name}_z")]
    return row.groupBy(*SERIES).agg(*parts)


def _judged(cells: DataFrame, skip: Iterable[str]) -> DataFrame:
    steps = near(cells, skip)
    return judged(steps, profile(steps))


def outliers(cells: DataFrame, skip: Iterable[str] = (), of: DataFrame | None = None) -> DataFrame:
    """``of``: the result of ``judged``, where it is made already."""
    found = (_judged(cells, skip) if of is None else of).filter("out_n > 0")
    return _rows(found, "outliers", F.col("out_n"), affected(F.col("out_a"), F.col("out_z")), {"count": F.col("out_n"), "median": F.col("median"), "mad": F.col("mad")}, {"deviations": 6}, F.col("field"))


def sudden_spikes(cells: DataFrame, skip: Iterable[str] = (), of: DataFrame | None = None) -> DataFrame:
    """``of``: the result of ``judged``, where it is made already."""
    found = (_judged(cells, skip) if of is None else of).filter("spike_n > 0")
    return _rows(found, "sudden-spikes", F.col("spike_n"), affected(F.col("spike_a"), F.col("spike_z")), {"count": F.col("spike_n"), "median_step": F.col("base")}, {"times_median": 10}, F.col("field"))


def high_noise(cells: DataFrame, skip: Iterable[str] = (), of: DataFrame | None = None) -> DataFrame:
    found = (profile(near(cells, skip), False) if of is None else of).filter("n >= 5 and mean <> 0 and sd / abs(mean) > 0.5")
    return _rows(found, "high-noise", F.col("n"), affected(F.col("a"), F.col("z")), {"ratio": F.col("sd") / F.abs("mean")}, {"ratio": 0.5}, field=F.col("field"))


def _named(found: DataFrame, field: str) -> DataFrame:
    return found.withColumn("field", F.lit(field))


def duplicate_timestamps(times: DataFrame, field: str = "t") -> DataFrame:
    """Records whose time an earlier record has: all of a time but the first; no row is compared to another."""
    kept = times.filter("t is not null").select("session_id", "record_index", "t")
    first = kept.groupBy("session_id", "t").agg(F.min("record_index").alias("f"), F.count("*").alias("c")).filter("c > 1").select(F.col("session_id").alias("s"), F.col("t").alias("tt"), "f")
    late = kept.join(first, (F.col("session_id") == F.col("s")) & (F.col("t") == F.col("tt"))).filter("record_index > f")
    return _named(_where(late, "duplicate-timestamps", F.lit(True)), field)


def backwards(times: DataFrame, field: str = "t", steps: DataFrame | None = None) -> DataFrame:
    """``steps``, here and below: the result of ``intervals``, where it is made already."""
    return _named(_where(intervals(times) if steps is None else steps, "timestamps-backwards", F.col("dt") < 0), field)


def _against_median(times: DataFrame, steps: DataFrame | None, most_rows: int | None) -> DataFrame:
    steps = (intervals(times) if steps is None else steps).filter("dt > 0")
    middle = percentiles(steps, ["session_id"], "dt", [0.5], most_rows=most_rows).select("session_id", F.get("p", F.lit(0)).alias("median"))
    enough = steps.groupBy("session_id").agg(F.count("*").alias("positives")).filter("positives > 2")
    return steps.join(middle.join(enough, "session_id"), "session_id")


def irregular_timing(times: DataFrame, field: str = "t", steps: DataFrame | None = None, most_rows: int | None = None) -> DataFrame:
    return _named(_where(_against_median(times, steps, most_rows), "irregular-timing", F.abs(F.col("dt") - F.col("median")) > 0.2 * F.col("median"), {"share": 0.2}, {"median": F.col("median")}), field)


def large_gaps(times: DataFrame, field: str = "t", steps: DataFrame | None = None, most_rows: int | None = None) -> DataFrame:
    return _named(_where(_against_median(times, steps, most_rows), "large-timing-gaps", F.col("dt") > 2 * F.col("median"), {"times_median": 2}, {"median": F.col("median")}), field)


def packet_loss(sequences: DataFrame, field: str = "seq") -> DataFrame:
    """``sequences``: session_id, record_index, seq double."""
    kept = sequences.filter("seq is not null and seq = floor(seq)")
    width = kept.groupBy("session_id").agg((F.max("seq") - F.min("seq") + 1).cast("long").alias("expected"), F.min("record_index").alias("a"), F.max("record_index").alias("z"))
    distinct = kept.select("session_id", "seq").distinct().groupBy("session_id").agg(F.count("*").alias("d"))
    lost = width.join(distinct, "session_id").withColumn("lost", F.col("expected") - F.col("d")).filter("lost > 0")
    return _named(_rows(lost, "packet-loss", F.col("lost"), affected(F.col("a"), F.col("z")), {"expected": F.col("expected"), "distinct": F.col("d")}), field)


def non_integer_sequences(sequences: DataFrame, field: str = "seq") -> DataFrame:
    return _named(_where(sequences, "invalid-values", F.col("seq") != F.floor("seq")), field)


def all_findings(sessions: DataFrame, records: DataFrame, cells: DataFrame, times: DataFrame | None = None, time_field: str | None = None, sequences: DataFrame | None = None, sequence_field: str | None = None, monotonic: Iterable[str] = (), counters: Iterable[str] = (), most_rows: int | None = None) -> DataFrame:
    """Findings of all checks. A time or sequence field is only checked as such, and for missing values and types.

    Values beside the value before them, a profile a series, and intervals are written once; the checks of values and of timing read these. ``most_rows``: see ``percentiles``.
    """
    skip = [f for f in (time_field, sequence_field) if f]
    parts = [empty_data(sessions, records), duplicate_rows(records), shape_change(records), length_change(records), missing_values(cells, records), type_change(cells), large_integers(cells)]
    steps = written(near(cells, skip), "near")
    of = written(profile(steps, most_rows=most_rows), "profile")
    marks = written(judged(steps, of), "judged")
    for fields, check in ((monotonic, "monotonicity-violation"), (counters, "counter-reset")):
        if named := [f for f in fields if f not in skip]:
            parts.append(descents(cells, named, check, of))
    parts += [constant_signal(cells, of=of), frozen_values(cells, steps=steps), outliers(cells, of=marks), sudden_spikes(cells, of=marks), high_noise(cells, of=of)]
    if times is not None:
        at, name = written(intervals(times), "intervals"), time_field or "t"
        parts += [duplicate_timestamps(times, name), backwards(times, name, at), *(f(times, name, at, most_rows) for f in (irregular_timing, large_gaps))]
    if sequences is not None:
        parts += [f(sequences, sequence_field or "seq") for f in (packet_loss, non_integer_sequences)]
    out = parts[0].select(*COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*COLUMNS))
    return out


def in_order(found: DataFrame) -> DataFrame:
    """By check, field and affected text."""
    return found.orderBy("session_id", "check_id", F.coalesce("field", F.lit("")), "affected")
