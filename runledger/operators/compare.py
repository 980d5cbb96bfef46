"""Comparison of sessions by field name, against a baseline session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_fields(stats: DataFrame) -> DataFrame:
    """(field) of the numeric fields that every session of ``stats`` (session_id, field, ...) has."""
    sessions = stats.select("session_id").distinct().count()
    return stats.select("session_id", "field").distinct().groupBy("field").count().filter(F.col("count") == sessions).select("field")


def unique_labels(sources: DataFrame, label: str = "label", order: str = "position") -> DataFrame:
    """``sources`` with equal labels told apart: x, x#2, x#3 by ``order``."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return sources.withColumn("_n", n).withColumn(label, F.when(F.col("_n") > 1, F.concat_ws("#", F.col(label), F.col("_n"))).otherwise(F.col(label))).drop("_n")


def percent_change(value: Column, baseline: Column, lower_is_better: Column) -> Column:
    """Improvement in per cent of the baseline's size; null for a zero or missing baseline."""
    sign = F.when(lower_is_better, baseline - value).otherwise(value - baseline)
    return F.when(baseline != 0, sign / F.abs(baseline) * 100)


def compare(stats: DataFrame, baseline: str, goal_field: str | None = None, lower: bool = True, units: DataFrame | None = None, rates: DataFrame | None = None) -> DataFrame:
    """A row for each shared field and session: mean, difference to the baseline's mean, comparable, improvement, warnings.

    ``units`` (session_id, field, unit) must agree in a field; ``rates`` (session_id, effective_sample_rate) must agree
    within 1 %. Only ``goal_field`` gets an improvement, in per cent; without a goal nothing wins.
    """
    kept = stats.join(shared_fields(stats), "field").select("session_id", "field", "mean", "valid_count")
    base = kept.filter(F.col("session_id") == baseline).select("field", F.col("mean").alias("baseline_mean"), F.col("valid_count").alias("baseline_count"))
    out = kept.join(base, "field")
    same_unit, same_rate = F.lit(True), F.lit(True)
    if units is not None:
        agree = units.groupBy("field").agg((F.count_distinct(F.coalesce("unit", F.lit(""))) <= 1).alias("same_unit"))
        out, same_unit = out.join(agree, "field", "left"), F.coalesce("same_unit", F.lit(True))
    if rates is not None:
        agree = rates.agg(F.coalesce(F.max("effective_sample_rate") / F.min("effective_sample_rate") <= 1.01, F.lit(True)).alias("same_rate"))
        out, same_rate = out.crossJoin(F.broadcast(agree)), F.col("same_rate")  # one row
    comparable = same_unit & same_rate
    improvement = F.when(comparable & (F.col("field") == F.lit(goal_field)), percent_change(F.col("mean"), F.col("baseline_mean"), F.lit(lower)))
    warnings = F.array_sort(F.array_compact(F.array(
        F.when(~same_unit, F.concat(F.lit("units differ for "), "field")), F.when(~same_rate, F.lit("sampling rates differ by more than 1 %")),
        F.when(F.col("valid_count") != F.col("baseline_count"), F.concat(F.lit("numbers of valid values differ for "), "field")),
        F.when((F.col("field") == F.lit(goal_field)) & (F.col("baseline_mean") == 0), F.concat(F.lit("no percentage for a zero baseline of "), "field")),
    )))
    return out.select("field", "session_id", "mean", "valid_count", (F.col("mean") - F.col("baseline_mean")).alias("difference"), comparable.alias("comparable"), improvement.alias("improvement_percent"), warnings.alias("warnings"))


def timing_context(ranges: DataFrame) -> DataFrame:
    """One row from ``ranges`` (session_id, start, end): the shared absolute range (null if disjoint) and the shared relative range from 0."""
    lo, hi = F.max("start"), F.min("end")
    found = ranges.filter("start is not null").agg(lo.alias("lo"), hi.alias("hi"), F.min(F.greatest(F.lit(0.0), F.col("end") - F.col("start"))).alias("relative_end"), F.count("*").alias("sessions"))
    meets = F.col("lo") <= F.col("hi")
    return found.select("sessions", F.when(meets, F.col("lo")).alias("shared_start"), F.when(meets, F.col("hi")).alias("shared_end"), F.lit(0.0).alias("relative_start"), "relative_end")
