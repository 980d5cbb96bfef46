"""Timing of a series of times in record order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators.ordered import percentiles, previous
from runledger.operators.written import written


def intervals(times: DataFrame) -> DataFrame:
    """(session_id, record_index, t, dt): dt is the time since the record before that has a time; null for the first."""
    kept = times.filter("t is not null").select("session_id", "record_index", "t")
    return previous(kept, ["session_id"], "record_index", ["t"]).select("session_id", "record_index", "t", (F.col("t") - F.col("prev.t")).alias("dt"))


def timing_metrics(times: DataFrame, most_rows: int | None = None) -> DataFrame:
    """One row a session of ``times`` (session_id, record_index, t in seconds).

    start, end and duration follow record order. Means, jitter and the sample rate are over positive
    intervals, the extremes over all. ``most_rows``: see ``percentiles``. gap_count counts positive intervals of at least twice the median.
    """
    steps = written(intervals(times), "intervals")
    positive = F.when(F.col("dt") > 0, F.col("dt"))
    i, t = F.col("record_index"), F.col("t")
    # One pass; the median needs the positive intervals once more, and the gaps the median.
    base = steps.groupBy("session_id").agg(
        F.count("t").alias("n"), F.min_by(t, i).alias("start"), F.max_by(t, i).alias("end"), F.avg(positive).alias("mean_positive"),
        F.min("dt").alias("minimum_interval"), F.max("dt").alias("maximum_interval"), F.stddev_pop(positive).alias("sd"),
        F.count_if(F.col("dt") < 0).alias("backward_timestamp_count"), F.count("dt").alias("steps"),
    )
    distinct = steps.select("session_id", "t").distinct().groupBy("session_id").agg(F.count("*").alias("distinct_t"))
    median = percentiles(steps.withColumn("dt", positive), ["session_id"], "dt", [0.5], most_rows=most_rows).select("session_id", F.get("p", F.lit(0)).alias("m"))
    gaps = steps.join(median, "session_id").groupBy("session_id").agg(F.first("m").alias("median_positive"), F.count_if((F.col("dt") > 0) & (F.col("m") > 0) & (F.col("dt") >= 2 * F.col("m"))).alias("gap_count"))
    some = F.col("steps") > 0
    return base.join(distinct, "session_id").join(gaps, "session_id", "left").select(
        "session_id", "start", "end", (F.col("end") - F.col("start")).alias("duration"),
        F.when(some, F.coalesce("mean_positive", F.lit(0.0))).alias("mean_interval"), F.when(some, F.coalesce("median_positive", F.lit(0.0))).alias("median_interval"),
        "minimum_interval", "maximum_interval", F.when(some, F.coalesce("sd", F.lit(0.0))).alias("jitter"), F.try_divide(F.lit(1.0), "mean_positive").alias("effective_sample_rate"),
        F.coalesce("gap_count", F.lit(0)).alias("gap_count"), (F.col("n") - F.col("distinct_t")).alias("duplicate_timestamp_count"), "backward_timestamp_count",
    )
