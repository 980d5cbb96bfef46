"""Downsampling that keeps extrema, and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.operators.cells import SERIES
from runledger.operators.ordered import positions


def evenly(i: Column, n: Column, most: Column) -> Column:
    """Whether place ``i`` of ``n`` is one of ``most`` evenly spaced ones: round(k * (n - 1) / (most - 1)), half to even."""
    k = F.rint(i * (most - 1) / F.greatest(n - 1, F.lit(1)))
    near = lambda d: i == F.rint((k + d) * (n - 1) / F.greatest(most - 1, F.lit(1)))
    return (n <= most) | F.when(most == 1, i == 0).otherwise((most > 1) & (near(0) | near(-1) | near(1)))


def downsample(series: DataFrame, most: int = 5000) -> DataFrame:
    """At most ``most`` points a series of (session_id, field, record_index, x, y), without nulls in y.

    Longer series are cut into (max(most, 4) - 2) // 2 buckets of equal count, each with its first and last points, its first
    smallest and its last largest value. The series' first and last points and extrema are always kept; if all that is more than ``most``, the
    other points are thinned evenly to what the budget leaves.
    """
    points = positions(series.filter("y is not null").select(*SERIES, "record_index", "x", "y"), SERIES, "record_index", "i")
    sized = points.groupBy(*SERIES).agg(F.count("*").alias("n"), F.min_by("i", F.struct("y", "i")).alias("lo"), F.max_by("i", F.struct("y", "i")).alias("hi"))
    buckets = max(1, (max(most, 4) - 2) // 2)
    all_ = points.join(sized, SERIES)
    small = all_.filter(F.col("n") <= most)
    large = all_.filter(F.col("n") > most).withColumn("b", F.floor(((F.col("i") + 1) * buckets - 1) / F.col("n")))
    ends = large.groupBy(*SERIES, "b").agg(F.min_by("i", F.struct("y", "i")).alias("a"), F.max_by("i", F.struct("y", "i")).alias("z"), F.min("i").alias("first"), F.max("i").alias("last"))
    bucketed = ends.select(*SERIES, F.explode(F.array("a", "z", "first", "last")).alias("i"))
    required = F.array_distinct(F.array(F.lit(0).cast("long"), F.col("n") - 1, "lo", "hi"))
    anchors = sized.filter(F.col("n") > most).select(*SERIES, required.alias("anchors"), F.size(required).alias("n_anchors"))
    # A series' points are at most 4 a bucket now.
    wanted = bucketed.unionByName(anchors.select(*SERIES, F.explode("anchors").alias("i"))).distinct().join(anchors, SERIES)
    extras = wanted.filter(~F.array_contains("anchors", F.col("i")))
    placed = positions(extras, SERIES, "i", "at").join(extras.groupBy(*SERIES).agg(F.count("*").alias("n_extras")), SERIES)
    budget = F.lit(most) - F.col("n_anchors")
    thinned = placed.filter((budget > 0) & evenly(F.col("at"), F.col("n_extras"), budget)).select(*SERIES, "i")
    kept = thinned.unionByName(anchors.select(*SERIES, F.explode(F.slice(F.array_sort("anchors"), 1, most)).alias("i")))
    return small.select(*SERIES, "record_index", "x", "y").unionByName(large.join(kept, [*SERIES, "i"]).select(*SERIES, "record_index", "x", "y"))


def histogram_values(series: DataFrame, most: int = 5000) -> DataFrame:
    """(session_id, field, i, y): at most ``most`` evenly spaced values of a series in order, its smallest at the first place and its
    largest at the last one unless they are there anyway."""
    points = positions(series.filter("y is not null").select(*SERIES, "record_index", "y"), SERIES, "record_index", "at")
    sized = points.groupBy(*SERIES).agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    picked = points.join(sized, SERIES).filter(evenly(F.col("at"), F.col("n"), F.lit(most)))
    # As many as ``most`` values from here on, renumbered by their places.
    held = picked.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("at", "y"))).alias("v"), F.first("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    held = held.withColumn("v", F.transform("v", lambda s: s["y"])).withColumn("size", F.size("v"))
    low = F.transform("v", lambda y, k: F.when((k == 0) & ~F.array_contains("v", F.col("lo")), F.col("lo")).otherwise(y))
    held = held.withColumn("v", F.when(F.col("n") > most, low).otherwise(F.col("v")))
    high = F.transform("v", lambda y, k: F.when((k == F.col("size") - 1) & ~F.array_contains("v", F.col("hi")), F.col("hi")).otherwise(y))
    held = held.withColumn("v", F.when(F.col("n") > most, high).otherwise(F.col("v")))
    return held.select(*SERIES, F.posexplode("v").alias("i", "y"))


def missing_markers(series: DataFrame, most: int = 5000) -> DataFrame:
    """(session_id, field, record_index, x) of points that have an x and no number, evenly thinned to ``most``."""
    gone = positions(series.filter("x is not null and y is null").select(*SERIES, "record_index", "x"), SERIES, "record_index", "i")
    n = gone.groupBy(*SERIES).agg(F.count("*").alias("n"))
    return gone.join(n, SERIES).filter(evenly(F.col("i"), F.col("n"), F.lit(most))).select(*SERIES, "record_index", "x")


def histogram(cells: DataFrame, bins: int = 10) -> DataFrame:
    """(session_id, field, bin, low, high, count) of equal bins between a series' extremes; the last one is closed."""
    values = cells.filter("num is not null").select(*SERIES, "num")
    limits = values.groupBy(*SERIES).agg(F.min("num").alias("lo"), F.max("num").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("num") - F.col("lo")) / width))).otherwise(F.lit(0))
    counted = values.join(limits, SERIES).withColumn("bin", at.cast("int")).groupBy(*SERIES, "bin").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.count("*").alias("count"))
    return counted.select(*SERIES, "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "count")
