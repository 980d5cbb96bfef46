"""Numeric summaries of every series (session and field): one pass over blocks of adjacent values, and one for percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.operators.cells import SERIES
from runledger.operators.ordered import BLOCK, percentiles, samples

SHARES = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
#: Bits of a value's exponent that share a bin of exact sums.
BIN = 32


def exact_parts(x: Column) -> tuple[Column, Column, Column]:
    """(bin, high, low): a double as whole numbers, x = (high + low * 2**-53) * 2**(32 * bin), whose sums are exact.

    Values below 2**-900 have no bin; they are summed as they are.
    """
    at = F.when(F.abs(x) >= 2.0**-900, F.floor(F.log2(F.abs(x)) / BIN).cast("int"))
    unit = F.pow(F.lit(2.0), at * BIN)
    high = F.when(x >= 0, F.floor(x / unit)).otherwise(-F.floor(-x / unit)).cast("long")
    low = ((x / unit - high) * (2.0**53)).cast("long")
    return at, high, low


def joined_parts(parts: Column) -> Column:
    """The sum of an array of (bin, high, low, rest) of exact sums, largest bins first, with what each step rounds off carried along."""
    pieces = F.flatten(F.transform(F.reverse(F.array_sort(parts)), lambda p: F.array(*_pieces(p), F.coalesce(p["rest"], F.lit(0.0)))))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(a: Column, x: Column) -> Column:
        s = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - s) + x).otherwise((x - s) + a["s"])
        return F.struct(s.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(pieces, zero, add, lambda a: a["s"] + a["c"])


def _pieces(p: Column) -> list[Column]:
    unit = F.pow(F.lit(2.0), p["bin"] * BIN)
    out = []
    for name, scale in (("high", 1.0), ("low", 2.0**-53)):
        # A sum of many whole numbers has more bits than a double: it goes on in three.
        left = p[name]
        for size in (1 << 80, 1 << 40):
            by = F.lit(str(size)).cast("decimal(38,0)")
            whole = F.round(left / by).cast("decimal(38,0)")
            out.append(F.coalesce(whole.cast("double") * float(size) * scale * unit, F.lit(0.0)))
            left = (left - whole * by).cast("decimal(38,0)")
        out.append(F.coalesce(left.cast("double") * scale * unit, F.lit(0.0)))
    return out


def numeric_summary(cells: DataFrame, records: DataFrame | None = None, sparkline: int = 0, most_rows: int | None = None) -> DataFrame:
    """One row a series with a numeric value.

    count is the session's records (of ``records``, else the cells' largest record_index and one, as it has no gaps), missing_count
    those without a finite number in the field. Variance is of the sample, 0 for a single value; percentiles are exact; sums are
    rounded once; rate_of_change and mean_absolute_difference follow record_index over the numeric values. ``sparkline`` asks for so many samples.
    ``most_rows``: see ``percentiles``.
    """
    valid = cells.filter(F.col("num").isNotNull()).select(*SERIES, "record_index", "num")
    totals = records.groupBy("session_id").agg(F.count("*").alias("count")) if records is not None else cells.groupBy("session_id").agg((F.max("record_index") + 1).alias("count"))
    x, i = F.col("num"), F.col("record_index")
    blocked = valid.withColumn("_block", F.floor(i / F.lit(BLOCK)))
    near = blocked.withColumn("_before", F.lag(x).over(Window.partitionBy(*SERIES, "_block").orderBy("record_index")))
    at, high, low = exact_parts(x)
    step = F.abs(x - F.col("_before"))
    # A row a block and bin of exact sums: nothing below this line sees single values.
    rows = near.groupBy(*SERIES, "_block", at.alias("bin")).agg(
        F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count("*")).alias("m2"), F.sum(x * x).alias("squares"), F.sum(step).alias("steps"), F.count(step).alias("n_steps"),
        F.min(F.struct(i, x)).alias("first"), F.max(F.struct(i, x)).alias("last"), *_sums(x, at, high, low),
    )
    blocks = rows.groupBy(*SERIES, "_block").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(c).alias(c) for c in ("n", "squares", "steps", "n_steps")],
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.collect_list(F.struct("n", "mean", "m2")).alias("moments"), F.collect_list(F.struct("bin", "high", "low", "rest")).alias("parts"),
    )
    spread = F.aggregate("moments", F.lit(0.0), lambda a, m: a + m["m2"] + m["n"] * (m["mean"] - F.col("mean")) * (m["mean"] - F.col("mean")))
    w = Window.partitionBy(*SERIES).orderBy("_block")
    away = F.col("mean") - F.first("mean").over(w)  # moments about the first block's mean lose no digits to it
    edge = F.abs(F.col("first.num") - F.lag("last").over(w)["num"])
    across = blocks.select(*SERIES, "first", "last", "lo", "hi", "n", "squares", "parts", (F.coalesce("steps", F.lit(0.0)) + F.coalesce(edge, F.lit(0.0))).alias("steps"), (F.col("n_steps") + edge.isNotNull().cast("int")).alias("n_steps"),
        (F.col("n") * away).alias("s1"), (spread + F.col("n") * away * away).alias("s2"))
    added = ("n", "squares", "steps", "n_steps", "s1", "s2")
    one = across.select(*SERIES, "first", "last", "lo", "hi", F.posexplode("parts").alias("at", "p"), *added)
    bins = one.groupBy(*SERIES, "p.bin").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(F.when(F.col("at") == 0, F.col(c))).alias(c) for c in added],
        F.sum("p.high").cast("decimal(38,0)").alias("high"), F.sum("p.low").cast("decimal(38,0)").alias("low"), F.sum("p.rest").alias("rest"),
    )
    found = bins.groupBy(*SERIES).agg(
        F.sum("n").alias("valid_count"), F.min("lo").alias("minimum"), F.max("hi").alias("maximum"), (F.max("last")["num"] - F.min("first")["num"]).alias("rate_of_change"), F.sqrt(F.sum("squares") / F.sum("n")).alias("root_mean_square"),
        F.coalesce(F.try_divide(F.sum("steps"), F.sum("n_steps")), F.lit(0.0)).alias("mean_absolute_difference"), joined_parts(F.collect_list(F.struct("bin", "high", "low", "rest"))).alias("sum"),
        F.when(F.sum("n") > 1, F.greatest(F.lit(0.0), F.sum("s2") - F.sum("s1") * F.sum("s1") / F.sum("n")) / (F.sum("n") - 1)).otherwise(F.lit(0.0)).alias("variance"),
    ).withColumn("mean", F.col("sum") / F.col("valid_count"))
    parts = found.join(percentiles(valid, SERIES, "num", SHARES, most_rows=most_rows), SERIES).join(totals, "session_id")
    if sparkline:
        parts = parts.join(samples(valid, SERIES, "record_index", "num", sparkline, "sparkline_values"), SERIES)
    named = [F.get("p", F.lit(k)).alias(f"p{round(100 * s)}") for k, s in enumerate(SHARES)]
    return parts.select(
        *SERIES, "count", "valid_count", (F.col("count") - F.col("valid_count")).alias("missing_count"), "minimum", "maximum", "mean", F.get("p", F.lit(2)).alias("median"),
        F.sqrt("variance").alias("standard_deviation"), "variance", *named, "sum", "rate_of_change", "root_mean_square", "mean_absolute_difference", *(["sparkline_values"] if sparkline else []),
    )


def _sums(x: Column, at: Column, high: Column, low: Column) -> list[Column]:
    whole = lambda c: F.sum(c.cast("decimal(20,0)")).cast("decimal(38,0)")
    return [whole(high).alias("high"), whole(low).alias("low"), F.sum(F.when(at.isNull(), x)).alias("rest")]


def exact_sums(cells: DataFrame) -> DataFrame:
    """(session_id, field, sum): the sums of all numeric values, rounded once."""
    x = F.col("num")
    at, high, low = exact_parts(x)
    rows = cells.filter(x.isNotNull()).groupBy(*SERIES, at.alias("bin")).agg(*_sums(x, at, high, low))
    return rows.groupBy(*SERIES).agg(joined_parts(F.collect_list(F.struct("bin", "high", "low", "rest"))).alias("sum"))
