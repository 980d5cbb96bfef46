"""Synthetic sources: ten profiles as expressions over a range, the same for any partitions of one seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators.ordered import positions, previous

PROFILES = ("sine", "noisy-sensor", "frozen-sensor", "missing-samples", "duplicate-samples", "pid-response", "motor-speed", "battery-drain", "network-latency", "packet-loss")
MAX_RECORDS = 10_000_000
FIELDS = {
    "pid-response": ["timestamp", "target", "response", "error"], "motor-speed": ["timestamp", "target_rpm", "speed_rpm", "current_a"], "battery-drain": ["timestamp", "voltage_v", "current_a"],
    "network-latency": ["timestamp", "sequence", "latency_ms", "bytes"], "packet-loss": ["timestamp", "sequence", "latency_ms", "bytes"],
}


def _uniform(seed: int, stream: int) -> Column:
    """In (0, 1), by seed, stream and index."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), F.col("i")), 11) + 0.5) / float(1 << 53)


def _gauss(seed: int, stream: int) -> Column:
    return F.sqrt(-2 * F.ln(_uniform(seed, stream))) * F.cos(2 * math.pi * _uniform(seed, stream + 100))


def generate(spark: SparkSession, profile: str, seed: int = 0, duration: float = 10.0, sample_rate: float = 10.0, noise: float = 0.05, missing_rate: float | None = None, duplicate_rate: float | None = None, most: int = MAX_RECORDS) -> DataFrame:
    """(record_index, fields) of a profile.

    ``missing_rate`` drops records of missing-samples and packet-loss, never the first, and empties values of noisy-sensor; ``duplicate_rate``
    writes the record before once more. Rates of None give missing-samples, packet-loss and duplicate-samples a tenth, and the middle for sure.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    if not all(map(math.isfinite, (duration, sample_rate, noise))) or duration < 0 or sample_rate <= 0 or noise < 0:
        raise ValueError("duration and noise must be 0 or more, the sample rate above 0")
    if any(r is not None and not 0 <= r <= 1 for r in (missing_rate, duplicate_rate)):
        raise ValueError("rates lie between 0 and 1")
    n = int(duration * sample_rate) + 1
    if n > most:
        raise ValueError(f"{n} records; at most {most} are allowed")
    t, g = F.col("i") / F.lit(float(sample_rate)), _gauss(seed, 1) * noise
    base = 20 + F.sin(t) + g
    forms = {
        "sine": {"value": F.sin(2 * math.pi * t) + g}, "noisy-sensor": {"value": base}, "missing-samples": {"value": base}, "duplicate-samples": {"value": base},
        "frozen-sensor": {"value": F.when(t.between(0.35 * duration, 0.7 * duration), F.lit(20.0)).otherwise(base)},
        "motor-speed": {"target_rpm": F.lit(1500.0), "speed_rpm": 1500 * (1 - F.exp(-t / 1.5)) + 20 * g, "current_a": 2 + 8 * F.exp(-t)},
        "battery-drain": {"voltage_v": 4.2 - 1.2 * t / F.lit(max(duration, 1e-12)) + g, "current_a": 0.5 + g / 10},
    }
    response = 1 - F.exp(-t) * (F.cos(2 * t) + 0.2 * F.sin(2 * t)) + g
    forms["pid-response"] = {"target": F.lit(1.0), "response": response, "error": 1.0 - response}
    forms["network-latency"] = forms["packet-loss"] = {"sequence": F.col("i"), "latency_ms": F.greatest(F.lit(0.0), 20 + _gauss(seed, 1) * 20 * noise), "bytes": F.lit(1024).cast("long")}
    i, middle = F.col("i"), max(1, n // 2)
    kept, gaps = spark.range(n).withColumnRenamed("id", "i"), False
    if profile in ("missing-samples", "packet-loss") and missing_rate != 0:
        gone = _uniform(seed, 2) < F.lit(0.1 if missing_rate is None else float(missing_rate))
        if missing_rate is None:
            gone = gone | (i == middle)
        kept, gaps = kept.filter((i == 0) | ~gone), True
    rate = duplicate_rate if duplicate_rate is not None else 0.1 if profile == "duplicate-samples" else 0.0
    places = kept.select("i", (i * 2).alias("at"))
    if rate:
        twice = _uniform(seed, 3) < F.lit(float(rate))
        if duplicate_rate is None:
            twice = twice | (i == middle)
        # The copy is of the record before, which is not the number before where records were dropped.
        before = previous(kept, [], "i", [], "_p").select("i", F.col("_p.i").alias("before")) if gaps else kept.select("i", F.when(i > 0, i - 1).alias("before"))
        places = places.unionByName(before.filter(twice & F.col("before").isNotNull()).select(F.col("before").alias("i"), (i * 2 - 1).alias("at")))
    columns = {"timestamp": t} | forms[profile]
    if profile == "noisy-sensor" and missing_rate:
        columns["value"] = F.when(_uniform(seed, 2) >= F.lit(float(missing_rate)), columns["value"])
    return positions(places, [], "at", "record_index").select("record_index", *[c.alias(k) for k, c in columns.items()])
