"""Replay: pauses between records by the time since the last record that had one."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators.ordered import previous


def replay_delays(records: DataFrame, speed: float = 1.0) -> DataFrame:
    """``records`` (session_id, record_index, t, ...) with delay_s before each: never negative, 0 without a time or an earlier one."""
    if not speed > 0:
        raise ValueError("speed must be above 0")
    timed = previous(records.filter("t is not null").select("session_id", "record_index", "t"), ["session_id"], "record_index", ["t"])
    waits = timed.select(F.col("session_id").alias("_s"), F.col("record_index").alias("_r"), F.greatest(F.lit(0.0), F.coalesce((F.col("t") - F.col("prev.t")) / speed, F.lit(0.0))).alias("delay_s"))
    joined = records.join(waits, (F.col("session_id") == F.col("_s")) & (F.col("record_index") == F.col("_r")), "left").drop("_s", "_r")
    return joined.withColumn("delay_s", F.coalesce("delay_s", F.lit(0.0)))


def replay(records: DataFrame, speed: float = 1.0, timing: bool = True, sleep: Callable[[float], None] = time.sleep) -> Iterator:
    """Rows in order, one partition at a time on the driver, after their pauses."""
    for row in replay_delays(records, speed).orderBy("record_index").toLocalIterator():
        if timing and row.delay_s > 0:
            sleep(row.delay_s)
        yield row
