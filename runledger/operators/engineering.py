"""Control-response and network metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators.ordered import percentiles, previous

LATENCY_SHARES = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def control_metrics(points: DataFrame) -> DataFrame:
    """One row a session of ``points`` (session_id, record_index, t, target, response) with two complete points or more.

    The target is stable if its range is at most 1e-9 of its size (or of 1). Rise (first crossings of 10 and
    90 % of the span), overshoot and settling (2 % of the larger of span and target) need a stable target.
    Integrals are trapezoids over steps of no negative time; ``warnings`` counts the others.
    """
    clean = points.select("session_id", "record_index", "t", "target", "response").dropna()
    i = F.col("record_index")
    head = clean.groupBy("session_id").agg(
        F.count("*").alias("n"), F.min_by("response", i).alias("r0"), F.max_by("target", i).alias("goal"), (F.max("target") - F.min("target")).alias("range"), F.min_by("t", i).alias("t0"),
    ).filter("n >= 2")
    head = head.withColumn("span", F.col("goal") - F.col("r0")).withColumn("stable", F.col("range") <= F.greatest(F.abs("goal"), F.lit(1.0)) * 1e-9)
    head = head.withColumn("tol", 0.02 * F.greatest(F.abs("span"), F.abs("goal"), F.lit(1e-12)))
    rows = previous(clean, ["session_id"], "record_index", ["t", "target", "response"]).join(head, "session_id")
    e, e0 = F.col("target") - F.col("response"), F.col("prev.target") - F.col("prev.response")
    dt = F.col("t") - F.col("prev.t")
    crossed = lambda share: F.when(F.col("span") >= 0, F.col("response") >= F.col("r0") + share * F.col("span")).otherwise(F.col("response") <= F.col("r0") + share * F.col("span"))
    out = F.abs(F.col("response") - F.col("goal")) > F.col("tol")
    when = lambda c, x: F.when(c, x)
    agg = rows.groupBy("session_id").agg(
        F.first("span").alias("span"), F.first("stable").alias("stable"), F.first("goal").alias("goal"), F.first("t0").alias("t0"), F.first("n").alias("points"),
        F.min_by(when(crossed(0.1), F.col("t")), when(crossed(0.1), i)).alias("t10"), F.min_by(when(crossed(0.9), F.col("t")), when(crossed(0.9), i)).alias("t90"),
        F.max("response").alias("hi"), F.min("response").alias("lo"), F.max(when(out, i)).alias("last_out"),
        F.max_by(e, i).alias("steady_state_error"), F.avg(F.abs(e)).alias("mean_absolute_error"), F.sqrt(F.avg(e * e)).alias("root_mean_square_error"),
        F.coalesce(F.sum(when(dt >= 0, dt * (F.abs(e) + F.abs(e0)) / 2)), F.lit(0.0)).alias("integral_absolute_error"), F.coalesce(F.sum(when(dt >= 0, dt * (e * e + e0 * e0) / 2)), F.lit(0.0)).alias("integral_squared_error"),
        F.count_if(dt < 0).alias("backward_intervals"),
    )
    settled = rows.join(agg.select("session_id", "last_out"), "session_id").filter(F.col("last_out").isNull() | (i > F.col("last_out"))).groupBy("session_id").agg(F.min_by("t", i).alias("settled_t"))
    peak = F.when(F.col("span") >= 0, F.col("hi")).otherwise(F.col("lo"))
    over = F.when(F.col("span") >= 0, peak - F.col("goal")).otherwise(F.col("goal") - peak)
    stable = F.col("stable")
    return agg.join(settled, "session_id", "left").select(
        "session_id", "points", "stable", F.when(stable & (F.col("span") != 0), F.col("t90") - F.col("t10")).alias("rise_time"), peak.alias("peak_value"),
        F.when(stable & (F.col("span") != 0), over / F.abs("span") * 100).alias("percentage_overshoot"), F.when(stable, F.col("settled_t") - F.col("t0")).alias("settling_time"),
        "steady_state_error", "mean_absolute_error", "root_mean_square_error", "integral_absolute_error", "integral_squared_error", "backward_intervals",
        F.array_compact(F.array(F.when(~stable, F.lit("target changes; step metrics are not defined")), F.when(F.col("backward_intervals") > 0, F.format_string("%d backward intervals excluded from integrals", "backward_intervals")))).alias("warnings"),
    )


def network_metrics(packets: DataFrame, most_rows: int | None = None) -> DataFrame:
    """One row a session of ``packets`` (session_id, record_index, t, seq, latency, bytes); t, latency and bytes may be null.

    Sequences that are no integers, and negative latencies or bytes, are left out and counted. Loss is
    estimated over the range of sequences; jitter is the mean step between latencies in order.
    """
    i = F.col("record_index")
    seq = packets.filter(F.col("seq").isNotNull() & (F.col("seq") == F.floor("seq"))).select("session_id", "record_index", "seq")
    order = previous(seq, ["session_id"], "record_index", ["seq"]).groupBy("session_id").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count_if(F.col("seq") < F.col("prev.seq")).alias("out_of_order_count"))
    distinct = seq.select("session_id", "seq").distinct().groupBy("session_id").agg(F.count("*").alias("d"))
    lat = packets.filter("latency >= 0").select("session_id", "record_index", "latency")
    late = previous(lat, ["session_id"], "record_index", ["latency"]).groupBy("session_id").agg(
        F.avg("latency").alias("mean_latency"), F.coalesce(F.avg(F.abs(F.col("latency") - F.col("prev.latency"))), F.lit(0.0)).alias("latency_jitter"),
    )
    shares = percentiles(lat, ["session_id"], "latency", LATENCY_SHARES, most_rows=most_rows)
    rest = packets.groupBy("session_id").agg(
        F.sum(F.when(F.col("bytes") >= 0, F.col("bytes"))).alias("total_bytes"), (F.max_by("t", F.when(F.col("t").isNotNull(), i)) - F.min_by("t", F.when(F.col("t").isNotNull(), i))).alias("duration"),
        F.count_if(F.col("seq") != F.floor("seq")).alias("non_integer_sequences"), F.count_if(F.col("latency") < 0).alias("negative_latencies"), F.count_if(F.col("bytes") < 0).alias("negative_bytes"),
    )
    width = F.col("hi") - F.col("lo") + 1
    names = [F.get("p", F.lit(k)).alias(f"latency_p{round(100 * s)}") for k, s in enumerate(LATENCY_SHARES)]
    warn = lambda c, what: F.when(F.col(c) > 0, F.format_string(f"%d {what} excluded", c))
    return rest.join(order, "session_id", "left").join(distinct, "session_id", "left").join(late, "session_id", "left").join(shares, "session_id", "left").select(
        "session_id", F.try_divide(width - F.col("d"), width).alias("packet_loss_estimate"), F.try_divide((F.col("n") - F.col("d")).cast("double"), "n").alias("duplicate_packet_rate"), "out_of_order_count",
        "mean_latency", F.get("p", F.lit(2)).alias("median_latency"), *names, "latency_jitter", "total_bytes",
        F.when(F.col("duration") > 0, F.col("total_bytes") / F.col("duration")).alias("throughput_bytes_per_second"), "non_integer_sequences", "negative_latencies", "negative_bytes",
        F.array_compact(F.array(warn("non_integer_sequences", "sequences that are no integers"), warn("negative_latencies", "negative latencies"), warn("negative_bytes", "negative byte counts"))).alias("warnings"),
    )
