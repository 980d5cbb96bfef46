"""The catalogue of queries over the driver's tables, each with the SQL it is held against where SQL can express it.

Sessions are made from tables: EV (events by type, in event order), OR (orders by status, in key order; dates step
back and repeat) and LI (lineitem by return flag, in a total order of keys). Floating results are compared to nine
significant digits.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.functions import scalars
from runledger.operators import compare as cmp
from runledger.operators import downsample as down
from runledger.operators import findings as q
from runledger.operators.cells import cells_of, infer_types
from runledger.operators.engineering import control_metrics, network_metrics
from runledger.operators.ordered import ACCURACY, percentiles, runs, samples, with_index
from runledger.operators.stats import SHARES, exact_sums, numeric_summary
from runledger.operators.timing import timing_metrics
from runledger.plans import user_paths

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def sig(x: str) -> str:
    """SQL, for both engines: nine significant digits of a double."""
    return f"(case when ({x}) is null or ({x}) = 0 then ({x}) else round(({x}) * pow(10, 8 - floor(log10(abs({x}))))) / pow(10, 8 - floor(log10(abs({x})))) end)"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.expr(sig(f"`{c}`")).alias(c) if c in columns else F.col(c) for c in df.columns])


MICROS = "cast(datediff(ts, date'1970-01-01') as bigint) * 86400000000 + hour(ts) * 3600000000 + cast(minute(ts) as bigint) * 60000000 + cast(extract(second from ts) * 1000000 as bigint)"


def seconds(column: str):
    """Epoch seconds of a zoneless timestamp, whatever the session's time zone."""
    return F.expr(f"({MICROS.replace('(ts', f'({column}').replace('from ts', f'from {column}')}) / 1e6")


def events(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "user_id", "value", seconds("ts").alias("t"), F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1).try_cast("bigint").alias("k"))
    return with_index(t.withColumnRenamed("event_type", "session_id"), ["session_id"], ["event_id"])


def orders(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderstatus").alias("session_id"), "o_orderkey", F.col("o_totalprice").alias("price"), seconds("o_orderdate").alias("t"))
    return with_index(t, ["session_id"], ["o_orderkey"])


def lines(spark: SparkSession, d: str) -> DataFrame:
    names = {"l_quantity": "quantity", "l_extendedprice": "price", "l_discount": "discount", "l_tax": "tax"}
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("session_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.col(a).alias(b) for a, b in names.items()])
    return with_index(t, ["session_id"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


EV_FIELDS = {"value": "float", "k": "int"}
LI_FIELDS = {"quantity": "float", "price": "float", "discount": "float", "tax": "float"}
OR_FIELDS = {"price": "float"}

EV = """ev as (select *, row_number() over (partition by session_id order by event_id) - 1 as record_index from (
  select event_id, event_type as session_id, user_id, value, epoch_us(ts) / 1e6 as t, try_cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) as bigint) as k from events))"""
OR = """od as (select *, row_number() over (partition by session_id order by o_orderkey) - 1 as record_index from (
  select o_orderstatus as session_id, o_orderkey, o_totalprice as price, epoch_us(o_orderdate) / 1e6 as t from orders))"""
LI = """li as (select *, row_number() over (partition by session_id order by l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 as record_index from (
  select l_returnflag as session_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as quantity, l_extendedprice as price, l_discount as discount, l_tax as tax from lineitem))"""


def cells_sql(table: str, fields) -> str:
    return "cells as (" + " union all ".join(f"select session_id, record_index, '{f}' as field, cast({f} as double) as num from {table}" for f in fields) + ")"


EVC, LIC, ORC = (f"with {a}, {cells_sql(b, f)}" for a, b, f in ((EV, "ev", EV_FIELDS), (LI, "li", LI_FIELDS), (OR, "od", OR_FIELDS)))
VALID = "v as (select *, lag(num) over (partition by session_id, field order by record_index) as p, lag(record_index) over (partition by session_id, field order by record_index) as pi from cells where num is not null)"
AFFECTED = "case when min(record_index) = max(record_index) then cast(min(record_index) as varchar) else min(record_index) || '-' || max(record_index) end"

SUMMARY_FLOATS = ["minimum", "maximum", "mean", "median", "standard_deviation", "variance", "p5", "p25", "p50", "p75", "p95", "p99", "sum", "rate_of_change", "root_mean_square", "mean_absolute_difference"]


def summary_sql(cells: str) -> str:
    parts = {
        "minimum": "min(num)", "maximum": "max(num)", "mean": "avg(num)", "median": "quantile_cont(num, 0.5)", "standard_deviation": "coalesce(stddev_samp(num), 0)", "variance": "coalesce(var_samp(num), 0)",
        **{f"p{round(100 * s)}": f"quantile_cont(num, {s})" for s in SHARES}, "sum": "sum(num)", "rate_of_change": "arg_max(num, record_index) - arg_min(num, record_index)",
        "root_mean_square": "sqrt(avg(num * num))", "mean_absolute_difference": "coalesce(avg(abs(num - p)), 0)",
    }
    inner = ", ".join(f"{e} as {n}" for n, e in parts.items())
    outer = ", ".join(f"{sig(n)} as {n}" for n in parts)
    return f"""{cells}, {VALID}, n as (select session_id, count(distinct record_index) as count from cells group by session_id),
a as (select session_id, field, count(*) as valid_count, {inner} from v group by session_id, field)
select session_id, field, count, valid_count, count - valid_count as missing_count, {outer} from a join n using (session_id)"""


def _summary(cells: DataFrame) -> DataFrame:
    return rounded(numeric_summary(cells), *SUMMARY_FLOATS)


@query("m_numeric_summary", summary_sql(EVC))
def m_numeric_summary(spark, d):
    """Numeric summary of every field of events by type."""
    return _summary(cells_of(events(spark, d), EV_FIELDS))


@query("m_numeric_summary_lineitem", summary_sql(LIC))
def m_numeric_summary_lineitem(spark, d):
    return _summary(cells_of(lines(spark, d), LI_FIELDS))


PERCENTILES_SQL = f"{LIC} select session_id, field, " + ", ".join(f"{sig(f'quantile_cont(num, {s})')} as p{round(100 * s)}" for s in SHARES) + " from cells group by session_id, field"


def _percentiles(spark, d, accuracy):
    cells = cells_of(lines(spark, d), LI_FIELDS)
    found = percentiles(cells, ["session_id", "field"], "num", SHARES, accuracy=accuracy)
    named = [f"p{round(100 * s)}" for s in SHARES]
    return rounded(found.select("session_id", "field", *[F.get("p", F.lit(k)).alias(n) for k, n in enumerate(named)]), *named)


@query("m_percentiles", PERCENTILES_SQL)
def m_percentiles(spark, d):
    return _percentiles(spark, d, ACCURACY)


@query("m_percentiles_by_rank", PERCENTILES_SQL)
def m_percentiles_by_rank(spark, d):
    """The same percentiles from a coarse sketch, so that groups of these sizes too are cut and counted."""
    return _percentiles(spark, d, 100)


@query("m_order_change", f"{ORC}, {VALID} select session_id, field, {sig('arg_max(num, record_index) - arg_min(num, record_index)')} as rate_of_change, {sig('avg(abs(num - p))')} as mean_absolute_difference from v group by session_id, field")
def m_order_change(spark, d):
    found = numeric_summary(cells_of(orders(spark, d), OR_FIELDS))
    return rounded(found.select("session_id", "field", "rate_of_change", "mean_absolute_difference"), "rate_of_change", "mean_absolute_difference")


@query("m_sum_exact", f"{LIC} select session_id, field, cast(sum(cast(num as decimal(28,10))) as double) as sum from cells group by session_id, field")
def m_sum_exact(spark, d):
    return exact_sums(cells_of(lines(spark, d), LI_FIELDS))


@query("m_sum_compensated", f"with {LI} select session_id, 'sum' as field, cast(sum(cast(cast(quantity as integer) as hugeint)) as double) as sum from li group by session_id")
def m_sum_compensated(spark, d):
    """Each quantity beside 1e16 and -1e16, at its two neighbours in order: a plain sum of doubles loses it."""
    i, big = F.col("record_index"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit(1e16).alias("num")), F.struct(F.lit(1).alias("k"), F.col("quantity").alias("num")), F.struct(F.lit(2).alias("k"), F.lit(-1e16).alias("num"))))
    cells = lines(spark, d).select("session_id", "record_index", "quantity", big.alias("c")).select("session_id", (i * 3 + F.col("c.k")).alias("record_index"), F.lit("sum").alias("field"), "c.num")
    return numeric_summary(cells).select("session_id", "field", "sum")


@query("m_sparkline_samples", f"""{EVC}, r as (select *, row_number() over (partition by session_id, field order by record_index) - 1 as pos, count(*) over (partition by session_id, field) as n from cells where num is not null),
w as (select distinct session_id, field, cast(case when n <= 40 then i else round_even(i * (n - 1) / 39.0, 0) end as bigint) as pos from (select distinct session_id, field, n from r), range(40) x(i) where i < n)
select session_id, field, cast(row_number() over (partition by session_id, field order by pos) - 1 as integer) as sample, num from r join w using (session_id, field, pos)""")
def m_sparkline_samples(spark, d):
    found = samples(cells_of(events(spark, d), EV_FIELDS), ["session_id", "field"], "record_index", "num", 40)
    return found.select("session_id", "field", F.posexplode("samples").alias("sample", "num"))


@query("m_schema", f"""with {EV} select session_id, 'value' as field, case when count(value) = 0 then 'null' else 'number' end as type from ev group by session_id
union all select session_id, 'k', case when count(k) = 0 then 'null' else 'integer' end from ev group by session_id""")
def m_schema(spark, d):
    found = infer_types(cells_of(events(spark, d), EV_FIELDS))
    return found.withColumn("type", F.when(F.col("type") == "float", "number").otherwise(F.col("type")))


TIMING_FLOATS = ["start", "end", "duration", "mean_interval", "median_interval", "minimum_interval", "maximum_interval", "jitter", "effective_sample_rate"]


def timing_sql(source: str, table: str) -> str:
    floats = ", ".join(f'{sig(chr(34) + n + chr(34))} as "{n}"' for n in TIMING_FLOATS)
    return f"""with {source}, s as (select session_id, record_index, t, t - lag(t) over (partition by session_id order by record_index) as dt from {table} where t is not null),
m as (select session_id, quantile_cont(dt, 0.5) filter (dt > 0) as med from s group by session_id),
a as (select s.session_id, arg_min(t, record_index) as "start", arg_max(t, record_index) as "end", arg_max(t, record_index) - arg_min(t, record_index) as duration,
  case when count(dt) > 0 then coalesce(avg(dt) filter (dt > 0), 0) end as mean_interval, case when count(dt) > 0 then coalesce(max(med), 0) end as median_interval, min(dt) as minimum_interval, max(dt) as maximum_interval,
  case when count(dt) > 0 then coalesce(stddev_pop(dt) filter (dt > 0), 0) end as jitter, 1 / avg(dt) filter (dt > 0) as effective_sample_rate,
  count(*) filter (dt > 0 and med > 0 and dt >= 2 * med) as gap_count, count(t) - count(distinct t) as duplicate_timestamp_count, count(*) filter (dt < 0) as backward_timestamp_count from s join m using (session_id) group by s.session_id)
select session_id, {floats}, gap_count, duplicate_timestamp_count, backward_timestamp_count from a"""


@query("t_timing_events", timing_sql(EV, "ev"))
def t_timing_events(spark, d):
    return rounded(timing_metrics(events(spark, d)), *TIMING_FLOATS)


@query("t_timing_orders", timing_sql(OR, "od"))
def t_timing_orders(spark, d):
    return rounded(timing_metrics(orders(spark, d)), *TIMING_FLOATS)


STEPS = f"with {OR}, s as (select session_id, record_index, t, t - lag(t) over (partition by session_id order by record_index) as dt from od), m as (select session_id, quantile_cont(dt, 0.5) filter (dt > 0) as med, count(*) filter (dt > 0) as pos from s group by session_id)"


@query("t_gap_count", f"{STEPS} select session_id, count(*) filter (dt > 0 and dt >= 2 * med) as gaps_of_twice, count(*) filter (dt > 0 and dt > 2 * med and pos > 2) as gaps_beyond_twice from s join m using (session_id) group by session_id")
def t_gap_count(spark, d):
    """The metric's rule (at least twice the median) beside the finding's (more than twice)."""
    rows = orders(spark, d)
    metric = timing_metrics(rows).select("session_id", F.col("gap_count").alias("gaps_of_twice"))
    found = q.large_gaps(rows).select(F.col("session_id").alias("s"), "n")
    return metric.join(found, F.col("session_id") == F.col("s"), "left").select("session_id", "gaps_of_twice", F.coalesce("n", F.lit(0)).cast("long").alias("gaps_beyond_twice"))


NETWORK_FLOATS = ["packet_loss_estimate", "duplicate_packet_rate", "mean_latency", "median_latency", "latency_p5", "latency_p25", "latency_p50", "latency_p75", "latency_p95", "latency_p99", "latency_jitter", "throughput_bytes_per_second"]


@query("n_network", f"""with {EV}, s as (select *, lag(event_id) over (partition by session_id order by record_index) as ps from ev),
l as (select session_id, record_index, value, lag(value) over (partition by session_id order by record_index) as pl from ev where value >= 0),
la as (select session_id, avg(value) as mean_latency, {", ".join(f"quantile_cont(value, {s}) as latency_p{round(100 * s)}" for s in SHARES)}, coalesce(avg(abs(value - pl)), 0) as latency_jitter from l group by session_id),
a as (select session_id, (max(event_id) - min(event_id) + 1 - count(distinct event_id)) / (max(event_id) - min(event_id) + 1) as packet_loss_estimate, (count(event_id) - count(distinct event_id)) / count(event_id) as duplicate_packet_rate,
  count(*) filter (event_id < ps) as out_of_order_count, cast(sum(k) filter (k >= 0) as double) as total_bytes, arg_max(t, record_index) - arg_min(t, record_index) as duration, count(*) filter (value < 0) as negative_latencies, count(*) filter (k < 0) as negative_bytes from s group by session_id)
select session_id, {", ".join(f"{sig({'median_latency': 'latency_p50', 'throughput_bytes_per_second': 'case when duration > 0 then total_bytes / duration end'}.get(c, c))} as {c}" for c in NETWORK_FLOATS)}, out_of_order_count, total_bytes, negative_latencies, negative_bytes from a left join la using (session_id)""")
def n_network(spark, d):
    packets = events(spark, d).select("session_id", "record_index", "t", F.col("event_id").cast("double").alias("seq"), F.col("value").alias("latency"), F.col("k").cast("double").alias("bytes"))
    return rounded(network_metrics(packets).select("session_id", *NETWORK_FLOATS, "out_of_order_count", "total_bytes", "negative_latencies", "negative_bytes"), *NETWORK_FLOATS)


CONTROL_FLOATS = ["rise_time", "peak_value", "percentage_overshoot", "settling_time", "steady_state_error", "mean_absolute_error", "root_mean_square_error", "integral_absolute_error", "integral_squared_error"]


def control_sql(points: str) -> str:
    return f"""with {points}, c as (select * from p where t is not null and target is not null and response is not null),
h as (select session_id, count(*) as n, arg_min(response, record_index) as r0, arg_max(target, record_index) as goal, max(target) - min(target) as rng, arg_min(t, record_index) as t0 from c group by session_id having count(*) >= 2),
g as (select *, goal - r0 as span, rng <= greatest(abs(goal), 1) * 1e-9 as stable, 0.02 * greatest(abs(goal - r0), abs(goal), 1e-12) as tol from h),
r as (select c.*, g.* exclude (session_id), target - response as e, lag(target - response) over w as e0, t - lag(t) over w as dt,
  case when span >= 0 then response >= r0 + 0.1 * span else response <= r0 + 0.1 * span end as c10, case when span >= 0 then response >= r0 + 0.9 * span else response <= r0 + 0.9 * span end as c90, abs(response - goal) > tol as outside
  from c join g using (session_id) window w as (partition by session_id order by record_index)),
lo as (select session_id, max(record_index) filter (outside) as last_out from r group by session_id),
st as (select r.session_id, arg_min(t, record_index) as settled from r join lo using (session_id) where last_out is null or record_index > last_out group by r.session_id),
a as (select session_id, any_value(n) as points, any_value(stable) as stable, any_value(span) as span, any_value(goal) as goal, any_value(t0) as t0, arg_min(t, record_index) filter (c90) - arg_min(t, record_index) filter (c10) as rise,
  case when any_value(span) >= 0 then max(response) else min(response) end as peak_value, arg_max(e, record_index) as steady_state_error, avg(abs(e)) as mean_absolute_error, sqrt(avg(e * e)) as root_mean_square_error,
  coalesce(sum(dt * (abs(e) + abs(e0)) / 2) filter (dt >= 0), 0) as integral_absolute_error, coalesce(sum(dt * (e * e + e0 * e0) / 2) filter (dt >= 0), 0) as integral_squared_error, count(*) filter (dt < 0) as backward_intervals from r group by session_id),
b as (select a.*, case when stable and span <> 0 then rise end as rise_time, case when stable and span <> 0 then (case when span >= 0 then peak_value - goal else goal - peak_value end) / abs(span) * 100 end as percentage_overshoot,
  case when stable then settled - t0 end as settling_time from a left join st using (session_id))
select session_id, points, stable, {", ".join(f"{sig(c)} as {c}" for c in CONTROL_FLOATS)}, backward_intervals from b"""


def _control(points: DataFrame) -> DataFrame:
    return rounded(control_metrics(points).select("session_id", "points", "stable", *CONTROL_FLOATS, "backward_intervals"), *CONTROL_FLOATS)


@query("c_control", control_sql(f"{EV}, p as (select session_id, record_index, t, 50.0 as target, value as response from ev)"))
def c_control(spark, d):
    return _control(events(spark, d).select("session_id", "record_index", "t", F.lit(50.0).alias("target"), F.col("value").alias("response")))


@query("c_control_moving_target", control_sql(f"{OR}, p as (select session_id, record_index, t, case when record_index % 2 = 0 then 1000.0 else 1500.0 end as target, price as response from od)"))
def c_control_moving_target(spark, d):
    """A target that changes, and time that steps back."""
    return _control(orders(spark, d).select("session_id", "record_index", "t", F.when(F.col("record_index") % 2 == 0, 1000.0).otherwise(1500.0).alias("target"), F.col("price").alias("response")))


STEP_SQL = control_sql("p as (select 'tau ' || tau as session_id, i as record_index, i / 10.0 as t, 1.0 as target, 1 - exp(-(i / 10.0) / tau) as response from range(100) a(i), range(1, 4) b(tau))")


@query("c_control_step", STEP_SQL)
def c_control_step(spark, d):
    """The exact answer of first-order lags to a step; rise time is 2.2 times the time constant, to the sampling."""
    i = F.col("id") % 100
    points = spark.range(300).select(F.concat(F.lit("tau "), (F.floor(F.col("id") / 100) + 1).cast("string")).alias("session_id"), i.alias("record_index"), (i / 10.0).alias("t"), F.lit(1.0).alias("target"), (1 - F.exp(-(i / 10.0) / (F.floor(F.col("id") / 100) + 1))).alias("response"))
    return _control(points)


def plain(found: DataFrame) -> DataFrame:
    return found.select("session_id", "check_id", "severity", "field", "n", "affected")


def check_sql(check: str, severity: str, body: str) -> str:
    """``body`` selects session_id, field, n and affected."""
    return f"{body.partition('@@')[0]} select session_id, '{check}' as check_id, '{severity}' as severity, field, cast(n as bigint) as n, affected from ({body.partition('@@')[2]})"


def where_sql(condition: str, source: str = "v", field: str = "field") -> str:
    keys = "session_id, field" if field == "field" else "session_id"
    return f"select session_id, {field} as field, count(*) as n, {AFFECTED} as affected from {source} where {condition} group by {keys}"


@query("q_duplicate_rows", check_sql("duplicate-rows", "warning", "with r as (select lang as session_id, text || '|' || source as payload, count(*) as c from documents group by all having count(*) > 1)@@select session_id, cast(null as varchar) as field, sum(c - 1) as n, 'dataset' as affected from r group by session_id"))
def q_duplicate_rows(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("lang").alias("session_id"), F.concat_ws("|", "text", "source").alias("payload"))
    return plain(q.duplicate_rows(docs))


EV_SHAPES = f"with {EV}, r as (select session_id, case when record_index % 7 = 0 then '[\"value\"]' else '[\"k\",\"value\"]' end as shape, case when record_index % 7 = 0 then 1 else 2 end as size from ev)"


def _shaped(spark, d) -> DataFrame:
    few = F.col("record_index") % 7 == 0
    return events(spark, d).select("session_id", F.when(few, F.array(F.lit("value"))).otherwise(F.array(F.lit("k"), F.lit("value"))).alias("schema_key"), F.when(few, 1).otherwise(2).alias("field_count"))


@query("q_shape_change", check_sql("record-shape-change", "warning", f"{EV_SHAPES}@@select session_id, cast(null as varchar) as field, count(distinct shape) as n, 'dataset' as affected from r group by session_id having count(distinct shape) > 1"))
def q_shape_change(spark, d):
    return plain(q.shape_change(_shaped(spark, d)))


@query("q_length_change", check_sql("record-length-change", "warning", f"{EV_SHAPES}@@select session_id, cast(null as varchar) as field, count(distinct size) as n, 'dataset' as affected from r group by session_id having count(distinct size) > 1"))
def q_length_change(spark, d):
    return plain(q.length_change(_shaped(spark, d)))


@query("q_missing_values", check_sql("missing-values", "warning", f"with {LI}, g as (select session_id, record_index, 'tax' as field from li where tax = 0 union all select session_id, record_index, 'quantity' from li where quantity > 45 or record_index % 5 = 2)@@{where_sql('true', 'g')}"))
def q_missing_values(spark, d):
    """Null cells (tax of 0 or of a large quantity) and absent ones (every fifth quantity)."""
    rows = lines(spark, d).withColumn("tax", F.nullif("tax", F.lit(0.0))).withColumn("quantity", F.when(F.col("quantity") <= 45, F.col("quantity")))
    cells = cells_of(rows, {"tax": "float", "quantity": "float"}).filter("field <> 'quantity' or record_index % 5 <> 2")
    return plain(q.missing_values(cells, rows.select("session_id", "record_index")))


@query("q_type_change", check_sql("type-change", "warning", f"with {EV}@@select session_id, 'value' as field, 2 as n, min(record_index) || '-' || max(record_index) as affected from ev group by session_id having count(*) filter (record_index % 11 = 3) > 0 and count(*) filter (record_index % 11 <> 3) > 0"))
def q_type_change(spark, d):
    cells = cells_of(events(spark, d), {"value": "float"}).withColumn("kind", F.when(F.col("record_index") % 11 == 3, "str").otherwise(F.col("kind")))
    return plain(q.type_change(cells))


@query("q_big_int", check_sql("invalid-values", "warning", f"with {EV}@@{where_sql('event_id % 97 = 0 and event_id > 0', 'ev', chr(39) + 'big' + chr(39))}"))
def q_big_int(spark, d):
    big = events(spark, d).withColumn("big", F.when(F.col("event_id") % 97 == 0, F.col("event_id") * F.lit(10_000_000_000_000_000).cast("decimal(38,0)")).otherwise(F.col("event_id").cast("decimal(38,0)")))
    return plain(q.large_integers(cells_of(big, {"big": "int"})))


@query("q_non_finite", check_sql("non-finite", "error", f"with {EV}@@{where_sql('record_index % 13 = 5 or record_index % 17 = 5', 'ev', chr(39) + 'value' + chr(39))}"))
def q_non_finite(spark, d):
    value = F.when(F.col("record_index") % 13 == 5, float("nan")).when(F.col("record_index") % 17 == 5, float("-inf")).otherwise(F.col("value"))
    return plain(q.non_finite(events(spark, d).select("session_id", "record_index", F.lit("value").alias("field"), value.alias("value"))))


@query("q_monotonic", check_sql("monotonicity-violation", "warning", f"{ORC}, {VALID}@@{where_sql('num < p')}"))
def q_monotonic(spark, d):
    return plain(q.descents(cells_of(orders(spark, d), OR_FIELDS), ["price"], "monotonicity-violation"))


@query("q_counter", check_sql("counter-reset", "warning", f"{EVC}, {VALID}@@{where_sql(chr(39).join(['num < p and field = ', 'k', '']))}"))
def q_counter(spark, d):
    return plain(q.descents(cells_of(events(spark, d), EV_FIELDS), ["k"], "counter-reset"))


@query("q_constant", check_sql("constant-signal", "info", f"with {LI}@@select session_id || '/' || l_linenumber as session_id, 'line' as field, count(*) as n, {AFFECTED} as affected from li group by session_id, l_linenumber having count(*) >= 2"))
def q_constant(spark, d):
    rows = lines(spark, d).withColumn("session_id", F.concat_ws("/", "session_id", "l_linenumber")).withColumn("line", F.col("l_linenumber").cast("double"))
    return plain(q.constant_signal(cells_of(rows, {"line": "float", "price": "float"}).filter("field = 'line'")))


RUNS = "i as (select *, sum(case when p is not null and num = p and record_index = pi + 1 then 0 else 1 end) over (partition by session_id, field order by record_index) as island from v), r as (select session_id, field, min(record_index) as a, max(record_index) as z, count(*) as len from i group by session_id, field, island)"


@query("q_frozen", check_sql("frozen-values", "warning", f"with {LI}, cells as (select session_id, record_index, 'tax' as field, round(tax * 25) as num from li), {VALID}, {RUNS}, w as (select *, row_number() over (partition by session_id, field order by len desc, a) as rn from r), n as (select session_id, field, count(*) as total from v group by all)@@select session_id, field, len as n, a || '-' || z as affected from w join n using (session_id, field) where rn = 1 and len >= 5 and len < total"))
def q_frozen(spark, d):
    rows = lines(spark, d).withColumn("tax", F.round(F.col("tax") * 25))
    return plain(q.frozen_values(cells_of(rows, {"tax": "float"})))


@query("w_runs", f"{EVC}, {VALID}, {RUNS} select session_id, field, a as start, z as \"end\", len as length from r where len >= 2")
def w_runs(spark, d):
    return runs(cells_of(events(spark, d), EV_FIELDS).filter("num is not null"), ["session_id", "field"], "record_index", "num")


@query("q_outliers", check_sql("outliers", "warning", f"{EVC}, m as (select session_id, field, quantile_cont(num, 0.5) as med, count(num) as c from cells group by all), w as (select *, abs(num - med) as dev from cells join m using (session_id, field) where num is not null), b as (select session_id, field, quantile_cont(dev, 0.5) as mad from w group by all), x as (select * from w join b using (session_id, field))@@{where_sql('c >= 5 and case when mad > 0 then dev > 6 * mad else num <> med end', 'x')}"))
def q_outliers(spark, d):
    return plain(q.outliers(cells_of(events(spark, d), EV_FIELDS)))


@query("q_outliers_flat", check_sql("outliers", "warning", f"with {LI}, cells as (select session_id, record_index, 'late' as field, case when quantity > 40 then quantity else 1 end as num from li)@@{where_sql('num <> 1', 'cells')}"))
def q_outliers_flat(spark, d):
    """A median absolute deviation of zero: whatever differs from the median stands out."""
    rows = lines(spark, d).withColumn("late", F.when(F.col("quantity") > 40, F.col("quantity")).otherwise(1.0))
    return plain(q.outliers(cells_of(rows, {"late": "float"})))


@query("q_spikes", check_sql("sudden-spikes", "warning", f"{EVC}, {VALID}, b as (select session_id, field, quantile_cont(abs(num - p), 0.5) as base, count(*) as c from v group by all), x as (select * from v join b using (session_id, field))@@{where_sql('c >= 5 and p is not null and case when base > 0 then abs(num - p) > 10 * base else abs(num - p) > 0 end', 'x')}"))
def q_spikes(spark, d):
    return plain(q.sudden_spikes(cells_of(events(spark, d), EV_FIELDS)))


@query("q_high_noise", check_sql("high-noise", "info", f"{EVC}@@select session_id, field, count(*) as n, {AFFECTED} as affected from cells where num is not null group by session_id, field having count(*) >= 5 and avg(num) <> 0 and stddev_samp(num) / abs(avg(num)) > 0.5"))
def q_high_noise(spark, d):
    return plain(q.high_noise(cells_of(events(spark, d), EV_FIELDS)))


@query("q_dup_ts", check_sql("duplicate-timestamps", "warning", f"with {OR}, x as (select *, row_number() over (partition by session_id, t order by record_index) as rn from od)@@{where_sql('rn > 1', 'x', chr(39) + 't' + chr(39))}"))
def q_dup_ts(spark, d):
    return plain(q.duplicate_timestamps(orders(spark, d)))


@query("q_backwards", check_sql("timestamps-backwards", "error", f"{STEPS}@@{where_sql('dt < 0', 's', chr(39) + 't' + chr(39))}"))
def q_backwards(spark, d):
    return plain(q.backwards(orders(spark, d)))


@query("q_irregular", check_sql("irregular-timing", "warning", f"{STEPS}, x as (select * from s join m using (session_id))@@{where_sql('pos > 2 and dt > 0 and abs(dt - med) > 0.2 * med', 'x', chr(39) + 't' + chr(39))}"))
def q_irregular(spark, d):
    return plain(q.irregular_timing(orders(spark, d)))


@query("q_large_gaps", check_sql("large-timing-gaps", "warning", f"{STEPS}, x as (select * from s join m using (session_id))@@{where_sql('pos > 2 and dt > 2 * med', 'x', chr(39) + 't' + chr(39))}"))
def q_large_gaps(spark, d):
    return plain(q.large_gaps(orders(spark, d)))


@query("q_packet_loss", check_sql("packet-loss", "warning", f"with {EV}@@select session_id, 'seq' as field, max(event_id) - min(event_id) + 1 - count(distinct event_id) as n, {AFFECTED} as affected from ev group by session_id having max(event_id) - min(event_id) + 1 > count(distinct event_id)"))
def q_packet_loss(spark, d):
    return plain(q.packet_loss(events(spark, d).select("session_id", "record_index", F.col("event_id").cast("double").alias("seq"))))


@query("q_nonint_seq", check_sql("invalid-values", "warning", f"with {EV}@@{where_sql('event_id % 10 = 1', 'ev', chr(39) + 'seq' + chr(39))}"))
def q_nonint_seq(spark, d):
    seq = F.when(F.col("event_id") % 10 == 1, F.col("event_id") + 0.5).otherwise(F.col("event_id").cast("double"))
    return plain(q.non_integer_sequences(events(spark, d).select("session_id", "record_index", seq.alias("seq"))))


@query("q_empty_data", "select 'unused' as session_id, 'empty-data' as check_id, 'warning' as severity, cast(null as varchar) as field, cast(0 as bigint) as n, 'dataset' as affected")
def q_empty_data(spark, d):
    records = events(spark, d).select("session_id")
    return plain(q.empty_data(records.distinct().unionByName(spark.createDataFrame([("unused",)], "session_id string")), records))


ALL_PARTS = [ORACLES[n] for n in ("q_dup_ts", "q_backwards", "q_irregular", "q_large_gaps")]


def _or_parts() -> str:
    price = f"{ORC}, {VALID}"
    parts = [f"({p})" for p in ALL_PARTS]
    parts.append("(" + check_sql("sudden-spikes", "warning", f"{price}, b as (select session_id, field, quantile_cont(abs(num - p), 0.5) as base, count(*) as c from v group by all), x as (select * from v join b using (session_id, field))@@{where_sql('c >= 5 and p is not null and case when base > 0 then abs(num - p) > 10 * base else abs(num - p) > 0 end', 'x')}") + ")")
    parts.append("(" + check_sql("high-noise", "info", f"{price}@@select session_id, field, count(*) as n, {AFFECTED} as affected from v group by session_id, field having count(*) >= 5 and avg(num) <> 0 and stddev_samp(num) / abs(avg(num)) > 0.5") + ")")
    parts.append("(" + check_sql("outliers", "warning", f"{price}, m as (select session_id, field, quantile_cont(num, 0.5) as med, count(num) as c from v group by all), w as (select *, abs(num - med) as dev from v join m using (session_id, field)), b as (select session_id, field, quantile_cont(dev, 0.5) as mad from w group by all), x as (select * from w join b using (session_id, field))@@{where_sql('c >= 5 and case when mad > 0 then dev > 6 * mad else num <> med end', 'x')}") + ")")
    return " union all ".join(parts)


@query("q_all_findings", _or_parts())
def q_all_findings(spark, d):
    rows = orders(spark, d)
    records = rows.select("session_id", "record_index", F.col("o_orderkey").cast("string").alias("payload"), F.array(F.lit("price"), F.lit("t")).alias("schema_key"), F.lit(2).alias("field_count"))
    found = q.all_findings(records.select("session_id"), records, cells_of(rows, {"price": "float", "t": "float"}), times=rows, time_field="t")
    return plain(q.in_order(found))


def stats_sql(goal: bool) -> str:
    return f"""{EVC}, s as (select session_id, field, avg(num) as mean, count(num) as valid_count from cells where num is not null group by all),
c as (select field from s group by field having count(distinct session_id) = (select count(distinct session_id) from s)),
b as (select field, mean as baseline_mean from s where session_id = (select min(session_id) from s))"""


@query("x_compare_stats", f"{stats_sql(False)} select field, session_id, {sig('mean')} as mean, valid_count, {sig('mean - baseline_mean')} as difference from s join c using (field) join b using (field)")
def x_compare_stats(spark, d):
    stats = numeric_summary(cells_of(events(spark, d), EV_FIELDS))
    first = stats.agg(F.min("session_id")).first()[0]
    return rounded(cmp.compare(stats, first).select("field", "session_id", "mean", "valid_count", "difference"), "mean", "difference")


@query("x_improvement", f"{stats_sql(True)} select session_id, {sig('(baseline_mean - mean) / abs(baseline_mean) * 100')} as improvement_percent from s join c using (field) join b using (field) where field = 'value'")
def x_improvement(spark, d):
    stats = numeric_summary(cells_of(events(spark, d), EV_FIELDS))
    first = stats.agg(F.min("session_id")).first()[0]
    return rounded(cmp.compare(stats, first, "value", lower=True).filter("field = 'value'").select("session_id", "improvement_percent"), "improvement_percent")


@query("x_field_align", "select 'price' as field")
def x_field_align(spark, d):
    """Fields that every session has: LI sessions have four, OR sessions one of them."""
    both = cells_of(lines(spark, d), LI_FIELDS).unionByName(cells_of(orders(spark, d).withColumn("session_id", F.concat(F.lit("order "), "session_id")), OR_FIELDS))
    return cmp.shared_fields(both.filter("num is not null"))


@query("x_shared_range", f"with {EV}, r as (select session_id, arg_min(t, record_index) as a, arg_max(t, record_index) as z from ev group by session_id) select count(*) as sessions, {sig('case when max(a) <= min(z) then max(a) end')} as shared_start, {sig('case when max(a) <= min(z) then min(z) end')} as shared_end, 0.0::double as relative_start, {sig('min(z - a)')} as relative_end from r")
def x_shared_range(spark, d):
    return rounded(cmp.timing_context(timing_metrics(events(spark, d))), "shared_start", "shared_end", "relative_end")


@query("x_unique_labels", "select cast(l_orderkey as bigint) as l_orderkey, cast(n as bigint) as position, case when n > 1 then cast(l_orderkey as varchar) || '#' || n else cast(l_orderkey as varchar) end as label from (select l_orderkey, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) as n from lineitem)")
def x_unique_labels(spark, d):
    rows = with_index(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"], "at")
    named = cmp.unique_labels(rows.withColumn("label", F.col("l_orderkey").cast("string")).withColumn("position", F.col("at") + 1))
    return named.select("l_orderkey", "position", "label")


def downsample_sql(most: int) -> str:
    """The rule over ``p`` (session_id, record_index, x, y, i, n)."""
    buckets = (max(most, 4) - 2) // 2
    return f"""b as (select *, ((i + 1) * {buckets} - 1) // n as b from p where n > {most}), e as (select session_id, b, min(y) as lo, max(y) as hi from b group by all),
k as (select b.session_id, min(i) as i from b join e on b.session_id = e.session_id and b.b = e.b and y = lo group by b.session_id, b.b union select b.session_id, max(i) from b join e on b.session_id = e.session_id and b.b = e.b and y = hi group by b.session_id, b.b
  union select session_id, min(i) from b group by session_id, b union select session_id, max(i) from b group by session_id, b),
g as (select session_id, min(y) as lo, max(y) as hi from b group by all),
r as (select session_id, 0 as i from b union select session_id, n - 1 from b union select b.session_id, min(i) from b join g using (session_id) where y = g.lo group by b.session_id union select b.session_id, max(i) from b join g using (session_id) where y = g.hi group by b.session_id),
x as (select *, row_number() over (partition by session_id order by i) - 1 as place, count(*) over (partition by session_id) as m from (select * from k except select * from r)),
u as (select session_id, {most} - count(*) as budget from r group by session_id),
j as (select session_id, range as j, budget, m from u join (select distinct session_id, m from x) using (session_id), range({most}) where range < budget),
t as (select session_id, cast(case when m <= budget then j when budget = 1 then 0 else round_even(j * (m - 1) / (budget - 1.0), 0) end as bigint) as place from j),
kept as (select session_id, i from x join t using (session_id, place) union select session_id, i from r)
select session_id, record_index, {sig('x')} as x, y from p where n <= {most} union all select p.session_id, record_index, {sig('x')}, y from p join kept using (session_id, i) where n > {most}"""


EV_POINTS = f"with {EV}, p as (select session_id, record_index, t as x, value as y, row_number() over (partition by session_id order by record_index) - 1 as i, count(*) over (partition by session_id) as n from ev where value is not null)"


def _value_series(spark, d) -> DataFrame:
    return events(spark, d).select("session_id", F.lit("value").alias("field"), "record_index", F.col("t").alias("x"), F.col("value").alias("y"))


@query("g_downsample", f"{EV_POINTS}, {downsample_sql(400)}")
def g_downsample(spark, d):
    return rounded(down.downsample(_value_series(spark, d), 400).select("session_id", "record_index", "x", "y"), "x")


@query("g_downsample_thinned", f"{EV_POINTS}, {downsample_sql(9)}")
def g_downsample_thinned(spark, d):
    """A budget that buckets of up to four points exceed: anchors stay, the others are thinned evenly."""
    return rounded(down.downsample(_value_series(spark, d), 9).select("session_id", "record_index", "x", "y"), "x")


@query("g_histogram_values", f"{EV_POINTS}, w as (select distinct session_id, j, cast(case when n <= 15 then j else round_even(j * (n - 1) / 14.0, 0) end as bigint) as i, n from p, range(15) x(j) where j < n), v as (select session_id, j, y, n, count(*) over (partition by session_id) as size from w join p using (session_id, i, n)), g as (select session_id, min(y) as lo, max(y) as hi from p group by all), h as (select session_id, bool_or(y = lo) as has_lo, bool_or(y = hi) as has_hi from v join g using (session_id) group by all) select session_id, cast(j as integer) as i, case when n > 15 and j = 0 and not has_lo then lo when n > 15 and j = size - 1 and not has_hi then hi else y end as y from v join g using (session_id) join h using (session_id)")
def g_histogram_values(spark, d):
    """The values that a histogram of a bounded number is drawn from."""
    return down.histogram_values(_value_series(spark, d), 15).select("session_id", "i", "y")


@query("g_missing_markers", f"with {EV}, p as (select session_id, record_index, row_number() over (partition by session_id order by record_index) - 1 as i from ev where record_index % 17 = 0), n as (select session_id, count(*) as n from p group by all), w as (select distinct session_id, cast(case when n <= 20 then j else round_even(j * (n - 1) / 19.0, 0) end as bigint) as i from n, range(20) x(j) where j < n) select session_id, record_index from p join w using (session_id, i)")
def g_missing_markers(spark, d):
    series = events(spark, d).select("session_id", F.lit("value").alias("field"), "record_index", F.col("t").alias("x"), F.when(F.col("record_index") % 17 != 0, F.col("value")).alias("y"))
    return down.missing_markers(series, 20).select("session_id", "record_index")


@query("g_histogram", f"{EVC}, l as (select session_id, field, min(num) as lo, max(num) as hi from cells where num is not null group by all), b as (select c.*, lo, hi, case when hi > lo then least(9, floor((num - lo) / ((hi - lo) / 10))) else 0 end as bin from cells c join l using (session_id, field) where num is not null) select session_id, field, cast(bin as integer) as bin, {sig('lo + bin * ((hi - lo) / 10)')} as low, {sig('lo + (bin + 1) * ((hi - lo) / 10)')} as high, count(*) as count from b group by session_id, field, bin, lo, hi")
def g_histogram(spark, d):
    return rounded(down.histogram(cells_of(events(spark, d), EV_FIELDS)), "low", "high")


WORDS = r"words as (select doc_id, w from (select doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) as w from documents))"
COERCE = """case when w = '' then 'null' when w in ('true', 'false') then 'bool' when regexp_full_match(w, '-?(0|[1-9][0-9]*)') then 'int'
 when regexp_full_match(w, '-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?') then 'float' else 'str' end"""


def _words(spark, d) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", F.explode(F.split(F.translate("text", "\n", " "), " ")).alias("w"))


@query("s_scalar_coercion", f"with {WORDS} select doc_id, {COERCE} as kind, count(*) as n, {sig(f"sum(case when ({COERCE}) = 'float' or (({COERCE}) = 'int' and abs(try_cast(w as hugeint)) <= 9007199254740992) then try_cast(w as double) end)")} as total from words group by doc_id, kind")
def s_scalar_coercion(spark, d):
    parts = scalars.coerce(F.col("w"))
    cells = _words(spark, d).select("doc_id", parts["kind"].alias("kind"), parts["num"].alias("num"))
    return rounded(cells.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum("num").alias("total")), "total")


@query("p_temporal", f"with {EV} select session_id, count(*) filter (record_index % 3 = 0) as zoned, count(*) filter (record_index % 3 = 1) as numeric, count(*) filter (record_index % 3 = 2) as naive, cast(sum(case when record_index % 3 = 0 then epoch_us(time_bucket(interval '1 second', to_timestamp(t)::timestamp)) // 1000000 - 7200 when record_index % 3 = 1 then event_id end) as double) as total from ev group by session_id")
def p_temporal(spark, d):
    """Times with an offset, numbers, and times without one, which are no times."""
    rows = events(spark, d)
    whole = F.floor("t").cast("long")
    stamp = F.concat_ws("", F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(whole / 86400).cast("int")), "yyyy-MM-dd"), F.lit("T"), F.lpad(F.floor(whole % 86400 / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(whole % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))
    third = F.col("record_index") % 3
    text = F.when(third == 0, F.concat(stamp, F.lit("+02:00"))).when(third == 1, F.col("event_id").cast("string")).otherwise(stamp)
    at = scalars.temporal(F.when(third == 1, "int").otherwise("str"), text, F.when(third == 1, F.col("event_id").cast("double")))
    found = rows.select("session_id", third.alias("third"), at.alias("at"))
    return found.groupBy("session_id").agg(F.count_if((F.col("third") == 0) & F.col("at").isNotNull()).alias("zoned"), F.count_if((F.col("third") == 1) & F.col("at").isNotNull()).alias("numeric"), F.count_if((F.col("third") == 2) & F.col("at").isNull()).alias("naive"), F.sum("at").alias("total"))


@query("f_csv_safe", f"with {WORDS} select doc_id, count(*) filter (regexp_matches(w, '^[ \\t\\r\\n\\f\\v]*[=+@-]')) as formulas, sum(length(case when regexp_matches(w, '^[ \\t\\r\\n\\f\\v]*[=+@-]') then chr(39) || w else w end))::bigint as chars from words group by doc_id")
def f_csv_safe(spark, d):
    w = F.col("w")
    return _words(spark, d).groupBy("doc_id").agg(F.count_if(scalars.csv_safe(w) != w).alias("formulas"), F.sum(F.length(scalars.csv_safe(w))).alias("chars"))


@query("f_markdown_safe", r"""select doc_id, sha256(regexp_replace(replace(replace(replace(regexp_replace(text, '[\r\n]+', ' ', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_{}\[\]()#+\-.!|])', '\\\1', 'g')) as digest from documents""")
def f_markdown_safe(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(scalars.markdown_safe(F.col("text")), 256).alias("digest"))


@query("f_sha256", "select doc_id, sha256(text) as digest from documents")
def f_sha256(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("o_findings_order", f"select row_number() over (order by session_id, check_id, coalesce(field, ''), affected) - 1 as place, * from ({_or_parts()})")
def o_findings_order(spark, d):
    """Findings as a reader gets them, each with its place."""
    found = q_all_findings(spark, d)
    rows = [(k, *r) for k, r in enumerate(found.toLocalIterator())]
    return spark.createDataFrame(rows, f"place long, {', '.join(f'{n} {t}' for n, t in found.dtypes)}")


@query("x07_replay_delays", f"with {OR}, d as (select session_id, record_index, case when record_index % 7 <> 3 then t end as t from od), l as (select *, last_value(t ignore nulls) over (partition by session_id order by record_index rows between unbounded preceding and 1 preceding) as before from d) select session_id, record_index, {sig('greatest(0, coalesce((t - before) / 2, 0))')} as delay_s from l")
def x07_replay_delays(spark, d):
    """Pauses before records at double speed; records without a time wait for nothing."""
    from runledger.operators.replay import replay_delays

    rows = orders(spark, d).withColumn("t", F.when(F.col("record_index") % 7 != 3, F.col("t")))
    return rounded(replay_delays(rows, 2.0).select("session_id", "record_index", "delay_s"), "delay_s")


def _generated(profile: str, **how):
    def run(spark, d):
        from runledger.sources.generate import generate

        made = generate(spark, profile, duration=100.0, noise=0.0, **how)
        return made.select("record_index", *[(F.round(F.col(c) * 1e6) / 1e6 + 0.0).alias(c) if t == "double" else F.col(c) for c, t in made.dtypes if c != "record_index"])

    return run


GEN_SQL = {
    "sine": "sin(2 * pi() * t) as value", "noisy-sensor": "20 + sin(t) as value", "frozen-sensor": "case when t between 35 and 70 then 20.0 else 20 + sin(t) end as value",
    "missing-samples": "20 + sin(t) as value", "duplicate-samples": "20 + sin(t) as value",
    "pid-response": "1.0::double as target, 1 - exp(-t) * (cos(2 * t) + 0.2 * sin(2 * t)) as response, exp(-t) * (cos(2 * t) + 0.2 * sin(2 * t)) as error",
    "motor-speed": "1500.0::double as target_rpm, 1500 * (1 - exp(-t / 1.5)) as speed_rpm, 2 + 8 * exp(-t) as current_a", "battery-drain": "4.2 - 1.2 * t / 100 as voltage_v, 0.5::double as current_a",
    "network-latency": "i as sequence, 20.0::double as latency_ms, 1024::bigint as bytes", "packet-loss": "i as sequence, 20.0::double as latency_ms, 1024::bigint as bytes",
}


def generated_sql(profile: str, rows: str = "select i from range(1001) x(i)") -> str:
    """``rows``: the times' numbers, in order of ``at`` where one comes twice."""
    cols = re.findall(r"as (\w+)(?:, |$)", GEN_SQL[profile])
    out = ", ".join(c if c in ("sequence", "bytes") else f"round({c} * 1e6) / 1e6 + 0.0 as {c}" for c in ["timestamp", *cols])
    return f"select row_number() over (order by i) - 1 as record_index, {out} from (select i, t as timestamp, {GEN_SQL[profile]} from (select i, i / 10.0 as t from ({rows})))"


#: Rates of 0 leave the anomalies out; of 1 they hit every record that they can hit: no draw is left to chance.
for _profile in GEN_SQL:
    _name = f"gen_{_profile.replace('-', '_')}"
    if _profile == "missing-samples" or _profile == "packet-loss":
        QUERIES[_name], ORACLES[_name] = _generated(_profile, missing_rate=1.0), generated_sql(_profile, "select 0 as i")
    elif _profile == "duplicate-samples":
        QUERIES[_name], ORACLES[_name] = _generated(_profile, duplicate_rate=1.0), generated_sql(_profile, "select i from range(1001) x(i) union all select i from range(1000) y(i)")
    else:
        QUERIES[_name], ORACLES[_name] = _generated(_profile), generated_sql(_profile)


@query("gen_rates", "select * from (values ('packet-loss', true, true, true), ('missing-samples', true, true, true), ('duplicate-samples', true, true, true), ('sine', true, true, true)) v(profile, first_kept, middle, share)")
def gen_rates(spark, d):
    """Of the default rates: row 0 is never dropped, the middle is hit for sure, and a tenth is hit, give or take; a sine has neither."""
    from runledger.sources.generate import generate

    parts = []
    for profile in ("packet-loss", "missing-samples", "duplicate-samples", "sine"):
        made = generate(spark, profile, seed=3, duration=1000.0)
        at = F.round(F.col("timestamp") * 10)
        count = made.agg(F.count("*").alias("n"), F.count_if(at == 0).alias("first"), F.count_if(at == 5000).alias("middle"), F.count_if(at == 4999).alias("before"))
        least, most = {"duplicate-samples": (10_800, 11_200), "sine": (10_001, 10_001)}.get(profile, (8800, 9200))
        middle = F.col("before") == 2 if profile == "duplicate-samples" else F.col("middle") == (1 if profile == "sine" else 0)
        parts.append(count.select(F.lit(profile).alias("profile"), (F.col("first") >= 1).alias("first_kept"), middle.alias("middle"), F.col("n").between(least, most).alias("share")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _text_query(kind: str, line, pairs: str):
    """Cells parsed from lines that are made of events, against the values they were made of."""

    def run(spark, d):
        from runledger.sources.text import cells_from, parse_table, records_of

        rows = events(spark, d)
        lines = rows.select("session_id", F.lit("events").alias("file"), F.lit(0).cast("long").alias("block"), F.col("record_index").alias("row"), line().alias("value"))
        cells = cells_from(records_of(parse_table(lines, kind)))
        found = cells.groupBy("session_id", "field", "kind").agg(F.count("*").alias("n"), F.sum("num").alias("total"))
        return rounded(found, "total")

    sql = f"with {EV}, c as (select session_id, unnest([{pairs}]) as p from ev) select session_id, p.field as field, p.kind as kind, count(*) as n, {sig('sum(p.num)')} as total from c group by all"
    return run, sql


def _text(*parts: str):
    """A line from literals and, after an @, columns; made when a session is there."""
    return lambda: F.concat(*[F.col(p[1:]).cast("string") if p[0] == "@" else F.lit(p) for p in parts])


def _pairs(*fields: tuple[str, str, str]) -> str:
    return ", ".join(f"{{'field': '{a}', 'kind': '{b}', 'num': {c}}}" for a, b, c in fields)


_E_NUM, _U_NUM, _NONE = "cast(event_id as double)", "cast(user_id as double)", "cast(null as double)"
for _name, _line, _fields in (
    ("jsonl", _text('{"e":', "@event_id", ',"u":"', "@user_id", '","n":null,"deep":[1,{"a":2.0}],"ok":true}'), _pairs(("e", "int", _E_NUM), ("u", "str", _NONE), ("n", "null", _NONE), ("deep", "list", _NONE), ("ok", "bool", _NONE))),
    ("keyvalue", _text("e=", "@event_id", " u='", "@user_id", "' type=\"a ", "@session_id", '" none= f=0.5'), _pairs(("e", "int", _E_NUM), ("u", "int", _U_NUM), ("type", "str", _NONE), ("none", "null", _NONE), ("f", "float", "0.5::double"))),
    ("whitespace", _text("@event_id", "  ", "@user_id", "\t", "@session_id", " 007"), _pairs(("field_1", "int", _E_NUM), ("field_2", "int", _U_NUM), ("field_3", "str", _NONE), ("field_4", "str", _NONE))),
    ("stream", _text("@event_id", ", ", "@user_id", ',"a ""b"", c",'), _pairs(("field_1", "int", _E_NUM), ("field_2", "int", _U_NUM), ("field_3", "str", _NONE), ("field_4", "null", _NONE))),
):
    QUERIES[f"s_{_name}"], ORACLES[f"s_{_name}"] = _text_query(_name, _line, _fields)


@query("s_rejects", f"with {EV} select session_id, case when record_index % 9 = 0 then 'empty line' when record_index % 9 = 1 then 'record must be a JSON object' when record_index % 9 = 2 then 'duplicate JSON key: a' when record_index % 9 = 3 then 'non-finite JSON number: NaN' else 'record has 2 fields; at most 1 are allowed' end as reason, count(*) as n from ev where record_index % 9 < 5 group by all")
def s_rejects(spark, d):
    """Each kind of broken line is kept with its reason."""
    from runledger.sources.text import parse_table, rejects_of

    k = F.col("record_index") % 9
    line = F.when(k == 0, "  ").when(k == 1, "[1]").when(k == 2, '{"a":1,"a":2}').when(k == 3, '{"a":NaN}').when(k == 4, '{"a":1,"b":2}').otherwise('{"a":1}')
    lines = events(spark, d).select("session_id", F.lit("events").alias("file"), F.lit(0).cast("long").alias("block"), F.col("record_index").alias("row"), line.alias("value"))
    return rejects_of(parse_table(lines, "jsonl", max_fields=1)).groupBy("session_id", "reason").agg(F.count("*").alias("n"))


@query("s_csv_document", "select 'document' as session_id, 'x' as field, 'int' as kind, count(*) as n, cast(sum(event_id) as double) as total from events union all select 'document', 'y', 'str', count(*), null from events")
def s_csv_document(spark, d):
    """One CSV text of all events, with line ends inside quotes, written and read as a file."""
    from runledger.plans.inspect import scratch_text
    from runledger.sources.text import cells_from, parse_source, records_of

    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.concat_ws("", F.col("event_id").cast("string"), F.lit(',"'), "event_type", F.lit('\nline two"')).alias("value"))
    path = scratch_text(spark, rows.select("value").unionByName(spark.createDataFrame([("x,y",)], "value string")).orderBy(F.col("value") != "x,y").coalesce(1), "csv-document")
    cells = cells_from(records_of(parse_source(spark, path, "csv", "document")))
    return rounded(cells.groupBy("session_id", "field", "kind").agg(F.count("*").alias("n"), F.sum("num").alias("total")))


@query("st_stream_equals_batch", f"with {EV} select session_id, count(*) as n, cast(sum(event_id) as double) as total, 0::bigint as differing from ev group by session_id")
def st_stream_equals_batch(spark, d):
    """Events as text files, captured by a stream and read in one batch: the same records either way."""
    from runledger.plans.inspect import scratch_text
    from runledger.sources.text import parse_source, records_of
    from runledger.streaming.capture import capture

    rows = spark.read.parquet(f"{d}/events.parquet").select(F.to_json(F.struct("event_id", "event_type")).alias("value"))
    path = scratch_text(spark, rows, "stream-input")
    landed = capture(spark, path, "jsonl", "live")
    batch = records_of(parse_source(spark, path, "jsonl", "live"))
    both = landed.select("payload").withColumn("s", F.lit(1)).unionByName(batch.select("payload").withColumn("s", F.lit(-1)))
    one = both.groupBy("payload").agg(F.sum("s").alias("d"), F.sum(F.greatest("s", F.lit(0))).alias("c"))
    e = F.get_json_object("payload", "$.event_id").cast("double")
    return one.groupBy(F.get_json_object("payload", "$.event_type").alias("session_id")).agg(F.sum("c").cast("long").alias("n"), F.sum(e).alias("total"), F.sum(F.abs("d")).cast("long").alias("differing"))


QUERIES |= user_paths.QUERIES
ORACLES |= user_paths.ORACLES
