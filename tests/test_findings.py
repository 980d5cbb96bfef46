from runledger.operators import findings as q
from runledger.plans.inspect import series


def found(spark, cells, records, rows, time=None, seq=None, **how):
    c = cells(rows)
    sessions = spark.createDataFrame([("s",)], "session_id string")
    out = q.all_findings(sessions, records(rows), c, series(c, time, "t", "t") if time else None, time, series(c, seq, "seq") if seq else None, seq, **how)
    return {(r.check_id, r.field): r for r in out.collect()}


def test_several_at_once(spark, cells, records):
    rows = [{"t": t, "x": x} for t, x in ((0, 1), (1, 1), (1, 1), (0.5, 1), (10, None), (11, 100))]
    got = {c for c, _ in found(spark, cells, records, rows, time="t")}
    assert {"missing-values", "duplicate-timestamps", "timestamps-backwards", "large-timing-gaps", "duplicate-rows"} <= got


def test_frozen_and_constant(spark, cells, records):
    got = found(spark, cells, records, [{"t": i, "x": 2 if i < 6 else i} for i in range(10)], time="t")
    assert got["frozen-values", "x"].affected == "0-5" and ("constant-signal", "x") not in got
    got = found(spark, cells, records, [{"t": i, "x": 2} for i in range(10)], time="t")
    assert ("constant-signal", "x") in got and ("frozen-values", "x") not in got


def test_shape_change_and_gap_in_a_run(spark, cells, records):
    rows = [{("a" if i < 4 else "b"): i, "x": None if i == 1 else 3 if i == 7 else 2} for i in range(8)]
    got = found(spark, cells, records, rows)
    assert got["frozen-values", "x"].affected == "2-6" and ("record-shape-change", None) in got
    assert got["missing-values", "a"].affected == "4-7" and got["missing-values", "b"].affected == "0-3" and got["missing-values", "x"].affected == "1"


def test_zero_deviation(spark, cells, records):
    got = found(spark, cells, records, [{"x": x} for x in (0, 0, 0, 0, 100, 0)])
    assert got["outliers", "x"].affected == "4" and ("sudden-spikes", "x") in got


def test_duplicate_time_is_global(spark, cells, records):
    assert found(spark, cells, records, [{"t": t} for t in (0, 1, 0)], time="t")["duplicate-timestamps", "t"].affected == "2"


def test_a_clock_is_not_noise(spark, cells, records):
    assert not found(spark, cells, records, [{"t": t} for t in range(20)], time="t")


def test_expectations(spark, cells, records):
    rows = [{"distance": a, "packets": b} for a, b in ((0, 10), (2, 11), (1, 1))]
    got = found(spark, cells, records, rows, monotonic=["distance"], counters=["packets"])
    assert got["monotonicity-violation", "distance"].affected == "2" and got["counter-reset", "packets"].n == 1


def test_types_big_integers_and_loss(spark, cells, records):
    rows = [{"v": 1, "n": 1}, {"v": "x", "n": 3}, {"v": None, "n": 1 << 70}, {"v": 2.5, "n": 4.5}]
    got = found(spark, cells, records, rows, seq="n")
    assert ("type-change", "v") in got and got["packet-loss", "n"].n == 1
    assert {r.check_id for (c, f), r in got.items() if f == "n"} >= {"invalid-values", "packet-loss"}


def test_empty(spark, cells, records):
    empty = spark.createDataFrame([], "session_id string, record_index long, payload string, schema_key array<string>, field_count int")
    none = spark.createDataFrame([], "session_id string, record_index long, field string, kind string, text string, num double, t double")
    rows = q.all_findings(spark.createDataFrame([("s",)], "session_id string"), empty, none).collect()
    assert [r.check_id for r in rows] == ["empty-data"]


def test_non_finite(spark):
    df = spark.createDataFrame([("s", i, "x", v) for i, v in enumerate((1.0, float("nan"), float("inf"), 2.0))], "session_id string, record_index long, field string, value double")
    assert q.non_finite(df).first().affected == "1-2"


def test_outliers_by_medians_of_a_sketch_that_comes_out_otherwise_each_time(spark, either_sketch, monkeypatch):
    """40 series of 0 .. 999 in mixed order and one value far off; the median and the deviations' median decide."""
    import functools

    from pyspark.sql import functions as F

    monkeypatch.setattr(q, "percentiles", functools.partial(q.percentiles, accuracy=100))
    i = F.floor(F.col("id") / 40)
    num = F.when(i == 7, 2001.0).otherwise((i * 7) % 1000).cast("double")
    cells = spark.range(40_000).select((F.col("id") % 40).cast("string").alias("session_id"), i.alias("record_index"), F.lit("x").alias("field"), num.alias("num"))
    values = sorted(2001.0 if k == 7 else k * 7 % 1000 for k in range(1000))
    median = (values[499] + values[500]) / 2
    away = sorted(abs(v - median) for v in values)
    mad = (away[499] + away[500]) / 2
    got = {(r.session_id, r.m, r.d) for r in q.profile(q.near(cells)).select("session_id", F.col("median").alias("m"), F.col("mad").alias("d")).collect()}
    assert got == {(str(k), median, mad) for k in range(40)}
    assert {(r.session_id, r.n, r.affected) for r in q.outliers(cells).collect()} == {(str(k), 1, "7") for k in range(40) if 2001 - median > 6 * mad}
