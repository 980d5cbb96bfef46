import math
import random

import pytest
from pyspark.sql import functions as F

from runledger.operators.engineering import control_metrics, network_metrics
from runledger.operators.ordered import following, percentiles, previous, runs, samples, with_index
from runledger.operators.stats import exact_sums, numeric_summary
from runledger.operators.timing import timing_metrics
from runledger.plans.inspect import by_role, series


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_numeric_with_null(cells):
    r = one(numeric_summary(cells([{"x": 1}, {"x": 2}, {"x": 3}, {"x": None}])))
    assert (r["mean"], r.missing_count, r["count"], r.valid_count) == (2, 1, 4, 3)


def test_order_matters(cells):
    r = one(numeric_summary(cells([{"x": 3}, {"x": 1}, {"x": 2}]), sparkline=40))
    assert (r.minimum, r.median, r.rate_of_change, r.mean_absolute_difference, r.sparkline_values) == (1, 2, -1, 1.5, [3, 1, 2])


def test_single_value_has_no_spread(cells):
    r = one(numeric_summary(cells([{"x": 5.5}])))
    assert (r.variance, r.standard_deviation, r.mean_absolute_difference, r.p99) == (0, 0, 0, 5.5)


def test_big_integers_are_kept_out_of_numbers(cells):
    r = one(numeric_summary(cells([{"x": 1 << 60}, {"x": 2}, {"x": True}, {"x": "7"}])))
    assert (r.valid_count, r.missing_count) == (1, 3)


def test_exact_sum(cells):
    assert one(exact_sums(cells([{"x": 1e16}, {"x": 1}, {"x": -1e16}])))["sum"] == 1


@pytest.mark.parametrize("block", [1, 3, 1000])
@pytest.mark.parametrize("parts", [1, 7])
def test_neighbours_do_not_depend_on_blocks_or_partitions(spark, block, parts):
    r = random.Random(block)
    rows = [(s, i, r.randrange(4)) for s in "ab" for i in sorted(r.sample(range(60), 25))]
    df = spark.createDataFrame(rows, "s string, i long, x int").repartition(parts)
    got = {(x.s, x.i): (x.prev and x.prev.x, x.next and x.next.x) for x in following(previous(df, ["s"], "i", ["x"], block=block), ["s"], "i", ["x"], block=block).collect()}
    for s in "ab":
        own = [x for x in rows if x[0] == s]
        for k, (_, i, _) in enumerate(own):
            assert got[s, i] == (own[k - 1][2] if k else None, own[k + 1][2] if k + 1 < len(own) else None)
    want = set()
    for s in "ab":
        start, last = None, None
        for _, i, x in [*(y for y in rows if y[0] == s), (s, None, None)]:
            if last and i == last[0] + 1 and x == last[1] if i is not None else False:
                pass
            else:
                if last and last[0] > start:
                    want.add((s, start, last[0]))
                start = i
            last = (i, x)
    assert {(x.s, x.start, x.end) for x in runs(df, ["s"], "i", "x", block).collect()} == want


def test_index_is_gapless(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("s"), (F.col("id") * 7919 % 1000).alias("o")).repartition(6)
    for rows in with_index(df, ["s"], ["o"]).groupBy("s").agg(F.array_sort(F.collect_list(F.struct("o", "record_index"))).alias("r")).collect():
        assert [x.record_index for x in rows.r] == list(range(len(rows.r)))


def test_percentiles_of_a_sketch_that_comes_out_otherwise_each_time(spark, either_sketch):
    df = spark.range(40_000).select((F.col("id") % 40).alias("k"), F.floor(F.col("id") / 40).cast("double").alias("x"))
    got = {r.k: r.p for r in percentiles(df, ["k"], "x", [0.25, 0.5, 0.75], accuracy=100).collect()}
    assert got == {k: [249.75, 499.5, 749.25] for k in range(40)}


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_percentiles(spark, accuracy):
    """Whole groups, and groups cut by a coarse sketch: ties, gaps, far outliers and equal values among them."""
    import numpy as np

    r = random.Random(5)
    groups = {"one": [1.5], "two": [2.0, -1.0], "five": [1.0, 1.0, 2.0, 9.0, 9.0], "flat": [3.0] * 400, "far": [*(r.gauss(0, 1) for _ in range(700)), 1e300, -1e300], "ties": [float(r.randrange(4)) for _ in range(900)], "even": [float(k) for k in range(1000)], "none": []}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v] + [("none", None), ("one", None)], "k string, x double")
    shares = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
    got = {x.k: x.p for x in percentiles(df.repartition(7), ["k"], "x", shares, accuracy=accuracy).collect()}
    assert set(got) == set(groups) - {"none"}
    for k, p in got.items():
        assert p == pytest.approx(np.quantile(groups[k], shares).tolist(), rel=1e-12), k


def test_sums_are_rounded_once(spark, cells):
    import math

    r = random.Random(1)
    sets = {"big": [1e16, 1.0, -1e16], "wide": [1e-12, 1e-12, 1e20, -1e20], "mixed": [r.uniform(-1, 1) * 10 ** r.randrange(-200, 200) for _ in range(300)], "tenths": [0.1] * 10, "tiny": [4e-320, 4e-320, -0.0], "huge": [1e308, 1e308, -1e308]}
    df = spark.createDataFrame([("s", i, k, x) for k, v in sets.items() for i, x in enumerate(v)], "session_id string, record_index long, field string, num double")
    want = {k: math.fsum(v) for k, v in sets.items() if k != "huge"} | {"huge": 1e308}
    assert {x.field: x["sum"] for x in numeric_summary(df).collect()} == want
    assert {x.field: x["sum"] for x in exact_sums(df).collect()} == want


def test_summary_over_many_blocks(spark, monkeypatch):
    """Adjacent values across block edges, and moments joined over blocks."""
    import statistics

    from runledger.operators import stats

    r = random.Random(3)
    values = [1e6 + r.gauss(0, 1) if r.random() < 0.8 else None for _ in range(500)]
    df = spark.createDataFrame([("s", i, "x", v) for i, v in enumerate(values)], "session_id string, record_index long, field string, num double")
    monkeypatch.setattr(stats, "BLOCK", 7)
    got, known = one(stats.numeric_summary(df)), [v for v in values if v is not None]
    steps = [abs(a - b) for a, b in zip(known, known[1:])]
    assert (got["count"], got.valid_count, got.missing_count) == (500, len(known), 500 - len(known))
    assert got.mean_absolute_difference == pytest.approx(sum(steps) / len(steps), rel=1e-9) and got.variance == pytest.approx(statistics.variance(known), rel=1e-9)
    assert got.rate_of_change == known[-1] - known[0] and got.mean == pytest.approx(statistics.fmean(known), rel=1e-14)


def test_positions_and_runs_over_blocks(spark):
    from runledger.operators.ordered import positions

    r = random.Random(8)
    rows = [(k % 2, o, float(r.randrange(2))) for k, o in enumerate(sorted(r.sample(range(400), 150)))]
    df = spark.createDataFrame(rows, "k int, o long, x double")
    for key in (0, 1):
        own = [(o, x) for k, o, x in rows if k == key]
        assert [(x.o, x.i) for x in positions(df.repartition(5), ["k"], "o", "i", block=16).filter(f"k = {key}").orderBy("o").collect()] == [(o, i) for i, (o, _) in enumerate(own)]
        want, start = [], 0
        for i in range(1, len(own) + 1):
            if i == len(own) or own[i][0] != own[i - 1][0] + 1 or own[i][1] != own[i - 1][1]:
                if i - start > 1:
                    want.append((own[start][0], own[i - 1][0], i - start))
                start = i
        assert sorted((x.start, x.end, x.length) for x in runs(df, ["k"], "o", "x", block=16).filter(f"k = {key}").collect()) == want


def test_samples(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(100)], "k string, i long, x double")
    assert one(samples(df, ["k"], "i", "x", 5)).samples == [0, 25, 50, 74, 99]  # 49.5 and 74.25: half to even


def times(cells, values):
    return series(cells([{"t": v} for v in values]), "t", "t", "t")


def test_timing(cells):
    r = one(timing_metrics(times(cells, [0, 1, 2, 4, 4])))
    assert (r.duplicate_timestamp_count, r.gap_count, r.duration) == (1, 1, 4)
    assert one(timing_metrics(times(cells, [0, 1, 0]))).duplicate_timestamp_count == 1
    r = one(timing_metrics(times(cells, [5])))
    assert (r.start, r.end, r.duration, r.mean_interval) == (5, 5, 0, None)


def test_control(cells):
    rows = [{"t": i / 10, "target": 1, "response": 1 - 2.71828 ** -(i / 10)} for i in range(51)]
    r = one(control_metrics(by_role(cells(rows), {"time": "t", "target": "target", "response": "response"})))
    assert r.mean_absolute_error > 0 and abs(r.rise_time - 2.2) < 0.2 and r.warnings == []


def test_network(cells):
    rows = [{"seq": a, "latency": b, "bytes": c} for a, b, c in ((1, 10, 100), (2, 20, 100), (2, 20, 100), (4, 40, 100))]
    r = one(network_metrics(by_role(cells(rows), {"sequence": "seq", "latency": "latency", "bytes": "bytes"})))
    assert (r.packet_loss_estimate, r.duplicate_packet_rate) == (0.25, 0.25)


def test_iso_times_give_throughput(cells):
    rows = [{"timestamp": t, "seq": k, "latency": 1, "bytes": 100} for k, t in enumerate(("2024-01-01T00:00:00+00:00", "2024-01-01T00:00:02Z"))]
    c = cells(rows)
    assert one(timing_metrics(series(c, "timestamp", "t", "t"))).mean_interval == 2
    assert one(network_metrics(by_role(c, {"time": "timestamp", "sequence": "seq", "latency": "latency", "bytes": "bytes"}))).throughput_bytes_per_second == 100


def test_summary_against_plain_python(cells):
    r = random.Random(3)
    xs = [r.gauss(10, 3) for _ in range(200)]
    got = one(numeric_summary(cells([{"x": x} for x in xs])))
    mean = math.fsum(xs) / len(xs)
    assert got["mean"] == pytest.approx(mean, rel=1e-9)
    assert got.variance == pytest.approx(math.fsum((x - mean) ** 2 for x in xs) / 199, rel=1e-9)
    assert got.mean_absolute_difference == pytest.approx(math.fsum(abs(a - b) for a, b in zip(xs, xs[1:])) / 199, rel=1e-9)


def test_index_does_not_depend_on_the_columns_read(spark):
    df = spark.range(0, 300_000, 1, 6).select((F.col("id") % 3).alias("s"), F.xxhash64("id").alias("o"), F.col("id").cast("string").alias("x"))
    got = with_index(df, ["s"], ["o"]).groupBy("s").agg(F.count("x").alias("n"), F.count_distinct("record_index").alias("d"), F.min("record_index").alias("a"), F.max("record_index").alias("z"))
    assert all((r.n, r.a, r.z) == (r.d, 0, r.n - 1) for r in got.collect())
