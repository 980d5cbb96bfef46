"""Operators against plain restatements of their rules."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

# --- tiling


def test_a_seed_that_repeats_on_both_sides_stays_small():
    import pyarrow as pa

    from runledger.llm import decontam

    block = decontam.Block([(1, "a " * 400), (2, "b a a a a a a a")], 5)
    held = decontam.HITS
    try:
        whole = list(decontam._matches(block, pa.array(["a " * 3000, "c " + "a " * 7])))
        decontam.HITS = 500  # runs go on from one part to the next
        assert list(decontam._matches(block, pa.array(["a " * 3000, "c " + "a " * 7]))) == whole
    finally:
        decontam.HITS = held
    assert [(r, k, t) for r, k, t in whole] == [(0, 0, [(0, 0, 400)]), (0, 1, [(1, 0, 7)]), (1, 0, [(0, 1, 7)]), (1, 1, [(1, 1, 7)])]


def test_blocks_of_a_benchmark_with_one_large_item(spark):
    from runledger.llm.decontam import drop_leaks, find_leaks

    r = random.Random(1)
    prose = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    items = [(0, prose(3000))] + [(k, prose(12)) for k in range(1, 40)]
    docs = [(k, f"{prose(20)} {items[k][1]} {prose(20)}") for k in range(0, 40, 3)] + [(k, prose(50)) for k in range(100, 110)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = find_leaks(df, bench, block_words=2000).collect()
    assert {(x.doc_id, x.item_id) for x in found} == {(k, k) for k in range(0, 40, 3)}
    assert {x.doc_id for x in drop_leaks(df, bench, block_words=2000).collect()} == set(range(100, 110))


# --- components


def test_components_at_once_and_in_rounds(spark):
    from runledger.llm.components import connected_components
    from runledger.llm.scratch import Scratch

    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7)]
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    df = spark.createDataFrame(edges, "u long, v long")
    for few in (0, 10**6):
        s = Scratch(spark, "t")
        got = [(x.node, x.label) for x in connected_components(s.write(df, "e"), s, "c", few).collect()]
        want = label if few else {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}
        assert sorted(got) == sorted(want.items())


def test_texts_of_one_key_are_one_document(spark):
    from runledger.llm.near_dup import near_duplicates

    prose = lambda seed: " ".join(f"{seed}w{k}" for k in range(30))
    rows = [(1, prose("a")), (5, prose("a")), (5, prose("b")), (9, prose("b")), (5, prose("c")), (11, prose("c")), (12, prose("d")), (None, prose("a"))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.component_id) for x in got} == {(1, 1), (5, 1), (9, 1), (11, 1), (12, 12), (None, None)}


# --- packing


def test_places_by_the_sum_of_squares():
    from runledger.llm import packing

    def plain(sizes, capacity):
        gaps, bins, out, left = [], 0, [], sum(sizes)
        for size in sizes:
            left -= size
            if size >= capacity:
                out.append(bins)
                bins += 1
                continue
            squares = lambda g: sum(n * n for x, n in collections.Counter(g).items() if x)
            now = squares(gaps)
            choices = [(squares([*gaps[:k], g - size, *gaps[k + 1 :]]) - now, g, k) for k, g in enumerate(gaps) if g >= size]
            anew = squares([*gaps, capacity - size]) - now
            best = min(choices, default=None, key=lambda c: c[:2])
            if best and (best[0] <= anew or sum(gaps) + capacity - size > packing.FILLABLE * left):
                out.append((best[1], size))
                gaps[best[2]] -= size
            else:
                out.append((capacity, size))
                gaps.append(capacity - size)
            gaps = [g for g in gaps if g]
        return [x for x in out if isinstance(x, tuple)]

    r = np.random.default_rng(3)
    for _ in range(30):
        sizes = r.integers(1, 21, 60)
        if _ % 2:
            sizes = np.sort(sizes)[::-1]
        bins, offsets = packing.sum_of_squares(sizes, 20)
        # The gap that each item was put into: bins of one gap are alike.
        got = [(20 - int(o), int(s)) for o, s in zip(offsets, sizes) if s < 20]
        assert got == plain(sizes.tolist(), 20)


# --- sharding


def test_differencing_against_plain_lists():
    from runledger.llm.sharding import difference

    r = random.Random(2)
    for k in (2, 3, 7):
        for _ in range(20):
            sizes = [r.randrange(1, 500) for _ in range(r.randrange(1, 40))]
            parts = [sorted([s] + [0] * (k - 1), reverse=True) for s in sizes]
            made = list(enumerate(parts))
            while len(made) > 1:
                made.sort(key=lambda x: (-(x[1][0] - x[1][-1]), x[0]))
                (_, a), (_, b) = made[0], made[1]
                made = made[2:] + [(len(parts), sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))]
                parts.append(None)
            bins, sums = difference([np.array([s] + [0] * (k - 1)) for s in sizes])
            loads = [0] * k
            for s, b in zip(sizes, bins):
                loads[int(b[0])] += s
            assert sums.tolist() == made[0][1] and sorted(loads, reverse=True) == made[0][1]


# --- quality


def test_the_best_test_against_all_thresholds():
    from runledger.llm.quality import FEATURES, _best_test

    r = random.Random(5)
    for _ in range(25):
        rows = [{n: float(r.randrange(6)) for n in FEATURES} | {"bad": int(r.random() < 0.4)} for _ in range(30)]
        bad, good = [x for x in rows if x["bad"]], [x for x in rows if not x["bad"]]
        if not bad or not good:
            continue
        base, top = math.log2(len(bad) / len(rows)), 0.0
        for name, bound, above in itertools.product(FEATURES, [x + 0.5 for x in range(-1, 6)], (False, True)):
            hit = lambda x: (x[name] > bound) == above  # noqa: E731, B023
            p, n = sum(map(hit, bad)), sum(map(hit, good))
            if p:
                top = max(top, p * (math.log2(p / (p + n)) - base))
        gain, test = _best_test(bad, good)
        assert abs(gain - top) < 1e-9 and (test is None) == (top <= 1e-9)
        if test:
            p, n = sum(map(test.holds, bad)), sum(map(test.holds, good))
            assert abs(p * (math.log2(p / (p + n)) - base) - top) < 1e-9


def test_rules_cover_in_order():
    from runledger.llm.quality import FEATURES, learn_rules

    r = random.Random(7)
    rows = []
    for k in range(900):
        x = {n: r.random() for n in FEATURES}
        x["bad"] = int(x["upper_share"] > 0.8 or (x["digit_share"] > 0.6 and x["words"] <= 0.3))
        rows.append(x)
    rules = learn_rules(rows)
    left = rows
    for rule in rules:
        hit = [x for x in left if rule.holds(x)]
        assert (rule.right, rule.wrong) == (sum(x["bad"] for x in hit), sum(not x["bad"] for x in hit)) and rule.right >= 3 and rule.right >= 0.9 * len(hit)
        left = [x for x in left if not rule.holds(x)]
    assert 1 <= len(rules) <= 16 and sum(x["bad"] for x in left) <= 0.1 * sum(x["bad"] for x in rows)


# --- language


def mixed(points, n):
    """The bucket of an n-gram, in plain integers."""
    x, mask = n, (1 << 64) - 1
    for p in points:
        x = ((x << 21) | p) & mask
    x = (x + 0x9E3779B97F4A7C15) & mask
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return ((x ^ (x >> 31)) >> 40) & ((1 << 15) - 1)


def test_naive_bayes_against_plain_sums(spark):
    from runledger.llm.langid import predict, train

    r = random.Random(3)
    kinds = {f"l{k}": [r.choice("abcdefghijklmnopqrstuvwxyzäé漢") for _ in range(9)] for k in range(5)}
    text = lambda lang: " ".join("".join(r.choice(kinds[lang]) for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 9))).title()
    rows = [(k, lang, text(lang)) for k, lang in enumerate(r.choice(sorted(kinds)) for _ in range(120))] + [(200, "l1", ""), (201, "l2", "123"), (202, None, "ab"), (203, "l9", None)]
    buckets = lambda t: [mixed([ord(c) for c in t.lower()[i : i + n]], n) for n in (2, 3) for i in range(len(t.lower()) - n + 1)]
    docs, counts = collections.Counter(), collections.defaultdict(collections.Counter)
    for _, lang, t in rows:
        if lang is not None and t is not None:
            docs[lang] += 1
            counts[lang].update(buckets(t))
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for most in (512, 2):  # more languages than a matrix holds are scored in blocks
        got = {x.doc_id: x for x in predict(df, train(df.repartition(9), most_languages=most)).collect()}
        for k, _, t in rows:
            if t is None or not re.search(r"[^\W\d_]", t):
                assert (got[k].lang_pred, got[k].score) == ("und", 0)
                continue
            logs = {}
            for lang in sorted(docs):
                total = sum(counts[lang].values()) + 0.5 * (1 << 15)
                logs[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((counts[lang][b] + 0.5) / total) for b in buckets(t))
            top = max(logs, key=logs.get)
            share = 1 / sum(math.exp(v - logs[top]) for v in logs.values())
            assert abs(got[k].score - share) < 1e-3 and (got[k].lang_pred == top or logs[top] - logs[got[k].lang_pred] < 1e-3)


def test_many_languages_of_few_rows(spark):
    from runledger.llm.langid import predict, train

    df = spark.range(700).select(F.col("id").alias("doc_id"), F.concat(F.lit("lang"), "id").alias("lang"), F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    model = train(df.coalesce(2))
    got = predict(df, model, keep=("doc_id", "lang")).collect()
    assert len(model.languages) == 700 and sum(x.lang == x.lang_pred for x in got) == 700
    tie = spark.createDataFrame([("b", "same text"), ("a", "same text")], "lang string, text string")
    assert {x.lang_pred for x in predict(tie.withColumn("doc_id", F.lit(1)), train(tie, most_languages=1)).collect()} == {"a"}


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_held_out_accuracy(spark):
    from runledger.llm.langid import op9_query

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    judged = op9_query(spark, "/root/testdata/sf0.01").filter("held_out and lang_pred <> 'und'").join(docs, "doc_id").filter("lang is not null")
    right, all_ = judged.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert all_ > 250 and right >= 0.99 * all_


def test_statistics_that_rules_read(spark):
    from runledger.llm.quality import text_statistics

    r = random.Random(11)
    rows = [(k, "".join(r.choice(["a", "B", "7", " ", " ", "\n", "!"]) for _ in range(r.randrange(90)))) for k in range(120)]
    for x in text_statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        t = dict(rows)[x.doc_id]
        w = t.split()
        assert (x.n_upper, x.n_exclaim, x.n_digits) == (t.count("B"), t.count("!"), t.count("7"))
        assert x.n_stutters == sum(a == b for a, b in zip(w, w[1:])) and x.n_lines == sum(bool(y.strip()) for y in t.split("\n"))
