"""Quality rules: an ordered decision list, learned by sequential covering, over native text statistics.

Statistics and verdicts are DataFrame expressions alone. The list is learned on the driver from a bounded
sample of labelled statistics (``LABELLED_ROWS`` rows at most) and emitted as one ordered ``when`` chain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.scratch import aliased, col, names

#: Most labelled rows that the list is fitted on; those with the smallest hash of doc_id are taken.
LABELLED_ROWS = 20_000
#: Tasks that compute their statistics.
FIT_TASKS = 32
WINDOW = 5
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and helper counts.

    Null and empty texts count as having no words. Words compare as they are written. Columns of ``df``
    that carry one of the new names are replaced; all others stay, whatever their names.
    """
    own = [c for c in df.columns if c not in STATISTICS]
    out = _statistics(df.select(F.struct(*aliased(own)).alias("row"), F.coalesce(col(text), F.lit("")).alias("t")))
    return out.select(*[F.col(f"row.{n}").alias(c) for c, n in zip(own, names(own), strict=True)], *STATISTICS)


def _statistics(rows: DataFrame) -> DataFrame:
    """(row, and the statistics) of rows (row, t)."""
    t = F.col("t")
    base = rows.select(
        "row",
        F.array_remove(F.split(t, WORD_GAP), "").alias("words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("!")).cast("long").alias("n_exclaim"),
        F.regexp_count(t, F.lit("[0-9]")).cast("long").alias("n_digits"),
    )
    spans = F.when(
        F.size("words") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
    )
    base = base.select(
        "row", "n_symbols", "n_upper", "n_exclaim", "n_digits",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.filter("words", lambda w, i: w.eqNullSafe(F.get("words", i - 1)))).cast("long").alias("n_stutters"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        spans.alias("spans"),
    )
    # Only texts with an equal pair of windows are sorted; equal windows are then neighbours.
    order = F.when(F.size(F.array_distinct("spans")) < F.size("spans"), F.sort_array(F.transform("spans", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    base = base.withColumn("order", order).drop("spans")
    s = F.col("order")
    again = F.when(
        s.isNotNull(),
        F.array_sort(
            F.filter(
                F.transform(
                    F.sequence(F.lit(0), F.size(s) - 1),
                    lambda k: F.when((F.get(s, k)["h"] == F.get(s, k - 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"]), F.get(s, k)["i"]),
                ),
                lambda x: x.isNotNull(),
            )
        ),
    )
    base = base.withColumn("at", again).drop("order")
    covered = F.aggregate(F.col("at"), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


VERDICTS = ("base_failed", "rule_no", "kept")
STATISTICS = ("n_symbols", "n_upper", "n_exclaim", "n_digits", "n_words", "word_chars", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters")

#: Features of the decision list: name -> (numerator, denominator); a denominator of 0 gives 0.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "exclaims_per_word": ("n_exclaim", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "word_length": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "stutter_share": ("n_stutters", "n_words"),
    "words": ("n_words", None),
}


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    x = F.col(top).cast("double")
    return x if bottom is None else F.when(F.col(bottom) > 0, x / F.col(bottom)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Test:
    """One threshold test of a conjunction: ``feature <= bound`` or ``feature > bound``."""

    feature: str
    above: bool
    bound: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.bound if self.above else row[self.feature] <= self.bound

    def column(self) -> Column:
        x = feature(self.feature)
        return x > F.lit(self.bound) if self.above else x <= F.lit(self.bound)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects; ``wrong`` of the ``right + wrong`` rows it covers in the pruning part were good."""

    tests: tuple[Test, ...]
    right: int
    wrong: int

    def holds(self, row: dict) -> bool:
        return all(t.holds(row) for t in self.tests)

    def column(self) -> Column:
        out = self.tests[0].column()
        for t in self.tests[1:]:
            out &= t.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


def _best_test(bad: list[dict], good: list[dict]) -> tuple[float, Test | None]:
    """The threshold test of most FOIL gain; among equal gains the first feature and the smallest bound."""
    p0, n0 = len(bad), len(good)
    base, best = math.log2(p0 / (p0 + n0)), (0.0, None)
    for name in FEATURES:
        marked = sorted([(r[name], 1) for r in bad] + [(r[name], 0) for r in good])
        p = n = 0
        for k, (x, mark) in enumerate(marked[:-1]):
            p, n = p + mark, n + 1 - mark
            if (upper := marked[k + 1][0]) == x:
                continue
            for above, pos, neg in ((False, p, n), (True, p0 - p, n0 - n)):
                if pos and (gain := pos * (math.log2(pos / (pos + neg)) - base)) > best[0] + 1e-9:
                    best = gain, Test(name, above, (x + upper) / 2)
    return best


def learn_rules(rows: list[dict], most_rules: int = 16, most_tests: int = 4, least_precision: float = 0.9, least_cover: int = 3) -> list[Rule]:
    """Sequential covering: grow a conjunction on two thirds of the rows, prune it on the rest, remove what it covers.

    ``rows`` have the features and ``bad`` (0 or 1), in any order that the caller holds fixed. A rule is
    kept if it covers ``least_cover`` bad rows of the whole sample with ``least_precision``; the first
    rule that does not ends the list. No bad rows, or no rows, give an empty list.
    """
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < most_rules:
        grow, prune = [r for k, r in enumerate(left) if k % 3], [r for k, r in enumerate(left) if not k % 3]
        bad, good, tests = [r for r in grow if r["bad"]], [r for r in grow if not r["bad"]], []
        if not bad:
            break
        while good and len(tests) < most_tests:
            gain, test = _best_test(bad, good)
            if test is None:
                break
            tests.append(test)
            bad, good = [r for r in bad if test.holds(r)], [r for r in good if test.holds(r)]
        if not tests:
            break

        def worth(k: int) -> tuple[float, int]:
            hit = [r["bad"] for r in prune if all(t.holds(r) for t in tests[:k])]
            return ((2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0, -k)

        tests = tests[: max(range(1, len(tests) + 1), key=worth)]
        hit = [r["bad"] for r in left if all(t.holds(r) for t in tests)]
        if sum(hit) < least_cover or sum(hit) < least_precision * len(hit):
            break
        rules.append(Rule(tuple(tests), sum(hit), len(hit) - sum(hit)))
        left = [r for r in left if not rules[-1].holds(r)]
    return rules


def fit_rules(labelled: DataFrame, label: str = "quality", key: str = "doc_id", most_rows: int = LABELLED_ROWS, **how) -> list[Rule]:
    """Rules from labelled texts (``text`` and a 0/1 label, 0 = bad). Rows with a null label are left out.

    At most ``most_rows`` rows come to the driver: those with the smallest hash of ``key``, so that the
    sample depends on the rows alone and not on their partitions.
    """
    known = labelled.select(F.struct(col(key).alias("key"), (col(label) == 0).cast("int").alias("bad")).alias("row"), F.coalesce(col("text"), F.lit("")).alias("t"))
    # Dealt out after the limit: their statistics are the work of tasks, not of the driver.
    picked = known.filter("row.bad is not null").orderBy(F.xxhash64("row.key"), "row.key", "t").limit(most_rows).repartition(FIT_TASKS, "row.key")
    stats = _statistics(picked).select(F.xxhash64("row.key").alias("hash"), "row.key", "row.bad", *(feature(n).alias(n) for n in FEATURES))
    rows = sorted((r.asDict() for r in stats.collect()), key=lambda r: (r["hash"], str(r["key"]), r["bad"], *(r[n] for n in FEATURES)))
    return learn_rules(rows, **how)


def decision(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the number (from 1) of the first rule that holds, else 0."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1].column(), F.lit(k)).otherwise(out)
    return out


def _judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule_no", decision(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule_no") == 0))


def apply_rules(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``df`` with its statistics, base_failed, rule_no (the rejecting rule, 0 for none) and kept.

    A null or empty text has no words and fails the base rules. Repeated rows are judged alike. Columns named as the new
    ones are replaced; all others stay, whatever their names.
    """
    own = [c for c in df.columns if c not in STATISTICS and c not in VERDICTS]
    judged = _judged(_statistics(df.select(F.struct(*aliased(own)).alias("row"), F.coalesce(col(text), F.lit("")).alias("t"))), rules)
    return judged.select(*[F.col(f"row.{n}").alias(c) for c, n in zip(own, names(own), strict=True)], *STATISTICS, *VERDICTS)


def keep_good(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``df`` that ``apply_rules`` keeps, with all their columns unchanged, whatever their names."""
    own = df.columns
    rows = df.select(F.struct(*aliased(own)).alias("row"), F.coalesce(col(text), F.lit("")).alias("t"))
    # The row mark keeps the filter above the statistics: pushed below them, it would compute them once for each use.
    judged = _judged(_statistics(rows), rules).withColumn("mark", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("mark") >= 0)).select(*[F.col(f"row.{n}").alias(c) for c, n in zip(own, names(own), strict=True)])


def rules_from_tables(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality); one label a document, the smallest."""
    one = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality is not null")
    bounded = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    return fit_rules(docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id"))


def op8_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = rules_from_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply_rules(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_no")
