"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of all training rows are made by vectorised tasks and summed by (language, segment of buckets). The matrix
of log probabilities, languages times buckets, is broadcast; texts are scored in numpy, a slice at a time. More languages
than one matrix may hold are scored in blocks, each with a pass of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.kernel import U, slices, splitmix, texts
from runledger.llm.scratch import Scratch, aliased, col, restored

BUCKETS = 1 << 15
GRAMS = (2, 3)
SEGMENT = 1 << 10
#: Bounds the broadcast matrix: so many languages of BUCKETS 4-byte numbers, 64 MB.
MOST_LANGUAGES = 512
#: Languages that a counting task holds at once, 256 KB each, and those that it counts at once.
HELD, AT_ONCE = 64, 16
LETTER = re.compile(r"[^\W\d_]")


def grams(data: np.ndarray, offsets: np.ndarray, n_buckets: int = BUCKETS):
    """(buckets, row) of the n-grams of each size, of lower-cased texts; grams never span texts."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(U)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    for n in GRAMS:
        if len(points) < n:
            continue
        size = len(points) - n + 1
        mixed = np.full(size, n, U)
        for j in range(n):
            mixed = (mixed << U(21)) | points[j : j + size]
        inside = row[:size] == row[n - 1 :]
        yield (splitmix(mixed[inside]) >> U(40)).astype(np.int64) & (n_buckets - 1), row[:size][inside]


def _lowered(column: pa.Array):
    data, offsets = texts(pc.utf8_lower(pc.fill_null(column, "")))
    for i, j in slices(offsets):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, segment, docs, buckets, counts) of the buckets that occur; docs are with segment 0 alone."""
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}

    def send() -> pa.RecordBatch:
        rows = []
        for lang, own in counts.items():
            for s in range(BUCKETS // SEGMENT):
                part = own[s * SEGMENT : (s + 1) * SEGMENT]
                full = np.flatnonzero(part)
                if len(full) or not s:
                    rows.append((lang, s, docs[lang] if not s else 0, full.astype(np.uint16).tobytes(), part[full].tobytes()))
        counts.clear()
        docs.clear()
        lang, segment, n, at, found = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(segment, pa.int32()), pa.array(n, pa.int64()), pa.array(at, pa.binary()), pa.array(found, pa.binary())], names=["lang", "segment", "docs", "buckets", "counts"])

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for i, j, data, offsets in _lowered(batch.column("text")):
            names, code, n = np.unique(langs[i:j].astype(str), return_inverse=True, return_counts=True)
            found = list(grams(data, offsets))
            for lo in range(0, len(names), AT_ONCE):
                some = names[lo : lo + AT_ONCE]
                for k, lang in enumerate(some.tolist()):
                    docs[lang] = docs.get(lang, 0) + int(n[lo + k])
                    counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for bucket, row in found:
                    own = code[row] - lo
                    if len(names) > AT_ONCE:
                        pick = (own >= 0) & (own < AT_ONCE)
                        own, bucket = own[pick], bucket[pick]
                    sums = np.bincount(own * BUCKETS + bucket, minlength=len(some) * BUCKETS).reshape(-1, BUCKETS)
                    for k, lang in enumerate(some.tolist()):
                        counts[lang] += sums[k]
                if len(counts) > HELD:
                    yield send()
    if counts:
        yield send()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows that come by (lang, segment), one of which is held at a time."""
    current, docs, total = None, 0, np.zeros(SEGMENT, np.int64)
    row = lambda: pa.RecordBatch.from_arrays([pa.array([current[0]]), pa.array([current[1]], pa.int32()), pa.array([docs], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["lang", "segment", "docs", "counts"])
    for batch in batches:
        for lang, segment, n, at, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if (lang, segment) != current:
                if current is not None:
                    yield row()
                current, docs = (lang, segment), 0
                total[:] = 0
            docs += n
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(raw, np.int64)
    if current is not None:
        yield row()


class Model:
    """Languages in name order with their log shares, and the counts by language and segment as a written table."""

    def __init__(self, languages: list[str], prior: np.ndarray, table: DataFrame, alpha: float, most_languages: int):
        self.languages, self.prior, self.table, self.alpha, self.most = languages, prior, table, alpha, most_languages

    def blocks(self) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """(languages, log probabilities of their buckets, log shares), of at most ``most`` languages each."""
        for k in range(0, len(self.languages), self.most):
            own = self.languages[k : k + self.most]
            place = {lang: n for n, lang in enumerate(own)}
            counts = np.full((len(own), BUCKETS), self.alpha, np.float32)
            total = np.full(len(own), self.alpha * BUCKETS)
            for r in self.table.filter(F.col("lang").between(own[0], own[-1])).toLocalIterator():
                part = np.frombuffer(r.counts, np.int64)
                counts[place[r.lang], r.segment * SEGMENT : (r.segment + 1) * SEGMENT] += part
                total[place[r.lang]] += part.sum()
            yield own, np.log(counts / total[:, None]).astype(np.float32), self.prior[k : k + self.most]


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", alpha: float = 0.5, most_languages: int = MOST_LANGUAGES) -> Model:
    """A model from all rows with a text and a language. ``most_languages`` bounds a block, not their number."""
    scratch = Scratch(labelled.sparkSession, "language")
    rows = labelled.select(col(lang).cast("string").alias("lang"), col(text).alias("text")).dropna()
    parts = rows.mapInArrow(_count, "lang string, segment int, docs long, buckets binary, counts binary")
    parts = parts.repartition("lang", "segment").sortWithinPartitions("lang", "segment")
    table = scratch.write(parts.mapInArrow(_summed, "lang string, segment int, docs long, counts binary"), "counts")
    known = sorted((r.lang, r.docs) for r in table.filter("segment = 0").select("lang", "docs").toLocalIterator())
    docs = np.array([n for _, n in known], float)
    return Model([lang for lang, _ in known], np.log(docs / docs.sum()) if known else docs, table, alpha, most_languages)


def _score(shared, last: bool):
    """Adds a block of languages to (text, lang_pred, best, total, ...): the best language, its log posterior, and the log of the sum of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, matrix, prior = shared.value
        for batch in batches:
            column = batch.column("text")
            logs = np.tile(prior, (len(column), 1))
            for i, j, data, offsets in _lowered(column):
                for bucket, row in grams(data, offsets):
                    if not len(row):
                        continue
                    start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    for k in range(len(languages)):
                        logs[i + row[start], k] += np.add.reduceat(matrix[k][bucket], start, dtype=np.float64)
            here = logs.argmax(axis=1)
            top = logs[np.arange(len(logs)), here]
            total = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
            lang, best, before = (batch.column(n) for n in ("lang_pred", "best", "total"))
            best, before = best.to_numpy(zero_copy_only=False), before.to_numpy(zero_copy_only=False)
            lang = [languages[h] if t > b else x for h, t, b, x in zip(here, top, best, lang.to_pylist(), strict=True)]
            best, total = np.maximum(best, top), np.logaddexp(before, total)
            if last:
                known = [bool(t.is_valid and LETTER.search(t.as_py())) for t in column]
                lang = [x if k else "und" for x, k in zip(lang, known, strict=True)]
                best = np.where(known, np.exp(np.minimum(0.0, best - total)), 0.0)
            new = {"lang_pred": pa.array(lang, pa.string()), "best": pa.array(best), "total": pa.array(total)}
            yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    return run


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred and score (the posterior probability) of every row, from its text alone.

    ``und`` with score 0 for a null text, one without a letter, or a model without languages. Of equal
    posteriors the first language by name wins. Repeated rows are judged alike; no rows give no rows. Kept columns named as
    the new ones are left out.
    """
    spark = df.sparkSession
    own = [c for c in keep if c not in ("lang_pred", "score")]
    never = F.lit(float("-inf"))
    state = df.select(col(text).alias("text"), F.lit("und").alias("lang_pred"), never.alias("best"), never.alias("total"), *aliased(own))
    if not model.languages:
        return state.select(*restored(own), "lang_pred", F.lit(0.0).alias("score"))
    scratch, n = Scratch(spark, "scores"), -(-len(model.languages) // model.most)
    for k, block in enumerate(model.blocks()):
        shared = spark.sparkContext.broadcast(block)
        state = state.mapInArrow(_score(shared, k == n - 1), state.schema)
        if k < n - 1:
            state = scratch.write(state, str(k))
            shared.destroy()
            if k:
                scratch.drop(str(k - 1))
    return state.select(*restored(own), "lang_pred", F.col("best").alias("score"))


def op9_query(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents. A row without a doc_id is trained on, not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))
    model = train(docs.filter(~F.col("held_out")))
    return predict(docs, model, keep=("doc_id", "held_out"))
