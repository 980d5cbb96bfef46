"""Line dedup with two Bloom filters: only lines suspected of repeating are shuffled.

The once-seen filter is kept by hash range: tasks send the hashes of their lines to the ranges, and each range's
filter picks those that were there before, so that the filter's size follows the lines and no task holds more than one
range of it. Those picked make the twice-seen filter, which is broadcast: its size follows the repeated lines. Pass 2
sends on only the lines in it; grouping them by a 128-bit digest confirms repeats exactly and picks the first
document. The filters have no false negatives, so a filter that is too full costs shuffle, not correctness.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.kernel import BYTE, LOWER, SPACE, STEP, U, powers, slices, splitmix, texts
from runledger.llm.scratch import Scratch, aliased, col, names, restored, schema_of

SEGMENT = 1 << 16
HASHES = 3
#: Filter bits for each line, and for each line picked by the first filter.
BITS_PER_LINE = 12
#: Bits of one hash range of the first filter; ranges at most, and bits of a range beyond so many ranges.
RANGE_BITS, MOST_RANGES, LARGEST_RANGE = 1 << 20, 1 << 16, 1 << 26
#: The largest second filter: 2**30 bits, 128 MB, whatever the input.
MOST_BITS = 1 << 30
#: Distinct lines that a task holds before it sends them on, and hashes in a row that it sends.
HELD, ROW_HASHES = 1_000_000, 512
#: Bytes of text that are cut into lines at once; each takes some 60 bytes on the way.
SLICE = 1 << 19
BLANK = b" \t\n\x0b\x0c\r"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def line_keys(data: np.ndarray, offsets: np.ndarray, least: int):
    """Hash, row, and byte range of the key of every line whose key has at least ``least`` code points."""
    n, none = len(data), np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, U), none, none, none, none
    newline = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([newline + 1, offsets[:-1]]))
    begin = begin[begin < n]
    span = np.diff(np.append(begin, n))
    at = np.arange(n)
    solid = ~SPACE[data]
    first = np.minimum.reduceat(np.where(solid, at, n), begin)
    last = np.maximum.reduceat(np.where(solid, at, -1), begin)
    inside = (at >= np.repeat(first, span)) & (at <= np.repeat(last, span))
    points = np.add.reduceat(inside & ((data & 0xC0) != 0x80), begin, dtype=np.int64)
    with np.errstate(over="ignore"):
        value = BYTE[LOWER[data]] * powers(int(span.max()) + 1)[np.clip(at - np.repeat(first, span), 0, None)]
        value[~inside] = 0
        hashed = splitmix(np.add.reduceat(value, begin))
    row = np.searchsorted(offsets, begin, "right") - 1
    line = np.arange(len(begin)) - np.searchsorted(begin, offsets[row])
    long = points >= least
    return hashed[long], row[long], first[long], last[long] + 1, line[long]


def positions(hashed: np.ndarray, bits: int) -> np.ndarray:
    """Filter positions, one row for each hash function."""
    with np.errstate(over="ignore"):
        step = splitmix(hashed ^ U(STEP)) | U(1)
        return np.stack([(hashed + U(j) * step) & U(bits - 1) for j in range(HASHES)])


def power_of_two(least: float) -> int:
    return 1 << max(0, math.ceil(math.log2(least))) if least > 1 else 1


def _rows(hashed: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Sorted hashes as rows (range, hashes) of a bounded size each."""
    at = (hashed >> U(64 - (ranges.bit_length() - 1))).astype(np.int64) if ranges > 1 else np.zeros(len(hashed), np.int64)
    edges = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(hashed) else np.zeros(0, np.int64)
    starts = np.concatenate([np.arange(i, j, ROW_HASHES) for i, j in zip(edges, np.append(edges[1:], len(hashed)), strict=True)]) if len(edges) else edges
    offsets = np.append(starts, len(hashed)).astype(np.int64) * 8
    listed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(hashed.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(at[starts].astype(np.int32)), listed.cast(pa.binary())], names=["range", "hashes"])


def _hashes(ranges: int, least: int):
    """Hashes of the lines of one task, by range: a line once for a document, at most twice for a million of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        held = 0

        def send():
            every, count = np.unique(np.concatenate(pending), return_counts=True)
            pending.clear()
            yield _rows(every, ranges)
            if len(again := every[count > 1]):
                yield _rows(again, ranges)

        for batch in batches:
            data, offsets = texts(batch.column(0))
            for i, j in slices(offsets, SLICE):
                lo, hi = offsets[i], offsets[j]
                hashed, row, *_ = line_keys(data[lo:hi], offsets[i : j + 1] - lo, least)
                if len(hashed):
                    order = np.lexsort((hashed, row))
                    h, r = hashed[order], row[order]
                    pending.append(h[np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))])
                    held += len(pending[-1])
                if held > HELD:
                    yield from send()
                    held = 0
        if pending:
            yield from send()

    return run


def _seen_before(bits: int):
    """Hashes that the filter of their range already holds, each once; rows come range by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, current, found = np.zeros(bits, bool), None, []

        def picked() -> pa.RecordBatch:
            again = np.unique(np.concatenate(found)) if found else np.zeros(0, U)
            return pa.RecordBatch.from_arrays([pa.array(again.view(np.int64))], names=["hash"])

        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at != current:
                    if found:
                        yield picked()
                    current, found = at, []
                    once[:] = False
                own = np.frombuffer(raw.as_buffer(), U)
                place = positions(own, bits).astype(np.int64)
                hit = once[place].all(axis=0)
                if hit.any():
                    found.append(own[hit])
                once[place.ravel()] = True
                if len(found) > 4096:
                    found = [np.unique(np.concatenate(found))]
        if found:
            yield picked()

    return run


def _segments(bits: int):
    """Positions of hashes within the segments of a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(positions(batch.column(0).to_numpy(zero_copy_only=False).view(U), bits).ravel())
            at = (found // U(SEGMENT)).astype(np.int64)
            parts = np.split((found % U(SEGMENT)).astype(np.uint16), np.flatnonzero(np.diff(at)) + 1) if len(found) else []
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(at).astype(np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["segment", "at"])

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of each segment; rows come segment by segment, so that one is held at a time."""
    current, bits = None, np.zeros(SEGMENT, bool)
    row = lambda: pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["segment", "bits"])
    for batch in batches:
        for segment, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if segment != current:
                if current is not None:
                    yield row()
                current = segment
                bits[:] = False
            bits[np.frombuffer(raw.as_buffer(), np.uint16)] = True
    if current is not None:
        yield row()


def twice_seen(src: DataFrame, scratch: Scratch, least: int, bits_per_line: float, most_bits: int, range_bits: int) -> tuple[np.ndarray, int]:
    """The twice-seen filter of the lines of ``src`` (text), and its bits."""
    lines = src.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit("\n")) + 1), F.lit(0))).first()[0]
    ranges = min(MOST_RANGES, power_of_two(bits_per_line * lines / range_bits))
    bits = min(LARGEST_RANGE, power_of_two(max(1024, bits_per_line * lines / ranges)))
    sent = src.select("text").mapInArrow(_hashes(ranges, least), "range int, hashes binary")
    # Rows of a range come one after the other: a merging task holds one range's filter, whatever the number of tasks that sent rows.
    seen = sent.repartition("range").sortWithinPartitions("range").mapInArrow(_seen_before(bits), "hash long")
    seen = scratch.write(seen, "seen-before")
    bits = 1 << 20
    while bits < min(bits_per_line * seen.count(), most_bits):
        bits *= 2
    parts = seen.mapInArrow(_segments(bits), "segment int, at binary").repartition("segment").sortWithinPartitions("segment")
    made = scratch.write(parts.mapInArrow(_united, "segment int, bits binary"), "twice-seen")
    twice = np.zeros(bits // 8, np.uint8)  # bounded by most_bits
    for r in made.toLocalIterator():
        twice[r.segment * SEGMENT // 8 : (r.segment + 1) * SEGMENT // 8] = np.frombuffer(r.bits, np.uint8)
    scratch.drop("seen-before", "twice-seen")
    return twice, bits


def _suspects(shared, bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            ids, marks = batch.column("doc"), batch.column("mark")
            for i, j in slices(offsets, SLICE):
                lo, hi = offsets[i], offsets[j]
                part = data[lo:hi]
                hashed, row, start, stop, line = line_keys(part, offsets[i : j + 1] - lo, least)
                hit = np.ones(len(hashed), bool)
                for p in positions(hashed, bits):
                    hit &= (twice[(p >> U(3)).astype(np.int64)] >> (7 - (p & U(7)).astype(np.uint8))) & 1 == 1
                raw = part.tobytes()
                keys = [hashlib.blake2b(raw[a:b].translate(FOLD), digest_size=16).digest() for a, b in zip(start[hit], stop[hit], strict=True)]
                at = pa.array(row[hit] + i)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), ids.take(at), marks.take(at), pa.array(line[hit].astype(np.int32))], names=["key", "doc", "mark", "line"])

    return run


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, drops = batch.column("text"), batch.column("drops")
        kept, lines, dropped, sha = [], [], [], []
        for t, d in zip(text, drops, strict=True):
            was_null = not t.is_valid
            t = "" if was_null else t.as_py()
            n = t.count("\n") + 1
            if d.is_valid:
                gone = set(d.as_py())
                rest = [x for k, x in enumerate(t.split("\n")) if k not in gone]
                t, d = "\n".join(rest), len(gone)
            else:
                d = 0
            kept.append(None if was_null else t)
            lines.append(n)
            dropped.append(d)
            sha.append(hashlib.sha256(t.encode()).hexdigest())
        keep = batch.schema.names[2:]
        new = [pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *new], names=[*keep, "text", "n_lines", "n_dropped", "kept_sha256"])


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 10, bits_per_line: float = BITS_PER_LINE, most_bits: int = MOST_BITS, range_bits: int = RANGE_BITS) -> DataFrame:
    """``df`` with repeated lines gone from ``text``, and n_lines (before), n_dropped and kept_sha256.

    A line's key is the line without outer white space, A-Z lower-cased. Keys of ``least_chars`` code points or
    more that occur in two documents or more keep their lines only in the document of smallest ``key``. A null
    or empty text is one empty line; a null text stays null (its digest is that of the empty text). Rows of
    equal key are one document: a key that only they share is no repeat. A row of null key takes no part and
    keeps its text. Columns named as the new ones are replaced; all others stay, whatever their names.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "lines")
    new = ("n_lines", "n_dropped", "kept_sha256")
    src = df.select(col(key).alias("doc"), col(text).alias("text")).filter("doc is not null and text <> ''")
    twice, bits = twice_seen(src, scratch, least_chars, bits_per_line, most_bits, range_bits)
    shared = spark.sparkContext.broadcast(twice.tobytes())
    kind = src.schema["doc"].dataType.simpleString()
    marked = src.withColumn("mark", F.xxhash64("text"))
    suspects = scratch.write(marked.mapInArrow(_suspects(shared, bits, least_chars), f"key binary, doc {kind}, mark long, line int"), "suspects")
    repeats = suspects.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").drop("last")
    repeats = scratch.write(repeats, "repeats")
    # The key of a very common line is hot: adaptive execution splits the suspects' side, the other has one row a key.
    drops = suspects.join(repeats, "key").filter("doc > first").groupBy("doc", "mark").agg(F.collect_set("line").alias("drops"))
    own = [c for c in df.columns if c != text and c not in new]
    rows = df.select(col(text).alias("text"), col(key).alias("of"), F.xxhash64(col(text)).alias("like"), *aliased(own))
    joined = rows.join(drops, (F.col("of") == F.col("doc")) & (F.col("like") == F.col("mark")), "left").select("text", "drops", *names(own))
    out = joined.mapInArrow(_rebuild, schema_of(df, own, "text string, n_lines long, n_dropped long, kept_sha256 string"))
    back = dict(zip(own, restored(own), strict=True)) | {text: F.col("text").alias(text)}
    return out.select(*[back[c] for c in df.columns if c not in new], *new)


def op5_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP5_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), repeats as (
  select key, min(doc_id) as first from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1
), judged as (select k.*, r.first is not null and doc_id > r.first as gone from keyed k left join repeats r using (key))
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id"""
