"""Benchmark decontamination by greedy string tiling.

Documents and test items meet on shared seeds, rolling Karp-Rabin hashes of ``seed`` words. Seeds in a row on
one diagonal are a match; greedy tiling marks the longest unmarked match of a pair again and again, so that
passages count whatever their order, and the share of the item's words that is tiled decides. Items of fewer words
than a seed can be matched as wholes.

The benchmark is a stated query set: it is split into blocks of a bounded number of words, and each block is
held against all documents in one pass without a shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.kernel import PUNCT, U, shingles, slices, texts, words
from runledger.llm.scratch import Scratch, aliased, col, restored

SEED = 5
COVERAGE = 0.5
#: Words of a block of the benchmark, about 40 bytes each in every worker.
BLOCK_WORDS = 1_000_000
SIEVE = 1 << 20
#: Seed hits that are held at once.
HITS = 1_000_000


def tokens(column: pa.Array):
    """Words without punctuation and case: runs of letters, digits and non-ASCII characters, lower-cased."""
    data, offsets = texts(pc.utf8_lower(pc.fill_null(column, "")))
    for i, j in slices(offsets):
        lo = offsets[i]
        yield i, j, words(data[lo : offsets[j]], offsets[i : j + 1] - lo, PUNCT, None)


class Seeds:
    """Seeds of ``size`` words in hash order, with their items and places."""

    def __init__(self, size: int, seeds: list, item: list, at: list):
        self.size = size
        seeds, item, at = (np.concatenate(x) if x else np.zeros(0, U) for x in (seeds, item, at))
        order = np.lexsort((at, item, seeds))
        self.seeds, self.item, self.at = seeds[order], item[order], at[order]
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[(self.seeds & U(SIEVE - 1)).astype(np.int64)] = True


class Block:
    """Items' words and seeds; with ``whole``, an item of fewer words than a seed is one seed of its own length."""

    def __init__(self, rows: list[tuple], seed: int, whole: bool = False):
        self.ids = [r[0] for r in rows]
        self.words: list[np.ndarray] = []
        lists: dict[int, tuple] = {seed: ([], [], [])}
        for i, j, (_, hashed, _, before) in tokens(pa.array([r[1] for r in rows], pa.string())):
            for r in range(j - i):
                own = hashed[before[r] : before[r + 1]]
                self.words.append(own)
                size = len(own) if whole and 0 < len(own) < seed else seed
                found, _ = shingles(own, np.array([0, len(own)]), size, False)
                seeds, item, at = lists.setdefault(size, ([], [], []))
                seeds.append(found)
                item.append(np.full(len(found), i + r))
                at.append(np.arange(len(found)))
        self.tables = [t for t in (Seeds(size, *x) for size, x in lists.items()) if len(t.seeds)]


def runs(item_at: np.ndarray, doc_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed hits in a row on one diagonal, as (first in the item, first in the document, hits), by diagonal."""
    diagonal = doc_at - item_at
    order = np.lexsort((item_at, diagonal))
    d, i = diagonal[order], item_at[order]
    new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)))
    return i[new], i[new] + d[new], np.diff(np.append(new, len(i)))


def joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of several parts of a document, those that go on from one part to the next made one."""
    i, j, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((i, j - i))
    i, j, n = i[order], j[order], n[order]
    d = j - i
    first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (i[1:] != i[:-1] + n[:-1])))
    return i[first], j[first], np.add.reduceat(n, first)


def tile(item_at: np.ndarray, doc_at: np.ndarray, hits: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from runs of seed hits: (start in the item, start in the document, words) of each tile.

    The longest unmarked match goes first; of equal ones the first in the document, then in the item.
    """
    size = hits + seed - 1
    heap = list(zip((-size).tolist(), doc_at.tolist(), item_at.tolist(), strict=True))
    heapq.heapify(heap)
    i_low, j_low = int(item_at.min()), int(doc_at.min())
    item_free, doc_free = np.ones(int((item_at + size).max()) - i_low, bool), np.ones(int((doc_at + size).max()) - j_low, bool)
    left, tiles = len(item_free), []
    while heap and left >= seed:
        n, j, i = heapq.heappop(heap)
        n = -n
        free = item_free[i - i_low : i - i_low + n] & doc_free[j - j_low : j - j_low + n]
        if free.all():
            tiles.append((i, j, n))
            item_free[i - i_low : i - i_low + n] = doc_free[j - j_low : j - j_low + n] = False
            left -= n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]))).tolist()
        for a, b in zip(edges[::2], edges[1::2], strict=True):  # what is left of it, in runs
            if b - a >= seed:
                heapq.heappush(heap, (a - b, j + a, i + a))
    return tiles


def _matches(block: Block, column: pa.Array):
    """(row, item number, tiles) of every pair that shares a seed."""
    for i, _, (_, hashed, _, before) in tokens(column):
        for table in block.tables:
            for r, item, tiles in _hits(table, hashed, before):
                yield i + r, item, tiles


def _hits(table: Seeds, hashed: np.ndarray, before: np.ndarray):
    """As ``_matches``, of the seeds of one size in a slice; rows count from the slice's first.

    Hits are made for some HITS at a time and kept as runs: a document and an item that repeat one seed have as many hits as
    the product of the two, but no more runs than their words.
    """
    seed = table.size
    found, row = shingles(hashed, before, seed, False)
    if not len(found):
        return
    first = np.concatenate([[0], np.cumsum(np.maximum(np.diff(before) - seed + 1, 0))])
    hit = np.flatnonzero(table.sieve[(found & U(SIEVE - 1)).astype(np.int64)])
    lo, hi = np.searchsorted(table.seeds, found[hit], "left"), np.searchsorted(table.seeds, found[hit], "right")
    hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    if not len(hit):
        return
    upto = np.cumsum(n)
    open_row, held = -1, {}

    def tiled():
        for k in sorted(held):
            yield open_row, k, tile(*joined(held[k]), seed)

    begin = 0
    while begin < len(hit):
        stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + HITS, "right")))
        h, l, c = hit[begin:stop], lo[begin:stop], n[begin:stop]
        begin = stop
        at = np.repeat(l - np.append(0, np.cumsum(c)[:-1]), c) + np.arange(c.sum())
        r, doc_at = np.repeat(row[h], c), np.repeat(h - first[row[h]], c)
        item, item_at = table.item[at], table.at[at]
        order = np.lexsort((item, r))
        r, item, item_at, doc_at = r[order], item[order], item_at[order], doc_at[order]
        new = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (item[1:] != item[:-1])))
        for s, e in zip(new, np.append(new[1:], len(r)), strict=True):
            if int(r[s]) != open_row:
                yield from tiled()
                open_row, held = int(r[s]), {}
            held.setdefault(int(item[s]), []).append(runs(item_at[s:e], doc_at[s:e]))
    yield from tiled()


def _pairs(shared, least: float, item_type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            row, item, covered, n, longest = [], [], [], [], []
            for r, k, tiles in _matches(block, batch.column(1)):
                total = sum(t[2] for t in tiles)
                if total >= least * len(block.words[k]):
                    row.append(r)
                    item.append(k)
                    covered.append(total)
                    n.append(len(tiles))
                    longest.append(max(t[2] for t in tiles))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array([block.ids[k] for k in item], item_type), *(pa.array(x, pa.int64()) for x in (covered, [len(block.words[k]) for k in item], n, longest))],
                names=["key", "item", "tiled_words", "item_words", "n_tiles", "longest_tile"],
            )

    return run


def _clean(shared, least: float, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for r, k, tiles in _matches(block, batch.column(text)):
                if sum(t[2] for t in tiles) >= least * len(block.words[k]):
                    keep[r] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame, item_key: str, text: str, seed: int, block_words: int, whole: bool):
    """(number, blocks, broadcast block) of each block, collected by itself; an item is never split."""
    spark = benchmark.sparkSession
    items = benchmark.select(col(item_key).alias("item"), col(text).alias("text")).filter("item is not null and text <> ''")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // (block_words * 5)))
    for k in range(n):
        rows = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k).collect()]
        yield k, n, spark.sparkContext.broadcast(Block(sorted(rows, key=lambda r: (r[0], r[1])), seed, whole))


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", seed: int = SEED, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS, whole: bool = False) -> DataFrame:
    """Pairs of a document and a test item of whose words at least ``coverage`` are tiled by the document.

    Columns: key, item_key, tiled_words, item_words, coverage, n_tiles, longest_tile. Tiles have ``seed`` words or
    more; an item of fewer words has no seed and is found only with ``whole``, where all its words stand in a row in
    the document. Null and empty texts, and items without an
    id, match nothing. Repeated rows of ``docs`` are each reported; a null key is reported as null.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(benchmark.schema[item_key].dataType)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, item {benchmark.schema[item_key].dataType.simpleString()}, tiled_words long, item_words long, n_tiles long, longest_tile long"
    rows = docs.select(col(key).alias("key"), col(text).alias("text"))
    scratch, out = Scratch(docs.sparkSession, "leaks"), None
    for k, n, shared in _blocks(benchmark, item_key, text, seed, block_words, whole):
        part = rows.mapInArrow(_pairs(shared, coverage, item_type), schema)
        if n > 1:  # one block is in memory at a time
            part = scratch.write(part, str(k))
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("key").alias(key), F.col("item").alias(item_key), "tiled_words", "item_words", (F.col("tiled_words") / F.col("item_words")).alias("coverage"), "n_tiles", "longest_tile")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, item_key: str = "item_id", text: str = "text", seed: int = SEED, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS, whole: bool = False) -> DataFrame:
    """``docs`` without the rows that ``find_leaks`` reports, in one pass a block and without a shuffle."""
    scratch, own = Scratch(docs.sparkSession, "clean"), docs.columns
    rows = docs.select(*aliased(own))
    for k, n, shared in _blocks(benchmark, item_key, text, seed, block_words, whole):
        rows = rows.mapInArrow(_clean(shared, coverage, own.index(text)), rows.schema)
        if n > 1:
            rows = scratch.write(rows, str(k))
            shared.destroy()
            if k:
                scratch.drop(str(k - 1))
    return rows.select(*restored(own))


def op3_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), whole=True)


OP3_SQL = r"""
with recursive d as (
  select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') as w from documents
), b as (
  select item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') as w from benchmark where item_id is not null
), items as (select item_id, w, len(w) as m, least(5, len(w)) as k from b where len(w) > 0),
item_seeds as materialized (select item_id, k, p, array_to_string(w[p:p + k - 1], ' ') as s from (select *, unnest(range(1, m - k + 2)) as p from items)),
doc_seeds as (select r, k, p, array_to_string(w[p:p + k - 1], ' ') as s from (select r, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from items))),
hits as materialized (select r, item_id, k, i.p as ip, j.p as jp from doc_seeds j join item_seeds i using (k, s)),
rounds as (
  select 0 as round, r, item_id, k, ip, jp, cast(null as bigint) as bi, cast(null as bigint) as bj, cast(0 as bigint) as bn from hits
  union all
  select round + 1, r, item_id, k, ip, jp, best.i, best.j, best.n from (
    select *, first_value({'n': n, 'i': si, 'j': sj}) over (partition by r, item_id order by n desc, sj, si) as best from (
      select *, count(*) over run + k - 1 as n, min(ip) over run as si, min(jp) over run as sj from (
        select *, jp - row_number() over (partition by r, item_id, jp - ip order by jp) as island from rounds
        where round = 0 or ((ip + k <= bi or ip >= bi + bn) and (jp + k <= bj or jp >= bj + bn))
      ) window run as (partition by r, item_id, jp - ip, island)))
), tiles as (select distinct round, r, item_id, bi, bj, bn from rounds where round > 0),
found as (select r, item_id, cast(sum(bn) as bigint) as tiled_words, count(*) as n_tiles, max(bn) as longest_tile from tiles group by r, item_id)
select doc_id, found.item_id, tiled_words, cast(m as bigint) as item_words, tiled_words / m as coverage, n_tiles, longest_tile
from found join d on d.r = found.r join items on items.item_id = found.item_id where tiled_words >= 0.5 * m"""
