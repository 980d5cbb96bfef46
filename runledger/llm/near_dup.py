"""MinHash near-dedup by tensored banding, with every link confirmed on the full sets of shingles.

Two collections of ``m`` half-keys, each of ``HALF`` minhashes, give m * m table keys by pairing: 2 * m * HALF
minhashes do the work of 2 * m * m * HALF. Texts of equal sets are one class; of each table bucket only star links
to its smallest component are formed. Their components are candidates for exact comparison, in which only members
outside a component's largest cluster are compared to the others, until no link between different texts is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.components import connected_components
from runledger.llm.kernel import STEP, U, shingles, slices, splitmix, texts, words
from runledger.llm.scratch import Scratch, aliased, col, names, restored

HALF = 3
#: Most probability of missing a pair exactly at the threshold in all tables.
MISS = 2.5e-5
#: Most classes of a component whose half-keys pair at unequal places before those of all its classes do.
PILOTS = 32
#: Shingles of a component compared within one task, and of a task's components together; larger ones are compared by all tasks.
TASK_SHINGLES = 400_000
CHUNK_SHINGLES = 2_000_000
#: Shingles of a block of queries that every task holds, and first pivots of a large component.
QUERY_SHINGLES = 1_000_000
PIVOTS = 8


def half_keys(similarity: float, miss: float = MISS) -> int:
    """Half-keys on a side so that a pair at ``similarity`` shares a table key with probability 1 - miss."""
    return max(1, math.ceil(math.log(miss / 2) / math.log(1 - similarity**HALF)))


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingles in order by row, their bounds) of slices of a text column."""
    data, offsets = texts(column)
    for i, j in slices(offsets):
        lo = offsets[i]
        _, hashed, _, before = words(data[lo : offsets[j]], offsets[i : j + 1] - lo)
        found, row = shingles(hashed, before, k, True)
        bounds = np.searchsorted(row, np.arange(j - i + 1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            found[a:b].sort()
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
        yield i, j, found[new], np.searchsorted(row[new], np.arange(j - i + 1))


def _sketch(k: int, m: int):
    n_hashes = 2 * m * HALF

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            factor = splitmix(np.arange(1, n_hashes + 1, dtype=U)) | U(1)
            shift = splitmix(factor)
        for batch in batches:
            for i, j, found, bounds in sets_of(batch.column(1), k):
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                start = bounds[:-1][full]
                with np.errstate(over="ignore"):
                    sig = np.zeros((j - i, 2), U)
                    halves = np.zeros((len(full), 2 * m), U)
                    if len(full):
                        for c in range(2):
                            sig[full, c] = np.add.reduceat(splitmix(found ^ U(c + 1)), start)
                        for t in range(n_hashes):
                            least = np.minimum.reduceat((found ^ shift[t]) * factor[t], start)
                            halves[:, t // HALF] = splitmix(halves[:, t // HALF] + least + U(t))
                of = np.full(j - i, -1)
                of[full] = np.arange(len(full))
                listed = pa.FixedSizeListArray.from_arrays(pa.array(halves.ravel().view(np.int64)), 2 * m).cast(pa.list_(pa.int64()))
                pick = pa.array(of, pa.int64(), mask=of < 0)
                raw = pa.array([s.tobytes() if n else None for s, n in zip(sig, size, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size.astype(np.int64)), raw, listed.take(pick)], names=["key", "n", "sig", "halves"])

    return run


class Sets:
    """Sets of shingles with an inverted index: overlaps of one set with all of them at once."""

    def __init__(self, parts: list[np.ndarray]):
        self.size = np.array([len(p) for p in parts], np.int64)
        every = np.concatenate(parts) if parts else np.zeros(0, U)
        order = np.argsort(every, kind="stable")
        self.every, self.of = every[order], np.repeat(np.arange(len(parts)), self.size)[order]

    def like(self, own: np.ndarray, percent: int) -> np.ndarray:
        """Members with 100 * intersection >= percent * union."""
        lo, hi = np.searchsorted(self.every, own, "left"), np.searchsorted(self.every, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        shared = np.bincount(self.of[at], minlength=len(self.size))
        return np.flatnonzero((shared > 0) & (100 * shared >= percent * (self.size + len(own) - shared)))


class Forest:
    """Union-find over 0 .. n-1 that remembers the links that joined."""

    def __init__(self, n: int):
        self.up, self.weight, self.links = list(range(n)), [1] * n, []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            if self.weight[x] < self.weight[y]:
                x, y = y, x
            self.up[y] = x
            self.weight[x] += self.weight[y]
            self.links.append((a, b))


def link_all(parts: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of all links between the sets.

    A link that joins two clusters has an end outside the largest cluster, so it is enough to compare
    every set that is outside it, with all sets. Which cluster is largest may change on the way: sets that were
    passed over wait, and are compared if they lie outside the one that is largest then, until all that wait lie in it.
    """
    held, forest = Sets(parts), Forest(len(parts))
    largest, waiting, compared = None, range(len(parts)), True
    while compared:
        passed, compared = [], False
        for p in waiting:
            if largest is not None and forest.root(p) == forest.root(largest):
                passed.append(p)
                continue
            compared = True
            for q in held.like(parts[p], percent).tolist():
                forest.join(p, q)
            if largest is None or forest.weight[forest.root(p)] > forest.weight[forest.root(largest)]:
                largest = p
        waiting = passed
    return forest.links


def _link_chunk(k: int, percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["comp", "key", "text"]).sort_values(["comp", "key"], kind="stable", ignore_index=True)
        parts: list[np.ndarray] = []
        for _, _, found, bounds in sets_of(pa.array(pdf["text"], pa.string()), k):
            parts += [found[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        u, v = [], []
        comp = pdf["comp"].to_numpy()
        edges = np.flatnonzero(np.append(True, comp[1:] != comp[:-1])).tolist() + [len(comp)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for x, y in link_all(parts[a:b], percent):
                u.append(a + x)
                v.append(a + y)
        keys = pdf["key"]
        return pd.DataFrame({"u": keys.iloc[u].to_numpy(), "v": keys.iloc[v].to_numpy()})

    return run


def _link_queries(shared, k: int, percent: int, kind: pa.DataType):
    """Links of every row to the broadcast queries of its component, as a spanning forest for each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = {}
        for comp, (keys, column) in shared.value.items():
            parts = []
            for _, _, found, bounds in sets_of(column, k):
                parts += [found[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            groups[comp] = (keys, Sets(parts))
        for batch in batches:
            comps, keys = batch.column("comp").to_pylist(), batch.column("key").to_pylist()
            for i, j, found, bounds in sets_of(batch.column("text"), k):
                u, v = [], []
                forests: dict = {}
                for r in range(i, j):
                    if (group := groups.get(comps[r])) is None:
                        continue
                    names, held = group
                    forest, rows = forests.setdefault(comps[r], (Forest(len(names) + j - i), []))
                    rows.append(r)
                    for q in held.like(found[bounds[r - i] : bounds[r - i + 1]], percent).tolist():
                        forest.join(q, len(names) + r - i)
                for comp, (forest, _) in forests.items():
                    names = groups[comp][0]
                    for q, r in forest.links:
                        u.append(names[q])
                        v.append(keys[i + r - len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], names=["u", "v"])

    return run


def _against(members: DataFrame, queries: list, k: int, percent: int, kind: str, scratch: Scratch, name: str) -> DataFrame:
    """The links of all ``members`` to the queries, as a written table; the broadcast queries are let go of."""
    from pyspark.sql.pandas.types import to_arrow_type

    by: dict = {}
    for r in queries:
        by.setdefault(r.comp, ([], []))[0].append(r.key)
        by[r.comp][1].append(r.text)
    shared = members.sparkSession.sparkContext.broadcast({c: (keys, pa.array(t, pa.string())) for c, (keys, t) in by.items()})
    found = scratch.write(members.mapInArrow(_link_queries(shared, k, percent, to_arrow_type(members.schema["key"].dataType)), f"u {kind}, v {kind}"), name)
    shared.destroy()
    return found


def _joined(keys: DataFrame, labels: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """``labels`` (node, label) after components that share a bucket of ``keys`` (comp, bucket) are one, each with its smallest class as the label."""
    keys = scratch.write(keys.distinct(), f"{name}-keys")
    buckets = scratch.write(keys.groupBy("bucket").agg(F.min("comp").alias("first"), F.count("*").alias("c")).filter("c > 1").select("bucket", "first"), f"{name}-buckets")
    stars = keys.join(buckets, "bucket").filter("comp <> first").select(F.col("comp").alias("u"), F.col("first").alias("v")).distinct()
    found = scratch.write(connected_components(scratch.write(stars, f"{name}-stars"), scratch, name), f"{name}-found")
    scratch.drop(f"{name}-keys", f"{name}-buckets", f"{name}-stars")
    if labels is None:
        return found
    to = found.select(F.col("node").alias("from"), F.col("label").alias("to"))
    moved = labels.join(to, F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label"))
    return scratch.write(moved.unionByName(found.join(labels.select("node"), "node", "left_anti")), f"{name}-labels")


def _pairable(halves: DataFrame, labels: DataFrame, m: int, scratch: Scratch, name: str) -> DataFrame:
    """(rep, comp, a, b) of classes with half-keys on both sides that other components have too, as a written table; a and b hold these (side, h)."""
    to = labels.select(F.col("node").alias("rep"), "label")
    held = halves.join(to, "rep", "left").select(F.coalesce("label", "rep").alias("comp"), "h")
    shared = scratch.write(held.groupBy("h").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).filter("first <> last").select("h"), f"{name}-shared")
    one = F.struct("side", "h")
    paired = halves.join(shared, "h").groupBy("rep").agg(F.collect_list(F.when(F.col("side") < m, one)).alias("a"), F.collect_list(F.when(F.col("side") >= m, one)).alias("b"))
    paired = scratch.write(paired.filter("size(a) > 0 and size(b) > 0").join(to, "rep", "left").select("rep", F.coalesce("label", "rep").alias("comp"), "a", "b"), f"{name}-paired")
    scratch.drop(f"{name}-shared")
    return paired


def _table_keys(m: int, low: int, high: int) -> Column:
    """The keys of half-keys in ``a`` with those in ``b`` that are ``low`` to ``high`` - 1 places on, a row each."""

    def of(x: Column) -> Column:
        return F.transform(F.filter("b", lambda y: F.pmod(y["side"] - x["side"], F.lit(m)).between(low, high - 1)), lambda y: F.xxhash64(x["h"], y["h"]))

    return F.explode(F.flatten(F.transform("a", of)))


def candidates(classes: DataFrame, m: int, scratch: Scratch) -> DataFrame:
    """(node, label) of classes that table keys put together, as a written table; the label is the smallest class of a component of two or more.

    Near copies share most half-keys, so that each would have nearly all m * m table keys. Half-keys at equal places, a few of
    them first, put nearly all of these together. Then pairs of half-keys at unequal places are keys: of at most ``PILOTS`` classes
    of a component first, which draw in nearly all others that share any with it, then of all classes, those up to m / 4 places on
    before the rest. Each turn takes only half-keys that two components still share, of classes with such on both sides; all
    others can pair to no table key that joins components. A component has a key once.
    """
    labels = None
    for name, places in (("few", range(min(2, m))), ("equal", range(2, m))):
        if places:
            held = classes if labels is None else classes.join(labels, F.col("rep") == F.col("node"), "left")
            comp = F.col("rep") if labels is None else F.coalesce("label", "rep")
            bucket = F.explode(F.array(*(F.xxhash64(F.col("halves")[t], F.col("halves")[m + t]) for t in places)))
            labels = _joined(held.select(comp.alias("comp"), bucket.alias("bucket")), labels, scratch, name)
    pilots = labels.groupBy("label", F.pmod(F.xxhash64("node"), F.lit(PILOTS))).agg(F.min("node").alias("node")).select("node")
    wait = scratch.write(labels.select("node").join(pilots, "node", "left_anti"), "wait")
    every = F.posexplode("halves").alias("side", "h")
    held, near = classes.join(wait, F.col("rep") == F.col("node"), "left_anti").select("rep", every), max(2, m // 4)
    for name, low, high in (("pilots", 1, m), ("near", 1, min(near, m)), ("far", near, m)):
        if low >= high:
            break
        paired = _pairable(held, labels, m, scratch, name)
        labels = _joined(paired.select("comp", _table_keys(m, low, high).alias("bucket")), labels, scratch, name)
        held = classes.select("rep", every) if name == "pilots" else paired.select("rep", F.explode(F.concat("a", "b")).alias("x")).select("rep", "x.side", "x.h")
    scratch.drop("wait", "pilots-paired", "near-paired", "far-paired")
    return labels


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, task_shingles: int = TASK_SHINGLES, query_shingles: int = QUERY_SHINGLES) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Words are runs without white space, A-Z lower-cased. A text's set holds its distinct runs of ``shingle`` words,
    or its whole sequence if it has fewer; a text without words (null, empty) has none and is linked with
    nothing. Texts are linked if 100 * intersection >= percent * union. component_id is the smallest key that
    links reach, kept marks its own row. Rows of one key are one document, also where their texts differ; each of these
    rows has the n_shingles of its own text. A row of null key takes no part: it has no component and is kept.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "near")
    kind = df.schema[key].dataType.simpleString()
    m = half_keys(percent / 100)
    rows = df.select(col(key).alias("key"), col(text).alias("text"))
    sketched = scratch.write(rows.mapInArrow(_sketch(shingle, m), f"key {kind}, n long, sig binary, halves array<long>"), "sketched")
    known = sketched.filter("sig is not null and key is not null")
    classes = scratch.write(known.groupBy("sig").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("halves").alias("halves")), "classes")
    coarse = scratch.write(candidates(classes, m, scratch).join(classes.groupBy("rep").agg(F.max("n").alias("n"), F.min("n").alias("least")), F.col("node") == F.col("rep")).select("node", F.col("label").alias("comp"), "n", "least"), "coarse")
    sizes = scratch.write(coarse.groupBy("comp").agg(F.sum("n").alias("size")), "sizes")
    total = sizes.filter(F.col("size") <= task_shingles).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    chunks = max(1, -(-total // CHUNK_SHINGLES))
    members = rows.join(coarse.join(sizes, "comp"), F.col("key") == F.col("node")).select("comp", "size", "key", "text", "n", "least")
    members = scratch.write(members, "members")
    small = members.filter(F.col("size") <= task_shingles).select("comp", "key", "text", F.pmod(F.xxhash64("comp"), F.lit(chunks)).alias("chunk"))
    links = small.groupBy("chunk").applyInPandas(_link_chunk(shingle, percent), f"u {kind}, v {kind}")
    edges = scratch.write(links, "links")
    large = members.filter(F.col("size") > task_shingles).select("comp", "key", "text", "n", "least")
    more = list(_large_links(large, coarse, sizes, scratch, shingle, percent, task_shingles, query_shingles, kind))
    for found in [*more, *_shared_keys(known, classes, scratch)]:
        edges = edges.unionByName(found)
    labels = scratch.write(connected_components(edges, scratch, "fine"), "labels")
    of_class = classes.join(labels, F.col("rep") == F.col("node"), "left").select("sig", F.coalesce("label", "rep").alias("comp"))
    of_class = scratch.write(of_class, "of-class")
    scratch.drop("members", "sizes", "coarse", "links")
    out = sketched.select("key", "n", "sig").join(of_class, "sig", "left")
    comp = F.when(F.col("key").isNotNull(), F.coalesce("comp", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("key") == comp, F.lit(True)).alias("kept"))


def _large_links(large: DataFrame, coarse: DataFrame, sizes: DataFrame, scratch: Scratch, k: int, percent: int, task_shingles: int, query_shingles: int, kind: str) -> Iterator[DataFrame]:
    """Links within components too large for one task.

    First a few pivots of each are compared to all members. Then every member that these links leave outside
    its component's largest cluster is compared to all members, as queries in blocks of bounded size.
    """
    too_large = coarse.join(sizes.filter(F.col("size") > task_shingles), "comp")
    if too_large.limit(1).count() == 0:
        return
    # Pivots: the classes of smallest hash in each of PIVOTS parts of a component; minima combine before the shuffle.
    pivots = too_large.groupBy("comp", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("part")).agg(F.min_by("node", F.xxhash64(F.lit(1), "node")).alias("key"), F.min_by(F.struct("n", "least"), F.xxhash64(F.lit(1), "node")).alias("s")).select("comp", "key", "s.n", "s.least")
    found = []
    for rows, block in _query_blocks(large, pivots, query_shingles, percent, scratch, "pivots"):
        found.append(_against(rows, block, k, percent, kind, scratch, f"pivot-links-{len(found)}"))
        yield found[-1]
    edges = found[0]
    for f in found[1:]:
        edges = edges.unionByName(f)
    labels = scratch.write(connected_components(edges, scratch, "pivoted").withColumnRenamed("node", "n_node"), "pivot-labels")
    labelled = too_large.join(labels, F.col("node") == F.col("n_node"), "left").select("comp", "node", "n", "least", F.coalesce("label", "node").alias("label"))
    labelled = scratch.write(labelled, "labelled")
    clusters = labelled.groupBy("comp", "label").agg(F.sum("n").alias("weight"))
    largest = scratch.write(clusters.groupBy("comp").agg(F.max_by("label", F.struct("weight", "label")).alias("top")), "largest")
    outside = labelled.join(largest, "comp").filter("label <> top").select("comp", F.col("node").alias("key"), "n", "least")
    for n, (rows, block) in enumerate(_query_blocks(large, outside, query_shingles, percent, scratch, "outside")):
        yield _against(rows, block, k, percent, kind, scratch, f"outside-links-{n}")


def _query_blocks(large: DataFrame, queries: DataFrame, most: int, percent: int, scratch: Scratch, name: str) -> Iterator[tuple[DataFrame, list]]:
    """The queries' rows (comp, key, text), collected in blocks of about ``most`` shingles, each with the rows that it can be linked with.

    A block's sets are of like size: linked sets are of sizes within ``percent``, so that a pass leaves out all others.
    """
    band = F.floor(F.ln("least") / F.lit(math.log(100 / percent) + 1e-9)).alias("band")
    queries = scratch.write(queries.select(F.col("key").alias("q_key"), F.col("n").alias("q_n"), F.col("least").alias("q_least"), band), name)
    held = scratch.write(large.join(queries, F.col("key") == F.col("q_key")).select("comp", "key", "text", "band").distinct(), f"{name}-texts")
    # A row a band: sizes double every few bands.
    for r in sorted(queries.groupBy("band").agg(F.sum("q_n").alias("total"), F.min("q_least").alias("low"), F.max("q_n").alias("high")).collect()):
        rows = large.filter((100 * F.col("n") >= percent * r.low) & (percent * F.col("least") <= 100 * r.high)).select("comp", "key", "text")
        blocks = -(-r.total // most)
        for b in range(blocks):
            yield rows, held.filter((F.col("band") == r.band) & (F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)).select("comp", "key", "text").collect()


def _shared_keys(known: DataFrame, classes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Links of the classes of keys that have several texts."""
    several = known.groupBy("key").agg(F.min("sig").alias("first"), F.max("sig").alias("last")).filter("first <> last").select("key", "first")
    several = scratch.write(several, "several")
    if several.limit(1).count() == 0:
        return []
    pairs = scratch.write(known.join(several, "key").filter("sig <> first").select("sig", "first").distinct(), "same-key")
    reps = classes.select("sig", "rep")
    linked = pairs.join(reps.withColumnRenamed("rep", "u"), "sig").join(reps.select(F.col("sig").alias("first"), F.col("rep").alias("v")), "first")
    return [scratch.write(linked.select("u", "v").filter("u <> v").distinct(), "same-key-links")]


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, percent=85)


OP4_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) >= 3 then list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w
), classes as materialized (select s, min(doc_id) as rep from sets where len(s) > 0 group by s),
held as materialized (select rep, len(s) as n, unnest(s) as x from classes),
links as materialized (
  select a.rep as u, b.rep as v from held a join held b on a.x = b.x and a.rep <> b.rep group by a.rep, b.rep, a.n, b.n
  having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach as (select rep as node, rep as label from classes union select v, label from reach join links on u = node),
labels as (select node, min(label) as label from reach group by node)
select doc_id, cast(len(sets.s) as bigint) as n_shingles, coalesce(label, doc_id) as component_id, doc_id = coalesce(label, doc_id) as kept
from sets left join classes on sets.s = classes.s left join labels on node = rep"""


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one document of each component, that of the smallest key; rows of null key stay."""
    gone = near_duplicates(df, key, text, shingle, percent).filter("not kept").select(col(key).alias("gone")).distinct()
    own = df.columns
    return df.select(*aliased(own)).join(gone, F.col(names(own)[own.index(key)]) == F.col("gone"), "left_anti").select(*restored(own))
