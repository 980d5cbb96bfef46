"""Connected components: in one task where edges are few, else by alternating large and small stars, every round a written table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.scratch import Scratch

#: Edges that one task takes on by itself; the rounds of stars cost more than their work below that.
FEW = 100_000
#: Rows for a task of a written table; a round over few edges is not spread over every shuffle partition.
TASK_ROWS = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find whose roots are the smallest nodes; the task's batches are all there is."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    if kind is not None:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "label"])


def connected_components(edges: DataFrame, scratch: Scratch, name: str, few: int = FEW) -> DataFrame:
    """(node, label) of every node of ``edges`` (u, v); the label is the smallest node of the component.

    ``edges`` should be a written table: it is read twice. Each star joins edges to the smallest neighbour of
    a node. Those minima are combined before the shuffle and written, so that a node of very many edges is one
    row on one side and split by adaptive execution on the other.
    """
    total = edges.count()
    if not total:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    if total <= few:
        kind = edges.schema["u"].dataType.simpleString()
        return edges.select("u", "v").coalesce(1).mapInArrow(_at_once, f"node {kind}, label {kind}")
    tasks = -(-total // TASK_ROWS)

    def write(df: DataFrame, at: str) -> DataFrame:
        return scratch.write(df.coalesce(tasks), f"{name}-{at}")

    edges = write(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "0")
    before, n = _state(edges), 0
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{n}-large-min")
        large = write(both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{n}-large")
        least = write(large.groupBy("u").agg(F.min("v").alias("m")), f"{n}-small-min")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = write(small.distinct(), str(n + 1))
        now = _state(after)
        scratch.drop(*(f"{name}-{x}" for x in (n, f"{n}-large-min", f"{n}-large", f"{n}-small-min")))
        edges, n = after, n + 1
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
