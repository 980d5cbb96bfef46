"""Sharding by Karmarkar-Karp differencing: near-equal bytes for groups that stay together.

Groups (rows of equal text) above a fixed fraction of a shard are differenced on the driver: their number is
bounded by that fraction. All others are dealt to chunks by hash, and each chunk is differenced together with
its share of the large groups' loads. Texts are never shuffled, only their digests and sizes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.scratch import Scratch, col

#: Groups that one task differences at once, and rows that one task numbers at once, on average.
CHUNK_GROUPS = 20_000
SLOT_ROWS = 500_000
#: Groups above this part of a shard's fair share of bytes are placed first.
LARGE = 1024
#: A group of more fair shares of bytes than this is split, since no partition could hold it and be even.
WHOLE_UP_TO = 1.1


def difference(parts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Karmarkar-Karp over partial partitions: the bin of each slot of each part, and the sums of the bins.

    ``parts`` are arrays of equal length (a single size is that size and zeros). The two parts of largest
    spread are joined in opposite order until one is left. Ties go by position.
    """
    if not parts:
        return [], np.zeros(0, np.int64)
    k = len(parts[0])
    orders = [np.argsort(-p, kind="stable") for p in parts]
    sums = [p[o] for p, o in zip(parts, orders, strict=True)]
    heap = [(-int(s[0] - s[-1]), n) for n, s in enumerate(sums)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = sums[a] + sums[b][::-1]
        order = np.argsort(-joined, kind="stable")
        made.append((a, b, order))
        sums.append(joined[order])
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(sums[-1][0] - sums[-1][-1]), len(sums) - 1))
    final = sums[-1]
    bins: list = [None] * len(sums)
    bins[-1] = np.arange(k)
    for n in range(len(sums) - 1, len(parts) - 1, -1):
        a, b, order = made[n - len(parts)]
        own = np.empty(k, np.int64)
        own[order] = bins[n]
        bins[a], bins[b], bins[n] = own, own[::-1], None
    out = []
    for o, found in zip(orders, bins, strict=False):
        own = np.empty(k, np.int64)
        own[o] = found
        out.append(own)
    return out, final


def _difference_chunk(base: np.ndarray):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "gkey", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        parts = np.zeros((len(pdf) + 1, len(base)), np.int64)
        parts[0] = base
        parts[1:, 0] = pdf["bytes"].to_numpy()
        bins, _ = difference(list(parts))
        shard = np.argsort(bins[0])  # the shard whose load from the large groups went into a bin
        return pd.DataFrame({"gkey": pdf["gkey"], "piece": pdf["piece"], "shard": np.array([shard[b[0]] for b in bins[1:]], np.int32)})

    return run


def assign_shards(df: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text", chunk_groups: int = CHUNK_GROUPS, slot_rows: int = SLOT_ROWS, whole_up_to: float = WHOLE_UP_TO) -> DataFrame:
    """Shard and slot of every row: (key, size, text_crc32, shard, slot).

    Size is the UTF-8 bytes of the text (null: none) plus 8. Rows of equal text share a shard, unless
    together they exceed ``whole_up_to`` fair shares of all bytes; such a group is cut into as many
    pieces as fair shares, by a hash of the key. Null texts are a group of their own, apart from empty
    ones. A null key is a value like any other. Repeated rows each get a slot. No rows give no rows.
    Slots number a shard's rows from 0 without a gap.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "sharding")
    t = col(text)
    sized = df.select(
        col(key).alias("key"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(t, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.coalesce(F.sha2(t, 256), F.lit("null")).alias("gkey"),
    )
    sized = scratch.write(sized, "sized")
    groups = scratch.write(sized.groupBy("gkey").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total, n_groups, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    fair = max(1.0, total / n_shards)
    # At most n_shards / whole_up_to groups can be so large.
    large = {r.gkey: -int(-r.bytes // fair) for r in groups.filter(F.col("bytes") > F.lit(whole_up_to * fair)).filter("n > 1").collect()}
    pieces, piece = F.lit(1), F.lit(0)
    for g, n in large.items():
        pieces = F.when(F.col("gkey") == g, F.lit(n)).otherwise(pieces)
        piece = F.when(F.col("gkey") == g, F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")).otherwise(piece)
    items = groups.withColumn("_n", pieces).select("gkey", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("piece"), (F.col("bytes") / F.col("_n")).cast("long").alias("bytes"))
    # The driver differences the largest items, n_shards * LARGE of them at most whatever the input.
    is_large = F.col("bytes") > F.lit(fair / LARGE)
    top = sorted(items.filter(is_large).collect(), key=lambda r: (-r.bytes, r.gkey, r.piece))
    bins, base = difference([np.array([r.bytes] + [0] * (n_shards - 1), np.int64) for r in top])
    base = base if top else np.zeros(n_shards, np.int64)
    first = spark.createDataFrame([(r.gkey, r.piece, int(b[0])) for r, b in zip(top, bins, strict=True)], "gkey string, piece int, shard int")
    # Every chunk starts from its share of those loads, as one more partial partition, and evens them out.
    chunks = max(1, -(-n_groups // chunk_groups))
    rest = items.filter(~is_large).withColumn("chunk", F.pmod(F.xxhash64("gkey", "piece"), F.lit(chunks)).cast("int"))
    dealt = rest.groupBy("chunk").applyInPandas(_difference_chunk(base // chunks), first.schema)
    placed = scratch.write(first.unionByName(dealt), "placed")
    salts = max(1, -(-n_rows // slot_rows))
    # A hot group's rows are one join key: adaptive execution splits that partition, the other side has one row for it.
    rows = sized.withColumn("piece", piece).join(placed, ["gkey", "piece"]).select("key", "size", "text_crc32", "shard", F.pmod(F.xxhash64("key", "text_crc32"), F.lit(salts)).cast("int").alias("salt"))
    rows = scratch.write(rows, "rows")
    counts = rows.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    start = (F.sum("n").over(Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).alias("start")
    starts = counts.select("shard", "salt", F.coalesce(start, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "salt").orderBy(F.col("key").asc_nulls_first(), "text_crc32"))
    out = rows.withColumn("_n", within).join(starts, ["shard", "salt"])
    scratch.drop("groups")
    return out.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("start") + F.col("_n") - 1).cast("long").alias("slot"))


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = assign_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
