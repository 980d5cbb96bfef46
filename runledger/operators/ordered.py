"""Order-dependent building blocks that no single series can push into one task.

A series is cut into blocks of ``BLOCK`` consecutive order values. Windows run within blocks, and what crosses an
edge is carried over a table of one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.operators.written import written

BLOCK = 1_000_000
#: Of the sketches that percentiles start from.
ACCURACY = 10_000
#: Rows of a group whose values may be held in one buffer.
IN_MEMORY = 100_000


def _neighbour(df: DataFrame, keys: list[str], order: str, columns: list[str], name: str, block: int, back: bool) -> DataFrame:
    what = F.struct(F.col(order), *[F.col(c) for c in columns if c != order])
    df = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    w = Window.partitionBy(*keys, "_block").orderBy(F.col(order).asc() if back else F.col(order).desc())
    edge = (F.max_by if back else F.min_by)(what, F.col(order))
    edges = df.groupBy(*keys, "_block").agg(edge.alias("_edge"))
    across = Window.partitionBy(*keys).orderBy(F.col("_block").asc() if back else F.col("_block").desc())
    carried = edges.select(*keys, F.col("_block").alias("_b"), F.lag("_edge").over(across).alias("_carried"))
    inside = df.withColumn(name, F.lag(what).over(w))
    on = [inside[k].eqNullSafe(carried[k]) for k in keys] + [inside["_block"] == carried["_b"]]
    joined = inside.join(carried, on, "left").select(*[inside[c] for c in inside.columns if c not in (name, "_block")], F.coalesce(inside[name], F.col("_carried")).alias(name))
    return joined


def previous(df: DataFrame, keys: list[str], order: str, columns: list[str], name: str = "prev", block: int = BLOCK) -> DataFrame:
    """``df`` with a struct of ``order`` and ``columns`` of the row before, by ``order`` within ``keys``; null for the first."""
    return _neighbour(df, keys, order, columns, name, block, True)


def following(df: DataFrame, keys: list[str], order: str, columns: list[str], name: str = "next", block: int = BLOCK) -> DataFrame:
    """As ``previous``, of the row after."""
    return _neighbour(df, keys, order, columns, name, block, False)


def with_index(df: DataFrame, keys: list[str], order: list[str], name: str = "record_index") -> DataFrame:
    """A gapless number from 0 within ``keys``, by ``order`` (a total order): ranges are numbered by themselves, then moved on by counts.

    The ranges are written first. Their bounds come from a sample, and rows and counts must not see two of them.
    """
    ranged = written(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    counts = ranged.groupBy(*keys, "_part").count()
    moved = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(moved), F.lit(0)).alias("_start"))
    numbered = ranged.withColumn("_n", within)
    on = [numbered[k].eqNullSafe(starts[f"_k_{k}"]) for k in keys] + [numbered["_part"] == starts["_p"]]
    joined = numbered.join(starts, on)
    return joined.select(*[numbered[c] for c in df.columns], (F.col("_start") + F.col("_n") - 1).cast("long").alias(name))


def positions(df: DataFrame, keys: list[str], order: str, name: str, block: int = BLOCK) -> DataFrame:
    """A gapless number from 0 within ``keys``, by ``order``, an integer that each row has for itself; nothing is written."""
    df = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    counts = df.groupBy(*keys, "_block").count()
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order)))
    on = numbered["_block"] == starts["_b"]
    for k in keys:
        on = on & numbered[k].eqNullSafe(starts[f"_k_{k}"])
    return numbered.join(starts, on).select(*[numbered[c] for c in df.columns if c != "_block"], (F.col("_start") + F.col("_n") - 1).cast("long").alias(name))


def affected(first: Column, last: Column) -> Column:
    """``"i"`` or ``"first-last"``."""
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], name: str = "p", accuracy: int = ACCURACY, most_rows: int | None = None) -> DataFrame:
    """(keys, name): exact percentiles with linear interpolation at (n - 1) * share, as an array, of groups of any size.

    A sketch of bounded size gives values on either side of each rank. Only values between them are kept, all others are counted;
    so what is sorted is a few ``accuracy``-ths of a group, and no buffer holds its values. The sketch is written, a row a group: it depends on
    the order in which parts of it arrive, and all that is counted must see the same cuts. ``most_rows`` is a caller's bound on a group's
    rows, from a count that it has; up to IN_MEMORY, one pass that holds a group's values does it.
    """
    df = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    if most_rows is not None and most_rows <= IN_MEMORY:
        return df.groupBy(*keys).agg(F.percentile("_x", F.array(*map(F.lit, shares))).alias(name))
    # A sketch's rank is off by n / accuracy at most; groups of up to ``accuracy`` values are kept whole.
    near = [min(1.0, max(0.0, s + d / accuracy)) for s in shares for d in (-4, 4)]
    sketch = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.percentile_approx("_x", near, accuracy).alias("_c"))
    cut = lambda k: F.when(F.col("_n") > accuracy, F.get("_c", F.lit(k))).otherwise(F.col("_lo") if k % 2 == 0 else F.col("_hi"))
    sketch = written(sketch.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_n", *[cut(k).alias(f"_c{k}") for k in range(len(near))]), "sketch")
    same = [df[k].eqNullSafe(sketch[f"_k_{k}"]) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    x = F.col("_x")
    part, kept = F.lit(0), F.lit(False)
    for k in range(len(near)):
        part = part + (x > F.col(f"_c{k}")).cast("int")
    for k in range(0, len(near), 2):
        kept = kept | x.between(F.col(f"_c{k}"), F.col(f"_c{k + 1}"))
    # Parts are in the order of values; within one, those that are only counted come before those that are kept.
    counts = df.join(sketch, on).groupBy(*keys, part.alias("_part"), F.when(kept, x).alias("_x")).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    whole = counts.groupBy(*keys, "_part").agg(F.sum("_c").alias("_in"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start"))
    placed = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy(F.col("_x").asc_nulls_first())))
    on = placed["_part"] == starts["_p"]
    for k in keys:
        on = on & placed[k].eqNullSafe(starts[f"_k_{k}"])
    last = F.col("_start") + F.col("_upto")
    ranks = F.array(*[F.struct(F.lit(k).alias("share"), at.cast("long").alias("r")) for k, s in enumerate(shares) for at in (F.floor(F.lit(s) * (F.col("_n") - 1)), F.ceil(F.lit(s) * (F.col("_n") - 1)))])
    hit = placed.join(starts, on).filter(F.col("_x").isNotNull()).select(*keys, "_n", "_x", F.explode(F.filter(ranks, lambda r: (r["r"] >= last - F.col("_c")) & (r["r"] < last))).alias("_r"))
    one = hit.groupBy(*keys, F.col("_r.share").alias("_s")).agg(F.min("_x").alias("_a"), F.max("_x").alias("_z"), F.first("_n").alias("_n"))
    rank = F.get(F.array(*map(F.lit, shares)), F.col("_s")) * (F.col("_n") - 1)
    between = rank - F.floor(rank)
    one = one.withColumn("_v", F.when(between == 0, F.col("_a")).otherwise(F.col("_a") * (1 - between) + F.col("_z") * between))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_v"))), lambda s: s["_v"]).alias(name))


def samples(df: DataFrame, keys: list[str], order: str, value: str, most: int, name: str = "samples") -> DataFrame:
    """Evenly spaced values in order, at most ``most`` a series: offsets round(i * (n - 1) / (most - 1)), half to even."""
    ranked = positions(df.filter(F.col(value).isNotNull()).select(*keys, order, value), keys, order, "_pos")
    sized = ranked.groupBy(*keys).agg(F.count("*").alias("_n"))
    steps = F.when(F.col("_n") <= most, F.sequence(F.lit(0), F.col("_n").cast("int") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.rint(i * (F.col("_n") - 1) / F.lit(max(1, most - 1))).cast("int")))
    wanted = sized.select(*keys, F.explode(F.array_distinct(steps)).alias("_pos")).withColumn("_pos", F.col("_pos").cast("long"))
    picked = ranked.join(wanted, [*keys, "_pos"])
    return picked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", value))), lambda s: s[value]).alias(name))


def runs(df: DataFrame, keys: list[str], order: str, value: str, block: int = BLOCK) -> DataFrame:
    """Runs of two or more equal values at consecutive ``order`` numbers: (keys, start, end, length)."""
    return runs_of(previous(df.select(*keys, order, value), keys, order, [value], "_p", block), keys, order, value, "_p", block)


def runs_of(near: DataFrame, keys: list[str], order: str, value: str, before: str, block: int = BLOCK) -> DataFrame:
    """As ``runs``, of rows that have the row before as the struct ``before``.

    Only rows that repeat the one before go on, and of these only the ends of what is consecutive are paired: no running sum over a series is needed.
    """
    repeats = near.filter((F.col(f"{before}.{order}") == F.col(order) - 1) & (F.col(f"{before}.{value}") == F.col(value))).select(*keys, order)
    both = following(previous(repeats, keys, order, [], "_p", block), keys, order, [], "_n", block)
    starts = ~F.coalesce(F.col(f"_p.{order}") == F.col(order) - 1, F.lit(False))
    stops = ~F.coalesce(F.col(f"_n.{order}") == F.col(order) + 1, F.lit(False))
    ends = both.select(*keys, order, starts.alias("_starts"), stops.alias("_stops")).filter("_starts or _stops")
    paired = previous(ends, keys, order, [], "_s", block).filter("_stops")
    start = F.when(F.col("_starts"), F.col(order)).otherwise(F.col(f"_s.{order}")) - 1
    return paired.select(*keys, start.alias("start"), F.col(order).alias("end"), (F.col(order) - start + 1).alias("length"))
