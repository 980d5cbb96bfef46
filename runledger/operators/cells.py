"""Cells: the long form of records, one row for each field of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers beyond this are kept as text and take no part in numeric results.
EXACT = 1 << 53
SERIES = ["session_id", "field"]


def cells_of(df: DataFrame, fields: dict[str, str], session: str = "session_id", index: str = "record_index") -> DataFrame:
    """Cells (session_id, record_index, field, kind, text, num) of typed columns; ``fields`` maps names to kinds.

    A null is a cell of kind null. Columns stay narrow: only the named ones are read.
    """
    made = []
    for name, kind in fields.items():
        c = F.col(f"`{name}`")
        num = c.cast("double") if kind in ("int", "float") else F.lit(None).cast("double")
        if kind == "int":
            num = F.when(F.abs(c.cast("decimal(38,0)")) <= EXACT, num)
        elif kind == "float":
            num = F.when(~F.isnan(num) & (F.abs(num) != float("inf")), num)
        made.append(F.struct(F.lit(name).alias("field"), F.when(c.isNull(), "null").otherwise(kind).alias("kind"), c.cast("string").alias("text"), num.alias("num")))
    return df.select(F.col(session).alias("session_id"), F.col(index).alias("record_index"), F.explode(F.array(*made)).alias("c")).select("session_id", "record_index", "c.*")


def infer_types(cells: DataFrame) -> DataFrame:
    """(session_id, field, type): null, integer, number, the kind's name, or mixed."""
    kinds = cells.groupBy(*SERIES).agg(F.array_sort(F.collect_set(F.when(F.col("kind") != "null", F.col("kind")))).alias("k"))
    k = F.col("k")
    only = F.when(F.size(k) == 0, "null").when(k == F.array(F.lit("int")), "integer").when(F.size(F.array_except(k, F.array(F.lit("int"), F.lit("float")))) == 0, "number").when(F.size(k) == 1, F.get(k, F.lit(0))).otherwise("mixed")
    return kinds.select(*SERIES, only.alias("type"))


def is_missing() -> Column:
    """The quality rules' missing cell: null or the empty string."""
    return (F.col("kind") == "null") | ((F.col("kind") == "str") & (F.col("text") == ""))
