"""Written intermediate tables in the shared folder that the session names in ``spark.checkpoint.dir``, and columns of any name."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from runledger.operators.written import delete, gone_at_exit, shared_dir


#: Spark removes a query's shuffle files when the query has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """A folder of one job's intermediate Parquet tables.

    Writing a table cuts the lineage: a lost executor costs a task that rereads the table, never the
    stages before it. ``drop`` frees the disk of tables that no later step reads; all others go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.dir = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        gone_at_exit(spark, self.dir)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path, was = f"{self.dir}/{name}", self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # what is written is read from its table from now on
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if was is None else self.spark.conf.set(CLEANUP, was)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.dir}/{name}")


def col(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def names(own: list[str]) -> list[str]:
    """Names for a caller's columns inside an operator: by place, so that they clash with none of its own."""
    return [f"_k{n}" for n in range(len(own))]


def aliased(own: list[str]) -> list[Column]:
    return [col(c).alias(n) for c, n in zip(own, names(own), strict=True)]


def restored(own: list[str]) -> list[Column]:
    return [F.col(n).alias(c) for c, n in zip(own, names(own), strict=True)]


def schema_of(df: DataFrame, own: list[str], more: str) -> StructType:
    """The schema of a caller's columns under their inner names, then ``more`` (in DDL)."""
    return StructType([StructField(n, df.schema[c].dataType) for c, n in zip(own, names(own), strict=True)] + list(StructType.fromDDL(more)))
