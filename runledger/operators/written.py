"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made in this process, with what deletes them; they go when it ends.
_made: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session has none, a local master gets a temporary folder, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='runledger-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        gone_at_exit(spark, found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Marks a folder to be deleted when this process ends, as tables are read until then."""
    _made.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path))


@atexit.register
def _delete_made() -> None:
    for jvm, conf, path in _made:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the JVM may have ended first
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table: what is read twice is the same both times, whatever is lost or computed anew."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    gone_at_exit(df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
