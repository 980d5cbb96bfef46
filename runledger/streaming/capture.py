"""Live capture: a stream of text lines, parsed and landed batch by batch, analysed after the end.

Late and repeated lines are kept: order and duplicates are what the findings are about. A batch that runs again after
a failure replaces its own rows, so a restart neither loses nor doubles lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators.written import shared_dir
from runledger.sources.parsers import LINE_FORMATS, MAX_FIELDS
from runledger.sources.text import PARSED, _parse, records_of


def start(spark: SparkSession, path: str, kind: str, session_id: str, folder: str, max_fields: int = MAX_FIELDS, files_per_batch: int = 100, once: bool = True):
    """Starts the query that lands raw lines and parse results of new files under ``path`` in ``folder``."""
    if kind not in LINE_FORMATS:
        raise ValueError(f"only line formats can be captured live: {', '.join(LINE_FORMATS)}")
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def land(batch: DataFrame, batch_id: int) -> None:
        placed = batch.withColumn("row", F.monotonically_increasing_id()).withColumn("session_id", F.lit(session_id))
        # Raw lines are landed before anything is parsed, so that what parsing cannot take is kept as well.
        placed.write.mode("overwrite").parquet(f"{folder}/raw/batch={batch_id}")
        landed = batch.sparkSession.read.parquet(f"{folder}/raw/batch={batch_id}").select("value", "file", "block", "row", "session_id")
        landed.mapInArrow(_parse(kind, max_fields), PARSED).write.mode("overwrite").parquet(f"{folder}/parsed/batch={batch_id}")

    writer = lines.writeStream.foreachBatch(land).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """All parse results so far, numbered from 1 in the order of batches, files and lines; complete once the query has stopped."""
    from runledger.operators.ordered import with_index

    try:
        parsed = spark.read.parquet(f"{folder}/parsed")
    except Exception as why:
        if "UNABLE_TO_INFER_SCHEMA" not in str(why) and "PATH_NOT_FOUND" not in str(why):
            raise
        parsed = spark.createDataFrame([], f"{PARSED}, batch int")
    return with_index(parsed, ["session_id"], ["batch", "file", "block", "row", "item"], "ordinal").withColumn("ordinal", F.col("ordinal") + 1)


def capture(spark: SparkSession, path: str, kind: str, session_id: str, folder: str | None = None) -> DataFrame:
    """Captures what is there, waits for the end, and returns the records."""
    folder = folder or f"{shared_dir(spark)}/capture-{uuid.uuid4().hex}"
    query = start(spark, path, kind, session_id, folder)
    query.awaitTermination()
    return records_of(landed(spark, folder))


