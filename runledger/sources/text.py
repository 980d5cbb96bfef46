"""Text sources as DataFrames: records, rejects and cells, with an order that does not depend on partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators.ordered import positions, with_index
from runledger.sources.parsers import LINE_FORMATS, MAX_FIELDS, canonical, cell, detect_format, epoch, parse_line, parse_lines

CELL = "struct<field:string,kind:string,text:string,num:double,t:double>"
PARSED = f"session_id string, file string, block long, row long, item long, payload string, original string, schema_key array<string>, field_count int, cells array<{CELL}>, error string"
MAX_LINE_BYTES = 1 << 20
SAMPLE_BYTES, SAMPLE_LINES = 262_144, 20
_CELLS = pa.list_(pa.struct([("field", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("num", pa.float64()), ("t", pa.float64())]))


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), _CELLS, pa.string()]
    names = ["session_id", "file", "block", "row", "item", "payload", "original", "schema_key", "field_count", "cells", "error"]
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def _row(place: tuple, parsed) -> tuple:
    import json

    r = parsed.record
    if r is None:
        return (*place, None, None, None, None, None, parsed.error)
    cells = []
    for name in sorted(r):
        kind, text, num = cell(r[name])
        cells.append({"field": name, "kind": kind, "text": text, "num": num, "t": epoch(r[name])})
    return (*place, canonical(r), json.dumps(r, ensure_ascii=False), sorted(r), len(r), cells, None)


def _parse(kind: str, max_fields: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, file, block, row, session in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                if kind in LINE_FORMATS:
                    rows.append(_row((session, file, block, row, 0), parse_line(text, kind, max_fields)))
                    continue
                for n, parsed in enumerate(parse_lines(text.splitlines(keepends=True), kind, max_fields)):
                    rows.append(_row((session, file, block, row, n), parsed))
                    if len(rows) >= 2000:
                        yield _emit(rows)
                        rows = []
            yield _emit(rows)

    return run


def detect(spark: SparkSession, path: str) -> str:
    """The format by the first lines of the source's first file."""
    first = spark.read.text(path).select("value", "_metadata.file_path").limit(SAMPLE_LINES).collect()
    name = first[0].file_path if first else None
    return detect_format("\n".join(r.value for r in first if r.file_path == name)[:SAMPLE_BYTES], name)


def parse_source(spark: SparkSession, path: str, kind: str | None = None, session_id: str = "session", max_fields: int = MAX_FIELDS, max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """Results of all logical records of the files at ``path``, valid or not, with their ordinal (from 1) by file name and place.

    Line formats are read in splits. CSV, TSV and JSON arrays need a file's start, so each file is one task's
    work. A line of more than ``max_line_bytes`` bytes fails the read.
    """
    kind = kind or detect(spark, path)
    whole = kind not in LINE_FORMATS
    # Splits of one file are told apart by where they start; within one, rows come in order.
    lines = spark.read.text(path, wholetext=whole).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    longest = F.octet_length("value") if not whole else F.array_max(F.transform(F.split("value", "\n"), F.octet_length))
    lines = lines.withColumn("value", F.when(longest > max_line_bytes, F.raise_error(F.lit(f"a line is longer than {max_line_bytes} bytes"))).otherwise(F.col("value")))
    if not whole:
        first = (F.col("block") == 0) & F.col("value").startswith("﻿")
        lines = lines.withColumn("value", F.when(first, F.regexp_replace("value", "^﻿+", "")).otherwise(F.col("value")))
    return parse_table(lines.withColumn("session_id", F.lit(session_id)), kind, max_fields)


def parse_table(lines: DataFrame, kind: str, max_fields: int = MAX_FIELDS) -> DataFrame:
    """As ``parse_source``, of a table of lines (or whole documents): session_id, file, block, row and value."""
    parsed = lines.select("value", "file", "block", "row", "session_id").mapInArrow(_parse(kind, max_fields), PARSED)
    numbered = with_index(parsed, ["session_id"], ["file", "block", "row", "item"], "ordinal")
    return numbered.withColumn("ordinal", F.col("ordinal") + 1)


def records_of(parsed: DataFrame) -> DataFrame:
    """Valid records, with record_index from 0 without a gap."""
    kept = parsed.filter("error is null").select("session_id", "ordinal", "payload", "original", "schema_key", "field_count", "cells")
    return positions(kept, ["session_id"], "ordinal", "record_index")


def rejects_of(parsed: DataFrame) -> DataFrame:
    """(session_id, record, reason): record counts valid and invalid ones."""
    return parsed.filter("error is not null").select("session_id", F.col("ordinal").alias("record"), F.col("error").alias("reason"))


def cells_from(records: DataFrame) -> DataFrame:
    """(session_id, record_index, field, kind, text, num, t)."""
    return records.select("session_id", "record_index", F.explode("cells").alias("c")).select("session_id", "record_index", "c.*")
