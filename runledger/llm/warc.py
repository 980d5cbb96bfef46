"""WARC archives and a two-level capture index over them.

Tasks write archives of gzip members, one a record, and return a capture row for each. Captures are sorted by
reversed-host URL key into shards; a shard file holds compressed blocks of index lines, and its directory keeps the
first key, offset and length of every block. A look-up goes from the shards' first keys to one directory, by
binary search to one block, and from its lines to range reads of the records.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.scratch import Scratch, col

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 1000
BLOCK_LINES = 1000
SHARD_LINES = 200_000
ARCHIVE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
REFERS, NULL = "urn:capture:", "null:"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder that driver and executors share (file, hdfs, s3, gs)."""
    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return pafs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Reversed-host sort key: ``org,example,www)/path?query``; scheme, user, port and fragment go, case is folded."""
    rest = (url or "").strip().lower()
    rest = rest.partition("://")[2] or rest
    rest = rest.partition("#")[0]
    cut = min((k for k in (rest.find("/"), rest.find("?")) if k >= 0), default=len(rest))
    host, path = rest[:cut], rest[cut:] or "/"
    host = host.rpartition("@")[2].partition(":")[0]
    key = f"{','.join(reversed(host.split('.')))}){path if path[0] == '/' else '/' + path}"
    return quote(key, safe="!$&'()*+,;=:@/?-._~%")


def _line(x) -> str:
    """A header value: one line, without control characters."""
    return quote(str(x), safe="!#$&'()*+,;=:@/?-._~%[]")


def record(kind: str, capture, named: bool, url: str | None, payload: bytes, digest: bytes, refers=None) -> bytes:
    """One WARC 1.1 record; one without a name has a number that stands for its null key. A revisit holds the HTTP head alone, with the length of the payload it leaves out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{REFERS}{'' if named else NULL}{capture}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{REFERS}{refers}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers (lower-case names), its HTTP head's length and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"headers": headers, "payload_bytes": length, "payload": payload}


def _write(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows: list[tuple] = []
            for capture, named, url, page, refers in zip(*(batch.column(n).to_pylist() for n in ("capture", "named", "url", "payload", "refers")), strict=True):
                if out is None or at >= most:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                payload = (page or "").encode()
                kind = "response" if refers is None else "revisit"
                raw = gzip.compress(record(kind, capture, named, url, payload, hashlib.sha1(payload).digest(), refers), 5, mtime=0)
                out.write(raw)
                rows.append((url_key(url), capture, named, name, at, len(raw)))
                at += len(raw)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=LINE)
        if out is not None:
            out.close()

    return run


def _index(folder: str, block_lines: int):
    """The index file of one shard's sorted captures and its directory file; returns the shard's first key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        out, name, at, held, blocks = None, f"{uuid.uuid4().hex}.cdx", 0, [], []

        def flush():
            nonlocal at, held
            # A key's captures are never parted: look-ups read one block.
            raw = zlib.compress("\n".join(json.dumps(x, separators=(",", ":")) for x in held).encode(), 6)
            out.write(raw)
            blocks.append([*held[0][:3], at, len(raw)])
            at, held = at + len(raw), []

        for batch in batches:
            for line in zip(*(batch.column(n).to_pylist() for n in LINE), strict=True):
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                if len(held) >= block_lines and held[-1][:3] != line[:3]:
                    flush()
                held.append(line)
        if out is not None:
            flush()
            out.close()
            with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as f:
                f.write(zlib.compress(json.dumps(blocks).encode(), 6))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([blocks[0][0]]), pa.array([blocks[0][1]], pa.int64()), pa.array([blocks[0][2]]), pa.array([len(blocks)], pa.int64())], names=["shard", *KEY, "blocks"])

    return run


class Reader:
    """Range reads of one folder's files; the last directory and the last block of an index stay read."""

    def __init__(self, folder: str):
        self.fs, self.root = open_folder(folder)
        self.files: dict = {}
        self.block: tuple = (None, [])
        self.shard: tuple = (None, [], [])

    def read(self, name: str, offset: int, length: int) -> bytes:
        if (f := self.files.get(name)) is None:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            f = self.files[name] = self.fs.open_input_file(f"{self.root}/{name}")
        return f.read_at(length, offset)

    def directory(self, shard: str) -> tuple[list[tuple], list[tuple]]:
        """The blocks' first keys, and their (offset, length)."""
        if self.shard[0] != shard:
            with self.fs.open_input_stream(f"{self.root}/{shard}.dir", compression=None) as f:
                blocks = json.loads(zlib.decompress(f.read()))
            self.shard = shard, [tuple(b[:3]) for b in blocks], [(b[3], b[4]) for b in blocks]
        return self.shard[1:]

    def lines(self, shard: str, offset: int, length: int) -> list[list]:
        if self.block[0] != (shard, offset):
            self.block = (shard, offset), [json.loads(x) for x in zlib.decompress(self.read(shard, offset, length)).decode().split("\n")]
        return self.block[1]


def _fetch(folder: str, tops: list[tuple], per_batch: int = 200):
    """Records of rows sorted by KEY. ``tops``: (first key, shard) in order."""
    firsts = [t[0] for t in tops]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, rows = Reader(folder), None, []

        def table():
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FOUND, strict=True)], names=[n for n, _ in FOUND])

        for batch in batches:
            for wanted in zip(*(batch.column(n).to_pylist() for n in KEY), strict=True):
                if wanted == last:
                    continue
                last = wanted
                shard = tops[max(0, bisect.bisect_right(firsts, wanted) - 1)][1]
                starts, where = reader.directory(shard)
                lines = reader.lines(shard, *where[max(0, bisect.bisect_right(starts, wanted) - 1)])
                at = bisect.bisect_left(lines, list(wanted))
                while at < len(lines) and tuple(lines[at][:3]) == wanted:
                    key, capture, named, file, offset, length = lines[at]
                    found = parse(gzip.decompress(reader.read(file, offset, length)))
                    h = found["headers"]
                    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    refers = h.get("warc-refers-to")
                    rows.append((capture if named else None, key, found["payload_bytes"], digest, h["warc-type"], int(refers[1:-1].removeprefix(REFERS)) if refers else None, found["payload"].decode()))
                    at += 1
                if len(rows) >= per_batch:
                    yield table()
                    rows.clear()
        if rows:
            yield table()

    return run


#: What tells captures apart, in the order of the index, and the whole of an index line.
KEY = ["urlkey", "capture", "named"]
LINE = [*KEY, "file", "offset", "length"]
#: A record found; capture is null for one without a name.
FOUND = [("capture", pa.int64()), ("urlkey", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())]
FOUND_SCHEMA = "capture long, urlkey string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, key: str = "page_id", url: str = "url", page: str = "html", least_revisit: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every row as a record and returns the captures (urlkey, capture, named, file, offset, length).

    Of payloads (UTF-8, null: empty) that are equal and of ``least_revisit`` bytes or more, the record of the largest
    key is a response and the others revisit it. A null key is smaller than all others and revisits none of its kind: its
    capture is a hash of URL and payload, not named. Rows of one key are each archived. A null URL has the key of an empty one. A task that runs again writes new files; only files
    named by returned rows count.
    """
    pafs_root = open_folder(folder)
    pafs_root[0].create_dir(pafs_root[1], recursive=True)
    number = col(key).cast("long")
    rows = pages.select(F.coalesce(number, F.xxhash64(col(url), col(page))).alias("capture"), number.isNotNull().alias("named"), col(url).alias("url"), col(page).alias("payload"))
    digests = rows.select("capture", "named", F.sha1("payload").alias("d"), F.octet_length("payload").alias("n")).filter(F.col("n") >= least_revisit)
    digests = scratch.write(digests, "digests")
    last = scratch.write(digests.groupBy("d").agg(F.max(F.when(F.col("named"), F.col("capture"))).alias("refers"), F.count("*").alias("c")).filter("refers is not null and c > 1").select("d", "refers"), "last")
    revisits = scratch.write(digests.join(last, "d").filter("not named or capture < refers").select("capture", F.col("named").alias("_n"), "refers", "d").distinct(), "revisits")
    joined = rows.withColumn("_d", F.sha1("payload")).join(revisits.withColumnRenamed("capture", "_c"), (F.col("capture") == F.col("_c")) & (F.col("named") == F.col("_n")) & (F.col("_d") == F.col("d")), "left")
    wrote = joined.select("capture", "named", "url", "payload", "refers").mapInArrow(_write(folder, archive_bytes), "urlkey string, capture long, named boolean, file string, offset long, length long")
    return scratch.write(wrote, "captures")


def build_index(captures: DataFrame, folder: str, scratch: Scratch, shard_lines: int = SHARD_LINES, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the index and returns a row for each shard: shard (its file), its first KEY, blocks.

    A shard is sorted by KEY and has about ``shard_lines`` lines, fewer where that gives the tasks
    of a small table something to share.
    """
    n = captures.count()
    shards = max(1, -(-n // shard_lines), min(48, n // block_lines))
    ranged = captures.repartitionByRange(shards, *KEY).sortWithinPartitions(*KEY, "file", "offset")
    made = ranged.mapInArrow(_index(folder, block_lines), "shard string, urlkey string, capture long, named boolean, blocks long")
    return scratch.write(made, "shards")


def read_captures(wanted: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """Records (``FOUND_SCHEMA``) of the wanted KEYs, each found through the index and read by its range.

    The shards' first keys come to the driver, a row for about ``SHARD_LINES`` captures. Keys that the index does
    not have give no rows; one wanted twice is read once.
    """
    tops = sorted((tuple(r[:3]), r.shard) for r in shards.select(*KEY, "shard").collect())
    if not tops:
        return wanted.sparkSession.createDataFrame([], FOUND_SCHEMA)
    keys = wanted.select(*KEY)
    n = max(len(tops), int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return keys.repartitionByRange(n, *KEY).sortWithinPartitions(*KEY).mapInArrow(_fetch(folder, tops), FOUND_SCHEMA)


def op7_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.dir}/archives"
    captures = write_archives(pages, folder, scratch)
    found = read_captures(captures, build_index(captures, folder, scratch), folder)
    return found.select(F.col("capture").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, strlen(payload) as payload_bytes, sha1(payload) as payload_digest from p),
last as (select payload_digest, max(page_id) as top from d where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, d.payload_digest, case when page_id < top then 'revisit' else 'response' end as record_type,
  case when page_id < top then top end as refers_to
from d left join last on d.payload_digest = last.payload_digest"""
