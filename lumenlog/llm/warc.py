"""Operator 10, WARC: a PySpark Python data source that writes and reads archives of page records.

Writing: a record per row, each a gzip member of its own whose extra field holds the member's size.
Tasks write files under names of their own and the commit moves them in place, so a lost or repeated
task leaves nothing behind. Reading: a partition per file; predicates on header fields are pushed
down; of a record, the headers are inflated first, and where they fail a predicate or no payload is
wanted (option payload=false) the reader steps over the rest by the member's size.

The query sends equal payloads of at least `LEAST` bytes once: the largest page_id is the response,
others are revisits of it. A null html is empty; small and empty payloads are always responses.
Rows with equal page_id and html are each written. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from lumenlog.llm.common import load, new_path

LEAST = 1000
#: Bytes after which a task begins another file, so that reading divides evenly.
FILE_BYTES = 128 << 20
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("html", pa.string())])
_HEAD, _TAG = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff", b"WL"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (pafs.LocalFileSystem(), path)


def member(data: bytes) -> bytes:
    """A gzip member of data that tells its own size."""
    c = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = len(_HEAD) + 2 + 12 + len(body) + 8
    return _HEAD + struct.pack("<H2sHQ", 12, _TAG, 8, size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """The bytes of a WARC/1.1 record."""
    payload = (row["html"] or "").encode() if row["record_type"] == "response" else b""
    block = _HTTP + payload
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{row['page_id']}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {(row['url'] or '').replace(chr(13), '').replace(chr(10), '')}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"WARC-Payload-Length: {row['payload_bytes']}",
    ]
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File(InputPartition):
    def __init__(self, path: str, size: int):
        super().__init__(path)
        self.path, self.size = path, size


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, top = _at(self.path)
        fs.create_dir(f"{top}/_tmp", recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > FILE_BYTES:
                    if out:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{top}/_tmp/{files[-1]}", compression=None), 0
                data = member(record(row))
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, top = _at(self.path)
        fs.create_dir(top, recursive=True)
        for m in messages:
            for f in m.files if m else []:
                fs.move(f"{top}/_tmp/{f}", f"{top}/{f}")
        self._tidy(fs, top)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._tidy(*_at(self.path))

    def _tidy(self, fs: pafs.FileSystem, top: str) -> None:
        if fs.get_file_info(f"{top}/_tmp").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{top}/_tmp")


#: What pushed predicates do with a header's value; null passes none.
_TESTS = {EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x}


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in (None, "html") or type(f) not in (*_TESTS, IsNotNull):
                yield f
            else:
                self.tests.append((name, type(f), getattr(f, "value", None)))

    def partitions(self) -> list[InputPartition]:
        fs, top = _at(self.path)
        found = [x for x in fs.get_file_info(pafs.FileSelector(top)) if x.path.endswith((".warc", ".warc.gz"))]
        return [_File(x.path, x.size) for x in sorted(found, key=lambda x: -x.size)]

    def _passes(self, row: dict) -> bool:
        return all(row[n] is not None and (k is IsNotNull or _TESTS[k](row[n], v)) for n, k, v in self.tests)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _File):
            return  # a folder without archives has no partition of ours
        fs, _ = _at(self.path)
        rows, held = [], 0
        with fs.open_input_file(partition.path) as f:
            for row in _records(f, partition.size, self._passes, self.payload):
                rows.append(row)
                held += len(row["html"] or "")
                if held > 4 << 20 or len(rows) == 4096:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _records(f: pa.NativeFile, size: int, passes, payload: bool) -> Iterator[dict]:
    """Rows of one archive whose headers pass; a broken record is an error."""
    at = 0
    while at < size:
        f.seek(at)
        first = f.read(8192)
        if first[:4] != _HEAD[:4] or first[12:14] != _TAG:
            raise ValueError(f"no record of ours begins at byte {at}")
        total = struct.unpack_from("<Q", first, 16)[0]
        z = zlib.decompressobj(-15)
        text, rest = b"", first[24:]
        while b"\r\n\r\n" not in text:
            more = z.decompress(z.unconsumed_tail or rest, 2048)
            if not more and z.eof:
                raise ValueError(f"the record at byte {at} has no end of headers")
            if not more and not z.unconsumed_tail:
                rest = f.read(8192)
                if not rest:
                    raise ValueError(f"the record at byte {at} is cut")
            text += more
        head, _, _ = text.partition(b"\r\n\r\n")
        h = _fields(head)
        refers = h.get("warc-refers-to")
        row = {
            "page_id": _page(h["warc-record-id"]), "url": h["warc-target-uri"], "record_type": h["warc-type"], "refers_to": _page(refers) if refers else None,
            "payload_bytes": int(h["warc-payload-length"]), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "html": None,
        }
        if passes(row):
            if payload and row["record_type"] == "response":
                f.seek(at)
                block = gzip.decompress(f.read(total))[len(head) + 4 :][: int(h["content-length"])]
                body = block.partition(b"\r\n\r\n")[2]
                if len(body) != row["payload_bytes"] or hashlib.sha1(body).hexdigest() != row["payload_digest"]:
                    raise ValueError(f"the payload of page {row['page_id']} doesn't have its digest")
                row["html"] = body.decode()
            yield row
        at += total


def _page(urn: str) -> int | None:
    x = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if x == "None" else int(x)


class WarcDataSource(DataSource):
    """format("lumenlog_warc"): option path, and for reading payload (true)."""

    @classmethod
    def name(cls) -> str:
        return "lumenlog_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages with record_type, refers_to, payload_bytes and payload_digest; html is null where a revisit needs none."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", "html", F.length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"))
    large = F.col("payload_bytes") >= least
    again = p.where(large).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = p.join(again, ["payload_digest", "payload_bytes"], "left")
    revisit = F.coalesce(F.col("kept") != F.col("page_id"), F.lit(False))
    return joined.select(
        "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("kept")).alias("refers_to"),
        "payload_bytes", "payload_digest", F.when(~revisit, F.col("html")).alias("html"),
    )


def write_warc(pages: DataFrame, path: str, least: int = LEAST) -> None:
    register(pages.sparkSession)
    records(pages, least).write.format("lumenlog_warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("lumenlog_warc").option("payload", str(payload).lower()).load(path)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(load(spark, sf_dir, "pages"), path)
    got = read_warc(spark, path)
    length = F.when(F.col("html").isNotNull(), F.length(F.encode("html", "UTF-8")).cast("long")).otherwise(F.col("payload_bytes"))
    return got.select("page_id", length.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


SQL = {
    "op10_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to
FROM g
"""
}
