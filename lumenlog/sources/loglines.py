"""Line files as a PySpark data source by byte offsets, in batch and as a stream.

    spark.dataSource.register(LogLines)
    spark.read.format("loglines").option("roots", "/logs").load()
    spark.readStream.format("loglines").option("roots", "/logs").load()

A line is what a newline ends; the rest of a file waits for its newline. Batch: a file is read in splits of
`splitBytes`, and a split has the lines that begin in it. A zstd file (by its extension) can't be cut and is one
split, with offsets of what it holds. Option `mode`:

- `lines`: all lines, or those from byte offsets on (`resume`, JSON of file -> offset);
- `count`: (file, split, lines) only, for line numbers;
- `head`: each file's first line, finished or not; an error beyond `maxHead` bytes;
- `tail`: the lines of each file's last `bytes` bytes, without the first one where the cut hits it, with an
  unfinished last one.

Stream: the offset has each file's end of its last whole line and a check of its first bytes. A file that shrank or
whose first bytes changed is read again from its start with `replayed` set, and so is one that was away and came back
different. The check covers up to `HEAD` bytes, so a rewrite that keeps them and the length goes unseen.
"""

from __future__ import annotations

import fnmatch
import io
import json
import zlib
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

HEAD, BLOCK = 1024, 1 << 20
MODES = {
    "lines": "file string, split int, nth int, offset long, end long, value string",
    "count": "file string, split int, lines long",
    "head": "file string, value string",
    "tail": "file string, offset long, value string",
}
STREAM_SCHEMA = "file string, offset long, end long, replayed boolean, value string"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def found(roots: str, pattern: str) -> list[tuple[str, int]]:
    """(file, bytes) of the files below comma-separated roots whose name fits the pattern, in order of their names."""
    out = []
    for root in filter(None, (r.strip() for r in roots.split(","))):
        fs, inner = filesystem(root)
        prefix = root[: len(root) - len(inner)] if root.endswith(inner) else ""
        info = fs.get_file_info(inner)
        infos = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inner, recursive=True, allow_not_found=True))
        out += [(prefix + i.path, i.size) for i in infos if i.type == pafs.FileType.File and fnmatch.fnmatch(i.base_name, pattern)]
    return sorted(set(out))


def opened(file: str) -> io.RawIOBase:
    fs, inner = filesystem(file)
    return fs.open_input_stream(inner, compression="zstd") if is_zstd(file) else fs.open_input_file(inner)


def is_zstd(file: str) -> bool:
    return file.endswith((".zst", ".zstd"))


def whole_lines(file: str, start: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the whole lines that begin in start:stop; where start isn't 0, what comes before the first newline at or after start - 1 belongs to another reader."""
    with opened(file) as f:
        at = start
        if is_zstd(file):
            left = start
            while left:
                got = f.read(min(left, BLOCK))
                if not got:
                    return
                left -= len(got)
        elif start:
            f.seek(start - 1)
            at = start - 1
        skip, rest, searched = at < start, b"", 0
        while stop is None or at < stop:
            block = f.read(BLOCK)
            if not block:
                return
            rest += block
            lo = 0
            while stop is None or at < stop or skip:
                nl = rest.find(b"\n", max(lo, searched))
                if nl < 0:
                    break
                if skip:
                    skip = False
                else:
                    yield at, rest[lo:nl]
                at += nl + 1 - lo
                lo = nl + 1
            rest = rest[lo:]
            searched = len(rest)


class Split(InputPartition):
    def __init__(self, file: str, split: int, start: int, stop: int | None, replayed: bool = False):
        self.file, self.split, self.start, self.stop, self.replayed = file, split, start, stop, replayed


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots, self.pattern = options["roots"], options.get("pattern", "*.jsonl*")
        self.mode, self.step = options.get("mode", "lines"), int(options.get("splitbytes", 64 << 20))
        self.resume = json.loads(options.get("resume", "{}"))
        self.bytes, self.most = int(options.get("bytes", 64 << 10)), int(options.get("maxhead", 4 << 20))

    def partitions(self) -> list[Split]:
        out = []
        for file, size in found(self.roots, self.pattern):
            if self.mode in ("head", "tail"):
                out.append(Split(file, 0, 0, size))
                continue
            start = self.resume.get(file, 0)
            if is_zstd(file):
                out.append(Split(file, 0, start, None))
                continue
            out += [Split(file, i, at, min(at + self.step, size)) for i, at in enumerate(range(start, size, self.step))]
        return out

    def read(self, p: Split | None) -> Iterator[tuple]:
        if p is None:  # there are no files
            return
        if self.mode == "head":
            yield from self._head(p.file)
        elif self.mode == "tail":
            yield from self._tail(p.file, p.stop)
        elif self.mode == "count":
            yield p.file, p.split, sum(1 for _ in whole_lines(p.file, p.start, p.stop))
        else:
            for i, (at, line) in enumerate(whole_lines(p.file, p.start, p.stop), 1):
                yield p.file, p.split, i, at, at + len(line) + 1, line.decode("utf-8", "replace")

    def _head(self, file: str) -> Iterator[tuple]:
        got = b""
        with opened(file) as f:
            while b"\n" not in got and (block := f.read(64 << 10)):
                got += block
                if b"\n" not in got and len(got) > self.most:
                    raise ValueError(f"{file}: first line exceeds {self.most} bytes")
        if got:
            yield file, got.split(b"\n", 1)[0].decode("utf-8", "replace")

    def _tail(self, file: str, size: int) -> Iterator[tuple]:
        with opened(file) as f:
            if is_zstd(file):
                got, at = b"", 0
                while block := f.read(BLOCK):
                    at += len(block)
                    got = (got + block)[-self.bytes :]
                at -= len(got)
            else:
                at = max(0, size - self.bytes)
                f.seek(at)
                got = f.read(size - at)
        if at:  # the first line is cut, or may be
            cut = got.find(b"\n") + 1
            at, got = (at + cut, got[cut:]) if cut else (at, b"")
        for line in got.split(b"\n") if got else []:
            if line:
                yield file, at, line.decode("utf-8", "replace")
            at += len(line) + 1


class LineStream(DataSourceStreamReader):
    """Offsets: file -> [end of its last whole line, bytes checked, their crc]. One entry for each file there is."""

    def __init__(self, options: dict):
        self.roots, self.pattern = options["roots"], options.get("pattern", "*.jsonl")
        self.step = int(options.get("splitbytes", 64 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {file: [end, min(end, HEAD), self._check(file, min(end, HEAD))] for file, size in found(self.roots, self.pattern) if (end := self._whole(file, size))}

    @staticmethod
    def _check(file: str, n: int) -> int:
        with opened(file) as f:
            return zlib.crc32(f.read(n))

    @staticmethod
    def _whole(file: str, size: int) -> int:
        """Where the file's last whole line ends, read from its end on."""
        with opened(file) as f:
            while size > 0:
                at = max(0, size - 64 * 1024)
                f.seek(at)
                nl = f.read(size - at).rfind(b"\n")
                if nl >= 0:
                    return at + nl + 1
                size = at
        return 0

    def partitions(self, start: dict, end: dict) -> list[Split]:
        out = []
        for file, (stop, _, _) in sorted(end.items()):
            at, replayed = 0, False
            if file in start:
                seen, n, crc = start[file]
                same = stop >= seen and self._check(file, n) == crc
                at, replayed = (seen, False) if same else (0, True)
            out += [Split(file, i, lo, min(lo + self.step, stop), replayed) for i, lo in enumerate(range(at, stop, self.step))]
        return out

    def read(self, p: Split) -> Iterator[tuple]:
        for at, line in whole_lines(p.file, p.start, p.stop):
            if line.strip():
                yield p.file, at, at + len(line) + 1, p.replayed, line.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class LogLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loglines"

    def schema(self) -> str:
        return MODES[self.options.get("mode", "lines")]

    def reader(self, schema: object) -> LineReader:
        return LineReader(dict(self.options))

    def streamReader(self, schema: object) -> LineStream:
        return LineStream(dict(self.options))


def _read(spark: SparkSession, roots: list[str], **options: object) -> DataFrame:
    spark.dataSource.register(LogLines)
    return spark.read.format("loglines").options(roots=",".join(roots), **options).load()


def lines(spark: SparkSession, roots: list[str], resume: dict[str, tuple[int, int]] | None = None, pattern: str = "*.jsonl*", split_bytes: int = 64 << 20) -> DataFrame:
    """(file, line_no, offset, end, value) of whole lines that aren't blank, with the numbers that a plain reader gives.

    resume: file -> (offset, lines) already read. Lines of a split are numbered in it; a read of the newlines alone
    tells what comes before.
    """
    seen = {k: v[0] for k, v in (resume or {}).items()}
    options = {"pattern": pattern, "splitBytes": split_bytes, "resume": json.dumps(seen)}
    counted = _read(spark, roots, mode="count", **options)
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("file", "split", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))
    if resume:
        held = spark.createDataFrame([(k, v[1]) for k, v in resume.items()], "file string, held long")
        base = base.join(held, "file", "left").select("file", "split", (F.col("before") + F.coalesce("held", F.lit(0))).alias("before"))
    rows = _read(spark, roots, mode="lines", **options).join(base, ["file", "split"])
    return rows.where("value <> ''").select("file", (F.col("before") + F.col("nth")).alias("line_no"), "offset", "end", "value")


def first_lines(spark: SparkSession, roots: list[str], pattern: str = "*.jsonl*", most: int = 4 << 20) -> DataFrame:
    """(file, value): each file's first line; only its first blocks are read."""
    return _read(spark, roots, mode="head", pattern=pattern, maxHead=most)


def last_lines(spark: SparkSession, roots: list[str], n_bytes: int, pattern: str = "*.jsonl*") -> DataFrame:
    """(file, offset, value): the lines of each file's last bytes; only those are read, but for zstd."""
    return _read(spark, roots, mode="tail", pattern=pattern, bytes=n_bytes)


def tail(spark: SparkSession, roots: list[str], pattern: str = "*.jsonl") -> DataFrame:
    """The stream of whole lines (file, offset, end, replayed, value), each once; a rewritten file's lines again, marked."""
    spark.dataSource.register(LogLines)
    return spark.readStream.format("loglines").schema(STREAM_SCHEMA).options(roots=",".join(roots), pattern=pattern).load()
