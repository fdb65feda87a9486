"""Vector chunks as a PySpark data source: a folder of pairs <name>.f32 (vectors end to end) and <name>.json ({"hashes": [...]}).

A partition reads one chunk. The JSON makes a chunk visible, so it is written last; a chunk whose bytes don't fit its
hashes is an error. Option `mode`: `vectors` (chunk, at, hash, vec), or `hashes` (chunk, at, hash), which opens no vector file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lumenlog.sources.loglines import filesystem

DIM = 1024
SCHEMAS = {"vectors": "chunk string, at int, hash string, vec array<float>", "hashes": "chunk string, at int, hash string"}


def _json(name: str) -> bool:
    return name.endswith(".json") and ".tmp" not in name


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode, self.dim = options["path"].rstrip("/"), options.get("mode", "vectors"), int(options.get("dim", DIM))

    def partitions(self) -> list[InputPartition]:
        fs, inner = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
        return [InputPartition(i.base_name[:-5]) for i in sorted(found, key=lambda i: i.base_name) if i.type == pafs.FileType.File and _json(i.base_name)]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no chunks
            return
        fs, inner = filesystem(self.path)
        name = partition.value
        with fs.open_input_file(f"{inner}/{name}.json") as f:
            hashes = json.loads(f.read())["hashes"]
        columns = [pa.array([name] * len(hashes), pa.string()), pa.array(range(len(hashes)), pa.int32()), pa.array(hashes, pa.string())]
        if self.mode == "hashes":
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "at", "hash"])
            return
        with fs.open_input_file(f"{inner}/{name}.f32") as f:
            if f.size() != len(hashes) * self.dim * 4:
                raise ValueError(f"chunk {name}: {f.size()} bytes for {len(hashes)} vectors of {self.dim}")
            vectors = np.frombuffer(f.read(), "<f4")
        offsets = pa.array(np.arange(len(hashes) + 1, dtype=np.int32) * self.dim)
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(vectors, pa.float32()))], ["chunk", "at", "hash", "vec"])


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class ChunkWriter(DataSourceWriter):
    """A chunk for each task; its JSON is put in place when all tasks are done, so that a failed job shows nothing."""

    def __init__(self, options: dict):
        self.path, self.dim = options["path"].rstrip("/"), int(options.get("dim", DIM))

    def write(self, rows: Iterator) -> Written:
        fs, inner = filesystem(self.path)
        hashes, vectors = [], []
        for r in rows:
            if len(r["vec"]) != self.dim:
                raise ValueError(f"a vector of {len(r['vec'])} where {self.dim} are due")
            hashes.append(r["hash"])
            vectors.append(np.asarray(r["vec"], "<f4"))
        if not hashes:
            return Written(None)
        name = uuid.uuid4().hex
        fs.create_dir(inner, recursive=True)
        with fs.open_output_stream(f"{inner}/{name}.f32") as f:
            f.write(np.concatenate(vectors).tobytes())
        with fs.open_output_stream(f"{inner}/{name}.json.tmp") as f:
            f.write(json.dumps({"hashes": hashes}).encode())
        return Written(name)

    def commit(self, messages: list) -> None:
        fs, inner = filesystem(self.path)
        for name in filter(None, (m.name for m in messages if m)):
            fs.move(f"{inner}/{name}.json.tmp", f"{inner}/{name}.json")

    def abort(self, messages: list) -> None:
        fs, inner = filesystem(self.path)
        for name in filter(None, (m.name for m in messages if m)):
            for end in ("f32", "json.tmp"):
                fs.delete_file(f"{inner}/{name}.{end}")


class VectorChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectorchunks"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("mode", "vectors")]

    def reader(self, schema: object) -> ChunkReader:
        return ChunkReader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(dict(self.options))


def vectors(spark: SparkSession, path: str, dim: int = DIM) -> DataFrame:
    """(hash, vec), one for each hash: that of the first chunk by name, then the first in it."""
    spark.dataSource.register(VectorChunks)
    rows = spark.read.format("vectorchunks").option("dim", dim).load(path)
    return rows.groupBy("hash").agg(F.min_by("vec", F.struct("chunk", "at")).alias("vec"))


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """The distinct hashes that have a vector; no vector is read."""
    spark.dataSource.register(VectorChunks)
    return spark.read.format("vectorchunks").option("mode", "hashes").load(path).select("hash").distinct()


def append(rows: DataFrame, path: str, dim: int = DIM) -> None:
    """Write rows (hash, vec) as new chunks, one for each partition."""
    rows.sparkSession.dataSource.register(VectorChunks)
    rows.select(F.lit("").alias("chunk"), F.lit(0).alias("at"), "hash", "vec").write.format("vectorchunks").option("dim", dim).mode("append").save(path)
