"""A live view: lines of growing files as a keyed table that every batch brings up to date.

Lines are keyed by file and offset. A batch of the line stream is put in with one commit that also names it, so a batch
that comes again after a crash changes nothing. Lines of a file that was rewritten take the place of all it had before.
A snapshot is a query over the table at one manifest, whatever the stream does meanwhile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenlog.sources.commits import KeyedTable
from lumenlog.sources.staging import staged

KEYS, SCHEMA = ["file", "offset"], "file string, offset long, batch long, value string"


class LiveView:
    def __init__(self, table: KeyedTable, listen: Callable[[str, DataFrame], None] | None = None):
        """listen(event, rows): "reset" with the files read again, then "line" with the new lines that are no history."""
        self.table, self.listen = table, listen

    def put(self, batch: DataFrame, number: int) -> None:
        if int(self.table.snapshot().properties.get("batch", -1)) >= number:
            return
        rows = staged(batch.select("file", "offset", "replayed", "value"), "batch")
        again = rows.where("replayed").select("file").distinct()
        gone = self.table.read().join(again, "file", "left_semi").select(*KEYS)
        self.table.replace(rows.select("file", "offset", F.lit(number).cast("long").alias("batch"), "value"), retired=gone, properties={"batch": str(number)})
        if self.listen:
            if not again.isEmpty():
                self.listen("reset", again)
            self.listen("line", rows.where("not replayed").drop("replayed"))

    def start(self, lines: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        w = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.put)
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()

    def snapshot(self, schema: str, version: int | None = None) -> DataFrame:
        """The lines as records (file, offset, ...) of a schema; lines that aren't JSON have nulls."""
        return self.table.read(version).withColumn("r", F.from_json("value", schema)).select("file", "offset", "r.*")
