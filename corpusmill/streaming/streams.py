"""Structured Streaming forms: counts over a growing journal, and ingest of files as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..plans.corpus_table import CorpusTable
from ..plans.ingest import ingest
from ..settings import Settings
from ..sources.readers import read_documents
from ..sources.routing import resolve


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", ts: str = "ts", event: str = "event") -> DataFrame:
    """window_start, event, n, of a stream or a table. Rows later than ``late`` are left out of a stream."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.window(ts, every), F.col(event).alias("event")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event", "n")


def watch(table: CorpusTable, folder: str, checkpoint: str, settings: Settings = Settings(), tags: tuple[str, ...] = (), **trigger: object) -> StreamingQuery:
    """Ingest the files that are in ``folder`` or come to it. A batch that is run again is a no-op."""
    files = table.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def batch(rows: DataFrame, _: int) -> None:
        found = rows.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
        ingest(table, read_documents(found.select("*", F.inline(F.array(resolve(F.col("path"), F.col("content")))))), tags, settings)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class RunCounter(StatefulProcessor):
    """For each run: its start, and how many dispatches it has had. A row whenever either changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "started timestamp, event string, dispatches long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values: object) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else (None, None, 0)
        started, event, n = held[0], held[1], held[2]
        for r in rows:
            n += r.event == "DISPATCH_START"
            if r.event in ("RUN_START", "ASK_START") and (started is None or r.ts < started):
                started, event = r.ts, r.event
        if (started, event, n) != (held[0], held[1], held[2]):
            self.state.update((started, event, n))
            yield Row(run_id=key[0], started=started, event=event, dispatches=n)

    def close(self) -> None:
        pass


def run_counts(events: DataFrame) -> DataFrame:
    """run_id, started, event, dispatches of a stream of journal rows; the last row of a run holds. The state lives in RocksDB, a run a key."""
    told = events.where(F.col("run_id").isNotNull() & F.col("event").isin("RUN_START", "ASK_START", "DISPATCH_START")).select("run_id", "ts", "event")
    return told.groupBy("run_id").transformWithState(RunCounter(), "run_id string, started timestamp, event string, dispatches long", "Update", "None")
