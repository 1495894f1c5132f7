"""Resumable ingest: rows of Parquet folders to text blocks, exactly once.

`start` goes on with a growing input, with Spark's checkpoint as its only state. `append_text` has a log beside its
target that says of which revision of the input it is, and of each block how many rows were scanned for it and
written to it, and at which byte it ends; from it a later run goes on, cuts back what was not committed, starts over, or has nothing to do.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener
from pyspark.sql.types import StringType, StructType

from ..functions import text as T

SCHEMA = StructType().add("article", StringType()).add("abstract", StringType())


def blocks(rows: DataFrame) -> DataFrame:
    """Article and abstract as a block of text; rows with neither are left out."""
    return rows.select(T.article_block(F.col("article"), F.col("abstract")).alias("text")).filter("text is not null")


def start(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Runs over what is there now and stops; call again for what has come since."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return blocks(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Log:
    """The log of a target: a header, an entry for each block, and a last word, each a file that appears whole or not at all."""

    def __init__(self, spark: SparkSession, target: str):
        self._jvm, self.target, self.folder = spark._jvm, target.rstrip("/"), f"{target.rstrip('/')}/_log"
        self.store = self._path(target).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.store.listStatus(path)) if self.store.exists(path) else []

    def remove(self, path: str) -> None:
        self.store.delete(self._path(path), True)

    def write(self, name: str, value: dict) -> None:
        whole, part = self._path(f"{self.folder}/{name}.json"), self._path(f"{self.folder}/_{name}.part")
        out = self.store.create(part, True)
        try:
            out.write(json.dumps(value).encode())
            out.hsync()
        finally:
            out.close()
        if not self.store.rename(part, whole):
            raise OSError(f"{name} could not be committed to {self.folder}")

    def read(self, name: str) -> dict | None:
        """None if it is not there; a ValueError if it can't be understood."""
        path = self._path(f"{self.folder}/{name}.json")
        if not self.store.exists(path):
            return None
        stream = self.store.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def entries(self) -> list[dict]:
        """Of all blocks so far; a ValueError if one is damaged, missing or does not go on from the one before."""
        out: list[dict] = []
        for name in (n for n in self.names(self.folder) if n[:8].isdigit() and n.endswith(".json")):
            entry = self.read(name.removesuffix(".json"))
            offset = out[-1]["byte_offset"] if out else 0
            if not isinstance(entry, dict) or entry.get("block") != len(out) or entry.get("byte_offset", -1) - entry.get("bytes", 0) != offset:
                raise ValueError(f"{name} does not go on from the entry before")
            out.append(entry)
        done = [int(n) for n in self.names(f"{self.folder}/checkpoint/commits") if n.isdigit()]
        if done and max(done) >= len(out):
            raise ValueError("blocks were committed that the log does not have")
        if missing := {f"block={e['block']:08d}" for e in out} - set(self.names(self.target)):
            raise ValueError(f"the target lacks {', '.join(sorted(missing))}")
        return out


def append_text(spark: SparkSession, source: str, target: str, *, revision: dict[str, str], files_per_batch: int = 1, listener: StreamingQueryListener | None = None) -> dict:
    """Text blocks of the input's rows in folders of target, with a log; gives the log's sums.

    revision: what the input is (its name, configuration, split and revision). A finished target of the same
    revision is left as it is. An unfinished one goes on after its last committed block, and loses blocks that are not in the log. One of
    another revision, or with a damaged log, is started over.
    """
    log = Log(spark, target)
    try:
        same = log.read("header") == {"input": revision}
        entries, last = (log.entries(), log.read("complete")) if same else ([], None)
    except ValueError:
        same = False
    if same and last is not None:
        return last
    if same:
        known = {f"block={e['block']:08d}" for e in entries}
        for name in log.names(target):
            if name.startswith("block=") and name not in known:
                log.remove(f"{log.target}/{name}")
    else:
        log.remove(target)
        log.write("header", {"input": revision})

    def sums() -> dict:
        found = log.entries()
        return {"source_rows_scanned": sum(e["rows_scanned"] for e in found), "rows_written": sum(e["rows_written"] for e in found), "byte_offset": found[-1]["byte_offset"] if found else 0, "blocks": len(found)}

    def write(rows: DataFrame, block: int) -> None:
        name = f"{block:08d}"
        if log.read(name) is not None:  # committed here, and not yet by the stream
            return
        read, written = Observation(), Observation()
        made = blocks(rows.observe(read, F.count(F.lit(1)).alias("n")))
        made = made.observe(written, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
        # Each block of text ends with a blank line, which the writer puts there.
        made.select(F.regexp_replace("text", r"\n\n\z", "")).write.mode("overwrite").option("lineSep", "\n\n").text(f"{log.target}/block={name}")
        before = log.read(f"{block - 1:08d}") if block else None
        size = written.get["bytes"]
        log.write(name, {"block": block, "rows_scanned": read.get["n"], "rows_written": written.get["n"], "bytes": size, "byte_offset": (before["byte_offset"] if before else 0) + size})

    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    if listener is not None:
        spark.streams.addListener(listener)
    try:
        query = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{log.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if listener is not None:
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
            spark.streams.removeListener(listener)
    log.write("complete", sums() | {"complete": True})
    return log.read("complete")


class Progress(StreamingQueryListener):
    """How far a stream is: the seven figures of a snapshot, and the seconds left.

    Bytes are the share of the input's bytes that its rows read so far are of all rows. Tokens and sequences
    are what the stream observes under the name `windows` (columns tokens and sequences), if it does.
    """

    def __init__(self, total_bytes: int, total_rows: int):
        super().__init__()
        self.total_bytes, self.total_rows = total_bytes, total_rows
        self.rows = self.tokens = self.sequences = self.batches = 0
        self.began = time.monotonic()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.began = time.monotonic()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        told = event.progress
        self.batches += 1
        self.rows += told.numInputRows
        seen = told.observedMetrics.get("windows")
        if seen is not None:
            self.tokens += seen["tokens"] or 0
            self.sequences += seen["sequences"] or 0

    def snapshot(self) -> dict[str, float]:
        share = min(1.0, self.rows / self.total_rows) if self.total_rows > 0 else 0.0
        read, mb = int(self.total_bytes * share), 1024 * 1024
        fraction = min(1.0, read / self.total_bytes) if self.total_bytes > 0 else 0.0
        return {
            "bytes_read": read, "total_bytes": self.total_bytes, "data_consumed_mb": read / mb, "data_remaining_mb": max(0.0, (self.total_bytes - read) / mb),
            "progress_fraction": fraction, "tokens_yielded": self.tokens, "sequences_yielded": self.sequences,
        }

    def seconds_left(self) -> float | None:
        """None while nothing was read."""
        done = self.snapshot()["progress_fraction"]
        return max(0.0, max(0.001, time.monotonic() - self.began) * (1 / done - 1)) if done > 0 else None


def input_size(spark: SparkSession, source: str) -> tuple[int, int]:
    """Bytes and rows of a Parquet folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(source)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return size, spark.read.parquet(source).count()


def progress(query: StreamingQuery) -> dict[str, float]:
    """Batches, rows read and rows per second of the last batches."""
    seen = [p for p in query.recentProgress if p["numInputRows"]]
    seconds = sum(p["durationMs"]["triggerExecution"] for p in seen) / 1000
    rows = sum(p["numInputRows"] for p in seen)
    return {"batches": len(seen), "rows": rows, "rows_per_second": rows / seconds if seconds else 0.0}
