"""What builds write: text by split, manifests, sharded records, rejections, and checks on what was written."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans import corpus


def write_corpus(rows: DataFrame, folder: str, source: str) -> None:
    """Accepted texts, each ended by a blank line, by split, and the manifest as JSON lines. rows: of corpus.staged()."""
    kept = rows.filter("stage = 'accepted'")
    kept.select("text", "split").write.mode("overwrite").partitionBy("split").option("lineSep", "\n\n").text(f"{folder}/corpus")
    corpus.manifest(rows, source).write.mode("overwrite").json(f"{folder}/manifest")


def write_cleaned(rows: DataFrame, folder: str, relative: str = "relative") -> dict[str, int]:
    """Cleaned texts that were accepted, by their relative path; numbers processed and rejected, counted as the rows pass."""
    seen = Observation()
    rows = rows.observe(seen, F.count_if("accepted").alias("processed"), F.count_if(~F.col("accepted")).alias("rejected"))
    rows.filter("accepted").select(relative, "cleaned").write.mode("overwrite").parquet(folder)
    return seen.get


def write_tree(rows: DataFrame, folder: str, relative: str = "relative") -> dict[str, int]:
    """Cleaned texts that were accepted, each in a file of its own at its relative path below folder; numbers processed and rejected.

    Tasks write the files, to any store that pyarrow reaches. A file appears whole, under its last name, so a task that
    is run again leaves the same tree. Only two numbers come back.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            written = 0
            for path, text, accepted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if accepted:
                    at, _, name = f"{root}/{path}".rpartition("/")
                    store.create_dir(at, recursive=True)
                    part = f"{at}/.{name}.{uuid.uuid4().hex}"
                    with store.open_output_stream(part) as out:
                        out.write(text.encode("utf-8"))
                    store.move(part, f"{at}/{name}")
                    written += 1
            yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64()), pa.array([batch.num_rows - written], pa.int64())], names=["processed", "rejected"])

    counts = rows.select(relative, "cleaned", "accepted").mapInArrow(write, "processed long, rejected long")
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("processed", "rejected")]).first().asDict()


def write_jsonl(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def write_shards(records: DataFrame, folder: str) -> None:
    """records with split and shard as JSON lines in a folder for each."""
    records.repartition("split", "shard").write.mode("overwrite").partitionBy("split", "shard").json(folder)


def write_training_text(texts: DataFrame, path: str, order: list[str], column: str = "training_text") -> None:
    """Texts in order, parted by blank lines."""
    texts.repartitionByRange(*order).sortWithinPartitions(*order).select(column).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def write_manifest(spark: SparkSession, path: str, counts: dict) -> None:
    """A JSON file of figures."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(json.dumps(counts, indent=2, ensure_ascii=False).encode())
    finally:
        out.close()


def verify(written: DataFrame, expected: int) -> None:
    """Fails unless as many records were written, each id once over all splits."""
    n, ids = written.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    if n != expected:
        raise ValueError(f"{n} records were written, not {expected}")
    if ids != n:
        raise ValueError(f"{n - ids} ids were written more than once")
