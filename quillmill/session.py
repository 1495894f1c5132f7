"""Tables, the shared folder and cutting lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after finding that it has no more rows, and no more bytes of values, than this.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which only on a single machine may be unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()).rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """df written to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shared_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """The path of a new folder in the shared one, removed with all that is in it at the end, well or not."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)



def arrow_bounds(spark: SparkSession) -> None:
    """Arrow batches of 512 rows, so that whole texts don't pile up in a worker; a session with a setting of its own keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "512")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it has at most so many rows and bytes (of its values as JSON); df should be cheap to read again."""
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most else df
