"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from types import TracebackType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after finding that it has no more rows, and no more bytes of values, than this.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, from spark.checkpoint.dir; only on a single machine may it be unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there.

    Keep df narrow: rows are stored uncompressed. Survives the loss of executors, and later
    passes do not repeat the work (or a non-deterministic partitioning) above it. Spark removes
    checkpoints that nothing refers to where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder for one run of an operator, removed when it ends, well or not.

    While it is open, Spark removes the shuffle files of each job at the job's end (all that is
    used again is a table). The session's own setting is put back.
    """

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        self._before = self.spark.conf.get(self.CLEAN, None)
        self.spark.conf.set(self.CLEAN, "true")
        return self

    def __exit__(self, kind: type | None, fault: BaseException | None, trace: TracebackType | None) -> None:
        if self._before is None:
            self.spark.conf.unset(self.CLEAN)
        else:
            self.spark.conf.set(self.CLEAN, self._before)
        self.drop(self.folder)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """df as a table, in the same columns; a new name each time."""
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, *names: str) -> None:
        """Removes tables that are not read again, before the end."""
        for name in names:
            self.drop(f"{self.folder}/{name}")

    def drop(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes (of its values as JSON). It should be cheap to read again."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= rows and total <= most


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it fits(), else df as it is. df should be a table or a result of cut()."""
    return F.broadcast(df) if fits(df, rows) else df


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores after it while df has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_bucket(col: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def arrow_bounds(spark: SparkSession) -> None:
    """Hold Arrow batches to a few MB of text, so very long documents don't pile up in a worker.

    Sets spark.sql.execution.arrow.maxRecordsPerBatch to 512 in the session, and leaves it so, as
    results are lazy; a session with a setting of its own keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "512")


def give_back_memory() -> None:
    """Return what a worker's libraries have freed to the system, and let their threads share one heap from now on, where the C library can."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim") and hasattr(libc, "mallopt"):
        libc.mallopt(-8, 1)  # M_ARENA_MAX
        libc.malloc_trim(0)


def draw(id_: Column, text: Column) -> Column:
    """A number from 0 up to 1 from the hash of an id and a text, the same in every run; rows without an id are drawn by their texts."""
    return F.pmod(F.xxhash64(F.coalesce(id_.cast("string"), F.lit("")), F.coalesce(text, F.lit("")), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, chars: int) -> DataFrame:
    """Rows to fit a classifier on: of each label about `chars` characters, all while it has fewer.

    Rows are drawn by the hash of their id and text, so that reruns draw the same, and rows without an id
    like others. Of rows alike in id, text and label one counts, so however often a row is repeated, the sample is
    bounded. Labels are few: a row for each comes to the driver.
    """
    sums = docs.groupBy(label_col).agg(F.sum(F.length(text_col)).alias("n")).filter("n > 0").collect()
    if not sums:
        return docs.filter(F.lit(False))
    shares = F.create_map(*[F.lit(x) for r in sums for x in (r[0], min(1.0, chars / r[1]))])
    return docs.filter(draw(F.col(id_col), F.col(text_col)) < shares[F.col(label_col)]).dropDuplicates([id_col, text_col, label_col])
