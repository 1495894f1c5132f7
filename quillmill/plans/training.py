"""What training reads: windows over the rows of a Parquet file of any columns, or over the lines of a text.

A row of a file becomes text by its fields and belongs to a split by the hash of its number and
all its values. Rows stand in the order of the file; several files follow each other by path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packing, splits
from ..operators.scan import numbered
from ..session import materialized
from ..sources.lines import numbered_lines

ORDER = ["file", "row_index"]
STRIDES = {"train": 128}
EVALUATION_STRIDE = 256


def parquet_texts(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """file, row_index, text, split of the rows that have a text; split: the one to read.

    A row group is read by one task, so rows are dealt out before they are made text.
    """
    rows = spark.read.parquet(path)
    kinds = [F.col(f"`{c}`").alias(c) for c in rows.columns]
    placed = rows.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row_index"), *kinds)
    placed = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_file", "_row_index")
    row_index = F.col("_row_index")
    out = placed.select(
        F.col("_file").alias("file"), row_index.alias("row_index"), splits.row_to_text(rows.columns, dict(rows.dtypes)).alias("text"),
        splits.row_split(row_index, {c: splits.python_text(F.col(f"`{c}`"), kind) for c, kind in rows.dtypes}).alias("split"),
    ).filter("text <> ''")
    return out.filter(F.col("split") == split) if split else out


def line_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, row_index, text of the lines of a text file."""
    return numbered_lines(spark, path).select(F.col("path").alias("file"), F.col("line_no").alias("row_index"), F.col("line").alias("text"))


def skipped_and_limited(rows: DataFrame, order: list[str], skip: int = 0, most: int | None = None) -> DataFrame:
    """The rows after the first `skip` in order, `most` at most."""
    at = numbered(rows.select(*order), order, "_at").filter(F.col("_at") >= skip)
    at = at.filter(F.col("_at") < skip + most) if most is not None else at
    return rows.join(at.drop("_at"), order, "left_semi")


def dataset(texts: DataFrame, encode: Callable[[Column], Column], *, kind: str = "lm", context: int = 256, stride: int | None = None, split: str = "train", bos: int = 2, eos: int = 3) -> DataFrame:
    """Windows of the texts in their order.

    encode: a text column to a column of token ids. kind: `lm` (k, input_ids, target_ids; no token
    between rows) or `seq2seq` (k, source, decoder_input, target; eos after each row).
    """
    if kind not in ("lm", "seq2seq"):
        raise ValueError(f"{kind} is neither lm nor seq2seq")
    ids = texts.select(*ORDER, encode(F.col("text")).alias("ids"))
    ids = materialized(ids)  # read for lengths, then for windows
    if kind == "seq2seq":
        return packing.seq2seq_windows(ids, ORDER, context, bos, eos)
    return packing.lm_windows(ids, ORDER, context, stride or STRIDES.get(split, EVALUATION_STRIDE))
