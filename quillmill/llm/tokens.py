"""Token counts of documents in flat token files, found by their end-of-document identifiers.

A token file is nothing but token ids of a fixed width, each document's followed by the
end-of-document id; there is no index. Files are read in blocks of a fixed number of tokens,
wherever these begin and end. A block is searched for the end id in one vectorised comparison
and gives the lengths between the ends it has and the length of its rest. A prefix scan over
the blocks of a file then gives each block the number of documents before it and the tokens
since the last end, by which its first document is too short.

Tokens after a file's last end are a document of their own. Empty files have no documents.
Null and empty texts are written as documents of no tokens. Rows that repeat an id are
documents of their own. A text that spells a special token is ordinary text.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_bounds, cut, shared_dir

END = 50_256
DTYPE = "<u2"
BLOCK_TOKENS = 2_000_000
#: Pre-tokenisation of the public byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoder(ranks: bytes):
    """Built once in a worker. ranks: a vocabulary file, a base64 token and its rank in each line."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = END, dtype: str = DTYPE) -> DataFrame:
    """Writes a token file for each partition; gives file, first (ordinal in the file), ids, n_bytes (so far).

    folder must be one that all executors share. A file's name is new with each attempt at a
    partition, so what an executor leaves that is lost belongs to no row.
    """
    arrow_bounds(docs.sparkSession)
    ranks = open(vocabulary, "rb").read()
    used = {int(line.split()[1]) for line in ranks.splitlines()}
    if end in used or max(used | {end}) > np.iinfo(np.dtype(dtype)).max:
        raise ValueError(f"token ids of {vocabulary} include the end id {end}, or do not fit {dtype}")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value).encode_ordinary
        name, out, done, size = f"{uuid.uuid4().hex}.tokens", None, 0, 0
        try:
            for batch in batches:
                if out is None:
                    store, root = opened(folder)
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}")
                for text in batch.column(1).to_pylist():
                    size += out.write(np.array([*encode(text or ""), end], dtype).tobytes())
                rows = [pa.array([name]), pa.array([done], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(batch.schema.field(0).type)), pa.array([size], pa.int64())]
                done += batch.num_rows
                yield pa.RecordBatch.from_arrays(rows, names=["file", "first", "ids", "n_bytes"])
        finally:
            if out is not None:
                out.close()

    zero = F.lit(0).cast("long")
    return base.mapInArrow(write, base.select(F.lit("").alias("file"), zero.alias("first"), F.array("id").alias("ids"), zero.alias("n_bytes")).schema)


def count_tokens(files: DataFrame, folder: str, *, end: int = END, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, ordinal, n_tokens of each document. files: file (name in folder), n_bytes."""
    width = np.dtype(dtype).itemsize
    blocks = files.withColumn("_n", F.ceil(F.col("n_bytes") / (block_tokens * width)).cast("long")).filter("_n > 0")
    n_blocks = blocks.agg(F.sum("_n")).first()[0] or 0
    blocks = blocks.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("block"))
    blocks = blocks.repartition(max(1, min(n_blocks, 10_000)), "file", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        for batch in batches:
            for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{file}") as f:
                    tokens = np.frombuffer(f.read_at(block_tokens * width, block * block_tokens * width), dtype)
                ends = np.flatnonzero(tokens == end)
                lengths = np.diff(ends, prepend=-1) - 1
                rest = len(tokens) - (int(ends[-1]) + 1 if len(ends) else 0)
                columns = [[file], [block], [len(tokens)], [rest]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([lengths], pa.list_(pa.int64()))], names=["file", "block", "n", "rest", "lengths"])

    zero = F.lit(0).cast("long")
    schema = blocks.select("file", "block", zero.alias("n"), zero.alias("rest"), F.array(zero).alias("lengths")).schema
    found = cut(blocks.mapInArrow(scan, schema))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    narrow = found.select("file", "block", "n", "rest", F.size("lengths").cast("long").alias("ends"))
    narrow = narrow.withColumn("_stop", F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    narrow = narrow.withColumn("_last_end", F.when(F.col("ends") > 0, F.col("_stop") - F.col("rest")))
    narrow = narrow.select(
        "file", "block",
        (F.col("_stop") - F.col("n") - F.coalesce(F.max("_last_end").over(before), zero)).alias("carry"),
        F.coalesce(F.sum("ends").over(before), zero).alias("before"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("last"),
    )
    stitched = found.join(narrow, ["file", "block"])
    rest = F.col("rest") + F.when(F.size("lengths") == 0, F.col("carry")).otherwise(zero)
    lengths = F.concat("lengths", F.when(F.col("last") & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    stitched = stitched.select("file", "before", "carry", (F.size("lengths") > 0).alias("_own"), F.posexplode(lengths).alias("_i", "_len"))
    carry = F.when(F.col("_own") & (F.col("_i") == 0), F.col("carry")).otherwise(zero)
    return stitched.select("file", (F.col("before") + F.col("_i")).alias("ordinal"), (F.col("_len") + carry).alias("n_tokens"))


def document_token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens: documents are written to token files in the shared folder, counted there, and the files removed."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    try:
        written = cut(write_token_files(docs, folder, vocabulary, id_col=id_col, text_col=text_col))
        files = cut(written.groupBy("file").agg(F.max("n_bytes").alias("n_bytes")))
        counts = cut(count_tokens(files, folder))
    finally:
        store, root = opened(folder)
        if store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir(root)
    ids = written.select("file", F.col("first"), F.posexplode("ids").alias("_i", id_col)).select("file", (F.col("first") + F.col("_i")).alias("ordinal"), id_col)
    return ids.join(counts, ["file", "ordinal"]).select(id_col, "n_tokens")
