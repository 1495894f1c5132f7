"""Files: recursive scans in path order, text, inventories, PDF reports.

A path sorts by its parts, so `a/b` comes before `a-b`.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

# Suffixes.
TEXT_SUFFIXES = (".txt", ".text", ".md")
BUILDER_SUFFIXES = (".txt", ".md")
CORPUS_SUFFIXES = (*TEXT_SUFFIXES, ".pdf")
RECORD_SUFFIXES = (".json", ".jsonl", ".csv", ".tsv", ".xml", ".txt", ".md", ".parquet", ".xlsx", ".zip")


def checked_dir(spark: SparkSession, path: str) -> str:
    """The path, if it is a directory of any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(p):
        raise FileNotFoundError(f"there is no directory {path}")
    if not store.getFileStatus(p).isDirectory():
        raise NotADirectoryError(f"{path} is not a directory")
    return store.getFileStatus(p).getPath().toString().rstrip("/")


def suffix(path: Column) -> Column:
    """Lower-cased, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def path_order(path: Column) -> Column:
    return F.split(path, "/")


def below(base: str, path: Column) -> Column:
    """A file's path from a folder on; base as checked_dir() gives it, path as Spark's scans do."""
    path = F.regexp_replace(path, "^file:/+", "file:/")
    return F.substring(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), len(base) + 2, 1 << 30)


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] | None = None, recursive: bool = True, skip_unreadable: bool = False) -> DataFrame:
    """path, relative, suffix, length, content of the files under root; content is only read where it is used.

    Spark's reader passes over files of no bytes.
    """
    base = checked_dir(spark, root)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", str(skip_unreadable).lower())
    files = reader.load(base)
    files = files.withColumn("relative", below(base, F.col("path"))).withColumn("suffix", suffix(F.col("path")))
    return files.filter(F.col("suffix").isin(*suffixes)) if suffixes else files


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """relative, text: UTF-8 with bad bytes replaced; blank files, and files that can't be read, are left out."""
    files = scan(spark, root, TEXT_SUFFIXES, skip_unreadable=True)
    out = files.select("relative", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return out.filter(T.strip(F.col("text")) != "")


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8 with bad bytes dropped."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def builder_files(spark: SparkSession, root: str) -> DataFrame:
    files = scan(spark, root, BUILDER_SUFFIXES)
    return files.select("relative", decoded("content").alias("text"))


def corpus_files(spark: SparkSession, root: str) -> DataFrame:
    """relative, content, text: null where a file could not be read."""
    files = scan(spark, root, CORPUS_SUFFIXES)
    plain = files.filter("suffix <> '.pdf'").select("relative", "content", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    pdf = pdf_pages(files.filter("suffix = '.pdf'")).select("relative", "content", "text")
    return plain.unionByName(pdf)


def inventory(files: DataFrame) -> DataFrame:
    """One row: total_files, total_size_bytes, extensions (map of suffix to number)."""
    by = files.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_size_bytes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("suffix", "n")))).alias("extensions"),
    )


def duplicate_files(files: DataFrame, only: str = ".pdf") -> DataFrame:
    """digest, paths (sorted) of files of a kind with equal bytes."""
    groups = files.filter(F.col("suffix") == only).groupBy(T.bytes_hash(F.col("content")).alias("digest"))
    return groups.agg(F.array_sort(F.collect_list("relative")).alias("paths")).filter(F.size("paths") > 1)


PDF = "relative string, content binary, text string, pages int, images int, pages_with_images int, error string"


def pdf_pages(files: DataFrame) -> DataFrame:
    """relative, content, text (pages joined by line feeds), pages, images, pages_with_images; error where a file can't be read.

    Needs the optional library pymupdf; without it every file has an error.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([_pdf(r.relative, bytes(r.content)) for r in frame.itertuples()], columns=[c.split()[0] for c in PDF.split(", ")])

    return files.select("relative", "content").mapInPandas(read, PDF)


def _pdf(relative: str, content: bytes) -> tuple:
    try:
        import fitz

        with fitz.open(stream=io.BytesIO(content), filetype="pdf") as pdf:
            pages = [(p.get_text(), len(p.get_images(full=True))) for p in pdf]
        return relative, content, "\n".join(t for t, _ in pages), len(pages), sum(n for _, n in pages), sum(n > 0 for _, n in pages), None
    except Exception as exc:  # any fault of a file is its row's error
        return relative, content, None, None, None, None, f"{type(exc).__name__}: {exc}"


def pdf_report(files: DataFrame) -> DataFrame:
    """file, pages, characters, words, has_text, error."""
    n = F.size(T.words(F.col("text")))
    return pdf_pages(files.filter("suffix = '.pdf'")).select(
        F.col("relative").alias("file"), "pages", F.length("text").alias("characters"), F.when(F.col("text").isNotNull(), n).alias("words"), (T.strip(F.col("text")) != "").alias("has_text"), "error"
    )


def pdfs_without_words(files: DataFrame) -> DataFrame:
    """file, pages, images, pages_with_images of readable files without a word."""
    out = pdf_pages(files.filter("suffix = '.pdf'")).filter(F.col("text").isNotNull() & (F.size(T.words(F.col("text"))) == 0))
    return out.select(F.col("relative").alias("file"), "pages", "images", "pages_with_images")


def resolved(paths: dict[tuple[str, str], str], dataset: str, split: str, spark: SparkSession) -> str:
    """A corpus file's path from the catalogue of (dataset, split)."""
    if (dataset, split) not in paths:
        raise ValueError(f"no corpus is known as {dataset}, {split}")
    path = paths[dataset, split]
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"{path} of {dataset}, {split} is missing")
    return path
