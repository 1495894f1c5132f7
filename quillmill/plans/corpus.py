"""The corpus build: dedup by bytes, cleaning, filters, dedup by content and nearness, splits, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality
from ..functions import text as T
from ..operators import dedup
from ..operators.scan import numbered
from ..session import materialized

STAGES = ("exact_duplicate", "failed", "rejected", "content_duplicate", "near_duplicate", "accepted")


def staged(docs: DataFrame, *, id_col: str, raw: Column, text: Column, order: list[str], compose: bool = True) -> DataFrame:
    """A row for each document: id, order columns, stage (of STAGES), text (cleaned), characters, hashes, fp and split.

    order: columns in which no two documents are equal, as path_order() of a path. raw: the bytes, whose first document wins even if it fails later. text: null where
    extraction failed. Content duplicates are found before near ones, so a copy of a document
    that is dropped as near counts as a content duplicate.
    """
    keys = [c for c in order if c != id_col]
    base = docs.select(id_col, *keys, T.bytes_hash(raw).alias("file_sha256"), text.alias("_raw"))
    # The window sees ids and digests only; texts join the survivors by what they were before.
    first = dedup.first_wins(base.select(id_col, *keys, "file_sha256"), "file_sha256", order, "_first").select(id_col, "_first")
    base = base.join(first, id_col)
    clean = F.when(F.col("_first") & F.col("_raw").isNotNull(), T.clean_text(F.col("_raw"), compose))
    base = T.once(base, "text", clean).drop("_raw")
    ok = F.col("text").isNotNull() & quality.accepted(F.col("text"))
    base = base.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("content_sha256", F.when(F.col("_ok"), T.content_hash(F.col("text"))))
    narrow = materialized(base.select(id_col, *keys, "file_sha256", "_first", "_ok", F.col("text").isNull().alias("_none"), F.length("text").alias("characters"), "content_sha256", F.when(F.col("_ok"), F.col("text")).alias("text")))
    unique = dedup.first_wins(narrow.filter("_ok").select(id_col, *keys, "content_sha256"), "content_sha256", order, "_unique").filter("_unique").select(id_col, *keys)
    fps = materialized(dedup.simhash(narrow.join(unique, id_col, "left_semi"), id_col, F.col("text")))
    ranked = materialized(fps.join(numbered(unique, order, "_rank").select(id_col, "_rank"), id_col))
    # Of equal fingerprints all but the first go: if it stays they are near it, else near what it is near to.
    first = materialized(ranked.groupBy("fp").agg(F.min("_rank").alias("_first")))
    pairs = dedup.near_pairs(first.select(F.col("_first").alias("rank"), "fp"), "rank")
    near = dedup.greedy_drops(pairs).select(F.col("id").alias("_rank")).unionByName(ranked.join(first, "fp").filter("_rank <> _first").select("_rank"))
    gone = ranked.join(near.distinct(), "_rank").select(id_col, F.lit(True).alias("_near"))
    out = narrow.join(fps, id_col, "left").join(gone, id_col, "left")
    stage = (
        F.when(~F.col("_first"), "exact_duplicate").when(F.col("_none"), "failed").when(~F.col("_ok"), "rejected")
        .when(F.col("fp").isNull(), "content_duplicate").when(F.col("_near"), "near_duplicate").otherwise("accepted")
    )
    out = out.withColumn("stage", stage).withColumn("split", F.when(F.col("stage") == "accepted", T.split_of(F.col("content_sha256"))))
    return out.select(id_col, *keys, "stage", "text", "characters", "file_sha256", "content_sha256", "fp", "split")


def manifest(rows: DataFrame, source: str) -> DataFrame:
    """Of accepted documents: source, digests, simhash (16 hex digits), characters and split."""
    out = rows.filter("stage = 'accepted'")
    return out.select(F.col(source).alias("source"), "file_sha256", "content_sha256", T.hex16(F.col("fp")).alias("simhash"), "characters", "split")


def counters(rows: DataFrame) -> DataFrame:
    """One row: documents by stage, and accepted ones by split."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        *[n(F.col("stage") == s, s) for s in STAGES],
        *[n(F.coalesce(F.col("split") == s, F.lit(False)), s) for s in ("train", "validation", "test")],
    )


def preprocess(docs: DataFrame, text: Column, compose: bool = True) -> DataFrame:
    """docs with cleaned and accepted."""
    out = T.once(docs, "cleaned", T.clean_text(text, compose))
    return out.withColumn("accepted", F.coalesce(quality.accepted(F.col("cleaned")), F.lit(False)))
