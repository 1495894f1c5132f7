"""Heterogeneous files to instruction records: parse, normalise, dedup, token statistics, splits, shards, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, records, splits, tokens
from ..session import materialized
from ..sources import files, formats, sinks


# What a manifest says of the method.
SPLIT_POLICY = "stable hash of record id: 90% train, 5% validation, 5% test"
DEDUPLICATION = "first of equal SHA-256 keys"
STATS = ("prompt_tokens", "response_tokens", "total_tokens", "unk_tokens", "fits_context")


def normalized(parsed: DataFrame) -> DataFrame:
    """Records with file and seq."""
    rows = parsed.filter("error is null").select("file", "seq", *[F.col(f).alias(f"_{f}") for f in records.V2_FIELDS])
    made = records.v2_record(rows, **{f: F.col(f"_{f}") for f in records.V2_FIELDS})
    return made.select("file", "seq", *records.V2_FIELDS, "id")


def deduplicated(rows: DataFrame) -> DataFrame:
    """Adds is_first: the first of records with equal keys, in order of files and places. Records that are dropped later count."""
    keyed = rows.withColumn("key", T.dedup_key(F.col("instruction"), F.col("input"), F.col("response"))).withColumn("_order", files.path_order(F.col("file")))
    return dedup.first_wins(keyed, "key", ["_order", "seq"], "is_first").drop("_order")


def outcomes(parsed: DataFrame, prompt_ids: Column, response_ids: Column, context: int, unk: int = tokens.UNK) -> DataFrame:
    """A row for each record, fault and source, with its outcome: accepted, over_context, duplicate, a fault's reason, or member (a source begins).

    prompt_ids, response_ids: token ids as columns over T.prompt's text in `prompt` and `response`. The
    table is written once; everything that is counted or written afterwards is read from it.
    """
    rows = deduplicated(normalized(parsed)).withColumn("prompt", F.when(F.col("is_first"), T.prompt(F.col("instruction"), F.col("input"))))
    rows = rows.withColumn("_p", prompt_ids).withColumn("_r", response_ids)
    stats = F.struct(*[c.alias(n) for n, c in tokens.token_stats(F.col("_p"), F.col("_r"), context, unk).items()])
    outcome = F.when(~F.col("is_first"), "duplicate").when(F.col("stats.fits_context"), "accepted").otherwise("over_context")
    rows = rows.withColumn("stats", F.when(F.col("is_first"), stats)).withColumn("outcome", outcome).withColumn("split", F.when(outcome == "accepted", T.split_of(F.col("id"))))
    told = parsed.filter("error is not null").select("file", "seq", "source", F.col("error").alias("outcome"), F.col("detail").alias("error"))
    return materialized(rows.drop("_p", "_r", "prompt", "is_first").unionByName(told, allowMissingColumns=True))


def ingest_records(spark: SparkSession, root: str, prompt_ids: Column, response_ids: Column, context: int, shard_size: int = 50_000, unk: int = tokens.UNK) -> dict[str, DataFrame]:
    """outcomes, accepted (with statistics, split and shard), and rejections.

    A rejection is a reason with the record and its statistics, or with the source and the fault's own text.
    """
    if context < 2 or shard_size < 1:
        raise ValueError("the context must be at least 2 and a shard at least 1")
    all_rows = outcomes(materialized(formats.parsed_records(spark, root)), prompt_ids, response_ids, context, unk)
    fits = all_rows.filter("outcome = 'accepted'").withColumn("_order", files.path_order(F.col("file")))
    shards = splits.sharded(fits.select("split", "_order", "seq", "key"), ["_order", "seq"], shard_size)
    accepted = fits.join(shards.select("key", "shard"), "key").select("file", "seq", "key", *records.V2_FIELDS, "id", *[F.col(f"stats.{n}").alias(n) for n in STATS], "split", "shard")
    over = F.col("outcome") == "over_context"
    rejections = all_rows.filter(~F.col("outcome").isin("accepted", "duplicate", "member")).select(
        F.col("outcome").alias("reason"), F.when(over, F.struct(*records.V2_FIELDS, "id")).alias("record"), F.when(over, F.col("stats")).alias("stats"), F.when(~over, F.col("source")).alias("source"), "error"
    )
    return {"outcomes": all_rows, "accepted": accepted, "rejections": rejections}


def counts(rows: DataFrame) -> DataFrame:
    """outcome, split, source (of accepted records), n, total_tokens, unk_tokens: all that a manifest counts, in one job over outcomes()."""
    source = F.when(F.col("outcome") == "accepted", F.col("source")).alias("source")
    total = lambda c: F.coalesce(F.sum(f"stats.{c}"), F.lit(0)).cast("long").alias(c)
    return rows.groupBy("outcome", "split", source).agg(F.count(F.lit(1)).alias("n"), total("total_tokens"), total("unk_tokens"))


def manifest(rows: DataFrame, source_root: str, tokenizer: str, context: int) -> dict:
    """Figures of an ingest. A row for each source and split comes to the driver, as the manifest names every source."""
    found = counts(rows).collect()

    def by(column: str, *outcome: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for r in found:
            if (not outcome or r["outcome"] in outcome) and r[column] is not None:
                out[r[column]] = out.get(r[column], 0) + r["n"]
        return out

    outcome, split = by("outcome"), by("split", "accepted")
    inside, over = outcome.pop("accepted", 0), outcome.get("over_context", 0)
    members = outcome.pop("member", 0)
    total, unknown = (sum(r[c] for r in found) for c in ("total_tokens", "unk_tokens"))
    return {
        "source_root": source_root,
        "tokenizer": tokenizer,
        "context_length": context,
        "files_or_archive_members_seen": members,
        "unique_records_seen": inside + over,
        "accepted_records": inside,
        **{f"{s}_records": split.get(s, 0) for s in ("train", "validation", "test")},
        "rejections": outcome,
        "length_distribution": {k: n for k, n in (("within_context", inside), ("over_context", over)) if n},
        "average_tokens": total / max(1, inside + over),
        "unk_token_rate": unknown / max(1, total),
        "source_counts": by("source", "accepted"),
        "split_policy": SPLIT_POLICY,
        "deduplication": DEDUPLICATION,
    }


def build(spark: SparkSession, root: str, folder: str, model: str, context: int = 256, shard_size: int = 50_000, tokenizer: str = "tokenizer.json") -> dict:
    """Ingests root with a tokenizer's JSON (tokenizer: its name); writes shards, rejections and the manifest."""
    unk = tokens.special_ids(model)["<unk>"]
    parts = ingest_records(spark, root, tokens.encode(model, F.col("prompt"), bos=True), tokens.encode(model, F.col("response"), eos=True), context, shard_size, unk)
    sinks.write_shards(parts["accepted"].drop("file", "seq", "key"), f"{folder}/records")
    sinks.write_jsonl(parts["rejections"], f"{folder}/rejections")
    figures = manifest(parts["outcomes"], root, tokenizer, context)
    sinks.write_manifest(spark, f"{folder}/manifest.json", figures)
    return figures
