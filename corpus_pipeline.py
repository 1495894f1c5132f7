"""The training-data pipeline: five operators over documents, each over what the one before kept.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes as Parquet to
the shared folder and reads again as the next stage's docs. All stages but the last return the
columns of documents.

In every stage null ids and null or empty texts are rows like others, repeated rows are rows of their
own (but in near dedup, where they are copies), and an empty table gives an empty one. Extra columns
are kept, but those that a stage computes under the same name are replaced: `score` and `lang_pred`
by language id, `spans` by the secret scan, `mix`, `copy`, `served` and `finish` by mixing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import decontamination, language, mixing, near_dedup, secrets
from quillmill.llm.common import Scratch, cut, read_table, shared_dir, small

#: A document stays if the language is known and at least this likely.
LEAST_LIKELY = 0.5


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[df[f"`{c}`"] for c in docs.columns])


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and texts of no clear language, go; `lang` becomes the predicted one.

    The model is learned from the documents that carry a language. Without any, all stay as they are.
    """
    model = language.fit_language_model(docs)
    if not model.langs:
        return docs
    found = language.identify_language(docs, model)
    found = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LIKELY))
    return _columns(found.withColumn("lang", F.col("lang_pred")), docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays; rows without an id stay."""
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go; texts without words have none."""
    found = decontamination.find_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    hit = small(cut(found.filter("n_hit > 0").select(F.col("doc_id").alias("_id"), "_h").distinct()))
    same = docs["doc_id"].eqNullSafe(hit["_id"]) & (F.xxhash64(docs["text"]) == hit["_h"])
    return _columns(docs.join(hit, same, "left_anti"), docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret is replaced by its kind; n_chars follows."""
    out = secrets.scan_secrets(docs, redact=True)
    changed = F.size("spans") > 0
    return _columns(out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy served, with its number, its words within the budget and its virtual finish time."""
    return mixing.mix_schedule(mixing.mix_sources(docs))


STAGES = [("language id", identify), ("near dedup", deduplicate), ("decontamination", decontaminate), ("secret scan", redact), ("mixing", mix)]

#: A learned language model and order MinHash cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. If a stage fails, nothing that was written stays; else the last table, which the result reads."""
    docs = read_table(spark, sf_dir, "documents")
    folder, scratch = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", Scratch(spark)
    try:
        for i, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                scratch.drop(f"{folder}/{i - 1}")  # only the last stage's rows are read again
    except BaseException:
        scratch.drop(folder)
        raise
    return docs
