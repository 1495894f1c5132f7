"""The instruction builder: curated examples, questions and answers of texts and MedQuAD files, passage audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records, splits
from ..session import materialized
from ..sources import files, formats, jsonl, sinks

# The curated file's name, the instruction of its questions, what a manifest says of the records.
CURATED = "healthcare_examples.jsonl"
MEDQUAD_INSTRUCTION = "Answer the medical question using the provided biomedical source answer."
PROVENANCE = "SFT records come from curated healthcare examples, explicit source Q/A, or answer-bearing MedQuAD Q/A. Passage-copy records are retained only in the in-memory audit corpus."
FIELDS = ("instruction", "input", "response", "category", "source")
ORDER = ["rank", "order", "seq", "category"]


def build_records(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(supervised, audit): records with id, first of each key in the order curated, texts, MedQuAD, passages."""
    found = files.scan(spark, root)
    texts = files.builder_files(spark, root).filter(F.regexp_extract("relative", "[^/]*$", 0) != CURATED)
    path = lambda c: files.path_order(F.col(c)).alias("order")
    pairs = records.question_answers(texts, F.col("text"), min_question=10, min_answer=40)
    pairs = pairs.select(F.lit(1).alias("rank"), path("relative"), F.col("line_no").cast("long").alias("seq"), F.col("relative").alias("_s"), "question", "answer")
    pairs = records.builder_record(pairs, instruction=F.lit(records.SOURCE_INSTRUCTION), input=F.col("question"), response=F.col("answer"), category=F.lit("source_qa"), source=F.col("_s"))
    med = formats.medquad_pairs(found).select(F.lit(2).alias("rank"), path("relative"), "seq", F.col("relative").alias("_s"), "question", "answer")
    med = records.builder_record(med, instruction=F.lit(MEDQUAD_INSTRUCTION), input=F.col("question"), response=F.col("answer"), category=F.lit("medquad_qa"), source=F.col("_s"))
    columns = ["rank", "order", "seq", *FIELDS, "id"]
    rows = pairs.select(columns).unionByName(med.select(columns))
    if found.filter(F.col("relative") == CURATED).limit(1).count():
        mine = jsonl.load(spark, f"{root.rstrip('/')}/{CURATED}", categories=records.SFT_CATEGORIES, duplicates="first")
        mine = mine.select(F.lit(0).alias("rank"), F.array(F.lit(CURATED)).alias("order"), F.col("line_no").cast("long").alias("seq"), *[F.col(f).alias(f"_{f}") for f in FIELDS])
        mine = records.builder_record(mine, **{f: F.coalesce(F.col(f"_{f}"), F.lit(CURATED)) if f == "source" else F.col(f"_{f}") for f in FIELDS})
        rows = mine.select(columns).unionByName(rows)
    supervised = materialized(records.distinct_records(rows, ORDER))
    chunks = records.paragraph_chunks(texts.select("relative", "text"), F.col("text")).select(F.lit(3).alias("rank"), path("relative"), F.col("chunk_no").alias("seq"), F.col("relative").alias("_s"), "chunk")
    passages = records.passage_records(chunks, F.col("_s")).select(columns)
    audit = materialized(records.distinct_records(supervised.unionByName(passages), ORDER))
    if records.missing_from(supervised, audit).limit(1).count():
        raise ValueError("the audit set lacks a supervised record")
    return supervised, audit


def build(spark: SparkSession, root: str, folder: str, least: int = 100) -> dict:
    """Writes the supervised records by split, reads them back, and gives the manifest's figures."""
    supervised, audit = build_records(spark, root)
    n = supervised.count()
    if n < least:
        raise ValueError(f"{n} supervised records are fewer than {least}")
    placed = splits.count_split(supervised.select("id"), ["id"])
    supervised.select(*FIELDS, "id").join(placed, "id").write.mode("overwrite").partitionBy("split").json(f"{folder}/records")
    written = spark.read.json(f"{folder}/records")
    sinks.verify(written, n)
    kinds = F.array(F.struct(F.lit("split").alias("k"), F.col("split").alias("v")), F.struct(F.lit("category").alias("k"), F.col("category").alias("v")))
    found = {(r["k"], r["v"]): r["count"] for r in written.select(F.explode(kinds).alias("_")).groupBy("_.k", "_.v").count().collect()}
    counts = {
        "source_root": root,
        "supervised_total": n,
        **{s: found.get(("split", s), 0) for s in ("train", "validation", "test")},
        "supervised_categories": {v: c for (k, v), c in sorted(found.items()) if k == "category"},
        "passage_copy_total": audit.filter(~F.col("category").isin(*records.SFT_CATEGORIES)).count(),
        "sft_categories": sorted(records.SFT_CATEGORIES),
        "duplicate_examples": 0,
        "provenance": PROVENANCE,
    }
    sinks.write_manifest(spark, f"{folder}/manifest.json", counts)
    return counts
