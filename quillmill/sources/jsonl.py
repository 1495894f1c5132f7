"""Strict JSON-lines loaders: the first bad line fails the load with its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import records
from ..session import materialized
from .lines import numbered_lines

FIELDS = "instruction string, input string, response string, category string, source string"


def load(spark: SparkSession, path: str, *, categories: tuple[str, ...], duplicates: str = "error", keep: tuple[str, ...] | None = None) -> DataFrame:
    """line_no, instruction, input, response, category, source, with every record checked.

    duplicates: `error`, or `first` to keep the first of each. keep: categories to return, after all checks.
    """
    lines = numbered_lines(spark, path).drop("path").filter(T.strip(F.col("line")) != "")
    parsed = materialized(lines).withColumn("_r", F.from_json("line", FIELDS, {"mode": "PERMISSIVE"}))
    json_ok = F.try_parse_json("line").isNotNull()
    why = records.problem(F.col("_r.instruction"), F.col("_r.input"), F.col("_r.response"), F.col("_r.category"), categories)
    parsed = parsed.withColumn("_why", F.when(~json_ok, F.lit("not JSON")).otherwise(why))
    bad = parsed.filter("_why is not null").orderBy("line_no").limit(1).collect()
    if bad:
        raise ValueError(f"{path}, line {bad[0]['line_no']}: {bad[0]['_why']}")
    out = parsed.select("line_no", *[T.strip(F.col(f"_r.{f}")).alias(f) for f in ("instruction", "input", "response", "category")], F.col("_r.source").alias("source"))
    first = records.distinct_records(out, ["line_no"])
    if duplicates == "error":
        again = out.join(first.select("line_no"), "line_no", "left_anti").agg(F.min("line_no")).first()[0]
        if again is not None:
            raise ValueError(f"{path}, line {again}: duplicate")
    out = first
    if not out.limit(1).count():
        raise ValueError(f"{path} holds no record")
    return out.filter(F.col("category").isin(*keep)) if keep else out


def sharded(spark: SparkSession, folder: str, split: str, categories: tuple[str, ...] | None = None) -> DataFrame:
    """Records of all `split`-*.jsonl files of a folder."""
    rows = spark.read.json(f"{folder.rstrip('/')}/{split}-*.jsonl")
    return rows.filter(F.col("category").isin(*categories)) if categories else rows
