"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

The presence of each hashed n-gram is multiplied by the log ratio of its shares in toxic and
other texts, and a logistic regression is fitted on that. Scoring covers whole texts.

The model is fitted on a bounded sample of the labelled rows: of each class about
`sample_chars` characters in hash order of the id (all while there are fewer). A document with
several labels is toxic if one says so; null labels say nothing. Without rows of both classes
every score is the share of toxic ones, held to 0.01 to 0.99. Null and empty texts get the
score of no n-grams but the text's bounds. Repeated rows are scored each for itself; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import arrow_bounds, bounded_sample, cut, small

SAMPLE_CHARS = 6_000_000
LENGTHS = (4, 5, 6, 8)
BITS = 22
THRESHOLD = 0.7


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_chars: int = SAMPLE_CHARS) -> linear.LinearModel:
    """labels: id_col and label_col (0 or 1)."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).filter("_id is not null and _y is not null")
    marks = small(cut(marks.groupBy("_id").agg(F.max("_y").alias("_y"))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(marks, F.col("id") == F.col("_id"))
    rows = bounded_sample(rows.select("id", "text", "_y"), "id", "text", "_y", sample_chars).toArrow().to_pandas().sort_values(["id", "text"])
    features = linear.Features(LENGTHS, BITS)
    return linear.fit(features, rows["text"].tolist(), (rows["_y"] > 0).to_numpy(np.float64), naive_bayes=True)


def score_texts(docs: DataFrame, model: linear.LinearModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, from 0 to 1."""
    arrow_bounds(docs.sparkSession)
    names = [c for c in docs.columns if c != score_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            scores = [known.score(t) for t in batch.column(names.index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, score_col])

    kept = docs.select(*[docs[f"`{c}`"] for c in names])
    return kept.mapInArrow(score, kept.withColumn(score_col, F.lit(0.0).cast("double")).schema)
