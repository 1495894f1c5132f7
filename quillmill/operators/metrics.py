"""Evaluation figures and filters of next-token candidates."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_loss(losses: Column) -> Column:
    """Of batch means, each counted once."""
    return F.avg(losses)


def masked_mean(losses: Column, labels: Column, ignored: int = -100) -> Column:
    """Mean loss of the positions whose label counts; null if none does."""
    return F.avg(F.when(labels != ignored, losses))


def model_size(shapes: dict[str, tuple[int, ...]], bytes_each: int = 4) -> dict[str, float]:
    """Parameters, and the MB they take, of a model's arrays by their shapes."""
    n = sum(math.prod(s) for s in shapes.values())
    return {"parameters": n, "megabytes": n * bytes_each / (1 << 20)}


def perplexity(mean: Column, most: float | None = None) -> Column:
    return F.exp(mean if most is None else F.least(mean, F.lit(most)))


def evaluation(windows: DataFrame, loss: Callable[[Column, Column], Column], *, batch_size: int = 8, most: float | None = None) -> DataFrame:
    """One row: sequences, batches, loss and perplexity of a model over windows (k, input_ids, target_ids).

    loss: the model's mean loss of a window, of its inputs and targets. Windows make batches by their
    numbers; each batch counts once, as the last may be smaller. Fails if there is no window.
    """
    if batch_size <= 0:
        raise ValueError("the batch size must be positive")
    batches = windows.groupBy(F.floor(F.col("k") / batch_size).alias("_b")).agg(F.avg(loss(F.col("input_ids"), F.col("target_ids"))).alias("_l"), F.count(F.lit(1)).alias("_n"))
    out = batches.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("sequences"), F.count(F.lit(1)).alias("batches"), mean_loss(F.col("_l")).alias("loss"))
    none = F.raise_error(F.lit("the split has no complete sequence")).cast("long")
    return out.select(F.when(F.col("sequences") > 0, F.col("sequences")).otherwise(none).alias("sequences"), "batches", "loss", perplexity(F.col("loss"), most).alias("perplexity"))


def top_k(logits: DataFrame, k: int, row: str = "row", logit: str = "logit") -> DataFrame:
    """Candidates at least as likely as the k-th of their row; ties stay."""
    by = Window.partitionBy(row).orderBy(F.desc(logit))
    return logits.withColumn("_r", F.rank().over(by)).filter(F.col("_r") <= k).drop("_r")


def nucleus(logits: DataFrame, p: float, row: str = "row", logit: str = "logit", tie: str = "token") -> DataFrame:
    """The likeliest candidates up to and with the first at which their probabilities pass p."""
    best = F.max(logit).over(Window.partitionBy(row))
    weight = logits.withColumn("_e", F.exp(F.col(logit) - best))
    share = weight.withColumn("_p", F.col("_e") / F.sum("_e").over(Window.partitionBy(row)))
    before = Window.partitionBy(row).orderBy(F.desc(logit), tie).rowsBetween(Window.unboundedPreceding, -1)
    return share.filter("true").withColumn("_b", F.coalesce(F.sum("_p").over(before), F.lit(0.0))).filter(F.col("_b") <= p).drop("_e", "_p", "_b")
