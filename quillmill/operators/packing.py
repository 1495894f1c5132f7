"""Token windows for training: language-model windows, sequence pairs, masked examples, padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import running_total

IGNORED = -100


def _pieces(tokens: DataFrame, order: list[str], width: int, stride: int, by: str | None) -> DataFrame:
    """by (if given), k, start, all: complete windows of `width` tokens, k times `stride` into the stream.

    tokens: order columns, ids (array of int), and by. A row gives each window it overlaps the
    slice that falls in it; a window is the slices of its rows in order, at most `width` tokens.
    """
    if stride > width:
        raise ValueError(f"a stride of {stride} would leave tokens between windows of {width} unread")
    group = [by] if by else []
    # Rows keep their tokens; only their lengths go through the scan.
    sized = tokens.select(*group, *order, F.size("ids").cast("long").alias("_n")).filter("_n > 0")
    placed = running_total(sized, order, "_n", "_o", by=by)
    rows = tokens.join(placed, [*group, *order])
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_o") - width + 1) / stride))
    last = F.floor((F.col("_o") + F.col("_n") - 1) / stride)
    cut = rows.select(*group, "_o", "_n", "ids", F.explode(F.sequence(first, last)).alias("k")).withColumn("_s", F.col("k") * stride)
    head = F.greatest(F.lit(0).cast("long"), F.col("_s") - F.col("_o"))
    stop = F.least(F.col("_n"), F.col("_s") + width - F.col("_o"))
    cut = cut.filter(stop > head).select(*group, "k", "_o", F.slice("ids", (head + 1).cast("int"), (stop - head).cast("int")).alias("_part"))
    whole = cut.groupBy(*group, "k").agg(F.array_sort(F.collect_list(F.struct("_o", "_part"))).alias("_parts"))
    whole = whole.select(*group, "k", F.flatten(F.transform("_parts", lambda p: p["_part"])).alias("all"))
    return whole.filter(F.size("all") == width)


def lm_windows(tokens: DataFrame, order: list[str], context: int, stride: int, by: str | None = None) -> DataFrame:
    """k, input_ids and target_ids (shifted by one), for each complete window of the stream of all rows."""
    out = _pieces(tokens, order, context + 1, stride, by)
    return out.select(*([by] if by else []), "k", F.slice("all", 1, context).alias("input_ids"), F.slice("all", 2, context).alias("target_ids"))


def seq2seq_windows(tokens: DataFrame, order: list[str], context: int, bos: int, eos: int, by: str | None = None) -> DataFrame:
    """k, source, decoder_input and target: pairs of neighbouring windows; each row is followed by eos."""
    ended = tokens.filter(F.size("ids") > 0).withColumn("ids", F.concat("ids", F.array(F.lit(eos))))
    out = _pieces(ended, order, 2 * context, context, by)
    target = F.slice("all", context + 1, context)
    decoder = F.concat(F.array(F.lit(bos)), F.slice(target, 1, context - 1))
    return out.select(*([by] if by else []), "k", F.slice("all", 1, context).alias("source"), decoder.alias("decoder_input"), target.alias("target"))


def masked_example(prompt: Column, response: Column, context: int) -> tuple[Column, Column]:
    """(inputs, labels) of prompt and response ids: the prompt loses its head, or all of it and the response its head, to fit."""
    most = context + 1
    long = F.size(response) >= most
    tail = F.slice(response, -most, most)
    room = F.lit(most) - F.size(response)
    kept = F.when(long, F.array().cast("array<int>")).when(F.size(prompt) > room, F.slice(prompt, F.size(prompt) - room + 1, room)).otherwise(prompt)
    ids = F.concat(kept, F.when(long, tail).otherwise(response))
    masked = F.greatest(F.lit(0), F.size(kept) - 1)
    labels = F.transform(F.slice(ids, 2, F.size(ids)), lambda x, i: F.when(i < masked, F.lit(IGNORED)).otherwise(x))
    return F.slice(ids, 1, F.size(ids) - 1), labels


def padded(examples: DataFrame, batch: str, inputs: str = "inputs", labels: str = "labels", pad: int = 0) -> DataFrame:
    """examples with both arrays filled to the longest of their batch; labels with the ignored one."""
    longest = F.max(F.size(inputs)).over(Window.partitionBy(batch))
    out = examples.withColumn("_m", longest)
    fill = lambda c, x: F.concat(c, F.array_repeat(F.lit(x), F.col("_m") - F.size(c)))
    return out.withColumn(inputs, fill(F.col(inputs), pad)).withColumn(labels, fill(F.col(labels), IGNORED)).drop("_m")
