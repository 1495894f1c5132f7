"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents.

A window is 10 consecutive words of an item (a shorter item is one window). Words are ordered
by rarity over all documents. A window can only occur where its rarest word does, so that
word is its prefix: document words are joined with the prefix words, the second-rarest word
and the positional and length bounds are tested at once, and then the window is compared
with the document's words at that place. Only DataFrame functions are used.

The window table is broadcast only after its rows and bytes were found within bounds; a larger one is
joined by shuffle: document words meet it by word, and the candidates meet the documents
again by row key for verification.

Null and wordless texts have no words and hit nothing. Null item ids count as hits but not
as items. Repeated item rows are one item. Repeated document rows are returned as often as
they occur. Empty tables give empty or all-clean results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, fits

#: Between words, once A-Z is lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, GAP), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """Distinct windows: win (array of words), items (sorted ids as strings)."""
    w = F.col("_w")
    each = F.when(
        F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - width + 1)), lambda i: F.slice(w, i, width))
    ).otherwise(F.array(w))
    out = items.select(F.col(item_col).cast("string").alias("_item"), words(F.col(text_col)).alias("_w"))
    out = out.filter(F.size("_w") > 0).select("_item", F.explode(each).alias("win"))
    return out.groupBy("win").agg(F.array_sort(F.collect_set("_item")).alias("items"))


def with_prefix(wins: DataFrame, docs: DataFrame, text_col: str, broadcast_rows: int) -> DataFrame:
    """wins with tok, off (rarest word and its place), tok2, off2 (second-rarest; null if there is none).

    Windows with a word that no document has are dropped: they occur nowhere.
    """
    vocab = cut(wins.select(F.explode("win").alias("_v")).distinct())
    seen = docs.select(F.explode_outer(words(F.col(text_col))).alias("_v"))
    if fits(vocab, broadcast_rows):
        seen = seen.join(F.broadcast(vocab), "_v", "left_semi").groupBy("_v").agg(F.count(F.lit(1)).alias("_f"))
    else:
        seen = seen.groupBy("_v").agg(F.count(F.lit(1)).alias("_f")).join(vocab, "_v", "left_semi")
    each = wins.select("win", F.posexplode("win").alias("_p", "_v")).join(cut(seen), "_v", "left")
    ranked = each.groupBy("win").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("_v").alias("v"), F.col("_p").alias("p")))).alias("_r")
    )
    ranked = ranked.filter(F.col("_r")[0]["f"] > 0).select(
        "win", F.col("_r")[0]["v"].alias("tok"), F.col("_r")[0]["p"].alias("off"), F.get("_r", F.lit(1))["v"].alias("tok2"), F.get("_r", F.lit(1))["p"].alias("off2")
    )
    return ranked.join(wins, "win").withColumn("len", F.size("win"))


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """A row for each document: id, _h (hash of its text), n_words, n_hit, spans, items.

    spans: sorted [first word, one past the last) of the occurrences; items: sorted ids.
    """
    wins = cut(windows(items, item_col, item_text_col, width))
    pref = cut(with_prefix(wins, docs, text_col, broadcast_rows))
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"), words(F.col(text_col)).alias("_w"))

    at = F.col("_p") - F.col("off")
    bounds = (at >= 0) & (at + F.col("len") <= F.col("_n"))
    second = F.col("tok2").isNull() | (F.get("_w", at + F.col("off2")) == F.col("tok2"))
    same = F.slice("_w", at + 1, F.col("len")) == F.col("win")
    span = F.when(F.col("win").isNotNull(), F.struct(at.cast("int").alias("first"), (at + F.col("len")).cast("int").alias("last")))
    head = F.coalesce(F.col("_p"), F.lit(0)) == 0
    if fits(pref, broadcast_rows):
        # The word at place 0 stands for the document itself, so one pass gives clean documents too.
        rows = base.select("_id", "_h", "_w", F.size("_w").alias("_n"), F.posexplode_outer("_w").alias("_p", "_v"))
        rows = rows.join(F.broadcast(pref), (F.col("_v") == F.col("tok")) & bounds & second & same, "left")
        rows = rows.filter(head | F.col("win").isNotNull())
        rows = rows.select("_id", "_h", "_n", "_p", span.alias("_span"), "items")
        # Windows of several lengths may start at place 0; a repeated row has each of them as often as it occurs.
        rows = rows.withColumn("_copies", F.when(head, F.coalesce("_span.last", F.lit(0))))
    else:
        marks = base.select("_id", "_h", F.size("_w").alias("_n"), F.lit(0).alias("_p"), F.lit(None).cast("struct<first:int,last:int>").alias("_span"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).alias("_copies"))
        cand = base.select("_id", "_h", F.size("_w").alias("_n"), F.posexplode_outer("_w").alias("_p", "_v")).join(pref, (F.col("_v") == F.col("tok")) & bounds)
        cand = cand.select("_id", "_h", "_p", "off", "tok2", "off2", "len", "win", "items").distinct()
        whole = base.dropDuplicates(["_id", "_h"]).select(F.col("_id").alias("_i2"), F.col("_h").alias("_h2"), "_w", F.size("_w").alias("_n"))
        found = cand.join(whole, F.col("_id").eqNullSafe(F.col("_i2")) & F.col("_h").eqNullSafe(F.col("_h2")) & second & same)
        rows = marks.unionByName(found.select("_id", "_h", "_n", "_p", span.alias("_span"), "items", F.lit(None).cast("int").alias("_copies")))
    out = rows.groupBy("_id", "_h").agg(
        F.max("_n").alias("n_words"),
        F.array_sort(F.collect_set("_span")).alias("spans"),
        F.collect_set("items").alias("_items"),
        F.count("_copies").alias("_heads"),
        F.size(F.collect_set("_copies")).alias("_kinds"),
    )
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach"))
    step = lambda a, s: F.struct(
        (a["hit"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["reach"], s["first"]))).alias("hit"), F.greatest(a["reach"], s["last"]).alias("reach")
    )
    copies = F.sequence(F.lit(1), (F.col("_heads") / F.col("_kinds")).cast("int"))
    return out.select(
        F.col("_id").alias(id_col),
        "_h",
        F.col("n_words").cast("long").alias("n_words"),
        F.aggregate("spans", zero, step, lambda a: a["hit"]).cast("long").alias("n_hit"),
        "spans",
        F.array_sort(F.array_distinct(F.flatten("_items"))).alias("items"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")
