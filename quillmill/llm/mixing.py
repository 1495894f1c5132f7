"""Mixing sources to target weights by weighted fair queueing.

Every document gets a pseudo-random place in its source. Its virtual finish time is the
source's cumulative words up to and with it, divided by the source's target. All sources
reach their target at virtual time 1, where the words served are the total budget; so the
globally range-sorted sequence is truncated there. A source whose target is above its size
is passed through again: copy e of a document finishes a whole source later than copy e - 1.

The cumulative words come from a prefix scan over pseudo-random buckets (sums of coarse
buckets, of fine buckets, then rows of one fine bucket of about 64 rows), so that no task
sees a source as a whole, however large its share.

Null sources are one source, ordered last; null texts have no words; a source without words
has target 0; a column of the name `mix` is replaced; repeated rows are documents of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 52
ROWS_PER_BUCKET = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(id_: Column, seed: str) -> Column:
    """Uniform in [0, 2**52), from md5, so that reruns and other engines agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, repeats: int) -> DataFrame:
    """sizes: _source, _n (documents), _words, a row for each source.

    Adds _index (1 up, by code point, null last) and _target: the total budget is dealt out by
    weight, a target stops at `repeats` times the source's words, and what is over goes to the
    others by weight. That is one water level: the first in order of words per weight whose
    equal share of what the fuller ones leave stays within its own bound.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_index") - 1) % len(weights) + 1).cast("int"))
    out = sizes.withColumn("_index", F.row_number().over(by_name)).withColumn("_weight", weight)
    out = out.withColumn("_bound", F.col("_words") * float(repeats)).withColumn("_total", F.sum("_words").over(Window.partitionBy()))
    by_level = Window.orderBy(F.col("_bound") / F.col("_weight"), "_index")
    bound = F.coalesce(F.sum("_bound").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("_level", (F.col("_total") * share - bound) / rest)
    fits = F.when(F.col("_level") * F.col("_weight") <= F.col("_bound"), F.struct(F.col("_bound") / F.col("_weight"), "_index", "_level"))
    out = out.withColumn("_level", F.min(fits).over(Window.partitionBy())["_level"])
    target = F.when(F.col("_level").isNull(), F.col("_bound")).otherwise(F.least("_bound", F.col("_level") * F.col("_weight")))
    return out.select("_source", "_index", "_n", "_words", target.alias("_target"))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """docs with a struct column `mix`, in global order of virtual finish time.

    mix: size (words), source_size, target, taken (words over all passes), finish (virtual time
    at which the first copy is served whole; null if the target is 0), start (words of the
    source before the document), key. size: a column with a document's size, the number of
    words in `text` by default.
    """
    docs = docs.drop("mix")
    size = n_words(F.col("text")) if size is None else size
    key = shuffle_key(F.col(id_col), seed)
    narrow = cut(docs.select(F.col(source_col).alias("_source"), size.alias("_size"), key.alias("_key")))
    sums = narrow.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / ROWS_PER_BUCKET))).cast("int")
    sources = small(cut(source_targets(sums, weights, share, repeats).withColumn("_bits", bits)))

    def bucketed(df: DataFrame, source: Column, key: Column) -> DataFrame:
        joined = df.join(sources, source.eqNullSafe(F.col("_source")), "inner")
        return joined.withColumn("_fine", F.expr(f"shiftright({key}, {KEY_BITS} - _bits)"))

    fine = bucketed(narrow.withColumnRenamed("_source", "_s"), F.col("_s"), "_key")
    fine = fine.groupBy("_index", "_fine", F.expr("shiftright(_fine, cast(_bits / 2 as int))").alias("_coarse")).agg(F.sum("_size").alias("_sum"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    coarse = fine.groupBy("_index", "_coarse").agg(F.sum("_sum").alias("_csum"))
    coarse = coarse.withColumn("_cbefore", F.coalesce(F.sum("_csum").over(before("_index", "_coarse")), none)).drop("_csum")
    fine = fine.withColumn("_fbefore", F.coalesce(F.sum("_sum").over(before("_index", "_coarse", "_fine")), none))
    offsets = cut(
        fine.join(coarse, ["_index", "_coarse"]).select(F.col("_index").alias("_oi"), F.col("_fine").alias("_of"), (F.col("_cbefore") + F.col("_fbefore")).alias("_offset"))
    )

    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc"), docs[f"`{source_col}`"].alias("_s"), size.alias("_size"), key.alias("_k"))
    row = bucketed(row, F.col("_s"), "_k")
    row = row.join(offsets, (F.col("_index") == F.col("_oi")) & (F.col("_fine") == F.col("_of")))
    # Rows of one id and size go by their texts, so that reruns agree whatever the partitions.
    tie = F.xxhash64(F.col("_doc")["text"]) if "text" in docs.columns else none
    within = Window.partitionBy("_index", "_fine").orderBy("_k", F.col("_doc")[id_col], "_size", tie).rowsBetween(Window.unboundedPreceding, -1)
    row = row.withColumn("_start", F.col("_offset") + F.coalesce(F.sum("_size").over(within), none))
    finish = F.try_divide(F.col("_start") + F.col("_size"), F.col("_target"))
    taken = sum((served(F.col("_size"), F.col("_start"), F.col("_words"), F.col("_target"), e) for e in range(repeats)), none)
    row = row.select(
        "_doc",
        F.struct(
            F.col("_size").alias("size"), F.col("_words").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"),
            finish.alias("finish"), F.col("_start").alias("start"), F.col("_k").alias("key"),
        ).alias("mix"),
    )
    row = row.repartitionByRange("mix.finish", "mix.key").sortWithinPartitions("mix.finish", "mix.key")
    return row.select("_doc.*", "mix")


def served(size: Column, start: Column, source_size: Column, target: Column, copy: int) -> Column:
    """Words of a document's copy that the mix takes: all if its virtual finish time is at most 1, the time at which the budget is spent; of the copy that is
    being served then, those before; none of later ones."""
    before = start + source_size * copy
    finish, begin = F.try_divide(before + size, target), F.try_divide(before, target)
    rest = F.greatest(F.lit(0).cast("long"), F.floor(target).cast("long") - before)
    return F.when(target <= 0, 0).when(finish <= 1, size).when(begin < 1, F.least(size, rest)).otherwise(0).cast("long")


def mix_schedule(mixed: DataFrame, repeats: int = 2) -> DataFrame:
    """The mix itself: a row for each copy served, in global order of virtual finish time, cut where the budget is spent.

    mixed: result of mix_sources(). Adds `copy` (0 up), `served` (words of this copy within the
    budget: all of them, but for the copy at which a source reaches its target) and `finish`;
    columns of these names and `mix` are replaced, others kept. Documents without words, and
    sources of target 0, are not served; repeated rows are served each for itself; ties in time
    go by the key; an empty table gives an empty table.
    """
    m = F.col("mix")
    copies = [
        F.struct(F.lit(e).alias("copy"), served(m["size"], m["start"], m["source_size"], m["target"], e).alias("served"), (m["finish"] + F.try_divide(e * m["source_size"], m["target"])).alias("finish"))
        for e in range(repeats)
    ]
    rest = [c for c in mixed.columns if c not in ("mix", "copy", "served", "finish")]
    row = F.struct(*[mixed[f"`{c}`"] for c in rest])
    out = mixed.select(row.alias("row"), m["key"].alias("key"), F.explode(F.filter(F.array(*copies), lambda c: c["served"] > 0)).alias("c"))
    out = out.repartitionByRange("c.finish", "key").sortWithinPartitions("c.finish", "key")
    return out.select("row.*", "c.copy", "c.served", "c.finish")
