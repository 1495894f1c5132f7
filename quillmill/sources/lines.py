"""Lines of text files with their numbers, read in splits: neither a file nor its lines need fit in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import broadcast_if_small, materialized

#: What ends a line beside \n, \r and \r\n, where all of Python's line boundaries count.
MORE_BOUNDARIES = "[\x0b\x0c\x1c\x1d\x1e\x85  ]"


def glob_of(suffixes: tuple[str, ...]) -> str:
    """Pattern of file names with one of the suffixes, in any case."""
    either = lambda s: "*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)
    return "{" + ",".join(map(either, suffixes)) + "}"


def without_bad_bytes(line: Column) -> Column:
    """UTF-8 without the bytes that are not (a line that has such also loses its characters U+FFFD)."""
    return F.when(F.is_valid_utf8(line), line).otherwise(F.replace(F.make_valid_utf8(line), F.lit("�"), F.lit("")))


def numbered_lines(spark: SparkSession, path: str, *, suffixes: tuple[str, ...] = (), every_boundary: bool = False) -> DataFrame:
    """path, block (where the line's split begins), line_no (1 up in its file), line, of a file or of all files below a folder; blank lines are numbered too.

    A split's lines are in order in its task; the lines of a file's earlier splits are counted and added.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob_of(suffixes)) if suffixes else reader
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), without_bad_bytes(F.col("value")).alias("_text"))
    pieces = F.split("_text", MORE_BOUNDARIES) if every_boundary else F.array("_text")
    raw = raw.select("path", "_block", F.monotonically_increasing_id().alias("_at"), pieces.alias("_lines"))
    counts = raw.groupBy("path", "_block").agg(F.sum(F.size("_lines")).alias("_n"))
    zero = F.lit(0).cast("long")
    earlier = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("path", "_block", F.coalesce(F.sum("_n").over(earlier), zero).alias("_before"))
    within = Window.partitionBy("path", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = raw.withColumn("_inside", F.coalesce(F.sum(F.size("_lines")).over(within), zero)).join(broadcast_if_small(materialized(counts)), ["path", "_block"])
    rows = rows.select("path", F.col("_block").alias("block"), (F.col("_before") + F.col("_inside")).alias("_first"), F.posexplode("_lines").alias("_p", "line"))
    return rows.select("path", "block", (F.col("_first") + F.col("_p") + 1).alias("line_no"), "line")


def with_next_filled(lines: DataFrame) -> DataFrame:
    """Filled lines (collapsed) with place (1 up among the filled lines of their file) and following, the next of them.

    Lines meet their neighbours within their split. What the splits of a file have to tell each other is a row
    each: how many filled lines they have, and the first of them.
    """
    rows = lines.withColumn("line", T.collapse(F.col("line"))).filter("line <> ''")
    inside = Window.partitionBy("relative", "block").orderBy("line_no")
    rows = rows.withColumn("_n", F.row_number().over(inside)).withColumn("_next", F.lead("line").over(inside))
    edges = rows.groupBy("relative", "block").agg(F.max("_n").alias("_filled"), F.min_by("line", "line_no").alias("_first"))
    splits = Window.partitionBy("relative").orderBy("block")
    edges = edges.select(
        "relative", "block", F.coalesce(F.sum("_filled").over(splits.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(splits).alias("_after")
    )
    rows = rows.join(broadcast_if_small(materialized(edges)), ["relative", "block"])
    return rows.select("relative", "line_no", "line", (F.col("_before") + F.col("_n")).alias("place"), F.coalesce("_next", "_after").alias("following"))


def with_quote_state(lines: DataFrame) -> DataFrame:
    """lines with quoted: whether a quoted field of an earlier line goes on at the line's start.

    lines: relative, block, line_no, and from_open and from_closed: whether a field is left open at the line's
    end, if one was, or none was, open at its start. A line's effect is to leave the state, to turn it, or to
    set it; what is set last and how often it is turned since is known within a split, and a row for each
    split tells the state at its start.
    """
    fixed = F.col("from_open") == F.col("from_closed")
    turns = (F.col("from_closed") & ~F.col("from_open")).cast("int")
    inside = Window.partitionBy("relative", "block").orderBy("line_no")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("_turns", F.sum(turns).over(inside))
    rows = rows.withColumn("_set", F.when(fixed, F.struct(F.col("from_open").alias("to"), F.col("_turns").alias("at"))))
    rows = rows.withColumn("_last", F.last("_set", ignorenulls=True).over(before)).withColumn("_seen", F.coalesce(F.lag("_turns").over(inside), F.lit(0)))
    ends = rows.groupBy("relative", "block").agg(F.max_by(F.struct("_turns", F.coalesce("_set", "_last").alias("s")), "line_no").alias("_e"))
    turned = lambda state, n: F.when(n % 2 == 1, ~state).otherwise(state)
    effect = F.when(F.col("_e.s").isNotNull(), F.struct(turned(F.col("_e.s.to"), F.col("_e._turns") - F.col("_e.s.at")).alias("to")))
    ends = ends.select("relative", "block", effect.alias("_effect"), F.col("_e._turns").alias("_t"))
    splits = Window.partitionBy("relative").orderBy("block")
    ends = ends.withColumn("_sum", F.sum(F.when(F.col("_effect").isNull(), F.col("_t")).otherwise(0)).over(splits))
    known = F.when(F.col("_effect").isNotNull(), F.struct(F.col("_effect.to").alias("to"), F.col("_sum").alias("at")))
    ends = ends.withColumn("_known", known).withColumn("_k", F.last("_known", ignorenulls=True).over(splits.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("_so_far", F.coalesce(F.lag("_sum").over(splits), F.lit(0)))
    start = turned(F.coalesce(F.col("_k.to"), F.lit(False)), F.col("_so_far") - F.coalesce(F.col("_k.at"), F.lit(0)))
    rows = rows.join(broadcast_if_small(materialized(ends.select("relative", "block", start.alias("_start")))), ["relative", "block"])
    state = F.when(F.col("_last").isNotNull(), turned(F.col("_last.to"), F.col("_seen") - F.col("_last.at"))).otherwise(turned(F.col("_start"), F.col("_seen")))
    return rows.select(*[F.col(c) for c in lines.columns], state.alias("quoted"))


def counted(rows: DataFrame, flag: Column, out: str) -> DataFrame:
    """rows (relative, block, line_no) with the number of flagged rows of their file up to them, by sums of splits."""
    inside = Window.partitionBy("relative", "block").orderBy("line_no")
    rows = rows.withColumn("_c", F.sum(flag.cast("long")).over(inside))
    splits = Window.partitionBy("relative").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("relative", "block").agg(F.max("_c").alias("_n")).select("relative", "block", F.coalesce(F.sum("_n").over(splits), F.lit(0).cast("long")).alias("_before"))
    rows = rows.join(broadcast_if_small(materialized(sums)), ["relative", "block"])
    return rows.withColumn(out, F.col("_before") + F.col("_c")).drop("_before", "_c")
