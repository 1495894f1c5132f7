"""First-wins dedup, SimHash fingerprints and greedy near-duplicate removal."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import text as T
from ..session import broadcast_if_small, materialized
from .hamming import near_fingerprints

NEAR_BITS = 12


def first_wins(df: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """df (narrow) with a boolean column: whether the row is the first of its key.

    order: columns in which no two rows of a key are equal. Equal keys are summed up before they are
    shuffled, and only keys that occur again are sent back to the rows, so a key's rows never meet in one task.
    """
    kept = materialized(df)
    return _flagged(kept, kept, key, order, flag)


def first_rows(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key of a wide df, which is computed twice; order as for first_wins()."""
    keyed = df.withColumn("_key", key)
    narrow = materialized(keyed.select("_key", *order))
    return _flagged(keyed, narrow, "_key", order, "_is_first").filter("_is_first").drop("_key", "_is_first")


def _flagged(rows: DataFrame, narrow: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    place = F.col(f"`{order[0]}`") if len(order) == 1 else F.struct(*order)
    again = narrow.groupBy(F.col(key).alias("_k")).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    again = broadcast_if_small(materialized(again.drop("_n")))
    out = rows.join(again, rows[key].eqNullSafe(again["_k"]), "left")
    return out.select(*[rows[f"`{c}`"] for c in rows.columns], (F.col("_first").isNull() | (place == F.col("_first"))).alias(flag))


def duplicate_groups(df: DataFrame, key: Column, member: str) -> DataFrame:
    """digest and its sorted members, of digests with more than one."""
    groups = df.groupBy(key.alias("digest")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    return groups.filter(F.size("members") > 1)


def fingerprint_of(text: str | None, width: int = 3, at_once: int = 1 << 16) -> int:
    """64 bits, as a signed number; counts of bits are kept by plane, so a text takes memory for `at_once` digests only."""
    words = (text or "").lower().split()
    if not words:
        return -1
    shingles = max(1, len(words) - width + 1)
    # A shingle is a part of the words joined by single spaces.
    joined = " ".join(words).encode("utf-8", "surrogatepass")
    starts = np.append(0, np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1)
    ends = np.append(starts[width:] - 1, len(joined))
    counts = np.zeros(64, np.int64)
    for first in range(0, shingles, at_once):
        last = min(shingles, first + at_once)
        digests = b"".join([sha256(joined[a:b]).digest() for a, b in zip(starts[first:last].tolist(), ends[first:last].tolist(), strict=True)])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 32)[:, :8], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts >= shingles).tobytes(), "big", signed=True)


@F.arrow_udf(LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """SimHash of each text: there is no built-in that adds up bits within a row, and with rows of shingles the sums must be shuffled."""
    return pa.array([fingerprint_of(t) for t in texts.to_pylist()], pa.int64())


def simhash(df: DataFrame, id_col: str, text: Column, out: str = "fp") -> DataFrame:
    """id_col and a 64-bit fingerprint: bit i is set if at least half of the shingles' digests have it.

    Words are lower-cased and parted by white space; shingles have three of them, or are the whole of a shorter
    text. A text without words has all bits set. Nothing is shuffled.
    """
    return df.select(F.col(id_col), fingerprint(text).alias(out))


def near_pairs(fps: DataFrame, id_col: str, fp: str = "fp", most: int = NEAR_BITS) -> DataFrame:
    """(a, b, distance) with a < b and at most `most` differing bits. Equal fingerprints are one on the way."""
    distinct = materialized(fps.select(F.col(fp).alias("f")).filter("f is not null").distinct())
    close = near_fingerprints(distinct, "f", most).select("f", "g")
    near = close.unionByName(close.select(F.col("f").alias("g"), F.col("g").alias("f"))).unionByName(distinct.select("f", F.col("f").alias("g")))
    left = fps.select(F.col(id_col).alias("a"), F.col(fp).alias("f"))
    right = fps.select(F.col(id_col).alias("b"), F.col(fp).alias("g"))
    pairs = left.join(near, "f").join(right, "g").filter(F.col("a") < F.col("b"))
    return pairs.select("a", "b", T.hamming(F.col("f"), F.col("g")).alias("distance"))


def greedy_drops(pairs: DataFrame) -> DataFrame:
    """Ids that a pass in order would drop: those near an earlier one that is kept.

    pairs: (a, b), a before b. In each round an id goes if an earlier neighbour is kept, and is
    kept if all its earlier neighbours have gone.
    """
    edges = materialized(pairs.select("a", "b"))
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    state = materialized(ids.join(edges.select(F.col("b").alias("id")).distinct().withColumn("_later", F.lit(1)), "id", "left").select("id", F.when(F.col("_later").isNull(), "kept").otherwise("open").alias("state")))
    while state.filter("state = 'open'").limit(1).count():
        seen = edges.join(state.select(F.col("id").alias("a"), F.col("state").alias("_s")), "a").groupBy(F.col("b").alias("id"))
        seen = seen.agg(F.max(F.col("_s") == "kept").alias("_hit"), F.min(F.col("_s") == "gone").alias("_free"))
        step = state.join(seen, "id", "left")
        state = materialized(step.select("id", F.when(F.col("state") != "open", F.col("state")).when(F.col("_hit"), "gone").when(F.col("_free"), "kept").otherwise("open").alias("state")))
    return state.filter("state = 'gone'").select("id")
