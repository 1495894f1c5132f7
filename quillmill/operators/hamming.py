"""All pairs of 64-bit fingerprints within a Hamming distance, exactly.

If 64 bits differ in at most `most` places, then of four blocks of 16 bits one, the i-th, differs in no more
than (most - i) // 4 of its own (pigeonhole: if all differed in more, that were over `most`). So a fingerprint is
kept under four rotations, each beginning with another block, and compared with those above it whose first
bits are within the block's share. Fingerprints are dealt by ranges of their first bits (few, as each is sent
to all ranges that it reaches), full ranges in parts. Within a range they are sorted, so those of equal first
bits lie together, and the more there are, the more first bits are used.

Tries by byte, with chains of blocks, let fewer pairs come to be compared whole but take far longer for each: they are
kept as another way to the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialized

BLOCKS, BLOCK_BITS, BYTES = 4, 16, 8
#: Fingerprints in a range, about, while there are few; bits that part the ranges at most; fingerprints of a range kept in a task.
TRIE_SIZE, MOST_RANGE_BITS, PART_SIZE = 1 << 14, 5, 1 << 18
#: Fingerprints of equal first bits, about; pairs compared at once.
BUCKET, AT_ONCE = 32, 1 << 17


def shares(most: int) -> list[int]:
    """At most how many bits of its first 1 to 8 bytes a chain may have different: the share of the blocks begun."""
    return [(i // 2 + 1) * most // BLOCKS for i in range(BYTES)]


class Trie:
    """Sorted fingerprints; the nodes of a level are the ranges that are equal up to a byte."""

    def __init__(self, fingerprints: np.ndarray):
        self.values = np.unique(fingerprints)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # of each level: bytes of its nodes, and each parent's first node
        parents = np.zeros(1, np.int64)
        for i in range(BYTES):
            shift = np.uint64(56 - 8 * i)
            prefix = self.values >> shift
            starts = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
            self.levels.append(((prefix[starts] & np.uint64(255)).astype(np.uint8), np.append(np.searchsorted(starts, parents), len(starts))))
            parents = starts

    def near(self, asked: np.ndarray, limits: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
        """Places in asked and values that keep every limit; and how many pairs came as far as the last block."""
        probe, node, distance, beyond = np.arange(len(asked)), np.zeros(len(asked), np.int64), np.zeros(len(asked), np.uint8), 0
        for i, ((tokens, first), limit) in enumerate(zip(self.levels, limits, strict=True)):
            beyond += len(probe) if i == 6 else 0
            n = first[node + 1] - first[node]
            parent = np.repeat(np.arange(len(node)), n)
            child = np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n) + first[node][parent]
            byte = ((asked >> np.uint64(56 - 8 * i)) & np.uint64(255)).astype(np.uint8)
            far = distance[parent] + np.bitwise_count(tokens[child] ^ byte[probe[parent]])
            kept = far <= limit
            probe, node, distance = probe[parent[kept]], child[kept], far[kept]
        return probe, self.values[node], beyond


def first_start(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """For pairs within `most` bits: the first block, from the top, from which on each chain keeps its share."""
    blocks = np.stack([np.bitwise_count((a ^ b) >> np.uint64(48 - BLOCK_BITS * i) & np.uint64(0xFFFF)) for i in range(BLOCKS)]).astype(np.int64)
    chains = np.stack([np.cumsum(np.roll(blocks, -i, axis=0), axis=0) for i in range(BLOCKS)])
    limit = np.array([(i + 1) * most // BLOCKS for i in range(BLOCKS)])[None, :, None]
    return (chains <= limit).all(axis=1).argmax(axis=0)


def turned(values: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """Rotated to the left."""
    bits = np.asarray(bits, np.uint64)
    return np.where(bits % 64 == 0, values, (values << (bits % 64)) | (values >> ((64 - bits) % 64)))


def block_shares(most: int) -> list[int]:
    """In at most how many bits one of the blocks differs; less than none if it need not be looked at."""
    return [(most - i) // BLOCKS for i in range(BLOCKS)]


def first_block(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """For pairs within `most` bits: the first block, from the top, that keeps its share."""
    blocks = np.stack([np.bitwise_count((a ^ b) >> np.uint64(48 - BLOCK_BITS * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(BLOCKS)])
    return (blocks <= np.array(block_shares(most))[:, None]).argmax(axis=0)


def flips(width: int, most: int) -> list[int]:
    """Numbers of `width` bits of which at most `most` are set."""
    return [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(width), k)]


class Buckets:
    """Sorted fingerprints of a range (equal in their first `bits` bits); those that are equal in `width` bits lie together."""

    def __init__(self, fingerprints: np.ndarray, bits: int, width: int):
        self.values = np.unique(fingerprints)
        self.shift, self.within = np.uint64(64 - width), width - bits
        prefix = (self.values >> self.shift).astype(np.int64)
        self.range = int(prefix[0]) >> self.within
        self.starts = np.searchsorted(prefix, (self.range << self.within) + np.arange((1 << self.within) + 1))
        self.masks: dict[int, np.ndarray] = {}

    def near(self, asked: np.ndarray, share: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of one of asked (sorted) and a larger value, within `most` bits, of the first `width` bits within `share`."""
        prefix = (asked >> self.shift).astype(np.int64)
        edges = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])).tolist()
        for a, b in zip(edges, [*edges[1:], len(asked)], strict=True):
            own = int(prefix[a])
            other = own >> self.within ^ self.range
            room = share - other.bit_count()
            if room < 0:
                continue
            if room not in self.masks:
                self.masks[room] = np.array(flips(self.within, room))
            at = (own & ((1 << self.within) - 1)) ^ self.masks[room]
            if not other:
                at = at[at >= own & ((1 << self.within) - 1)]
            first = self.starts[at]
            n = self.starts[at + 1] - first
            ends = np.cumsum(n)
            if not ends[-1]:
                continue
            reached = self.values[np.repeat(first - ends + n, n) + np.arange(ends[-1])]
            for c in range(0, len(reached), AT_ONCE):
                some = reached[c : c + AT_ONCE]
                rows = max(1, AT_ONCE // len(some))
                for d in range(a, b, rows):
                    mine = asked[d : min(b, d + rows)]
                    hit = np.flatnonzero(np.bitwise_count(mine[:, None] ^ some) <= most)
                    f, g = mine[hit // len(some)], some[hit % len(some)]
                    yield f[f < g], g[f < g]


def near_fingerprints(distinct: DataFrame, fp: str, most: int) -> DataFrame:
    """f, g (f < g), distance: every pair of the fingerprints (long, distinct, not null) that differ in at most `most` bits."""
    kept = materialized(distinct.select(F.col(fp).alias("f")))
    n = kept.count()
    bits = min(MOST_RANGE_BITS, (n // TRIE_SIZE).bit_length())
    width = min(BLOCK_BITS, max(bits, 1, (n // BUCKET).bit_length()))
    shares = block_shares(most)
    top = (lambda c: F.shiftrightunsigned(c, 64 - bits).cast("int")) if bits else (lambda c: F.lit(0))
    turn = F.array(*[
        F.struct(
            F.lit(i).alias("start"), F.array(*[F.lit(m) for m in flips(bits, share)]).alias("masks"),
            F.shiftleft("f", BLOCK_BITS * i).bitwiseOR(F.shiftrightunsigned("f", 64 - BLOCK_BITS * i) if i else F.col("f")).alias("r"),
        ) for i, share in enumerate(shares) if share >= 0
    ])
    each = kept.select(F.explode(turn).alias("_t")).select("_t.*").withColumn("range", top("r"))
    counts = materialized(each.groupBy("start", "range").agg(F.ceil(F.count(F.lit(1)) / float(PART_SIZE)).cast("int").alias("parts")))  # at most 4 * 2^bits rows
    parts = broadcast_if_small(counts)
    held = each.join(parts, ["start", "range"]).select("start", "range", F.pmod(F.xxhash64("r"), "parts").cast("int").alias("part"), F.lit(0).alias("asks"), "r")
    # Of two ranges the lower one asks.
    reach = F.filter(F.transform("masks", lambda m: F.col("range").bitwiseXOR(m)), lambda other: other >= F.col("range"))
    asks = each.select("start", "r", F.explode(reach).alias("range")).join(parts, ["start", "range"])
    asks = asks.select("start", "range", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("asks"), "r")
    place = ["start", "range", "part"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, held = None, [], None
        for batch in batches:
            start, rng, part, asking = (c.to_numpy() for c in batch.columns[:4])
            values = batch.column(4).to_numpy().view(np.uint64)
            key = np.stack([start, rng, part, asking])
            edges = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            for a, b in zip(edges, [*edges[1:], len(values)], strict=True):
                if now != (own := tuple(key[:3, a].tolist())):
                    now, waiting, held = own, [], None
                if not asking[a]:
                    waiting.append(values[a:b])
                    continue
                held = held or Buckets(np.concatenate(waiting), bits, width)
                back = 64 - BLOCK_BITS * own[0]
                # Few pairs are found at a time, and go on together.
                some, n = [], 0
                for pair in held.near(np.sort(values[a:b]), shares[own[0]], most):
                    some.append(pair)
                    n += len(pair[0])
                    if n > AT_ONCE:
                        yield from told(some, back, own[0])
                        some, n = [], 0
                yield from told(some, back, own[0])

    def told(some: list[tuple[np.ndarray, np.ndarray]], back: int, start: int) -> Iterator[pa.RecordBatch]:
        if not some:
            return
        f, g = (turned(np.concatenate([pair[i] for pair in some]), back) for i in (0, 1))
        once = first_block(f, g, most) == start
        f, g = f[once].view(np.int64), g[once].view(np.int64)
        if len(f):
            columns = [np.minimum(f, g), np.maximum(f, g), np.bitwise_count((f ^ g).view(np.uint64)).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["f", "g", "distance"])

    dealt = held.unionByName(asks).repartition(*place).sortWithinPartitions(*place, "asks", "r")
    return dealt.mapInArrow(search, "f long, g long, distance int")
