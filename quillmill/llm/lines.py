"""Line dedup: lines found in several documents stay in one of them only.

Two Bloom filters find what may repeat: one of the keys' hashes seen once, one of those seen
again. The space of hashes is cut into segments. Each task sends a segment the hashes it saw, each
once and without its line; where a segment's hashes meet, one by one they enter the first filter, or
the second if the first had them already. The second goes back to the tasks, and only lines that it
holds are shuffled, by an exact digest, to be counted and to find the document that keeps them.

The filters have a fixed bound, so tables of very many lines make them fuller: more lines are
then suspected and shuffled, and the result is the same. A false suspicion never drops a line.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounds, cut, small, unused

LEAST_CHARS, LEAST_DOCS = 20, 3
#: What is stripped at both ends of a line for its key.
BLANKS = " \t\n\x0b\x0c\r"
#: Bits of a filter for each line, of a segment, and of all segments at most (64 MB).
BITS_PER_LINE, SEGMENT_BITS, FILTER_BITS = 8, 1 << 20, 1 << 29
#: Hashes that a task gathers before it sends them.
CHUNK = 1 << 20
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def split_lines(texts: pa.Array) -> pa.ListArray:
    """Lines of each text; null and empty texts are one empty line."""
    return pc.split_pattern(pc.fill_null(texts, ""), "\n")


def line_keys(lines: pa.Array, least_chars: int) -> tuple[np.ndarray, list[bytes]]:
    """Places of the lines whose keys are long enough, and digests (16 bytes) of these keys."""
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=BLANKS))
    long_enough = pc.greater_equal(pc.utf8_length(keys), least_chars)
    digest = xxhash.xxh3_128_digest
    return np.flatnonzero(long_enough.to_numpy(zero_copy_only=False)), [digest(k) for k in keys.filter(long_enough).cast(pa.binary()).to_pylist()]


def row_keys(texts: pa.Array, least_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and digests (of two uint64 each) of a batch's keys, a key once in its row."""
    lists = split_lines(texts)
    places, digests = line_keys(lists.flatten(), least_chars)
    rows = np.searchsorted(lists.offsets.to_numpy() - lists.offsets[0].as_py(), places, side="right") - 1
    found = np.empty(len(places), [("row", "<i8"), ("high", "<u8"), ("low", "<u8")])
    found["row"] = rows
    halves = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    found["high"], found["low"] = halves[:, 0], halves[:, 1]
    found = np.unique(found)
    return found["row"], np.stack([found["high"], found["low"]], axis=1)


def places_of(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash, and the 32 bits by which it is known there."""
    shift = segments.bit_length() - 1
    high = (hashes >> np.uint64(64 - shift)).astype(np.int64) if shift else np.zeros(len(hashes), np.int64)
    return high, ((hashes << np.uint64(shift)) >> np.uint64(32)).astype(np.uint32)


def bits_of(known: np.ndarray, k: int) -> np.ndarray:
    """The k bits of each in its segment."""
    width = SEGMENT_BITS.bit_length() - 1
    return (known[None, :] * MULTIPLIERS[:k, None]) >> np.uint32(32 - width)


def seen_twice(docs: DataFrame, segments: int, k: int, text_col: str, least_chars: int) -> DataFrame:
    """segment and twice (its second filter, packed), for segments of which that has a bit."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def sent() -> Iterator[pa.RecordBatch]:
            hashes, n = np.unique(np.concatenate(waiting), return_counts=True)
            segment, known = places_of(hashes, segments)
            own, starts = np.unique(segment, return_index=True)
            ends = np.append(starts[1:], len(hashes))
            once = [known[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
            again = [known[a:b][n[a:b] > 1].tobytes() for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(once, pa.binary()), pa.array(again, pa.binary())], names=["segment", "once", "again"])

        for batch in batches:
            _, digests = row_keys(batch.column(0), least_chars)
            waiting.append(digests[:, 0])
            if sum(map(len, waiting)) >= CHUNK:
                yield from sent()
                waiting.clear()
        if sum(map(len, waiting)):
            yield from sent()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)

        def filled() -> Iterator[pa.RecordBatch]:
            if now is not None and twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["segment", "twice"])

        for batch in batches:
            for segment, first, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != now:
                    yield from filled()
                    now = segment
                    once[:], twice[:] = False, False
                bits = bits_of(np.frombuffer(first, np.uint32), k)
                twice[bits[:, once[bits].all(axis=0)]] = True
                twice[bits_of(np.frombuffer(again, np.uint32), k)] = True
                once[bits] = True
        yield from filled()

    sent = docs.select(text_col).mapInArrow(send, "segment int, once binary, again binary")
    return sent.repartition("segment").sortWithinPartitions("segment").mapInArrow(meet, "segment int, twice binary")


@cache
def second_filter(segments: int, parts: tuple[tuple[int, bytes], ...]) -> np.ndarray:
    """All segments' packed bits; built once in a worker."""
    out = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for segment, bits in parts:
        out[segment] = np.frombuffer(bits, np.uint8)
    return out


def suspected_keys(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """id, text_hash, key (digest) of each row's keys that the second filter holds, each once in its row."""
    spark = docs.sparkSession
    breaks = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    n = docs.agg(F.sum(1 + F.coalesce(breaks, F.lit(0)))).first()[0] or 0
    segments = 1 << max(0, min(FILTER_BITS, n * BITS_PER_LINE) // SEGMENT_BITS).bit_length()
    segments = min(segments, FILTER_BITS // SEGMENT_BITS)
    k = max(1, min(len(MULTIPLIERS), round(0.7 * segments * SEGMENT_BITS / max(1, n))))
    # At most FILTER_BITS come to the driver, whatever the size of the table.
    twice = seen_twice(docs, segments, k, text_col, least_chars).toArrow()
    parts = spark.sparkContext.broadcast(tuple(zip(twice["segment"].to_pylist(), twice["twice"].to_pylist(), strict=True)))

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = second_filter(segments, parts.value)
        for batch in batches:
            rows, digests = row_keys(batch.column(2), least_chars)
            segment, known = places_of(digests[:, 0], segments)
            bits = bits_of(known, k)
            hit = ((held[segment[None, :], bits >> np.uint32(3)] >> (7 - (bits & np.uint32(7))).astype(np.uint8)) & 1).all(axis=0)
            if hit.any():
                at = pa.array(rows[hit])
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), int(hit.sum()), [None, pa.py_buffer(np.ascontiguousarray(digests[hit]).tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), keys.cast(pa.binary())], names=["id", "text_hash", "key"])

    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    schema = base.select("id", "text_hash", F.lit(b"").alias("key")).schema
    return base.mapInArrow(suspect, schema)


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with text without the lines dropped, n_lines (before) and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at
    least least_chars code points that stand in at least least_docs rows lose their lines in all
    rows but those with the largest id that has it. Rows that repeat an id are documents of their
    own; so are rows alike in all columns, and if their id is the largest all of them keep the line. A
    null id is smaller than every other. A null or empty text is one empty line and becomes empty. Columns
    n_lines and n_dropped of the input are replaced. An empty table gives an empty one.
    """
    arrow_bounds(docs.sparkSession)
    suspects = cut(suspected_keys(docs, id_col, text_col, least_chars))
    repeated = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max("id").alias("_last")).filter(F.col("_n") >= least_docs)
    drops = suspects.join(small(cut(repeated)), "key").filter(~F.col("id").eqNullSafe(F.col("_last")))
    # A group is the suspected keys of one text, however often the row occurs.
    drops = small(cut(drops.groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_h")).agg(F.collect_set("key").alias("_keys"))))

    @F.arrow_udf("kept string, n_lines long, n_dropped long")
    def without(texts: pa.Array, keys: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts, "")
        n_lines = pc.add(pc.cast(pc.count_substring(texts, "\n"), pa.int64()), 1)
        kept, dropped = texts.to_pylist(), [0] * len(texts)
        for i in np.flatnonzero(pc.is_valid(keys).to_numpy(zero_copy_only=False)):
            lines = kept[i].split("\n")
            places, digests = line_keys(pa.array(lines, pa.string()), least_chars)
            gone = set(keys[i].as_py())
            out = {p for p, d in zip(places.tolist(), digests, strict=True) if d in gone}
            kept[i], dropped[i] = "\n".join(x for p, x in enumerate(lines) if p not in out), len(out)
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), n_lines, pa.array(dropped, pa.int64())], names=["kept", "n_lines", "n_dropped"])

    same = docs[f"`{id_col}`"].eqNullSafe(drops["_id"]) & (F.xxhash64(docs[f"`{text_col}`"]) == drops["_h"])
    keep, made = [c for c in docs.columns if c not in ("n_lines", "n_dropped")], unused(docs, "_made")
    out = docs.join(drops, same, "left")
    out = out.select(*[docs[f"`{c}`"] for c in keep if c != text_col], without(docs[f"`{text_col}`"], drops["_keys"]).alias(made))
    return out.select(*[F.col(f"{made}.kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in keep], f"{made}.n_lines", f"{made}.n_dropped")
