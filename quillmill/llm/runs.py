"""Periodic run detection: stretches of words that repeat with a period at least four times.

For each lag the number of places whose word occurs again that far on is counted exactly: of
frequent words by the autocorrelation of their places (FFT), of rare ones by the differences of
their places. A stretch of period q has at least max(6 - q, 3 q) such places in a row, so only
lags with that many are scanned for islands of them. What runs found with a divisor of a lag
account for is taken off its count first: a text that is one long run is scanned once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounds, unused

#: Words and periods that a run has at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def lag_matches(words: np.ndarray, most: int) -> np.ndarray:
    """At q, up to most: the number of places i with words[i] == words[i + q]. words: numbers from 0."""
    n = len(words)
    frequent = np.bincount(words) ** 2 > 4 * n * np.log2(n + 2)
    counts = np.zeros(most + 1, np.int64)
    order = np.argsort(words, kind="stable")
    rare = order[~frequent[words[order]]]
    kind, at, step = words[rare], np.arange(len(rare)), 0
    while len(at):  # the next place of the same word, then the one after that, as long as these are near enough
        step += 1
        at = at[at + step < len(rare)]
        gap = rare[at + step] - rare[at]
        near = (kind[at + step] == kind[at]) & (gap <= most)
        at = at[near]
        counts += np.bincount(gap[near], minlength=most + 1)
    if frequent.any():
        size = 1 << int(n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        for w in np.flatnonzero(frequent):
            power += np.abs(np.fft.rfft(words == w, size)) ** 2
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    return counts


def find_runs(words: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start and period; the period is the smallest one."""
    n = len(words)
    most = n // periods
    if n < least or most == 0:
        return []
    lags = np.arange(most + 1)
    needed = np.maximum(least - lags, (periods - 1) * lags)
    left = lag_matches(words, most)
    left[0] = -1
    runs: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero(left >= needed).tolist():
        if left[q] < needed[q]:
            continue
        ends = np.concatenate([[-1], np.flatnonzero(words[q:] != words[: n - q]), [n - q]])
        island = np.diff(ends) - 1
        for i in np.flatnonzero(island >= needed[q]).tolist():
            start, length = int(ends[i]) + 1, int(island[i]) + q
            if (start, length) not in runs:  # else it has a smaller period, which divides this one
                runs[start, length] = q
                multiples = np.arange(2 * q, min(most, length) + 1, q)
                left[multiples] -= length - multiples
    return sorted((s, length, q) for (s, length), q in runs.items())


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words that no run holds after its first period, joined by spaces."""
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0))


def periodic_runs(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with runs (array of start, length, period, by start and period) and collapsed.

    Words are parted by ASCII white space and numbered from 0. A run is a maximal stretch with a
    smallest period q of at least four periods and six words. collapsed has the words that no run
    holds after its first period, joined by single spaces. Null texts, empty ones and those of white
    space have no words and no runs, and collapse to the empty text. Every row is worked on by
    itself, so repeated rows and ids give repeated results. Columns runs and collapsed of the input are replaced.
    """
    arrow_bounds(docs.sparkSession)

    @F.arrow_udf("runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def found(texts: pa.Array) -> pa.Array:
        offsets, parts, collapsed = [0], [], []
        for text in texts.cast(pa.binary()).to_pylist():
            words = (text or b"").split()
            numbers: dict[bytes, int] = {}
            runs = find_runs(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
            parts += runs
            offsets.append(len(parts))
            collapsed.append((without_repeats(words, runs) if runs else b" ".join(words)).decode())
        columns = np.array(parts, np.int64).reshape(-1, 3).T
        each = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["start", "length", "period"])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each), pa.array(collapsed, pa.string())], names=["runs", "collapsed"])

    keep, made = [c for c in docs.columns if c not in ("runs", "collapsed")], unused(docs, "_found")
    out = docs.select(*[docs[f"`{c}`"] for c in keep], found(docs[f"`{text_col}`"]).alias(made))
    return out.select(*[F.col(f"`{c}`") for c in keep], f"{made}.runs", f"{made}.collapsed")
