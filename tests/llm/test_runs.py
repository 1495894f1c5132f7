"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import runs
from quillmill.llm.queries import QUERIES

from .test_operators import docs
from .test_queries import SF, tables, texts  # noqa: F401


def brute(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        start = 0
        while start + q < len(words):
            end = start
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            smaller = lambda: any(all(words[k] == words[k + d] for k in range(start, start + length - d)) for d in range(1, q))  # noqa: B023, E731
            if length >= max(6, 4 * q) and not smaller():
                out.append((start, length, q))
            start = end + 1
    return sorted(out)


def kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(0, 59), st.integers(1, 12))
def test_runs_equal_brute_force(words, start, period):
    words = [w if i < start else words[start + (i - start) % period] if start + (i - start) % period < len(words) else w for i, w in enumerate(words)]
    assert runs.find_runs(np.array(words, np.int64)) == brute(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=400), st.integers(1, 100))
def test_lags_are_counted_exactly(words, most):
    words = np.array([0 if w > 9 else w for w in words], np.int64)
    wanted = [int((words[q:] == words[: len(words) - q]).sum()) if q < len(words) else 0 for q in range(1, most + 1)]
    assert runs.lag_matches(words, most)[1:].tolist() == wanted


def test_lags_of_frequent_and_rare_words():
    rng = np.random.default_rng(1)
    words = np.where(rng.random(6000) < 0.5, 0, rng.integers(1, 3000, 6000))
    assert (np.bincount(words) ** 2 > 4 * 6000 * np.log2(6002)).sum() == 1  # one by FFT, the rest by pairs
    assert runs.lag_matches(words, 1500)[1:].tolist() == [int((words[q:] == words[:-q]).sum()) for q in range(1, 1501)]


def test_long_texts_of_one_run():
    assert runs.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    words = np.concatenate([np.arange(10, 1010), np.tile(np.arange(5), 20_000), [3]])
    assert runs.find_runs(words) == [(1000, 100_000, 5)]


def test_periodic_runs(spark):
    given = ["a b a b a b a b c", "x", None, "", " \n ", "é é é\té é é é", "a b a b a b a b c", "go " * 50_000, "n n " * 6]
    rows = docs(spark, given).withColumn("runs", F.lit("old")).withColumn("start", F.lit(7))
    out = {r["doc_id"]: r for r in runs.periodic_runs(rows).collect()}
    assert [[tuple(x) for x in out[i]["runs"]] for i in range(9)] == [[(0, 8, 2)], [], [], [], [], [(0, 7, 1)], [(0, 8, 2)], [(0, 50_000, 1)], [(0, 6, 1)]]
    assert [out[i]["collapsed"] for i in range(9)] == ["a b c", "x", "", "", "", "é", "a b c", "go", "n n"]
    assert runs.periodic_runs(rows.limit(0)).count() == 0
    twice = runs.periodic_runs(rows.unionByName(rows)).groupBy("doc_id").count().collect()
    assert all(r["count"] == 2 for r in twice) and len(twice) == 9


def test_op11_equals_brute_force(spark, texts):  # noqa: F811
    out = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert out.keys() == texts.keys()
    rewritten = 0
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            rewritten += 1
        if n <= 1500:
            found = brute(words)
            best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if found else (None,) * 3
            listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
            wanted = (i, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept(words, found).encode()).hexdigest())
            assert tuple(out[i]) == wanted
    assert rewritten > 5
