import hashlib
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.operators import dedup, hamming
from quillmill.plans import corpus


def fingerprint(text):
    w = text.lower().split()
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    weights = [0] * 64
    for g in grams:
        d = int.from_bytes(hashlib.sha256(g.encode()).digest()[:8], "big")
        for i in range(64):
            weights[i] += 1 if d >> i & 1 else -1
    return sum(1 << i for i in range(64) if weights[i] >= 0)


def test_simhash_equals_the_definition(spark):
    rng = random.Random(3)
    texts = ["", "two words", "one two three", " ".join(rng.choice("abcdefg") * 3 for _ in range(200))]
    out = dedup.simhash(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", F.col("t")).collect()
    assert {r["id"]: r["fp"] % (1 << 64) for r in out} == {i: fingerprint(t) for i, t in enumerate(texts)}


def test_simhash_shuffles_nothing_and_takes_any_length(spark):
    texts = [None, " \x1c\u2003", "Ünïcode ÉÉ ŒUVRE words", "a b c " * 50_000, "x" * 200_000]
    out = dedup.simhash(spark.createDataFrame([(1, t) for t in texts], "id long, t string"), "id", F.col("t"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["fp"] % (1 << 64) for r in out.collect()) == sorted(fingerprint(t or "") for t in texts)
    assert dedup.fingerprint_of("a b c d e f g", at_once=2) % (1 << 64) == fingerprint("a b c d e f g")


def planted(rng, n):
    """n fingerprints, a quarter of them within 16 bits of another."""
    fps = [rng.getrandbits(64) for _ in range(n - n // 4)]
    return fps + [fps[i] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 16))) for i in range(n // 4)]


@pytest.mark.parametrize("most", [0, 3, 12, 17])
def test_tries_find_each_pair_at_one_start(most):
    values = np.unique(np.array(planted(random.Random(most), 1500), np.uint64))
    far = np.bitwise_count(values[:, None] ^ values[None, :])
    wanted = {(int(values[i]), int(values[j])) for i, j in zip(*np.nonzero(far <= most), strict=True)}
    found = []
    for start in range(4):
        own = hamming.turned(values, 16 * start)
        probe, near, _ = hamming.Trie(own).near(own, hamming.shares(most))
        f, g = values[probe], hamming.turned(near, 64 - 16 * start)
        once = hamming.first_start(f, g, most) == start
        found += zip(f[once].tolist(), g[once].tolist(), strict=True)
    assert len(found) == len(wanted) and set(found) == wanted


def test_few_pairs_are_compared_whole(spark):
    fps = dedup.simhash(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(4000), "doc_id", F.col("text")).toArrow()["fp"].to_numpy()
    values = np.unique(fps).view(np.uint64)
    compared = 0
    for start in range(4):
        own = hamming.turned(values, 16 * start)
        compared += hamming.Trie(own).near(own, hamming.shares(12))[2]
    assert compared - len(values) * 4 < 0.001 * len(values) * (len(values) - 1)  # of pairs in order, without those of a value with itself


def test_near_pairs_in_many_ranges_and_parts(spark, monkeypatch):
    fps = planted(random.Random(7), 800) + [0, 1, 3, (1 << 64) - 1] * 3
    monkeypatch.setattr(hamming, "TRIE_SIZE", 20)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    out = dedup.near_pairs(spark.createDataFrame([*rows, (9999, None)], "id long, fp long"), "id").collect()
    wanted = {(i, j, (fps[i] ^ fps[j]).bit_count()) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 12}
    assert sorted((r["a"], r["b"], r["distance"]) for r in out) == sorted(wanted)


@pytest.mark.parametrize("most", [0, 2, 3, 12, 17])
@pytest.mark.parametrize("bits, width", [(0, 1), (2, 9), (3, 16)])
def test_buckets_find_each_pair_at_one_block(most, bits, width):
    values = np.unique(np.array(planted(random.Random(most), 600), np.uint64))
    far = np.bitwise_count(values[:, None] ^ values[None, :])
    wanted = {(int(values[i]), int(values[j])) for i, j in zip(*np.nonzero(far <= most), strict=True) if i < j}
    found = []
    for start, share in enumerate(hamming.block_shares(most)):
        own = np.sort(hamming.turned(values, 16 * start))
        ranges = [own[own >> np.uint64(64 - bits) == r] if bits else own for r in range(1 << bits)]
        for held in filter(len, ranges):
            for f, g in hamming.Buckets(held, bits, width).near(own, share, most) if share >= 0 else ():
                f, g = hamming.turned(f, 64 - 16 * start), hamming.turned(g, 64 - 16 * start)
                once = hamming.first_block(f, g, most) == start
                found += zip(np.minimum(f, g)[once].tolist(), np.maximum(f, g)[once].tolist(), strict=True)
    assert len(found) == len(wanted) and set(found) == wanted


def test_a_fingerprint_is_sent_to_few_ranges_however_many_there_are():
    # 704 times at 2.8 M fingerprints before: the ranges grew in number with the table.
    masks = [hamming.flips(hamming.MOST_RANGE_BITS, share) for share in hamming.block_shares(12)]
    assert sum(len(m) for m in masks) < 80


def test_near_pairs_in_parts_and_small_batches(spark, monkeypatch):
    fps = planted(random.Random(8), 800) + [0, 1, 3, (1 << 64) - 1]
    monkeypatch.setattr(hamming, "TRIE_SIZE", 100)
    monkeypatch.setattr(hamming, "PART_SIZE", 10)
    monkeypatch.setattr(hamming, "AT_ONCE", 16)
    rows = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(set(fps))]
    out = hamming.near_fingerprints(spark.createDataFrame(rows, "f long"), "f", 12).collect()
    signed = [f for f, in rows]
    wanted = {(min(x, y), max(x, y)) for i, x in enumerate(signed) for y in signed[:i] if ((x ^ y) % (1 << 64)).bit_count() <= 12}
    assert len(out) == len(wanted) and {(r["f"], r["g"]) for r in out} == wanted


def test_first_of_a_key_that_all_rows_share(spark):
    rows = spark.range(0, 1_000_000, 1, 8).select("id", F.when(F.col("id") % 1000 < 999, "same").otherwise(F.col("id").cast("string")).alias("key"))
    out = dedup.first_wins(rows, "key", ["id"], "first")
    assert {r["id"] for r in out.filter("first").collect()} == {0} | set(range(999, 1_000_000, 1000))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * median(sizes)


def test_first_of_null_keys_and_orders_of_two_columns(spark):
    rows = spark.createDataFrame([(None, ["b"], 1), (None, ["a"], 2), ("k", ["b"], 0), ("k", ["a", "z"], 5), ("k", ["a", "z"], 4), ("u", None, 1)], "key string, path array<string>, n long")
    out = {(r["key"], r["n"]) for r in dedup.first_wins(rows, "key", ["path", "n"], "first").filter("first").collect()}
    assert out == {(None, 2), ("k", 4), ("u", 1)}
    assert {(r["key"], r["n"]) for r in dedup.first_rows(rows.withColumn("text", F.lit("x")), F.col("key"), ["path", "n"]).collect()} == out
    assert dedup.first_wins(rows.limit(0), "key", ["n"], "first").count() == 0


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for base in fps[:10]:
        for bits in (1, 12, 13):
            fps.append(base ^ sum(1 << i for i in rng.sample(range(64), bits)))
    fps.append(fps[0])
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    out = dedup.near_pairs(spark.createDataFrame(rows, "id long, fp long"), "id").collect()
    wanted = {(i, j, (fps[i] ^ fps[j]).bit_count()) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 12}
    assert sorted((r["a"], r["b"], r["distance"]) for r in out) == sorted(wanted)


def test_greedy_keeps_the_end_of_a_chain(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (10, 12), (11, 12)], "a long, b long")
    assert {r["id"] for r in dedup.greedy_drops(chain).collect()} == {2, 4, 11, 12}


def test_stages_of_a_corpus(spark):
    good = "This passage is long enough to be kept, and it says nothing of note at all. " * 4
    docs = [(1, good), (2, good), (3, good.replace(". ", ".  ", 1)), (4, good + "One more sentence."), (5, "short"), (6, None)]
    rows = corpus.staged(spark.createDataFrame(docs, "id long, t string"), id_col="id", raw=F.coalesce("t", F.lit("?")).cast("binary"), text=F.col("t"), order=["id"])
    assert {r["id"]: r["stage"] for r in rows.collect()} == {1: "accepted", 2: "exact_duplicate", 3: "content_duplicate", 4: "near_duplicate", 5: "rejected", 6: "failed"}
    n = corpus.counters(rows).first()
    assert (n["total"], n["accepted"], n["train"] + n["validation"] + n["test"]) == (6, 1, 1)
    assert corpus.manifest(rows, "id").count() == 1


def test_documents_in_the_order_of_paths(spark):
    good = "This passage is long enough to be kept, and it says nothing of note at all. " * 4
    rows = spark.createDataFrame([("a-b", good), ("a/b", good + "One more sentence."), ("c", good + "One more sentence!")], "path string, t string")
    rows = rows.withColumn("parts", F.split("path", "/"))
    out = corpus.staged(rows, id_col="path", raw=F.col("t").cast("binary"), text=F.col("t"), order=["parts"])
    assert {r["path"]: r["stage"] for r in out.collect()} == {"a/b": "accepted", "a-b": "near_duplicate", "c": "near_duplicate"}
