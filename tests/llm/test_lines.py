"""Line dedup against brute force. The query itself is held against SQL in test_queries."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.llm import lines

from .test_operators import docs

LICENSE = "This line stands in very many documents."


def brute(rows, least_chars=20, least_docs=3):
    """rows: (id, text); a tuple (id, n_lines, n_dropped, kept) for each."""
    key = lambda x: x.strip(lines.BLANKS).translate({c: c + 32 for c in range(65, 91)})
    found = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            found[k].append(i)
    last = {k: max((i for i in ids if i is not None), default=None) for k, ids in found.items() if len(ids) >= least_docs and len(k) >= least_chars}
    out = []
    for i, text in rows:
        each = (text or "").split("\n")
        stay = [x for x in each if last.get(key(x), i) == i]
        out.append((i, len(each), len(each) - len(stay), "\n".join(stay)))
    return out


def made(df):
    return sorted(map(repr, ((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in lines.drop_repeated_lines(df).collect())))


@pytest.fixture
def given():
    rng = random.Random(4)
    shared = [f"shared line number {i} of some length" for i in range(30)] + ["ÉCOLE of twenty characters", "short", "", "exactly nineteen ch", "exactly twenty chars"]
    rows = []
    for i in range(300):
        own = [f"own line {rng.random()} of document {i}" for _ in range(rng.randint(0, 4))]
        each = own + rng.sample(shared, rng.randint(0, 6)) + ([rng.choice([LICENSE, f"\t{LICENSE.upper()} \r"])] * rng.randint(0, 2))
        rng.shuffle(each)
        rows.append((i, "\n".join(each)))
    rows += [(300, None), (301, ""), (302, "\n\n"), (None, LICENSE), (None, "nothing but this line here\nx"), (5, LICENSE), (5, LICENSE), (299, LICENSE)]
    rows += [(400 + i, "twice only, this one line") for i in range(2)] + [(None, "three times without an id")] * 3
    return rows + [(900, "long line " * 40_000 + "\n" + LICENSE)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_lines_equal_brute_force(spark, given):
    assert made(table(spark, given).repartition(7)) == sorted(map(repr, brute(given)))


def test_filters_of_many_segments_and_full_ones(spark, given, monkeypatch):
    wanted = sorted(map(repr, brute(given)))
    with monkeypatch.context() as m:
        m.setattr(lines, "BITS_PER_LINE", 1 << 15)
        assert made(table(spark, given).repartition(5)) == wanted
    full = spark.createDataFrame([(0, b"\xff" * (lines.SEGMENT_BITS // 8))], "segment int, twice binary")
    monkeypatch.setattr(lines, "seen_twice", lambda *a: full)  # every line is suspected: none the more goes
    assert made(table(spark, given)) == wanted


def test_second_filter_holds_what_is_seen_again(spark):
    rows = [(i, f"line {i} that stands in one text\n{LICENSE if i % 5 == 0 else ''}") for i in range(2000)]
    keys = {r["key"]: r["n"] for r in lines.suspected_keys(table(spark, rows).repartition(9), "doc_id", "text", 20).groupBy("key").agg(F.count("*").alias("n")).collect()}
    _, (wanted,) = lines.line_keys(pa.array([LICENSE]), 20)
    assert keys[bytearray(wanted) if not isinstance(next(iter(keys)), bytes) else wanted] == 400 and len(keys) < 40


def test_row_keys_counts_a_key_once_in_its_row():
    rows, digests = lines.row_keys(pa.array([f"{LICENSE}\n{LICENSE} ", None, LICENSE, "x"]), 20)
    assert rows.tolist() == [0, 2] and np.array_equal(digests[0], digests[1])


def test_lines_with_other_columns_and_none(spark):
    rows = docs(spark, [LICENSE, f"a\n{LICENSE}", LICENSE]).withColumns({c: F.lit(3) for c in ("n_lines", "_keys", "_id", "_h", "key", "id", "_made")})
    out = {r["doc_id"]: r for r in lines.drop_repeated_lines(rows).collect()}
    assert [(out[i]["text"], out[i]["n_dropped"], out[i]["n_lines"], out[i]["_id"]) for i in range(3)] == [("", 1, 1, 3), ("a", 1, 2, 3), (LICENSE, 0, 1, 3)]
    assert lines.drop_repeated_lines(rows.limit(0)).count() == 0
    assert [r["text"] for r in lines.drop_repeated_lines(docs(spark, [None, ""])).collect()] == ["", ""]
