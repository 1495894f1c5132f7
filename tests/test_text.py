import hashlib
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillmill import queries
from quillmill.functions import quality
from quillmill.functions import text as T


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ("a\r\nb\rc", "a\nb\nc"),
        ("a  \t b  \n   c", "a b\nc"),
        ("a\n\n\n\n\nb", "a\n\nb"),
        ("ﬁx ＡＢ", "fix AB"),
        ("a\x00b​c", "abc"),
        ("   x  ", "x"),
        ("", ""),
    ],
)
def test_clean(spark, raw, wanted):
    assert one(spark, raw, T.clean_text(F.col("t"))) == wanted


def test_clean_null_stays_null(spark):
    assert one(spark, None, T.clean_text(F.col("t"))) is None


def test_collapse_equals_python(spark):
    for raw in (" a  b\x1f\x1cc \n", "", "x"):
        assert one(spark, raw, T.collapse(F.col("t"))) == " ".join(raw.split())


def test_filters_at_their_bounds(spark):
    t = F.col("t")
    base = "ab cd "
    assert not one(spark, "a" + "bc" * 99, quality.long_enough(t))
    assert one(spark, "ab" * 100, quality.long_enough(t))
    assert one(spark, "a" * 8, quality.no_long_run(t)) and not one(spark, "a" * 9, quality.no_long_run(t))
    assert one(spark, "\n" * 12 + base, quality.no_long_run(t))
    assert one(spark, "abcdefg###", quality.mostly_text(t)) and not one(spark, "abcdef####", quality.mostly_text(t))
    assert not one(spark, "", quality.mostly_text(t))
    assert not one(spark, " \n ", quality.not_empty(t))


def test_record_id_is_that_of_sorted_json(spark):
    record = {"instruction": 'say "x"\\', "input": "", "response": "tab\x01\x1f é", "category": "c", "source": "a/b", "source_id": "1"}
    made = spark.range(1).select(T.record_id({k: F.lit(v) for k, v in record.items()}).alias("x")).first()["x"]
    assert made == hashlib.sha256(json.dumps(record, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def test_split_of_first_digits(spark):
    assert one(spark, "00" * 32, T.split_of(F.col("t"))) == "train"
    assert one(spark, "ff" * 32, T.split_of(F.col("t"))) == "test"  # 0xffffffff % 100 = 95


def test_shingles_and_blocks(spark):
    def run(text):
        return spark.createDataFrame([(text,)], "t string").select(T.words(F.lower("t")).alias("w")).select(T.shingles(F.col("w")).alias("x")).first()["x"]

    assert run("A b c D") == ["a b c", "b c d"]
    assert run("a b") == ["a b"]
    assert run(" ") == []
    rows = spark.createDataFrame([("a", "b"), (None, " b "), (" ", None)], "p string, q string").select(T.article_block(F.col("p"), F.col("q")).alias("x")).collect()
    assert [r["x"] for r in rows] == ["a\n\nb\n\n", "b\n\n", None]


def test_nfkc_is_python_s(spark):
    raw = "ẛ̣ ① 가"
    assert one(spark, raw, T.nfkc(F.col("t"))) == unicodedata.normalize("NFKC", raw)


def test_stable_characters_are_not_sent_to_python(spark):
    stable = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and re.fullmatch(T.STABLE, chr(c))]
    assert len(stable) > 20_000 and not any(unicodedata.combining(c) or unicodedata.category(c)[0] == "M" or 0x1100 <= ord(c) < 0x1200 for c in stable)
    assert all(unicodedata.normalize("NFKC", c) == c for c in stable)
    given = ["plain", "naïve – “fine”", "e\u0301", "ﬁ", None, "x\u00a0y", "Ⅷ ½", "가", "ಠ", "漢字", "Привет, Ωμέγα", "a" * 100_000 + "ｂ"]
    rows = spark.createDataFrame(list(enumerate(given)), "id long, t string")
    out = {r["id"]: r["t"] for r in rows.select("id", T.nfkc(F.col("t")).alias("t")).collect()}
    assert out == {i: t and unicodedata.normalize("NFKC", t) for i, t in enumerate(given)}
    plan = rows.select(T.nfkc(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("CASE WHEN") > 0 and "RLIKE" in plan


def test_strip_and_tidy_leave_single_spaces_alone(spark):
    assert {c for c in map(chr, range(0x110000)) if c.isspace()} == set(T.SPACES)
    texts = [f"{c} a{c}{c} b \n{c}\n\n \n c {c}" for c in T.SPACES] + ["", " ", "\t", "a \n b", "a\n \t\nb", "x  y \t z\t", "\u200b x \u200b", None]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip(F.col("t")).alias("s"), T.collapse(F.col("t")).alias("c"), T.tidy_space(F.col("t")).alias("y")).collect()

    def tidy(t):
        return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", t))).strip()

    for t, s, c, y in out:
        assert (s, c, y) == ((None, "", None) if t is None else (t.strip(), " ".join(t.split()), tidy(t)))


def test_composed_documents_reach_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        rows = queries.composed_documents(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(key) == "512"
        assert rows.count() == 200
    finally:
        spark.conf.set(key, was)
    texts = [None if i % 7 == 0 else "e\u0301" * i for i in range(3 * T.AT_ONCE + 1)]
    found = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.nfkc(F.col("t")).alias("c")).collect()
    assert {r["i"]: r["c"] for r in found} == {i: t and unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
