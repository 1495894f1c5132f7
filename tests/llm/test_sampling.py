"""Samples that models are fitted on, and what the models do with rows without ids and repeated rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.llm import language, mixing, near_dedup, quality, toxicity
from quillmill.llm.common import bounded_sample

from .test_operators import docs, sentence


def test_rows_without_ids_are_drawn_like_others(spark):
    rng = random.Random(1)
    rows = docs(spark, [sentence(rng, 20) for _ in range(2000)], lang=dict.fromkeys(range(2000), "a"))
    chars = rows.agg(F.sum("n_chars")).first()[0]
    for df in (rows, rows.withColumn("doc_id", F.lit(None).cast("long"))):
        drawn = bounded_sample(df, "doc_id", "text", "lang", chars // 10)
        assert 120 < drawn.count() < 280
        assert sorted(r["text"] for r in drawn.collect()) == sorted(r["text"] for r in bounded_sample(df.repartition(7), "doc_id", "text", "lang", chars // 10).collect())


def test_a_repeated_row_comes_once(spark):
    rows = docs(spark, ["one text"] * 3 + ["other"], lang=dict.fromkeys(range(4), "a")).withColumn("doc_id", F.lit(7))
    assert sorted(r["text"] for r in bounded_sample(rows, "doc_id", "text", "lang", 1 << 20).collect()) == ["one text", "other"]


@pytest.mark.parametrize("ids", [True, False])
def test_models_learn_without_ids_as_with(spark, ids):
    rng = random.Random(2)
    texts = [sentence(rng, 30, "abcde" if i % 2 else "vwxyz") for i in range(200)]
    rows = docs(spark, texts, lang={i: "aa" if i % 2 else "zz" for i in range(200)})
    rows = rows if ids else rows.withColumn("doc_id", F.lit(None).cast("long"))
    model = language.fit_language_model(rows, sample_chars=4000)
    assert model.langs == ["aa", "zz"]
    assert [model.predict(t)[0] for t in texts] == ["aa" if i % 2 else "zz" for i in range(200)]
    scored = quality.score_quality(rows, sample_chars=2000)
    assert scored.count() == 200 and all(0 <= r["score"] <= 1 for r in scored.collect())


def test_rare_words_back_off_and_frequent_ones_are_known(spark):
    rng = random.Random(3)
    texts = [" ".join(["often"] * 5 + [sentence(rng, 1, "mnopq") + str(i)]) for i in range(50)] + ["onceonly"]
    model = language.fit_language_model(docs(spark, texts, lang=dict.fromkeys(range(51), "a")))
    assert "often" in model.words and "onceonly" not in model.words and "o" in model.ngrams[1]


def test_toxicity_of_repeated_rows(spark):
    rng = random.Random(4)
    texts = [sentence(rng, 20) + (" vile hateful scum" if i % 3 == 0 else "") for i in range(90)] + [None, ""]
    rows = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    alone = toxicity.score_texts(rows, toxicity.fit_toxicity(rows, labels)).collect()
    often = rows.unionByName(rows.limit(1)).unionByName(rows.limit(1))
    again = toxicity.score_texts(rows, toxicity.fit_toxicity(often, labels.unionByName(labels))).collect()
    score = lambda out: {r["doc_id"]: round(r["score"], 9) for r in out}
    assert score(alone) == score(again)
    assert min(score(alone)[i] for i in range(0, 90, 3)) > max(score(alone)[i] for i in range(1, 90, 3))


def test_one_of_a_class_stays_whatever_the_columns_are_called(spark):
    rng = random.Random(5)
    text = sentence(rng, 60)
    rows = docs(spark, [text, text, sentence(rng, 60), None, ""]).withColumns({c: F.lit(1) for c in ("_gone", "_again", "_class", "class_id", "_n")})
    rows = rows.unionByName(rows.filter("doc_id = 2"))
    out = near_dedup.keep_one(rows)
    assert out.columns == rows.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 2, 3, 4]


def test_mix_agrees_without_ids_and_with_repeated_ones(spark):
    rng = random.Random(6)
    texts = [sentence(rng, 10) for _ in range(90)]
    rows = docs(spark, texts, source={i: "ab"[i % 2] for i in range(90)}).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(5)))
    mixes = []
    for n in (1, 3, 7):
        out = mixing.mix_schedule(mixing.mix_sources(rows.repartition(n, F.rand(n)))).collect()
        mixes.append(sorted((r["text"], r["copy"], r["served"]) for r in out))
    assert mixes[0] == mixes[1] == mixes[2]
