"""Each stage of the pipeline against brute force, on what the one before kept."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quillmill.llm import queries, secrets

from .test_operators import DOCS, brute_contamination, distance, sentence, targets


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(21)
    texts = []
    for i in range(60):
        texts.append(sentence(rng, rng.randint(40, 90), "abcdefg" if i % 2 else "tuvwxyz"))
    bench = [(i, sentence(rng, 20)) for i in range(5)]
    texts += [texts[0], texts[1].replace(" ", ", ", 1), texts[2] + " tail", texts[3].upper(), None, "", "1234 !!", texts[9] + " " + bench[2][1], texts[5] + " password=abcdef0123456789ab and so on"]
    rows = [(i, t, None if i % 7 == 0 else "ab"[i % 2 == 0] if i < 60 else None, "xyz"[i % 3] if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    steps, docs = [spark.createDataFrame(rows, DOCS)], spark.read.parquet(f"{folder}/documents.parquet")
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        steps.append(docs)
    return str(folder), bench, [{r["doc_id"]: r for r in s.collect()} for s in steps], steps


def test_columns_stay(made):
    _, _, _, steps = made
    assert all(s.columns == steps[0].columns for s in steps[:5])


def test_only_texts_without_letters_go(made):
    _, _, (before, after, *_), _ = made
    assert set(before) - set(after) == {64, 65, 66}
    assert all(r["lang"] == "ab"[i % 2 == 0] for i, r in after.items() if i < 60)


def test_one_of_each_group_stays(made):
    _, _, (_, before, after, *_), _ = made
    w = {i: re.findall(r"[^\W_]+", r["text"].lower()) for i, r in before.items()}
    near = lambda a, b: abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and distance(a, b) <= 0.2 * max(len(a), len(b))
    gone = {i for i in w for j in w if j < i and near(w[i], w[j])}
    assert set(before) - set(after) == gone and {60, 61, 62, 63} <= gone


def test_contaminated_documents_go(made):
    _, bench, (_, _, before, after, *_), _ = made
    assert set(before) - set(after) == {i for i, r in before.items() if brute_contamination(r["text"], bench)[1]}
    assert 67 not in after


def test_secrets_are_redacted_and_documents_stay(made):
    _, _, (_, _, _, before, after, _), _ = made
    assert set(before) == set(after)
    assert not any(secrets.find_spans(r["text"]) for r in after.values())
    assert all(after[i]["text"] == before[i]["text"] and after[i]["n_chars"] == before[i]["n_chars"] or after[i]["n_chars"] == len(after[i]["text"]) for i in after)


def test_mix_meets_targets(made):
    _, _, (_, _, _, _, before, _), steps = made
    served, sums = Counter(), Counter()
    for r in steps[5].collect():
        served[r["source"]] += r["served"]
    for r in before.values():
        sums[r["source"]] += len(r["text"].split())
    wanted = targets(sums)
    assert all(abs(served[s] - wanted[s]) < 1 for s in sums)


def test_run_is_the_stages(spark, made):
    folder, _, _, steps = made
    again = queries.QUERIES["pipeline"](spark, folder)
    key = lambda df: sorted((r["doc_id"], r["copy"], r["served"]) for r in df.collect())
    assert key(again) == key(steps[5])


def test_empty_tables(spark, made, tmp_path):
    folder, _, _, _ = made
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
