"""The queries: against SQL where there is some, else against brute force or held-out labels."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from quillmill.llm import secrets, tokens
from quillmill.llm.queries import ORACLES, QUERIES

from .test_operators import VOCABULARY, brute_spans, distance

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.fixture(scope="module")
def texts(tables):
    return dict(tables.sql("select doc_id, text from documents").fetchall())


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    other = tables.sql(ORACLES[name])
    at = [list(other.columns).index(c) for c in df.columns]
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(repr, map(plain, df.collect()))) == sorted(repr(plain([r[i] for i in at])) for r in other.fetchall())


def test_op1_on_held_out_documents(spark, tables, texts):
    lang = dict(tables.sql("select doc_id, lang from documents").fetchall())
    out = rows(spark, "op1_language_id")
    assert {r["doc_id"]: r["held_out"] for r in out} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in out)


def test_op4_removes_what_stands_in_the_kept_document(spark, texts):
    w = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in texts.items()}
    out = rows(spark, "op4_substring_dedup")
    grams = defaultdict(set)
    for i, x in w.items():
        grams[i] = {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
    for r in out:
        span = w[r["doc_id"]][r["first_word"] : r["first_word"] + 16]
        own = {tuple(span[k : k + 5]) for k in range(12)}
        assert r["doc_id"] > r["kept_id"] and len(own & grams[r["kept_id"]]) >= 0.6 * len(own)
    # A passage of 50 equal words is missed nowhere.
    first, wanted = {}, set()
    for i in sorted(w):
        runs = {tuple(w[i][k : k + 50]) for k in range(len(w[i]) - 49)}
        runs = {x for x in runs if len(set(x)) > 20}
        wanted |= {i} if any(first.get(x, i) != i for x in runs) else set()
        for x in runs:
            first.setdefault(x, i)
    assert wanted <= {r["doc_id"] for r in out}


def test_op5_on_held_out_documents(spark, texts):
    out = rows(spark, "op5_toxicity")
    assert {r["doc_id"]: r["held_out"] for r in out} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in texts}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)


def test_op6_counts_every_document(spark, texts):
    encode = tokens.encoder(open(VOCABULARY, "rb").read()).encode_ordinary
    assert {r["doc_id"]: r["n_tokens"] for r in rows(spark, "op6_token_counts")} == {i: len(encode(t or "")) for i, t in texts.items()}


def test_op7_finds_the_base_spans(spark, texts):
    for r in rows(spark, "op7_scan_secrets"):
        spans = brute_spans(texts[r["doc_id"]] or "")
        shown = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        n = Counter(secrets.KINDS[k] for _, k, _ in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n["assign"], n["access"], n["hex"]) and shown in r["spans"]


def test_op8_classes(spark, texts):
    w = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in texts.items()}
    grams = {i: {tuple(x[k : k + 3]) for k in range(max(1, len(x) - 2))} for i, x in w.items()}
    label = {i: i for i in w}
    for i in sorted(w):
        for j in sorted(w):
            long = max(len(w[i]), len(w[j]))
            if j < i and min(len(w[i]), len(w[j])) >= 0.8 * long and grams[i] & grams[j] and long < 1500 and distance(w[i], w[j]) <= 0.2 * long:
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    out = {r["doc_id"]: r["class_id"] for r in rows(spark, "op8_near_dedup")}
    long_ones = {i for i in w if len(w[i]) >= 1500}
    assert {i: c for i, c in out.items() if i not in long_ones} == {i: c for i, c in label.items() if i not in long_ones}


def test_op9_against_labels(spark, tables):
    keep = {r["doc_id"]: r["keep"] for r in rows(spark, "op9_quality")}
    good = dict(tables.sql("select doc_id, quality from labels").fetchall())
    assert np.mean([keep[i] == bool(q) for i, q in good.items() if i in keep]) >= 0.85


def test_op10_recall(spark, tables):
    vectors = {i: np.array(v, np.float64) for i, v in tables.sql("select vec_id, embedding from embeddings").fetchall()}
    out = defaultdict(list)
    for r in sorted(rows(spark, "op10_nearest_neighbours"), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append(r["vec_id"])
        assert r["score"] == pytest.approx(float(np.sqrt(((vectors[r["query_id"]] - vectors[r["vec_id"]]) ** 2).sum())), abs=1e-12)
    found = 0
    for q in (i for i in vectors if i % 100 == 0):
        near = sorted((float(np.sqrt(((v - vectors[q]) ** 2).sum())), i) for i, v in vectors.items() if i != q)[:10]
        assert len(out[q]) == 10
        found += len(set(out[q]) & {i for _, i in near})
    assert found / (10 * len(out)) >= 0.9
