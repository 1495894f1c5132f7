"""Token alignment against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import alignment
from quillmill.llm.queries import QUERIES

from .test_queries import SF

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabularies():
    return alignment.ByteLevel(open(A_FILE, "rb").read()), alignment.Pieces(open(B_FILE, "rb").read())


def tokens_of(text, vocabularies):
    """Ids of both, by the libraries the files are for; none if they do not spell the text."""
    a, b = vocabularies
    if not text:
        return [], []
    x, y = a.tokenizer.encode(f" {text}", add_special_tokens=False).ids, b.model.encode(text)
    same = b"".join(a.token_bytes[i] for i in x) == b"".join(b.token_bytes[i] for i in y) == f" {text}".encode()
    return (x, y) if same else ([], [])


def grouped(x, y, vocabularies):
    """Groups as pairs of lists, walking both sequences."""
    a, b = (v.token_bytes for v in vocabularies)
    out, i, j, left, right = [([], [])] if x else [], 0, 0, 0, 0
    while i < len(x) or j < len(y):
        if left <= right and i < len(x):
            left, i = left + len(a[x[i]]), i + 1
            out[-1][0].append(x[i - 1])
        else:
            right, j = right + len(b[y[j]]), j + 1
            out[-1][1].append(y[j - 1])
        if left == right and i < len(x):
            out.append(([], []))
    return out


def brute(texts, vocabularies):
    """A tuple for each text: figures and the groups as text."""
    each = [grouped(*tokens_of(t, vocabularies), vocabularies) for t in texts]
    counts = Counter((g[0][-1], g[1][-1]) for groups in each for g in groups)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for groups in each:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        sizes = sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups)
        out.append((*sizes, len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), shown))
    return out


def rows(df):
    return [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in df.collect()]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FF) | st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n\t'’—–“”…"), max_size=60))
def test_both_encoders_of_vocabulary_a_agree(text):
    a = both()
    plain, other = a.plain.encode_ordinary(f" {text}"), a.tokenizer.encode(f" {text}", add_special_tokens=False).ids
    assert a.encode([text]) == [other]
    if alignment.PLAIN.fullmatch(text):
        assert plain == other


def both(found=[]):  # noqa: B006
    if not found:
        found.append(alignment.ByteLevel(open(A_FILE, "rb").read()))
    return found[0]


def test_encoders_agree_on_every_plain_character():
    a = both()
    for c in map(chr, [*range(0x250), *range(0x2010, 0x2020)]):
        for text in (f" a{c}b", f" {c}{c} {c}1{c}", f"{c}'s {c}\n{c}", f" .{c}, {c} {c}"):
            assert a.plain.encode_ordinary(text) == a.tokenizer.encode(text, add_special_tokens=False).ids


def test_alignment_equals_brute_force(spark, vocabularies, monkeypatch):
    rng = random.Random(5)
    words = ["unbelievable", "tokenizers", "straße", "naïve", "日本語", "🙂", "x1y22", "...", "it's", "<|endoftext|>", "</s>", "<unk>", "\t", "\n\n", "  ", "مرحبا", "é"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(60)]
    texts += [None, "", " ", "a", "a", "piece▁mark", "\x00", "word " * 3000, "".join(rng.choices("abcdefgh", k=5000))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "id", "n", "n_a", "groups", "pair")})
    wanted = [(i, *r) for i, r in enumerate(brute(texts, vocabularies))]
    assert sorted(rows(alignment.align_tokenizers(table.repartition(5), A_FILE, B_FILE))) == wanted
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 1)  # the merged counts are joined by a shuffle
    assert sorted(rows(alignment.align_tokenizers(table, A_FILE, B_FILE))) == wanted


def test_alignment_of_repeated_and_missing_ids(spark, vocabularies):
    texts = ["some words here", "some words here", "other ones", None]
    table = spark.createDataFrame(list(zip([1, 1, None, None], texts, strict=True)), "doc_id long, text string")
    wanted = [(i, *r) for i, r in zip([1, 1, None, None], brute(texts, vocabularies), strict=True)]
    assert sorted(map(repr, rows(alignment.align_tokenizers(table, A_FILE, B_FILE)))) == sorted(map(repr, wanted))
    assert alignment.align_tokenizers(table.limit(0), A_FILE, B_FILE).count() == 0
    assert rows(alignment.align_tokenizers(table.filter("text is null"), A_FILE, B_FILE)) == [(None, 0, 0, 0, 0, 0, 0, "")]


def test_op13_equals_brute_force(spark, vocabularies):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall())
    out = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_token_alignment"](spark, SF).collect()}
    wanted = {i: (*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for i, r in zip(texts, brute(texts.values(), vocabularies), strict=True)}
    assert out == wanted
