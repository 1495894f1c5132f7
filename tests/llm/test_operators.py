"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, extra columns and no rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import ann, decontamination, language, linear, mixing, near_dedup, quality, secrets, substrings, tokens, toxicity
from quillmill.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang", {}).get(i), more.get("source", {}).get(i, "s"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sentence(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


# Language


def test_language_backs_off_from_words_to_ngrams(spark):
    rng = random.Random(1)
    texts = [sentence(rng, 40, "abcde") for _ in range(30)] + [sentence(rng, 40, "vwxyz") for _ in range(30)]
    rows = docs(spark, texts, lang={i: "aa" if i < 30 else "zz" for i in range(60)})
    model = language.fit_language_model(rows)
    assert model.langs == ["aa", "zz"]
    asked = docs(spark, ["abcdeabcde ecdab", "ZYXWVZY vwxyx", None, "", "123 !?", "aé", "ab " * 200_000]).withColumn("score", F.lit("x"))
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify_language(asked, model).collect()}
    assert [out[i][0] for i in (0, 1, 6)] == ["aa", "zz", "aa"] and out[0][1] > 0.9
    assert [out[i] for i in (2, 3, 4)] == [("und", 0.0)] * 3
    assert language.identify_language(rows.limit(0), model).count() == 0


def test_language_memory_is_bounded_and_right(monkeypatch):
    monkeypatch.setattr(language, "REMEMBERED", 3)
    rows = np.log(np.array([[0.9, 0.1], [0.1, 0.9]], np.float32))
    model = language.LanguageModel(["a", "b"], {"known": 0}, {1: {"x": 0, "y": 1}}, rows, np.zeros(2, np.float32))
    text = "xx yy xxx yyy xxxx yyyy xxxxx known xx"
    wanted = sum(model.back_off(w) if w != "known" else rows[0] for w in text.split())
    name, score = model.predict(text)
    assert name == "a" and score == pytest.approx(1 / (1 + np.exp(wanted[1] - wanted[0])), abs=1e-6)
    assert model.predict("yy yyy yyyyyy") [0] == "b"


def test_language_without_anything_to_learn_from(spark):
    model = language.fit_language_model(docs(spark, ["abc", None]))
    assert model.langs == [] and model.predict("abc") == ("und", 0.0)


# Mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    """By rounds: deal out by weight, stop at the bound, deal the excess among the rest."""
    w = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > repeats * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = repeats * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix_reaches_its_targets(spark):
    rng = random.Random(2)
    texts = [sentence(rng, rng.randint(0, 30)) for _ in range(400)] + [None, "", "one"]
    source = {i: rng.choice(["a", "a", "a", "b", "c", None, "é"]) for i in range(403)}
    rows = docs(spark, texts, source=source).withColumn("mix", F.lit(1))
    out = mixing.mix_sources(rows).collect()
    assert len(out) == 403
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = Counter()
    for i, t in enumerate(texts):
        sums[source[i]] += size(t)
    wanted, taken = targets(sums), Counter()
    for r in out:
        m = r["mix"]
        assert m["size"] == size(r["text"]) and m["source_size"] == sums[r["source"]] and m["target"] == pytest.approx(wanted[r["source"]])
        assert 0 <= m["taken"] <= 2 * m["size"]
        taken[r["source"]] += m["taken"]
    assert all(abs(taken[s] - wanted[s]) < 1 for s in sums)
    again = mixing.mix_sources(rows.repartition(7)).collect()
    assert {r["doc_id"]: r["mix"]["taken"] for r in again} == {r["doc_id"]: r["mix"]["taken"] for r in out}
    finish = [r["mix"]["finish"] for r in out if r["mix"]["finish"] is not None]
    assert finish == sorted(finish)


def test_mix_schedule_gives_each_copy(spark):
    rng = random.Random(3)
    rows = docs(spark, [sentence(rng, 20) for _ in range(60)], source={i: "ab"[i % 2] for i in range(60)})
    mixed = mixing.mix_sources(rows)
    out = mixing.mix_schedule(mixed).collect()
    by = Counter()
    for r in out:
        by[r["doc_id"]] += r["served"]
    assert by == Counter({r["doc_id"]: r["mix"]["taken"] for r in mixed.collect() if r["mix"]["taken"]})
    assert [r["finish"] for r in out] == sorted(r["finish"] for r in out) and max(r["finish"] for r in out) < 1.1
    # The same rows as the whole sequence by virtual time, cut where the budget is spent: but for the copies being served at the cut.
    sequence = sorted((r["mix"]["finish"] + e * r["mix"]["source_size"] / r["mix"]["target"], r["doc_id"], e) for r in mixed.collect() for e in range(2))
    whole = {(d, e) for finish, d, e in sequence if finish <= 1}
    assert whole <= {(r["doc_id"], r["copy"]) for r in out} and len(out) - len(whole) <= 2
    words = {r["doc_id"]: r["mix"]["size"] for r in mixed.collect()}
    assert all(r["served"] == words[r["doc_id"]] for r in out if (r["doc_id"], r["copy"]) in whole)
    clash = mixing.mix_schedule(mixed.withColumns({c: F.lit(5) for c in ("_c", "_key", "c", "row", "key", "copy")}))
    assert {"_c", "_key", "c", "row", "key"} <= set(clash.columns) and clash.count() == len(out)


def test_mix_of_nothing(spark):
    empty = docs(spark, ["x"]).limit(0)
    assert mixing.mix_sources(empty).count() == 0
    assert [r["mix"]["taken"] for r in mixing.mix_sources(docs(spark, [None, "", " "])).collect()] == [0, 0, 0]


# Decontamination


def low_words(text):
    lowered = (text or "").translate(str.maketrans(decontamination.UPPER, decontamination.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_contamination(text, items, width=10):
    w, hit, found = low_words(text), set(), set()
    for item, content in items:
        v = low_words(content)
        wins = [v[i : i + width] for i in range(len(v) - width + 1)] if len(v) >= width else [v] if v else []
        for win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_contamination_equals_brute_force(spark, broadcast_rows):
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randint(0, 25), "abÉ1")) for i in range(20)] + [(7, "same again"), (None, "no id"), (8, None), (9, "?"), (10, "aa"), (11, "the the the the the the the the the the the")]
    texts = [None, "", "!", "NO ID", "the " * 300, "x" * 100_000]
    for i in range(40):
        part = low_words(items[i % 20][1])
        texts.append(sentence(rng, 20, "abÉ1") + " / ".join(["", *part[i % 3 :], ""]) + sentence(rng, 5))
    rows = docs(spark, texts)
    rows = rows.union(rows.filter("doc_id in (3, 10)")).withColumn("items", F.lit(1)).withColumn("win", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.find_contamination(rows, bench, broadcast_rows=broadcast_rows).collect()
    assert Counter(r["doc_id"] for r in out) == Counter([*range(len(texts)), *([3, 10] if broadcast_rows else [3, 10])])
    for r in out:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_contamination(texts[r["doc_id"]], items), texts[r["doc_id"]]


def test_contamination_of_nothing(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.find_contamination(docs(spark, ["a b"]).limit(0), bench).count() == 0
    assert [r["n_hit"] for r in decontamination.find_contamination(docs(spark, ["a b"]), bench.limit(0)).collect()] == [0]


# Substrings


def test_repeated_passages_are_found_and_others_left(spark):
    rng = random.Random(5)
    passage = sentence(rng, 55)
    texts = [sentence(rng, rng.randint(60, 200)) for _ in range(40)]
    for i in (3, 8, 20, 31):
        texts[i] = texts[i] + " " + passage + ". " + sentence(rng, 30)
    texts += [texts[5], None, "", "short one", "word " * 5000]
    rows = docs(spark, texts).withColumn("pos", F.lit(1))
    out = substrings.repeated_passages(rows).collect()
    assert {r["doc_id"] for r in out} == {8, 20, 31, 40}
    assert {r["kept_id"] for r in out if r["doc_id"] != 40} == {3} and {r["kept_id"] for r in out if r["doc_id"] == 40} == {5}
    place = texts[8].split().index(passage.split()[0])
    assert all(place <= r["first_word"] < r["last_word"] <= place + 55 for r in out if r["doc_id"] == 8)
    assert substrings.repeated_passages(rows.limit(0)).count() == 0


def test_every_run_of_fifty_words_shares_a_paragraph():
    rng = np.random.default_rng(6)
    for _ in range(200):
        run = rng.integers(0, 1 << 60, 50)
        a = np.concatenate([rng.integers(0, 1 << 60, rng.integers(0, 90)), run, rng.integers(0, 1 << 60, rng.integers(0, 90))])
        b = np.concatenate([rng.integers(0, 1 << 60, rng.integers(0, 90)), run, rng.integers(0, 1 << 60, rng.integers(0, 90))])
        assert set(substrings.paragraphs(a)[1]) & set(substrings.paragraphs(b)[1])


def test_every_text_of_a_paragraph_or_more_has_one():
    rng = np.random.default_rng(19)
    assert all(len(substrings.paragraphs(rng.integers(0, 1 << 60, n))[0]) for n in range(substrings.PARAGRAPH, 60) for _ in range(50))


@pytest.mark.parametrize("n", [50, 60, 120])
def test_an_equal_run_goes_whole(spark, n):
    rng = random.Random(n)
    texts = []
    for _ in range(6):
        run = sentence(rng, n)
        texts += [" ".join([sentence(rng, rng.randint(0, 80)), run, sentence(rng, rng.randint(1, 80))]) for _ in range(2)]
    out = [(r["doc_id"], r["kept_id"], r["first_word"], r["last_word"]) for r in substrings.repeated_passages(docs(spark, texts)).collect()]
    wanted = []
    for i in range(0, 12, 2):
        a, b = texts[i].split(), texts[i + 1].split()
        shared = {tuple(a[y : y + n]) for y in range(len(a) - n + 1)}
        at = next(x for x in range(len(b)) if tuple(b[x : x + n]) in shared)
        wanted.append((i + 1, i, at, at + n))
    assert sorted(out) == wanted


def similar_sets(spark, rows, similarity):
    with Scratch(spark) as scratch:
        return substrings.similar_sets(rows, similarity, scratch).collect()


@pytest.mark.parametrize("similarity", [0.8, 0.7])
def test_similar_sets_have_the_classes_of_all_pairs(spark, similarity):
    rng = random.Random(13)
    sets = []
    for _ in range(60):
        base = rng.sample(range(40), 12)
        sets += [base, base[:11] + [99], base[:10], base[:10] + [97, 98], base[:8], [*base[:9], 96], base[:4], base[:5]]
    sets = [sorted(set(s)) for s in sets]
    rows = spark.createDataFrame(list(enumerate(sets)), "h long, s array<int>").repartition(3)
    edges = [(r["a"], r["b"]) for r in similar_sets(spark, rows, similarity)]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if len(set(sets[i]) & set(sets[j])) >= len(set(sets[i]) | set(sets[j])) * similarity - 1e-9]
    assert set(edges) <= set(pairs)

    def classes(links):
        label = list(range(len(sets)))
        for i, j in links:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
        return label

    assert classes(edges) == classes(pairs)


def test_similar_paragraphs_of_a_crowded_band_are_linked(spark):
    rng = random.Random(14)
    vocabulary = [sentence(rng, 1, "abcdefghijkl") + str(i) for i in range(200)]
    hashes = np.array([r[0] for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select(F.xxhash64("w")).collect()])
    runs = np.random.default_rng(15).integers(0, 200, (400_000, 5))
    grams = hashes[runs].view(np.uint64)
    value = np.zeros(len(runs), np.uint64)
    for i in range(5):
        value = value * near_dedup.STEP + grams[:, i]
    value = near_dedup._mixed(value)
    # The shingle that is the smallest of nearly all: an anchor, and the minimum of each band.
    least = np.max([value, *[near_dedup._mixed(value ^ np.uint64(b * 2 + 1)) for b in range(substrings.BANDS)]], axis=0).argmin()
    phrase = " ".join(vocabulary[i] for i in runs[least])
    tail = sentence(rng, 10)
    texts = [f"{sentence(rng, 40)} {phrase} {t} {sentence(rng, 40)}" for t in [tail + " last", *[sentence(rng, 11) for _ in range(30)], tail + " other"]]
    out = substrings.repeated_passages(docs(spark, texts)).collect()
    assert [(r["doc_id"], r["kept_id"], r["first_word"], r["last_word"]) for r in out] == [(31, 0, 40, 56)]


# Toxicity and quality


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(7)
    texts, marks = [], []
    for i in range(400):
        w = sentence(rng, 60).split()
        if i % 4 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vileword", "vilest", "vilely"]))
        texts.append(" ".join(w))
        marks.append((i, int(i % 4 == 0)))
    rows = docs(spark, texts)
    labels = spark.createDataFrame([m for m in marks if m[0] % 2] + marks[:200] + [(None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(rows, labels)
    out = {r["doc_id"]: r["score"] for r in toxicity.score_texts(rows, model).collect()}
    held = range(200, 400, 4)
    assert all(out[i] >= 0.7 for i in held) and all(out[i] < 0.5 for i in range(201, 400, 2))
    odd = toxicity.score_texts(docs(spark, [None, "", "x" * 50_000]).withColumn("score", F.lit("y")), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.fit_toxicity(rows, labels.filter("toxic = 0")).score("vile") < 0.1
    assert toxicity.fit_toxicity(rows.limit(0), labels).score(None) < 0.1


def test_features_of_long_texts_are_those_of_the_definition(monkeypatch):
    features, rng = linear.Features((2, 3, 5), 20), random.Random(21)
    for n in (0, 1, 3, 40, 99, 100, 101, 350):
        text = sentence(rng, n)[:n] if n else ""
        whole = set(features.present(text).tolist())
        with monkeypatch.context() as m:
            m.setattr(linear, "BLOCK_CHARS", 50)
            blocks = features.present(text).tolist()
        assert set(blocks) == whole and len(blocks) == len(whole)


def test_features_are_each_given_once():
    f = linear.Features((2, 3), 12)
    x = f.present("abababab")
    assert len(x) == len(set(x.tolist())) and len(f.present(None)) > 0 and sorted(f.present("AB")) == sorted(f.present("ab"))


@pytest.mark.parametrize("good", [0.8, 0.9, 0.95])
def test_labellers_accuracies_are_estimated(good):
    rng = random.Random(8)
    truth = [rng.random() < 0.8 for _ in range(6000)]
    accuracy = dict(zip(quality.LABELLERS, (0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.6), strict=True))
    right_on_good = {x: quality.PRECISE if x == quality.TRUSTED else good for x in quality.LABELLERS}
    vote = lambda z, x: "-" if rng.random() < 0.2 else "gb"[z ^ (rng.random() < (right_on_good[x] if z else accuracy[x]))]
    rows = Counter("".join(vote(z, x) for x in quality.LABELLERS) for z in truth)
    post, right = quality.estimate(dict(rows))
    for name, a in accuracy.items():
        assert right[name] == pytest.approx((right_on_good[name], a), abs=0.05)
    assert post["ggggggg"] > 0.95 > 0.05 > post["bbbbbbb"] and quality.estimate({})[0] == {}


def test_quality_keeps_prose_and_not_junk(spark):
    rng = random.Random(9)
    prose = [". ".join(sentence(rng, 9).capitalize() for _ in range(8)) + ".\n" + sentence(rng, 8) + "." for _ in range(80)]
    junk = ["%%% ### " * 30, "BUY NOW!! " * 30, "a | b | c | " * 30] * 8
    rows = docs(spark, prose + junk + [None, ""]).withColumns({c: F.lit(0) for c in ("votes", "_words", "_lines", "m", "row", "t")})
    out = quality.score_quality(rows).withColumn("keep", quality.worth_keeping(F.col("score")))
    out = {r["doc_id"]: r["keep"] for r in out.collect()}
    assert all(out[i] for i in range(80)) and not any(out[i] for i in range(80, 104))
    assert quality.score_quality(rows.limit(0)).count() == 0


@pytest.mark.parametrize("n", [200, 3999, 4000, 40_000])
def test_repeats_are_bad_at_any_length(spark, n):
    rng = random.Random(18)
    few = [sentence(rng, 1) + str(i) for i in range(700)]
    texts = [
        " ".join((sentence(rng, 9) + ". ").split() * (n // 9 + 1)),  # one sentence
        " ".join(few[i % min(n // 7, 700)] for i in range(n)),  # a longer passage
        " ".join(rng.choice(few[:8]) for _ in range(n)),  # eight words
        " ".join(rng.choice(few) for _ in range(n)),  # 700 words in any order
    ]
    out = quality.with_votes(docs(spark, texts), "text").orderBy("doc_id").collect()
    votes = [r["votes"][quality.LABELLERS.index("repeats")] for r in out]
    assert votes[:3] == ["b"] * 3 and votes[3] != "b"


# Tokens


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_token_counts_over_any_blocks(spark, tmp_path, block):
    rng = random.Random(10)
    streams = {"a": [rng.choice([9, 9, 5, 6, 7]) for _ in range(60)], "b": [9, 9, 9], "c": [5, 6], "d": [], "e": [5] * 20 + [9]}
    for name, s in streams.items():
        (tmp_path / name).write_bytes(np.array(s, "<u2").tobytes())
    files = spark.createDataFrame([(n, 2 * len(s)) for n, s in streams.items()], "file string, n_bytes long")
    out = defaultdict(dict)
    for r in tokens.count_tokens(files, str(tmp_path), end=9, block_tokens=block).collect():
        out[r["file"]][r["ordinal"]] = r["n_tokens"]
    for name, s in streams.items():
        parts, n = [], 0
        for t in s:
            n = n + 1 if t != 9 else (parts.append(n), 0)[1]
        parts += [n] * (n > 0)
        assert [out[name][i] for i in range(len(parts))] == parts and len(out[name]) == len(parts)


def test_document_token_counts(spark):
    texts = ["Hello world, hello.", None, "", "<|endoftext|> is text", "é" * 5000]
    rows = docs(spark, texts)
    rows = rows.union(rows.filter("doc_id = 0")).withColumn("file", F.lit(1)).withColumn("first", F.lit(1))
    encode = tokens.encoder(open(VOCABULARY, "rb").read()).encode_ordinary
    out = sorted((r["doc_id"], r["n_tokens"]) for r in tokens.document_token_counts(rows, VOCABULARY).collect())
    assert out == sorted([(i, len(encode(t or ""))) for i, t in enumerate(texts)] + [(0, len(encode(texts[0])))])
    assert tokens.document_token_counts(rows.limit(0), VOCABULARY).count() == 0


# Secrets


def brute_spans(text):
    out = []
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


PIECES = st.sampled_from(["password", "passwd", "PassWord", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "f", "ſecret", "toKen", "é", "x", "a1b2c3", "token=", "\n", "AKIAAKIA"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=25))
def test_base_spans_equal_the_patterns(pieces):
    text = "".join(pieces)
    assert [s for s in secrets.find_spans(text) if s[1] < secrets.BASE] == brute_spans(text)


def with_checksum(prefix, body):
    v, d = zlib.crc32(body.encode()), ""
    for _ in range(6):
        v, r = divmod(v, 62)
        d = secrets.BASE62[r] + d
    return prefix + body + d


def test_checksums_decide(spark):
    good = with_checksum("ghp_", "Zz1" * 10)
    bad = good[:-1] + ("a" if good[-1] != "a" else "b")
    npm = with_checksum("npm_", "Q9k" * 10)
    texts = [f"x {good} y", f"x {bad}", npm + "!", None, "", "a " * 100_000 + "token: abcdefghijklmnop"]
    out = secrets.scan_secrets(docs(spark, texts).withColumn("spans", F.lit(1)), redact=True).orderBy("doc_id").collect()
    kinds = [[s["kind"] for s in r["spans"]] for r in out]
    assert kinds == [["github"], [], ["npm"], [], [], ["assign"]]
    assert out[0]["text"] == "x <github> y" and out[3]["text"] is None and out[5]["text"].endswith("a <assign>")
    assert secrets.scan_secrets(docs(spark, ["x"]).limit(0)).count() == 0


# Near duplicates


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=18), st.lists(st.integers(0, 4), max_size=18), st.integers(0, 12))
def test_banded_distance_equals_the_table(a, b, most):
    d = distance(a, b)
    assert near_dedup.banded_distance(a, b, most) == (d if d <= most else None)


def test_kmers_of_an_occurrence_differ():
    ids = np.array([1, 2, 3, 4, 5] * 4)
    assert len(set(near_dedup.kmers(ids).tolist())) == 16 and len(near_dedup.kmers(ids[:3])) == 1
    once = near_dedup.kmers(ids[:7])
    assert (once[:3] == near_dedup.kmers(ids)[:3]).all()  # alike in texts with and without repeats


def test_classes_equal_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(25):
        base = sentence(rng, rng.randint(30, 150)).split()
        texts.append(" ".join(base))
        for edits in (0, 1, 3):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w).upper() if edits == 1 else " ".join(w))
    texts += ["", "", None, None, "!!", "one two", "one, two", "word " * 20_000]
    rows = docs(spark, texts).withColumn("class_id", F.lit(7)).withColumn("key", F.lit(1))
    out = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(rows).collect()}
    w = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = texts[i] is not None and texts[i] == texts[j]
            if w[i] and w[j] and min(len(w[i]), len(w[j])) >= 0.8 * max(len(w[i]), len(w[j])) and max(len(w[i]), len(w[j])) < 1000:
                same = distance(w[i], w[j]) <= 0.2 * max(len(w[i]), len(w[j]))
            if same:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert out == dict(enumerate(label))
    kept = near_dedup.keep_one(rows.union(rows.filter("doc_id in (0, 1)")))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label)) and kept.columns == rows.columns
    assert near_dedup.near_duplicate_classes(rows.limit(0)).count() == 0


@pytest.mark.parametrize(("share", "least"), [(0.05, 0.99), (0.10, 0.99), (0.15, 0.97), (0.20, 0.90)])
def test_scattered_edits_are_recalled(spark, share, least):
    rng = random.Random(16)
    texts = []
    for i in range(150):
        n = (50, 100, 300)[i % 3]
        base = sentence(rng, n).split()
        w = list(base)
        for at in rng.sample(range(n), int(share * n)):
            w[at] = sentence(rng, 1, "vwxyz") + "q"
        texts += [" ".join(base), " ".join(w)]
    out = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(docs(spark, texts)).collect()}
    assert all(out[i] == i for i in range(0, 300, 2)) and all(out[i] in (i, i - 1) for i in range(1, 300, 2))
    assert sum(out[i] == i - 1 for i in range(1, 300, 2)) >= least * 150


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=30), st.lists(st.integers(0, 400), max_size=30))
def test_counts_of_words_never_refuse_a_near_pair(a, b):
    x, y = (near_dedup.word_classes(np.array(t, np.int64)) for t in (a, b))
    if distance(a, b) <= 0.2 * max(len(a), len(b)):
        assert near_dedup.may_be_near(x, y, np.int64(len(a)), np.int64(len(b)), 0.8)
        p, q = (int.from_bytes(near_dedup.word_bits(np.array(t, np.int64) << 20).tobytes()) for t in (a, b))
        assert max((p & ~q).bit_count(), (q & ~p).bit_count()) <= 0.2 * max(len(a), len(b))


def test_a_pair_in_a_bucket_of_many_unlike_texts_is_found(spark):
    rng = random.Random(17)
    passage = sentence(rng, 140)
    texts = [passage + " " + sentence(rng, 60) for _ in range(300)]
    for i in (120, 130, 140, 150):
        w = texts[i].split()
        for at in range(140, 200, 2):  # half of the rest
            w[at] = sentence(rng, 1, "vwxyz") + "q"
        texts[i + 1] = " ".join(w)
    out = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(docs(spark, texts)).collect()}
    assert out == {i: i - 1 if i in (121, 131, 141, 151) else i for i in range(300)}


def test_near_copies_without_an_id_are_found(spark):
    rng = random.Random(20)
    base = sentence(rng, 100)
    rows = docs(spark, [sentence(rng, 80), base]).union(spark.createDataFrame([(None, base + " more", None, "s", 1), (None, sentence(rng, 90), None, "s", 1), (None, None, None, "s", 1)], DOCS))
    out = near_dedup.near_duplicate_classes(rows).collect()
    assert sorted((r["doc_id"] is None, r["n_words"], r["class_id"]) for r in out if r["n_words"] > 90) == [(False, 100, 1), (True, 101, 1)]
    assert [r["class_id"] for r in out if r["doc_id"] is None and r["n_words"] <= 90] == [None, None]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)], "a long, b long")
    with Scratch(spark) as scratch:
        out = near_dedup.components(edges, scratch).collect()
    assert sorted(Counter(r["label"] for r in out).items()) == [(0, 41), (100, 3)]


def test_scratch_leaves_nothing(spark):
    before = spark.conf.get(Scratch.CLEAN, None)
    with pytest.raises(ZeroDivisionError), Scratch(spark) as scratch:
        kept = scratch.keep("x", spark.range(3).repartition(2))
        assert kept.count() == 3 and spark.conf.get(Scratch.CLEAN) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(Scratch.CLEAN, None) == before and not Path(scratch.folder).exists()


# Nearest neighbours


def brute_nearest(rows, k=10):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % 10 == 0:
            d = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in ok if j != i)[:k]
            out[i] = d
    return out


@pytest.mark.parametrize("n", [4, 1500])
def test_neighbours_are_recalled_and_scores_exact(spark, n):
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(n)]
    rows += [(5000 + i, rows[0][1]) for i in range(40)] + [(9000, None), (9010, [0.0] * 8), (9020, [float("nan")] * 8), (9030, [None] * 8), (9040, [1.0]), (None, [1.0] * 8), (9050, [])]
    df = spark.createDataFrame(rows + rows[:1], "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    out = defaultdict(list)
    for r in ann.search(df, df.filter("vec_id % 10 = 0")).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    wanted = brute_nearest(rows)
    assert out.keys() == wanted.keys()
    found = total = 0
    for q, near in wanted.items():
        assert len(out[q]) == len(near) and out[q] == sorted(out[q])
        found += len({v for _, v in out[q]} & {v for _, v in near})
        total += len(near)
    assert found / total >= 0.9
    assert [v for _, v in out[0]] == [v for _, v in wanted[0]] and np.allclose([d for d, _ in out[0]], [d for d, _ in wanted[0]])
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
