"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Their accuracies are unknown
and they overlap; expectation-maximisation estimates, from how often each pattern of votes
occurs over all documents, the share of good ones and each labeller's accuracy in either class
(but for one labeller, TRUSTED, on good documents, which says which class is which).
The posterior of a pattern is then the target of a linear scorer over hashed n-grams, which
scores whole texts.

All documents count in the estimation (a row for each pattern of votes, at most
3 ** len(LABELLERS), comes to the driver). The scorer is fitted on a bounded sample: about
`sample_chars` characters of the likely good and of the likely bad each, in hash order of the
id. Null and empty texts are bad: each gets the labellers' votes for an empty text. If all
patterns say the same there is nothing to tell apart and every score is near that share.
Repeated rows are scored each for itself; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import draw
from .toxicity import score_texts

SAMPLE_CHARS = 4_000_000
LENGTHS = (1, 2, 3)
BITS = 18
ROUNDS = 200
#: The labeller that tells the classes apart: it is taken to be right on this share of the good
#: documents it votes on. All other accuracies are estimated. Without such an anchor estimation
#: takes junk that shows in symbols alone, the most frequent kind, for good documents and the
#: labeller for an inaccurate one, as the labellers do not err independently.
TRUSTED, PRECISE = "symbols", 0.999
KEEP = 0.5
RUN = 5


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _kept(text: Column, pattern: str) -> Column:
    """Number of characters that are of the class `pattern`."""
    return F.length(F.regexp_replace(text, f"[^{pattern}]+", ""))


def measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    runs = F.transform(F.sequence(F.lit(1), n - RUN + 1), lambda i: F.xxhash64(F.slice(words, i, RUN)))
    return {
        "n": n,
        "distinct": distinct,
        # Only where few words differ, which are few texts: share of runs of RUN words that occurred before.
        "repeated_runs": F.when((distinct < n * 0.2) & (n >= RUN), 1 - F.size(F.array_distinct(runs)) / (n - RUN + 1)).otherwise(F.lit(0.0)),
        "lines": F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)),
        "chars": F.length(text),
        "letters": _kept(text, r"\p{L}"),
        "capitals": _kept(text, r"\p{Lu}"),
        "symbols": F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s.,;:!?'\"()\-]+", "")),
        "stops": _kept(text, ".!?"),
    }


def labellers() -> dict[str, tuple[Column, Column]]:
    """Name: (votes bad, votes good) over the measures in a column m; neither is an abstention."""
    m = {name: F.col(f"m.{name}") for name in measures(*map(F.lit, ("", "", "")))}
    n = m["n"]
    symbols, capitals = _share(m["symbols"], m["chars"]), _share(m["capitals"], m["letters"])
    repeats, line_repeats = _share(n - m["distinct"], n), _share(m["lines"] - m["distinct_lines"], m["lines"])
    stops, length = _share(m["stops"], n), _share(m["letters"], n)
    # In prose the distinct words grow with about the root of the length, so neither bound depends on it.
    repetitive = (m["distinct"] < 3 * F.sqrt(n)) | (m["repeated_runs"] > 0.5)
    return {
        "length": (n < 3, n >= 40),
        "symbols": (symbols > 0.04, symbols < 0.01),
        "capitals": (capitals > 0.4, capitals < 0.15),
        "repeats": ((repeats > 0.8) & repetitive, repeats < 0.6),
        "lines": (line_repeats > 0.6, (line_repeats < 0.1) & (m["lines"] > 1)),
        "sentences": ((stops > 0.6) | ((n >= 40) & (stops < 0.01)), (stops > 0.02) & (stops < 0.4)),
        "word_length": ((length < 2) | (length > 12), (length > 3) & (length < 9)),
    }


LABELLERS = ("length", "symbols", "capitals", "repeats", "lines", "sentences", "word_length")


def with_votes(docs: DataFrame, text_col: str, out: str = "votes") -> DataFrame:
    """docs with a string of g, b or - for each labeller; a column of that name is replaced. Words, lines and measures are computed once, in steps."""
    kept = [c for c in docs.columns if c != out]
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("row"), text.alias("t"), F.array_remove(F.split(text, r"\s+"), "").alias("w"), F.array_remove(F.split(text, "\n"), "").alias("l"))
    rows = rows.select("row", F.struct(*[c.alias(x) for x, c in measures(F.col("t"), F.col("w"), F.col("l")).items()]).alias("m"))
    vote = F.concat(*[F.when(bad, "b").when(good, "g").otherwise("-") for bad, good in labellers().values()])
    return rows.select("row.*", vote.alias(out))


def estimate(patterns: dict[str, int], rounds: int = ROUNDS) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """Posterior of good for each pattern; for each labeller its accuracy on good and on bad documents."""
    if not patterns:
        return {}, {}
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], np.float64)
    good = np.array([[c == "g" for c in p] for p in names], np.float64)
    bad = np.array([[c == "b" for c in p] for p in names], np.float64)
    # A single bad vote outweighs: junk shows in one way, good text in all.
    post = np.where(bad.sum(axis=1) > 0, 0.1, 0.9)
    right = np.zeros((2, good.shape[1]))
    for _ in range(rounds):
        share = float(np.clip((n * post).sum() / n.sum(), 0.01, 0.99))
        for z, of in ((1, n * post), (0, n * (1 - post))):
            hit = good if z else bad
            right[z] = np.clip(((of[:, None] * hit).sum(axis=0) + 1) / ((of[:, None] * (good + bad)).sum(axis=0) + 2), 0.001, 0.999)
        right[1, LABELLERS.index(TRUSTED)] = PRECISE
        odds = math.log(share / (1 - share)) + good @ np.log(right[1] / (1 - right[0])) + bad @ np.log((1 - right[1]) / right[0])
        post = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    return dict(zip(names, post.tolist(), strict=True)), {x: (float(right[1, i]), float(right[0, i])) for i, x in enumerate(LABELLERS) if i < right.shape[1]}


def score_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """docs with votes, posterior (of good, from the votes alone) and score (of the linear scorer)."""
    marked = with_votes(docs, text_col)
    counted = marked.groupBy("votes").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars")).collect()
    post, _ = estimate({r["votes"]: r["n"] for r in counted})
    table = F.create_map(*[F.lit(x) for p in post.items() for x in p]) if post else F.create_map(F.lit(""), F.lit(0.5))
    chars = {good: sum(r["chars"] for r in counted if (post[r["votes"]] >= 0.5) == good) for good in (True, False)}
    shares = {good: min(1.0, sample_chars / max(1, n)) for good, n in chars.items()}
    # Drawn by id and text first, so that votes are counted for few rows; a row that is repeated counts once.
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("draw", draw(F.col("id"), F.col("text")))
    rows = with_votes(rows.filter(F.col("draw") < max(shares.values())), "text").withColumn("post", table[F.col("votes")])
    rows = rows.filter(F.col("draw") < F.when(F.col("post") >= 0.5, shares[True]).otherwise(shares[False]))
    rows = rows.select("id", "text", "post").dropDuplicates(["id", "text"]).toArrow().to_pandas().sort_values(["id", "text"])
    model = linear.fit(linear.Features(LENGTHS, BITS, lower=False), rows["text"].tolist(), rows["post"].to_numpy(np.float64), naive_bayes=False)
    kept = [marked[f"`{c}`"] for c in marked.columns if c not in ("posterior", "score")]
    return score_texts(marked.select(*kept, table[marked["votes"]].alias("posterior")), model, text_col=text_col)


def worth_keeping(score: Column) -> Column:
    """The scorer decides, on texts of every length."""
    return score >= KEEP
