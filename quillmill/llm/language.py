"""Language identification: word-first backoff.

A known word adds, for each language, its log frequency there. An unseen word is scored by its
character n-grams: the longest length at which any of its n-grams is known decides, with the
mean log frequency of the known ones. Frequencies are learned from labelled texts.

The model is fitted on a bounded sample: of each language, documents drawn by the hash of their id
and text up to about `sample_chars` characters (all of them while a language has fewer). A word, or an
n-gram among those of its length, is known if in some language it occurs twice at least, and makes
up at least one in ONE_IN of what that language has; so a language with little text loses none to the
others. Scoring covers whole texts.

A text that is null or has no letter is `und` with score 0; so is any text if there is nothing
to learn from. Ties go to the language that sorts first. Rows without an id are sampled like others;
rows alike in id, text and language count once in the model, and are scored each for itself; extra
columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounds, bounded_sample

SAMPLE_CHARS = 6_000_000
LEAST_TIMES, ONE_IN = 2, 200_000
LONGEST = 5
UNKNOWN = "und"
TOKEN = re.compile(r"[^\W\d_]+")
#: Words that were not in the model are remembered, up to so many in a worker.
REMEMBERED = 200_000


@dataclass
class LanguageModel:
    """langs; for each known word or n-gram (by length) a row of log frequencies."""

    langs: list[str]
    words: dict[str, int]
    ngrams: dict[int, dict[str, int]]
    rows: np.ndarray
    floor: np.ndarray
    _table: dict[str, int] = field(default_factory=dict, repr=False)
    _vectors: np.ndarray | None = field(default=None, repr=False)
    _used: int = 0

    def __getstate__(self):
        return self.__dict__ | {"_table": {}, "_vectors": None, "_used": 0}

    def _start(self) -> None:
        self._table = dict(self.words)
        self._vectors = np.concatenate([self.rows, np.zeros((REMEMBERED, len(self.langs)), np.float32)])
        self._used = len(self.rows)

    def back_off(self, word: str) -> np.ndarray:
        for n in range(min(LONGEST, len(word)), 0, -1):
            known = self.ngrams.get(n, {})
            if found := [i for k in range(len(word) - n + 1) if (i := known.get(word[k : k + n])) is not None]:
                return self.rows[found].mean(axis=0)
        return self.floor

    def _remember(self, words: list[str]) -> None:
        if self._vectors is None or self._used + len(words) > len(self._vectors):
            self._start()
        for w in words:
            if w not in self._table:
                if self._used == len(self._vectors):
                    self._vectors = np.concatenate([self._vectors, np.zeros((len(words), len(self.langs)), np.float32)])
                self._vectors[self._used] = self.back_off(w)
                self._table[w] = self._used
                self._used += 1

    def predict(self, text: str | None) -> tuple[str, float]:
        words = TOKEN.findall(text.lower()) if text and self.langs else []
        if not any(w.isalpha() for w in words) and not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        if self._vectors is None:
            self._start()
        ids = list(map(self._table.get, words))
        if None in ids:
            self._remember(list({w for w, i in zip(words, ids, strict=True) if i is None}))
            ids = list(map(self._table.get, words))
            if None in ids:  # the memory was emptied meanwhile
                self._remember(list(set(words)))
                ids = list(map(self._table.get, words))
        score = self._vectors[ids].sum(axis=0, dtype=np.float64)
        best = int(score.argmax())
        return self.langs[best], float(1.0 / np.exp(score - score[best]).sum())


def fit_language_model(
    labelled: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_chars: int = SAMPLE_CHARS,
) -> LanguageModel:
    rows = labelled.select(id_col, text_col, lang_col).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = bounded_sample(rows, id_col, text_col, lang_col, sample_chars)
    langs = sorted(r[0] for r in rows.select(lang_col).distinct().collect())
    word = F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"(\p{L}+)"), F.lit(1)))
    counts = rows.select(F.col(lang_col).alias("lang"), word.alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    # A row for each word, a column for each language.
    each = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).cast("int").alias(f"n{i}") for i, x in enumerate(langs)]
    counts = counts.groupBy("w").agg(*each).persist() if langs else None

    def known(rows: DataFrame) -> pd.DataFrame:
        """Those that are frequent enough in some language, with their counts in all."""
        totals = rows.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(langs))]).first()
        enough = [F.col(f"n{i}") >= max(LEAST_TIMES, -(-(totals[i] or 0) // ONE_IN)) for i in range(len(langs))]
        return rows.filter(reduce(Column.__or__, enough)).toArrow().to_pandas().sort_values("w")

    top = {0: known(counts)} if langs else {}
    for n in range(1, LONGEST + 1) if langs else ():
        at = F.sequence(F.lit(1), F.length("w") - n + 1)
        grams = counts.filter(F.length("w") >= n).withColumn("w", F.explode(F.transform(at, lambda i: F.substr("w", i, F.lit(n)))))
        grams = grams.groupBy("w").agg(*[F.sum(f"n{i}").cast("int").alias(f"n{i}") for i in range(len(langs))]).persist()
        top[n] = known(grams)
        grams.unpersist()
    if counts is not None:
        counts.unpersist()

    tables, blocks, used = {0: {}}, [np.zeros((0, len(langs)), np.float32)], 0
    for n, found in top.items():
        freq = found.drop(columns="w").to_numpy(np.float64).reshape(len(found), len(langs)) + 0.5
        tables[n] = dict(zip(found["w"], range(used, used + len(found)), strict=True))
        blocks.append(np.log(freq / np.maximum(freq.sum(axis=0), 1.0)).astype(np.float32))
        used += len(found)
    return LanguageModel(langs, tables.pop(0), tables, np.concatenate(blocks), np.zeros(len(langs), np.float32))


def identify_language(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (posterior of the predicted language, 0 to 1)."""
    arrow_bounds(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            found = [known.predict(t) for t in batch.column(names.index(text_col)).to_pylist()]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "lang_pred", "score"])

    kept = docs.select(*[docs[f"`{c}`"] for c in names])
    schema = kept.withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}).schema
    return kept.mapInArrow(predict, schema)
