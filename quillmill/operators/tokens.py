"""Tokenizers, token columns and token statistics."""

from __future__ import annotations

from functools import cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..functions import text as T

# Special tokens, in order of their ids.
SPECIALS = ("<pad>", "<unk>", "<bos>", "<eos>")
PAD, UNK, BOS, EOS = range(4)
VOCABULARY, MIN_COUNT = 10_000, 2
#: White space apart, a run of word characters or of others is a word.
WORD = r"(?U)(\w+|[^\w\s]+)"


def word_counts(texts: DataFrame, text: Column) -> DataFrame:
    """word, n over all texts."""
    rows = texts.select(F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(1))).alias("word"))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def word_vocabulary(counts: DataFrame, size: int = VOCABULARY, min_count: int = MIN_COUNT) -> list[str]:
    """The most frequent words (ties by word), at most `size` with the special tokens; a word's place after these is its token."""
    top = counts.filter(F.col("n") >= min_count).orderBy(F.desc("n"), "word").limit(size - len(SPECIALS))
    return top.select("word").toArrow()["word"].to_pylist()


def word_ids(text: Column, vocabulary: list[str]) -> Column:
    """Word-level tokens (array of int), unknown words as <unk>; none for null. Looked up within the row, as vectors."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(words: pa.Array) -> pa.Array:
        flat = pc.fill_null(pc.add(pc.index_in(words.flatten(), value_set=pa.array(vocabulary, pa.string())), len(SPECIALS)), UNK)
        ends = pc.cumulative_sum(pc.cast(pc.list_value_length(words), pa.int32()))
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), pc.cast(flat, pa.int32()))

    return ids(F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), F.array().cast("array<string>")))


def encode_words(df: DataFrame, key: list[str], text: Column, vocabulary: list[str]) -> DataFrame:
    """key columns and ids (array of int): word-level tokens."""
    return df.select(*key, word_ids(text, vocabulary).alias("ids"))


def train_bpe(texts: DataFrame, text: Column, size: int = VOCABULARY, min_count: int = MIN_COUNT, exact: bool = True) -> str:
    """A byte-pair tokenizer as JSON, trained from word counts: these are aggregated on the cluster, merges found on the driver.

    Words rarer than min_count cannot form a merge that frequent unless they share it, so all
    words that occur are given, each as often as it occurs.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    tokenizer = Tokenizer(models.BPE(unk_token=SPECIALS[UNK]))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    trainer = trainers.BpeTrainer(vocab_size=size, min_frequency=min_count, special_tokens=list(SPECIALS), show_progress=False)
    rows = word_counts(texts, text).orderBy("word").toLocalIterator()
    tokenizer.train_from_iterator((w for r in rows for w in _repeated(r["word"], r["n"])), trainer=trainer)
    if exact and tokenizer.get_vocab_size() != size:
        raise ValueError(f"the texts give {tokenizer.get_vocab_size()} tokens, not {size}")
    return tokenizer.to_str()


def _repeated(word: str, n: int, most: int = 10_000):
    """word n times, in lines of bounded length."""
    while n > 0:
        yield " ".join([word] * min(n, most))
        n -= most


@cache
def _tokenizer(model: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(model)
    missing = [t for t in SPECIALS if out.token_to_id(t) is None]
    if missing:
        raise ValueError(f"the tokenizer lacks {', '.join(missing)}")
    return out


def special_ids(model: str) -> dict[str, int]:
    return {t: _tokenizer(model).token_to_id(t) for t in SPECIALS}


def encode(model: str, text: Column, *, bos: bool = False, eos: bool = False) -> Column:
    """Token ids (array of int) of a tokenizer's JSON; loaded once in a worker."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        t = _tokenizer(model)
        head, tail = [t.token_to_id("<bos>")] * bos, [t.token_to_id("<eos>")] * eos
        found = t.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([head + e.ids + tail for e in found])

    return ids(text)


def decode(model: str, ids: Column) -> Column:
    """Text of token ids; special tokens are kept, null stays null."""

    @F.pandas_udf(StringType())
    def text(rows: pd.Series) -> pd.Series:
        found = iter(_tokenizer(model).decode_batch([[int(i) for i in r] for r in rows if r is not None], skip_special_tokens=False))
        return pd.Series([None if r is None else next(found) for r in rows], dtype=object)

    return text(ids)


def token_stats(prompt_ids: Column, response_ids: Column, context: int, unk: int = UNK) -> dict[str, Column]:
    """prompt_ids have their bos, response_ids their eos."""
    total = F.size(prompt_ids) + F.size(response_ids)
    unknown = F.size(F.filter(prompt_ids, lambda x: x == unk)) + F.size(F.filter(response_ids, lambda x: x == unk))
    return {
        "prompt_tokens": F.size(prompt_ids),
        "response_tokens": F.size(response_ids),
        "total_tokens": total,
        "unk_tokens": unknown,
        "fits_context": total <= context + 1,
    }


def record_tokens(records: DataFrame, vocabulary: list[str]) -> DataFrame:
    """records with prompt_ids and response_ids of word-level tokens."""
    prompt = word_ids(T.prompt(F.col("instruction"), F.col("input")), vocabulary)
    rows = records.withColumn("_p", prompt).withColumn("_r", word_ids(F.col("response"), vocabulary))
    return rows.withColumn("prompt_ids", F.concat(F.array(F.lit(BOS)), "_p")).withColumn("response_ids", F.concat("_r", F.array(F.lit(EOS)))).drop("_p", "_r")
