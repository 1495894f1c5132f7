"""Cross-tokenizer alignment: which tokens of one vocabulary cover which of another, and how often they end together.

Each Arrow batch is encoded by both tokenizers. Their tokens are two tables of byte intervals in DuckDB,
all documents of a batch on one line of offsets: an ASOF join gives each A token the B token under its last
byte, a window sum over those that end together numbers the groups, and a range join puts the B tokens that are
no group with one A token into the groups' intervals. Links (A and B tokens that end together) are counted by document and by batch there;
the batches' counts are merged in Spark, and each document's links meet the merged counts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_bounds, cut, give_back_memory, small
from .tokens import PATTERN

#: Bytes of text that DuckDB has at once; a longer text is alone there.
SLICE_BYTES = 250_000
#: Merged pairs of ids that are broadcast at most (beside the bound of bytes that small() has).
BROADCAST_PAIRS = 2_000_000
#: Texts of these characters alone go to the faster of two encoders of vocabulary A, which agree on them.
PLAIN = re.compile(r"[\x00-ɏ‐-‟]*")
PIECE_SPACE = "▁"

ALIGN = """
CREATE OR REPLACE TEMP TABLE ends AS
  SELECT a.doc, a.pos, a.id, a.start, a.stop, b.id AS b_id, b.pos AS b_pos, a.stop = b.stop AS together, a.stop = b.stop AND a.start = b.start AS alone,
         sum((a.stop = b.stop)::INT) OVER (ORDER BY a.pos ROWS UNBOUNDED PRECEDING) - (a.stop = b.stop)::INT AS grp
  FROM a ASOF JOIN b ON a.stop <= b.stop;
CREATE OR REPLACE TEMP TABLE groups AS
  SELECT grp, any_value(doc) AS doc, min(start) AS first, max(stop) AS last, bool_or(alone) AS alone FROM ends GROUP BY grp
"""
A_GROUPS = "SELECT pos, grp FROM ends"
#: Where an A and a B token have the same interval they are a group; only the other B tokens are joined by range.
B_GROUPS = """
SELECT b_pos AS pos, grp FROM ends WHERE alone
UNION ALL
SELECT b.pos, g.grp FROM b ANTI JOIN (SELECT b_pos FROM ends WHERE alone) e ON b.pos = e.b_pos
JOIN (SELECT * FROM groups WHERE NOT alone) g ON b.start >= g.first AND b.stop <= g.last
"""
BY_DOCUMENT = """
SELECT doc, list(pair) AS pairs, list(n) AS n
FROM (SELECT doc, id::BIGINT << 32 | b_id AS pair, count(*)::INT AS n FROM ends WHERE together GROUP BY ALL) GROUP BY doc ORDER BY doc
"""
BY_BATCH = "SELECT id::BIGINT << 32 | b_id AS pair, count(*)::INT AS n FROM ends WHERE together GROUP BY ALL"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Vocabulary A: its token bytes by id, and ids of texts, each with a space put before it."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work; threads of its own would each keep memory
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.tokenizer.get_vocab()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.token_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.token_bytes[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        ranks = {self.token_bytes[i]: i for token, i in vocabulary.items() if token not in special}
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        other = [i for i, t in enumerate(texts) if not PLAIN.fullmatch(t)]
        found = dict(zip(other, self.tokenizer.encode_batch_fast([f" {texts[i]}" for i in other], add_special_tokens=False), strict=True))
        return [found[i].ids if i in found else self.plain.encode_ordinary(f" {t}") for i, t in enumerate(texts)]


class Pieces:
    """Vocabulary B: its token bytes by id, and ids of texts, before each of which it puts a space itself."""

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=content)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.token_bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace(PIECE_SPACE, " ").encode() for i, x in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@cache
def loaded(kind: type, content: bytes) -> tuple[object, np.ndarray]:
    """A vocabulary and its tokens' lengths; built once in a worker."""
    made = kind(content)
    return made, np.array([len(b) for b in made.token_bytes], np.int64)


@cache
def ids_shown(n_a: int, n_b: int) -> np.ndarray:
    """The ids of both vocabularies as text, followed by each of three separators."""
    return np.array([f"{i}{mark}" for n in (n_a, n_b) for mark in (",", "|", ";") for i in range(n)], object)


@cache
def database():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB", "allocator_flush_threshold": "1MB"})


def intervals(ids: list[list[int]], lengths: np.ndarray) -> pa.Table:
    """doc, pos, id, start, stop of all tokens; documents follow each other on one line of bytes."""
    counts = [len(x) for x in ids]
    flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(counts))
    sizes = lengths[flat]
    stop = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    return pa.table({"doc": doc, "pos": np.arange(len(flat), dtype=np.int32), "id": flat, "start": stop - sizes, "stop": stop})


def by_place(db, query: str, n: int) -> np.ndarray:
    """The group of each of n tokens, by its place."""
    found, out = db.execute(query).fetchnumpy(), np.empty(n, np.int64)
    out[found["pos"]] = found["grp"]
    return out


def group_texts(a: pa.Table, a_groups: np.ndarray, b: pa.Table, b_groups: np.ndarray, shown: np.ndarray, n_a: int, n_b: int, n_docs: int) -> list[str]:
    """Each document's groups as `a1,a2|b1;a3|b2,b3`. shown: the n_a ids of A, then the n_b of B, with each of the separators."""
    n = int(a_groups[-1]) + 1
    a_before = np.concatenate([[0], np.cumsum(np.bincount(a_groups, minlength=n))])
    b_before = np.concatenate([[0], np.cumsum(np.bincount(b_groups, minlength=n))])
    codes = np.empty(len(a_groups) + len(b_groups), np.int64)
    last = lambda groups: np.append(groups[1:] != groups[:-1], True)
    codes[np.arange(len(a_groups)) + b_before[a_groups]] = a["id"].to_numpy() + last(a_groups) * n_a
    codes[np.arange(len(b_groups)) + a_before[b_groups + 1]] = 3 * n_a + b["id"].to_numpy() + last(b_groups) * 2 * n_b
    parts = shown[codes]
    ends = np.cumsum(np.bincount(a["doc"].to_numpy(), minlength=n_docs) + np.bincount(b["doc"].to_numpy(), minlength=n_docs)).tolist()
    return ["".join(parts[x:y].tolist())[:-1] for x, y in zip([0, *ends], ends, strict=False)]


def aligned(docs: DataFrame, a_file: str, b_file: str, *, id_col: str, text_col: str) -> DataFrame:
    """A row for each document: row (a number), id, n_a, n_b, n_groups, groups (text), pairs (a << 32 | b) and n of its links.

    And rows without a row number, with the pairs of a batch and their counts.
    """
    a_content, b_content = (docs.sparkSession.sparkContext.broadcast(open(f, "rb").read()) for f in (a_file, b_file))

    def slices(texts: list[str | None]) -> Iterator[list[tuple[int, list[int], list[int]]]]:
        """Places and token ids of texts that both tokenizers give back byte by byte."""
        (a, _), (b, _) = loaded(ByteLevel, a_content.value), loaded(Pieces, b_content.value)
        filled = [i for i, t in enumerate(texts) if t]
        while filled:
            size, n = 0, 0
            while n < len(filled) and (n == 0 or size + len(texts[filled[n]]) <= SLICE_BYTES):
                size, n = size + len(texts[filled[n]]), n + 1
            some, filled = filled[:n], filled[n:]
            given = [texts[i] for i in some]
            each = zip(some, given, a.encode(given), b.encode(given), strict=True)
            yield [(i, x, y) for i, t, x, y in each if b"".join([a.token_bytes[k] for k in x]) == b"".join([b.token_bytes[k] for k in y]) == f" {t}".encode()]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, a_lengths), (_, b_lengths), db = loaded(ByteLevel, a_content.value), loaded(Pieces, b_content.value), database()
        n_a, n_b = len(a_lengths), len(b_lengths)
        give_back_memory()
        for batch in batches:
            figures, groups, links = np.zeros((3, batch.num_rows), np.int64), [""] * batch.num_rows, [([], [])] * batch.num_rows
            for some in slices(batch.column(2).to_pylist()):
                if not some:
                    continue
                places = np.array([i for i, _, _ in some])
                a, b = intervals([x for _, x, _ in some], a_lengths), intervals([y for _, _, y in some], b_lengths)
                db.register("a", a)
                db.register("b", b)
                db.execute(ALIGN)
                a_groups, b_groups = by_place(db, A_GROUPS, a.num_rows), by_place(db, B_GROUPS, b.num_rows)
                each = db.execute("SELECT doc FROM groups").fetchnumpy()["doc"]
                figures[:, places] = [np.bincount(d, minlength=len(some)) for d in (a["doc"].to_numpy(), b["doc"].to_numpy(), each)]
                for i, shown in zip(places, group_texts(a, a_groups, b, b_groups, ids_shown(n_a, n_b), n_a, n_b, len(some)), strict=True):
                    groups[i] = shown
                for doc, pairs, n in db.execute(BY_DOCUMENT).fetchall():
                    links[places[doc]] = pairs, n
                merged = db.execute(BY_BATCH).fetchnumpy()
                yield rows([None], batch.column(1).slice(0, 0), np.zeros((3, 1), np.int64), [""], [(merged["pair"], merged["n"])])
                db.execute("DROP TABLE ends; DROP TABLE groups")
            yield rows(batch.column(0), batch.column(1), figures, groups, links)
            give_back_memory()

    def rows(row, ids: pa.Array, figures: np.ndarray, groups: list[str], links: list) -> pa.RecordBatch:
        ids = ids if len(ids) == len(groups) else pa.nulls(len(groups), ids.type)
        columns = [row if isinstance(row, pa.Array) else pa.array(row, pa.int64()), ids, *map(pa.array, figures), pa.array(groups, pa.string())]
        columns += [pa.array([p for p, _ in links], pa.list_(pa.int64())), pa.array([n for _, n in links], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_a", "n_b", "n_groups", "groups", "pairs", "n"])

    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    zero, none = F.lit(0).cast("long"), F.lit(None)
    shape = base.select(none.cast("long").alias("row"), F.when(none.cast("boolean"), F.col("id")).alias("id"), zero.alias("n_a"), zero.alias("n_b"), zero.alias("n_groups"), F.lit("").alias("groups"), none.cast("array<long>").alias("pairs"), none.cast("array<int>").alias("n"))
    return base.mapInArrow(align, shape.schema)


def align_tokenizers(docs: DataFrame, a_file: str, b_file: str, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (`a1,a2|b1;a3|b2,b3`, or its sha256 with digest) of each document.

    a_file: a byte-level vocabulary of the tokenizers library, b_file: a sentencepiece model; both on
    the driver's disk. Where tokens of both end, a group ends, and the two are linked. The count of a pair of ids
    is the number of its links in all documents; count_sum adds up the counts of a document's links, n_best
    says how many of them have a pair whose count no other pair of its B id exceeds. Null and empty
    texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros and an empty
    text. Rows that repeat an id, or have none, are documents of their own. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    arrow_bounds(spark)
    found = aligned(docs, a_file, b_file, id_col=id_col, text_col=text_col)
    if digest:
        found = found.withColumn("groups", F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise(""))
    with Scratch(spark) as scratch:
        found = scratch.keep("aligned", found)
        each = F.explode(F.arrays_zip("pairs", "n")).alias("_l")
        totals = found.filter("row is null").select(each).groupBy(F.col("_l.pairs").alias("pair")).agg(F.sum("_l.n").alias("total"))
        highest = F.max("total").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
        totals = small(cut(totals.select("pair", "total", (F.col("total") == highest).alias("best"))), BROADCAST_PAIRS)
        links = found.filter("row is not null").select("row", each).select("row", F.col("_l.pairs").alias("pair"), F.col("_l.n").alias("n"))
        n, zero = F.col("n"), F.lit(0).cast("long")
        sums = links.join(totals, "pair").groupBy("row").agg(
            F.sum(n).alias("n_links"), F.sum(F.when(F.col("best"), n).otherwise(zero)).alias("n_best"), F.sum(n * F.col("total")).alias("count_sum")
        )
        out = found.filter("row is not null").drop("pairs", "n").join(sums, "row", "left")
        return cut(out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", *[F.coalesce(c, zero).alias(c) for c in ("n_links", "n_best", "count_sum")], "groups"))
