"""Near-duplicate documents by order MinHash.

A document's k-mers are runs of five words, each labelled with its occurrence number. A sketch is
the `picks` labelled k-mers with the smallest hashes, put back in text order, so sketches agree
when much text does and in the same order. The hash functions of `circles` permutations are
rotated: a permutation's k-mers lie on a circle by their hashes, and each of `points` places on it
gives the sketch of the k-mers that follow it. Documents that share a sketch are candidates; a
candidate is verified by banded alignment of the words: edit distance at most (1 - similarity) of
the longer one's words. Candidates whose counts of words (first in BINS classes, then each word's
own) differ by more than that distance allows are not aligned.

A sketch of texts whose k-mers have Jaccard similarity J agrees with about J ** picks. Words
substituted at random up to an edit similarity of 0.8 leave J = 0.2, so that 96 sketches find
about 97 % of such pairs, and nearly all of those at 0.85.

Exact copies (equal words) are one node from the start. In a bucket of equal sketches each node
is first tried with one hub, the first node: with the smallest hub of all its buckets, and then
with those that are in other classes, which joins large classes in time linear in the
bucket. Then every two other nodes of a bucket that are not in one class yet are looked
at, without a cap, in blocks of BLOCK nodes or BLOCK_WORDS words; those that their words allow are
aligned at once, in the first bucket they share, unless links found on the way have joined them.
A bucket of many unlike texts, such as share a long passage, so takes time quadratic in
it, though only links make rows. Classes are the connected components of verified links.

A null text is a class of its own. Texts without any word are compared by their characters
only. A text of fewer than five words is one k-mer. Repeated rows are exact copies. A class id
is the smallest id in the class, null if all its ids are. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_bounds, cut, small

K = 5
CIRCLES = 4
POINTS = 24
PICKS = 2
SIMILARITY = 0.8
BINS = 128
BITS = 256
BLOCK = 2048
BLOCK_WORDS = 4_000_000

GAP = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), GAP), "")


def text_key(text: Column, w: Column) -> Column:
    """32 hex digits that are equal for equal words (for texts without words: equal texts)."""
    return F.md5(F.when(F.size(w) > 0, F.concat(F.lit("w "), F.array_join(w, " "))).otherwise(F.concat(F.lit("t "), text)).cast("binary"))


def halves(key: Column) -> list[Column]:
    """The key as two longs."""
    return [F.conv(F.substring(key, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "k1"), (17, "k2"))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


STEP = np.uint64(0x9E3779B97F4A7C15)


def kmers(ids: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-mers of word hashes, each with its occurrence number, in text order."""
    ids = ids.astype(np.int64).view(np.uint64)
    n = max(1, len(ids) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(ids))):
        out = out * STEP + ids[i : i + n]
    out = _mixed(out)
    order = np.argsort(out, kind="stable")
    new = np.ones(n, bool)
    new[1:] = out[order[1:]] != out[order[:-1]]
    if new.all():
        return _mixed(out)  # as first occurrences below
    place = np.arange(n)
    count = np.empty(n, np.uint64)
    count[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return _mixed(out + count * STEP)


def order_sketches(ids: np.ndarray, circles: int = CIRCLES, points: int = POINTS, picks: int = PICKS, k: int = K) -> np.ndarray:
    """The distinct sketches of a text, as hashes: of each place on each circle the k-mers that follow it, in text order."""
    grams = kmers(ids, k)
    places = np.arange(points, dtype=np.uint64) * np.uint64((1 << 64) // points)
    out = []
    for c in range(circles):
        h = _mixed(grams ^ np.uint64((c + 1) * int(STEP) % (1 << 64)))
        order = np.argsort(h)
        at = np.searchsorted(h, places, sorter=order)
        chosen = np.sort(order[(at[:, None] + np.arange(min(picks, len(grams)))) % len(grams)], axis=1)
        v = np.zeros(points, np.uint64)
        for i in range(chosen.shape[1]):
            v = _mixed(v * STEP + grams[chosen[:, i]])
        out.append(v)
    return np.unique(np.concatenate(out)).view(np.int64)


def word_classes(ids: np.ndarray) -> np.ndarray:
    """How many words fall in each of BINS classes, 255 at most: edit distance is at least what one text has more."""
    return np.minimum(np.bincount((ids.astype(np.int64).view(np.uint64) % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)


def word_bits(ids: np.ndarray) -> np.ndarray:
    """BITS bits as longs, of which each word sets one: edit distance is at least the number of bits one text has more."""
    on = np.zeros(BITS, np.uint8)
    on[((ids.astype(np.int64).view(np.uint64) >> np.uint64(20)) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(on).view(np.int64)


def allowed(x: str, y: str, similarity: float) -> Column:
    """may_be_near() by lengths and word_bits() alone, in columns of the structs x and y: n, bits."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    most = F.greatest(nx, ny) * F.lit(1 - similarity) + 1e-9
    more = lambda p, q: sum((F.bit_count(F.col(f"{p}.bits")[i].bitwiseAND(F.bitwise_not(F.col(f"{q}.bits")[i]))) for i in range(BITS // 64)), F.lit(0))
    return (F.abs(nx - ny) <= most) & (more(x, y) <= most) & (more(y, x) <= most)


def may_be_near(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, similarity: float) -> np.ndarray:
    """Whether lengths and counts of words allow the similarity; all arrays are broadcast against each other."""
    d = x.astype(np.int16) - y
    least = np.maximum(np.maximum(d, 0).sum(axis=-1), np.maximum(-d, 0).sum(axis=-1))
    longest = np.maximum(nx, ny)
    most = (1 - similarity) * longest + 1e-9
    return (least <= most) & (longest - np.minimum(nx, ny) <= most)


def banded_distance(a: Sequence[int], b: Sequence[int], most: int) -> int | None:
    """Edit distance of a and b if it is at most `most`, else None.

    Bit-parallel over the band of cells within `most` of the diagonal: bit t of a vector stands
    for row j - most + t of column j, and the band moves down one row with each column.
    """
    a, b = np.asarray(a), np.asarray(b)
    if abs(len(a) - len(b)) > most:
        return None
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if len(a) < len(b):
        a, b = b, a
    rows, columns = len(a), len(b)
    if not columns:
        return rows if rows <= most else None
    band = min(most, rows)
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << (2 * band + 1)) - 1
    low, lowest = 1 << (2 * band), rows - band
    up, down, distance = full & ~((1 << band) - 1), 0, band
    hopeless = band + most - (rows - columns) if rows >= columns else most
    for j in range(1, columns + 1):
        eq = where.get(b[j - 1], 0)
        shift = j - band - 1
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        same = ((((eq & up) + up) ^ up) | eq | down) & full
        right = down | (full & ~(same | up))
        left = same & up
        if j <= lowest:
            distance += not same & low
            if distance > hopeless:
                return None
        else:
            at = 1 << (rows - j + band)
            distance += bool(right & at) - bool(left & at)
        same >>= 1
        up = (left | ~(same | right)) & full
        down = same & right
    return distance if distance <= most else None


def bag(ids: np.ndarray) -> np.ndarray:
    """Sorted hashes of the words, each with its occurrence number."""
    return np.sort(kmers(ids, 1))


def within_band(a: np.ndarray, b: np.ndarray, similarity: float, bags: tuple[np.ndarray, np.ndarray] | None = None) -> bool:
    """Whether the edit distance allows the similarity. bags: bag() of both, if they are known.

    Edit distance is at least the number of words of the longer text that the other does not
    have, wherever they stand, so texts that share too few words need no alignment.
    """
    longest = max(len(a), len(b))
    most = int((1 - similarity) * longest + 1e-9)
    x, y = bags or (bag(a), bag(b))
    if longest - len(np.intersect1d(x, y, assume_unique=True)) > most:
        return False
    return banded_distance(a, b, most) is not None


def sketched(docs: DataFrame, id_col: str, text_col: str, circles: int, points: int, picks: int, k: int) -> DataFrame:
    """row (a number of its own), id, k1, k2 (null for a null text), n (words), counts (by class), bits (of words) and marks (sketches) of texts with words."""
    arrow_bounds(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"), words(F.col(text_col)).alias("_w"))
    base = base.select("id", text_key(F.col("_t"), F.col("_w")).alias("_key"), F.greatest(F.size("_w"), F.lit(0)).alias("n"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    base = base.select("id", *halves(F.col("_key")), "n", "_h")
    names = ["id", "k1", "k2", "n", "counts", "bits", "marks"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(batch.column(3).to_numpy(zero_copy_only=False))])
            texts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            marks = [order_sketches(t, circles, points, picks, k) if len(t) else np.empty(0, np.int64) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(m) for m in marks])]).astype(np.int32)
            values = np.concatenate(marks) if marks else np.empty(0, np.int64)
            counts = pa.array([word_classes(t).tobytes() for t in texts], pa.binary())
            bits = pa.array([word_bits(t) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], counts, bits, pa.ListArray.from_arrays(offsets, pa.array(values))], names=names)

    schema = base.select("id", "k1", "k2", "n", F.lit(b"").alias("counts"), F.col("_h").alias("bits"), F.col("_h").alias("marks")).schema
    return base.mapInArrow(sketch, schema).select(F.monotonically_increasing_id().alias("row"), *names)


def buckets_of(marked: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Buckets: v, hub (its first node), size, node, it (n, bits), a row for each node of each bucket of several; and their nodes: node, it.

    marked: node, n, bits, marks. All sketches go through a join with the shared ones, so nothing but the node goes with them.
    """
    rows = marked.select("node", F.explode("marks").alias("v"))
    shared = scratch.keep("shared", rows.groupBy("v").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    met = scratch.keep("met", rows.join(shared, "v"))
    within = scratch.keep("within", met.select("node").distinct())
    its = scratch.keep("its", marked.select("node", F.struct("n", "bits").alias("it")).join(small(within), "node", "left_semi"))
    buckets = scratch.keep("buckets", met.join(small(its), "node"))
    scratch.forget("shared", "met", "within")
    return buckets, its


def plausible(pairs: DataFrame, marked: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose lengths and counts of words allow the similarity. marked: node, n, counts."""
    side = lambda x: marked.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("counts").alias(f"c{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ca", "cb")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (4, 5))
            keep = may_be_near(x, y, batch.column(2).to_numpy(), batch.column(3).to_numpy(), similarity)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(hold, pairs.select("a", "b").schema)


def hub_pairs(rows: DataFrame, its: DataFrame, tried: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b) of hubs and nodes of their buckets that are not in one class yet, nor tried, and whose words allow the similarity. rows: of classed()."""
    apart = rows.filter(F.col("label") != F.col("hub_label")).select("hub", "node", "it")
    hubs = its.select(F.col("node").alias("_hub"), F.col("it").alias("_it"))
    found = apart.join(small(hubs), (F.col("hub") == F.col("_hub")) & allowed("it", "_it", similarity))
    return found.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")


def classed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """buckets with label and hub_label, the classes so far of the node and of the hub."""
    labels = small(labels.select("node", "label"))
    hubs = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    out = buckets.join(labels, "node", "left").join(small(hubs), "hub", "left")
    return out.withColumn("label", F.coalesce("label", "node")).withColumn("hub_label", F.coalesce("hub_label", "hub"))


def word_arrays(need: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """node, w (words as ints) of the nodes of need. nodes: node, k1, k2, id (a document with that key)."""
    key = F.lower(F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0")))
    need = need.join(nodes, "node").select("node", key.alias("_key"), F.col("id").alias("_need"))
    need = small(scratch.keep("need", need.withColumn("_only", F.when(F.col("_need").isNull(), F.col("_key")))))
    t = F.col(text_col)
    own = F.when(F.col(id_col).isNull(), text_key(t, words(t)))  # without an id: by key
    texts = docs.select(F.col(id_col).alias("_id"), t.alias("_t"), own.alias("_k"))
    texts = texts.join(need, F.col("_id").eqNullSafe(F.col("_need")) & F.col("_k").eqNullSafe(F.col("_only")))
    # A generator, below which no filter is pushed: a text is split into words once.
    texts = texts.select("node", "_key", "_t", F.explode(F.array(words(F.col("_t")))).alias("_w")).filter(text_key(F.col("_t"), F.col("_w")) == F.col("_key"))
    texts = texts.select("node", F.transform("_w", lambda w: F.pmod(F.xxhash64(w), F.lit(1 << 31)).cast("int")).alias("w")).dropDuplicates(["node"])
    return scratch.keep("texts", texts)


def other_edges(rows: DataFrame, texts: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b) of links between nodes of a bucket, other than its hub, that are not in one class yet. rows: v, hub, node, n, label; texts: of word_arrays().

    Buckets of one hub overlap much where many texts share a passage. They are compared as one, so
    that a pair is looked at once for a hub, where that is less work than each by itself.

    A large bucket is dealt out by pairs of blocks, so that many tasks share it. Of the links that
    join the same classes a task gives one, so its rows grow with the nodes, not with their pairs.
    """
    rows = rows.filter("node != hub")
    several = rows.groupBy("v").agg(F.first("hub").alias("_hub"), F.min("label").alias("_x"), F.max("label").alias("_y"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("words"))
    several = scratch.keep("several", several.filter("_x != _y").drop("_x", "_y"))
    rows = scratch.keep("met_again", rows.join(small(several.select("v", "size", "words")), "v"))
    union = scratch.keep("union", rows.groupBy("hub", "node").agg(F.first("n").alias("n"), F.first("label").alias("label")))
    squares = several.groupBy(F.col("_hub").alias("hub")).agg(F.sum(F.col("size") * F.col("size")).alias("squares"))
    whole = union.groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("words")).join(squares, "hub")
    whole = small(scratch.keep("whole", whole.filter(F.col("size") * F.col("size") <= F.col("squares")).select("hub", "size", "words")))
    apart = rows.join(small(whole.select("hub")), "hub", "left_anti").select("v", "node", "label", "size", "words")
    rows = union.join(whole, "hub").select(F.col("hub").alias("v"), "node", "label", "size", "words").unionAll(apart)
    rows = rows.withColumn("blocks", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("words") / BLOCK_WORDS)).cast("int"))
    held = rows.groupBy("node").agg(F.first("label").alias("label"), F.array_sort(F.collect_list(F.struct("v", "blocks"))).alias("at"))
    held = scratch.keep("held", held.join(texts, "node"))
    copies = F.aggregate("at", F.lit(0).cast("long"), lambda s, x: s + x["blocks"])
    n, words_in_all = held.agg(F.sum(copies), F.sum(copies * F.size("w"))).first()
    if not n:
        return scratch.keep("other_edges", rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    parts = 1 + n // 2_000 + words_in_all // 1_000_000
    dealt = held.select("node", "label", F.transform("at", lambda x: x["v"]).alias("shared"), "w", F.explode("at").alias("_at")).select("*", "_at.*").drop("_at")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "shared", "w")

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["v", "i", "j"])
        keys = frame[["v", "i", "j"]].to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(frame)]])
        own, node, label, shared, w = (frame[c].to_numpy() for c in ("own", "node", "label", "shared", "w"))
        n = np.array([len(t) for t in w])
        counts, bits = np.stack([word_classes(t) for t in w]), np.stack([word_bits(t) for t in w]).view(np.uint64)
        buckets = [frozenset(x.tolist()) for x in shared]
        joined: dict[int, int] = {}
        bags: dict[int, np.ndarray] = {}

        def bag_of(x: int) -> np.ndarray:
            if (out := bags.get(node[x])) is None:
                out = bags[node[x]] = bag(w[x])
            return out

        def find(x: int) -> int:
            while (up := joined.get(x, x)) != x:
                joined[x] = joined.get(up, up)
                x = up
            return x

        out = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            v, i, j = keys[lo].tolist()
            left, right = lo + np.flatnonzero(own[lo:hi] == i), lo + np.flatnonzero(own[lo:hi] == j)
            step = max(1, 1_000_000 // max(1, len(right)))
            for at in range(0, len(left), step):
                for x, y in candidates(left[at : at + step], right, node, label, n, bits, counts, similarity, i == j):
                    a, b = find(int(label[x])), find(int(label[y]))
                    if a != b and min(buckets[x] & buckets[y]) == v and within_band(w[x], w[y], similarity, (bag_of(x), bag_of(y))):
                        joined[max(a, b)] = min(a, b)
                        out.append((node[x], node[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return scratch.keep("other_edges", dealt.groupBy(F.pmod(F.xxhash64("v", "i", "j"), F.lit(parts)).alias("_part")).applyInPandas(link, "a long, b long"))


def candidates(left: np.ndarray, right: np.ndarray, node: np.ndarray, label: np.ndarray, n: np.ndarray, bits: np.ndarray, counts: np.ndarray, similarity: float, same: bool) -> Iterator[tuple[int, int]]:
    """The places x in left and y in right of two classes whose lengths, bits and counts of words allow the similarity; each pair once if both sides are the same."""
    x, y = left[:, None], right[None, :]
    near = label[x] != label[y]
    if same:
        near &= node[x] < node[y]
    most = (1 - similarity) * np.maximum(n[x], n[y]) + 1e-9
    near &= np.abs(n[x] - n[y]) <= most
    for p, q in ((x, y), (y, x)):
        near &= sum(np.bitwise_count(bits[p, c] & ~bits[q, c]).astype(np.int16) for c in range(BITS // 64)) <= most
    p, q = np.nonzero(near)
    p, q = left[p], right[q]
    for at in range(0, len(p), 50_000):
        a, b = p[at : at + 50_000], q[at : at + 50_000]
        keep = may_be_near(counts[a], counts[b], n[a], n[b], similarity)
        yield from zip(a[keep].tolist(), b[keep].tolist(), strict=True)


def verified_pairs(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose words align within the band."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("w").alias("wa")), "a").join(texts.select(F.col("node").alias("b"), F.col("w").alias("wb")), "b").select("a", "b", "wa", "wb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                keep.append(within_band(x.values.to_numpy(), y.values.to_numpy(), similarity))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(verify, both.select("a", "b").schema)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: the smallest node of the node's component.

    edges: a, b (longs). Each round takes the smallest label of the neighbours, then the label of
    the label; the table is written after each round, until none changes.
    """
    run = uuid.uuid4().hex
    both = scratch.keep(f"{run}_edges", edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch.keep(f"{run}_0", both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")))
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("_near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_k"), F.col("label").alias("_far"))
        step = step.join(jump, F.col("_new") == F.col("_k"), "left")
        step = scratch.keep(f"{run}_{turn}", step.select("node", "_old", F.least("_new", "_far").alias("label")))
        scratch.forget(f"{run}_{turn - 1}")
        changed = step.filter(F.col("label") != F.col("_old")).limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            scratch.forget(f"{run}_edges")
            return labels


def near_duplicate_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    circles: int = CIRCLES,
    points: int = POINTS,
    picks: int = PICKS,
    k: int = K,
) -> DataFrame:
    """A row for each document: id, class_id, exact_id (smallest id with equal words), n_words."""
    with Scratch(docs.sparkSession) as scratch:
        marked = scratch.keep("marked", sketched(docs, id_col, text_col, circles, points, picks, k))
        nodes = scratch.keep("nodes", marked.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("id").alias("id")))
        one = scratch.keep("one", marked.select(F.col("row").alias("node"), "n", "counts", "bits", "marks").join(small(nodes.select("node")), "node", "left_semi"))
        rows = scratch.keep("rows", marked.select("id", "k1", "k2", "n"))
        scratch.forget("marked")
        buckets, its = buckets_of(one, scratch)
        sized = one.select("node", "n", "counts")
        texts = word_arrays(its.select("node"), nodes, docs, id_col, text_col, scratch)
        # Each node with its smallest hub, then with the hubs of other classes, then whatever is left in a bucket.
        first = buckets.filter(F.col("node") != F.col("hub")).groupBy(F.col("node").alias("b")).agg(F.min("hub").alias("a"))
        tried = scratch.keep("first", first.select("a", "b"))
        edges = scratch.keep("edges_0", verified_pairs(scratch.keep("pairs_0", plausible(tried, sized, similarity)), texts, similarity))
        labels = components(edges, scratch)
        pairs = scratch.keep("pairs_1", plausible(hub_pairs(classed(buckets, labels), its, tried, similarity), sized, similarity))
        more = [lambda: scratch.keep("edges_1", verified_pairs(pairs, texts, similarity))]
        more.append(lambda: other_edges(scratch.keep("classed", classed(buckets.select("v", "hub", "node", "it.n"), labels).drop("hub_label")), texts, similarity, scratch))
        for step in more:
            found = step()
            if found.limit(1).count():
                edges = edges.union(found)
                labels = components(edges, scratch)
        classes = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        smallest = small(scratch.keep("smallest", classes.groupBy("label").agg(F.min("id").alias("_class"))))
        classes = scratch.keep("classes", classes.join(smallest, "label").select("k1", "k2", F.col("id").alias("_exact"), "_class"))
        out = rows.join(small(classes), ["k1", "k2"], "left")
        own = lambda c: F.when(F.col("k1").isNull(), F.col("id")).otherwise(F.col(c))
        return cut(out.select(F.col("id").alias(id_col), own("_class").alias("class_id"), own("_exact").alias("exact_id"), F.col("n").cast("long").alias("n_words")))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without near duplicates: of each class the document with the smallest id stays.

    Rows that repeat an id are one document: one of them stays. Rows without an id stay. Null and empty texts
    are in no class but by their id. An empty table gives an empty one; all columns are kept, whatever their names.
    """
    classes = near_duplicate_classes(docs, id_col=id_col, text_col=text_col, **options)
    ids = cut(classes.groupBy(id_col).agg(F.min("class_id").alias("_class"), F.count(F.lit(1)).alias("_n")))
    drop = small(ids.filter(F.col(id_col) != F.col("_class")).select(F.col(id_col).alias("_gone")))
    out = docs.join(drop, docs[f"`{id_col}`"] == drop["_gone"], "left_anti")
    repeated = ids.filter(F.col(id_col).isNotNull() & (F.col("_n") > 1)).select(F.col(id_col).alias("_again"))
    if repeated.limit(1).count():
        repeated = small(repeated)
        again = out[f"`{id_col}`"] == repeated["_again"]
        out = out.join(repeated, again, "left_anti").unionByName(out.join(repeated, again, "left_semi").dropDuplicates([id_col]))
    return out.select(*[out[f"`{c}`"] for c in docs.columns])
