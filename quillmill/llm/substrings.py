"""Substring dedup: passages that repeat across documents, by MinHash banding of paragraphs.

Documents have no marked paragraphs that a repeated passage would keep, so a paragraph is a run
of PARAGRAPH words that starts at an anchor, and anchors depend on the text around them alone:
in each window of WINDOW consecutive shingles (runs of five words) the smallest hash is one. An
equal run of WINDOW + PARAGRAPH + 4 = 50 words therefore has an equal paragraph wherever it
stands. Each paragraph has BANDS min-hashes of one row over its shingles (a similarity of 0.8
is missed with probability 0.2 ** BANDS by a paragraph, less by a passage, which has several).
Equal paragraphs are one node; two nodes alone in a band are a pair, verified by exact Jaccard
similarity of their shingles. Bands of more nodes have no cap: their nodes are linked by what
remains of their sets when few shingles are left out, which finds each similar pair among them
in time linear in the nodes. Classes are connected components. In
each class the paragraph of the smallest document id stays, and those of other documents go.

Anchors are up to WINDOW words apart, so a paragraph that goes is widened to the equal run around
it, word by word against the kept one, by up to WINDOW words on either side: the next paragraph
of an equal run begins within that, and widens on from there. So an equal run of 50 words goes
whole, from its first word to its last. (Where part of the run also stands in a document of a
smaller id, that part is compared with it, and the words beyond with the next kept document.)

Null ids, null texts and texts of fewer words than a paragraph take no part. Repeats within
one document, and so rows that repeat an id, are left. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_bounds, cut, small
from .near_dedup import STEP, _mixed, components, words

K = 5
PARAGRAPH = 16
WINDOW = 30
BANDS = 2
SIMILARITY = 0.8


def shingle_hashes(ids: np.ndarray) -> np.ndarray:
    ids = ids.astype(np.int64).view(np.uint64)
    out = np.zeros(max(0, len(ids) - K + 1), np.uint64)
    for i in range(K):
        out = out * STEP + ids[i : i + len(out)]
    return _mixed(out)


def paragraphs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes to: first words of paragraphs, their hashes, their band values (a column for each band).

    Of equal paragraphs of the document only the first is given.
    """
    width = PARAGRAPH - K + 1
    if len(ids) < PARAGRAPH:
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty((0, BANDS), np.int64)
    grams = shingle_hashes(ids)
    if len(grams) <= WINDOW:
        at = np.array([int(grams.argmin())])
    else:
        windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
        at = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    at = at[at + width <= len(grams)]
    if not len(at):  # a text of few words; what follows its anchors is too short
        at = np.array([int(grams[: len(grams) - width + 1].argmin())])
    inner = grams[at[:, None] + np.arange(width)]
    whole = np.zeros(len(at), np.uint64)
    for i in range(width):
        whole = _mixed(whole * STEP + inner[:, i])
    _, first = np.unique(whole, return_index=True)
    bands = [_mixed(inner[first] ^ np.uint64(b * 2 + 1)).min(axis=1) for b in range(BANDS)]
    return at[first].astype(np.int32), whole[first].view(np.int64), np.stack(bands, axis=1).view(np.int64) if len(first) else np.empty((0, BANDS), np.int64)


def all_paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, h, m0, m1, ...: a row for each paragraph."""
    arrow_bounds(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("w")).filter("id is not null and w is not null")
    names = ["id", "pos", "h", *(f"m{b}" for b in range(BANDS))]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).values.to_numpy(zero_copy_only=False)
            found = [paragraphs(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            of = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            if len(of):
                bands = np.concatenate([x[2] for x in found])
                columns = [pa.array(np.concatenate([x[i] for x in found])) for i in (0, 1)]
                columns += [pa.array(bands[:, b]) for b in range(BANDS)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *columns], names=names)

    long = F.lit(0).cast("long")
    return base.mapInArrow(cut_up, base.select("id", F.lit(0).alias("pos"), long.alias("h"), *[long.alias(f"m{b}") for b in range(BANDS)]).schema)


def shared_bands(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of nodes that are alone in a band; h of the nodes of bands with more."""
    rows = nodes.select("h", F.explode(F.array(*[F.xxhash64(F.col(f"m{b}"), F.lit(b)) for b in range(BANDS)])).alias("v"))
    bands = rows.groupBy("v").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count(F.lit(1)).alias("n")).filter(F.col("a") != F.col("b"))
    bands = scratch.keep("bands", bands)
    pairs = scratch.keep("pairs", bands.filter("n = 2").select("a", "b").distinct())
    crowd = scratch.keep("crowd", rows.join(small(bands.filter("n > 2").select("v")), "v").select("h").distinct())
    scratch.forget("bands")
    return pairs, crowd


def shingle_sets(need: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """h, s: the distinct shingles of each node of need."""
    need = need.join(nodes.select("h", "first"), "h")
    need = need.groupBy(F.col("first.id").alias("_need")).agg(F.collect_list(F.struct("first.pos", "h")).alias("_at"))  # a document's own
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(need, F.col("_id") == F.col("_need"))
    texts = texts.select(words(F.col("_t")).alias("_w"), "_at")

    def gram(i: Column) -> Column:
        return F.pmod(F.xxhash64(*[F.element_at("_w", i + j) for j in range(K)]), F.lit(1 << 31)).cast("int")

    # Only what a node needs of its text goes on with it.
    each = F.transform("_at", lambda p: F.struct(p["h"].alias("h"), F.array_distinct(F.transform(F.sequence(p["pos"] + 1, p["pos"] + PARAGRAPH - K + 1), gram)).alias("s")))
    return texts.select(F.explode(each).alias("_p")).select("_p.h", "_p.s").dropDuplicates(["h"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose sets of shingles have at least the Jaccard similarity."""
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= (F.size("x") + F.size("y") - common) * F.lit(similarity) - 1e-9).select("a", "b")


def left_out(sets: DataFrame, similarity: float, even: bool) -> DataFrame:
    """h, sig, left, size: the sets that remain when `left` shingles of a node are left out.

    Sets x and y are similar if and only if they share such a rest of some size whose two numbers
    left out are together at most size * (1 / similarity - 1). even: rests that two nodes with as
    many left out can share; else those that only a node with fewer left out can.
    """
    most = 1 / similarity - 1

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).values.to_numpy().astype(np.uint64)
            h, sizes = batch.column(0).to_numpy(), np.diff(ends)
            for p in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == p)
                x = _mixed((flat[ends[at][:, None] + np.arange(p)] + np.uint64(1)) * STEP)
                whole = np.bitwise_xor.reduce(x, axis=1)
                for r in range(p):
                    if r > (p - r) * most + 1e-9:
                        break
                    if (2 * r <= (p - r) * most + 1e-9) != even:
                        continue
                    for out in combinations(range(p), r):
                        sig = whole ^ np.bitwise_xor.reduce(x[:, out], axis=1) if r else whole
                        sig = _mixed(sig + np.full(1, p - r, np.uint64) * STEP).view(np.int64)
                        columns = [h[at], sig, np.full(len(at), r, np.int32), np.full(len(at), p - r, np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "sig", "left", "size"])

    return sets.select("h", "s").mapInArrow(rests, "h long, sig long, left int, size int")


def similar_sets(sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) among all the sets, that give the same classes as all pairs of the Jaccard similarity.

    Nodes that share a rest are linked with the one of them that leaves out fewest: whoever is
    similar to another by this rest is so to it, so nothing is lost, however many share one.
    """
    most = 1 / similarity - 1
    rows = left_out(sets, similarity, True)
    short = sets.filter(F.size("s") < PARAGRAPH - K + 1)
    if short.limit(1).count():  # repeat a shingle; only they can have fewer left out than their partner
        fewer = small(scratch.keep("fewer", left_out(short, similarity, True).select("sig").distinct()))
        rows = rows.unionByName(left_out(sets, similarity, False).join(fewer, "sig", "left_semi").select("h", "sig", "left", "size"))
    rows = scratch.keep("rests", rows)
    hubs = rows.groupBy("sig").agg(F.min(F.struct("left", "h")).alias("_hub"), F.min("h").alias("_first"), F.max("h").alias("_last"))
    hubs = scratch.keep("hubs", hubs.filter(F.col("_first") != F.col("_last")).select("sig", "_hub"))
    links = rows.join(small(hubs), "sig").filter(F.col("h") != F.col("_hub.h"))
    links = links.filter(F.col("left") + F.col("_hub.left") <= F.col("size") * F.lit(most) + 1e-9)
    links = scratch.keep("links", links.select(F.least("h", "_hub.h").alias("a"), F.greatest("h", "_hub.h").alias("b")).distinct())
    scratch.forget("rests", "hubs")
    return links


def linked_nodes(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float, scratch: Scratch) -> DataFrame:
    pairs, crowd = shared_bands(nodes, scratch)
    need = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).union(crowd).distinct()
    sets = scratch.keep("sets", shingle_sets(need, nodes, docs, id_col, text_col))
    alike = scratch.keep("alike", verified(pairs, sets, similarity))
    links = similar_sets(sets.join(crowd, "h", "left_semi"), similarity, scratch)
    scratch.forget("pairs", "crowd", "sets")
    return alike.unionByName(links)


def flanks(at: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, before, after: hashes of the n_before and n_after words beside each paragraph of at, the nearest first."""
    need = at.groupBy(F.col("id").alias("_need")).agg(F.collect_list(F.struct("pos", "n_before", "n_after")).alias("_at"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(need, F.col("_id") == F.col("_need"))
    texts = texts.select("_id", F.transform(words(F.col("_t")), lambda w: F.pmod(F.xxhash64(w), F.lit(1 << 31)).cast("int")).alias("_w"), "_at")
    near = lambda p: F.struct(
        p["pos"].alias("pos"),
        F.reverse(F.slice("_w", p["pos"] - F.least(p["pos"], p["n_before"]) + 1, F.least(p["pos"], p["n_before"]))).alias("before"),
        F.slice("_w", p["pos"] + PARAGRAPH + 1, p["n_after"]).alias("after"),
    )
    texts = texts.select(F.col("_id").alias("id"), F.explode(F.transform("_at", near)).alias("_f"))
    return texts.select("id", "_f.*").dropDuplicates(["id", "pos"])


def widened(gone: DataFrame, docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """gone with lo and hi (one past): the equal run around each paragraph, compared with the kept one's.

    A paragraph is widened as far as the next one that stands in the same place to the kept document, and WINDOW words at most.
    """
    by = Window.partitionBy("id", "kept_id", F.col("kept_pos") - F.col("pos")).orderBy("pos")
    room = lambda n: F.when(n.isNull(), WINDOW).otherwise(F.least(F.greatest(n, F.lit(0)), F.lit(WINDOW)))
    gone = gone.withColumn("n_before", room(F.col("pos") - PARAGRAPH - F.lag("pos").over(by))).withColumn("n_after", room(F.lead("pos").over(by) - PARAGRAPH - F.col("pos")))
    gone = scratch.keep("gone", gone)
    both_sides = ["n_before", "n_after"]
    places = gone.select("id", "pos", *both_sides).union(gone.select("kept_id", "kept_pos", *both_sides))
    places = places.groupBy("id", "pos").agg(*[F.max(c).alias(c) for c in both_sides])
    near = scratch.keep("near", flanks(places, docs, id_col, text_col))
    kept = near.select(F.col("id").alias("kept_id"), F.col("pos").alias("kept_pos"), F.col("before").alias("_b"), F.col("after").alias("_a"))
    both = gone.join(near, ["id", "pos"])
    both = both.withColumn("before", F.slice("before", F.lit(1), F.col("n_before"))).withColumn("after", F.slice("after", F.lit(1), F.col("n_after")))
    both = both.join(kept, ["kept_id", "kept_pos"])

    def equal(x: str, y: str) -> Column:
        differ = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), F.lit(True))
        return F.when(differ > 0, differ - 1).otherwise(F.size(x)).cast("int")

    return both.select("id", "pos", "class_id", "kept_id", (F.col("pos") - equal("before", "_b")).alias("lo"), (F.col("pos") + PARAGRAPH + equal("after", "_a")).alias("hi"))


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row for each span to remove: id, first_word, last_word (one past), n_paragraphs, class_id, kept_id.

    Words are numbered from 0. class_id and kept_id are those of the span's first paragraph;
    kept_id is the document whose copy stays.
    """
    with Scratch(docs.sparkSession) as scratch:
        each = scratch.keep("each", all_paragraphs(docs, id_col, text_col))
        nodes = each.groupBy("h").agg(F.min(F.struct("id", "pos")).alias("first"), F.max("id").alias("last_id"), *[F.min(f"m{b}").alias(f"m{b}") for b in range(BANDS)])
        nodes = scratch.keep("nodes", nodes)
        edges = linked_nodes(nodes, docs, id_col, text_col, similarity, scratch)
        labels = components(edges, scratch)
        linked = labels.select(F.col("node").alias("h"), F.col("label").alias("class_id")).join(nodes.select("h", "first", "last_id"), "h")
        kept = linked.groupBy("class_id").agg(F.min("first").alias("_kept"), F.max("last_id").alias("_last"))
        linked = linked.select("h", "class_id", "first").join(kept, "class_id").filter(F.col("_kept.id") != F.col("_last"))
        kept_pos = F.when(F.col("first.id") == F.col("_kept.id"), F.col("first.pos")).otherwise(F.col("_kept.pos"))
        linked = linked.select("h", "class_id", F.col("_kept.id").alias("kept_id"), kept_pos.alias("kept_pos"))
        alone = nodes.filter(F.col("first.id") != F.col("last_id")).join(labels, F.col("h") == F.col("node"), "left_anti")
        alone = alone.select("h", F.col("h").alias("class_id"), F.col("first.id").alias("kept_id"), F.col("first.pos").alias("kept_pos"))
        repeated = scratch.keep("repeated", linked.unionByName(alone))
        scratch.forget("nodes")
        gone = scratch.keep("found", each.select("id", "pos", "h").join(repeated, "h").filter(F.col("id") != F.col("kept_id")).drop("h").distinct())
        scratch.forget("each")
        gone = widened(gone, docs, id_col, text_col, scratch)
        by = Window.partitionBy("id").orderBy("lo", "pos")
        reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
        gone = gone.withColumn("_new", F.when(F.col("lo") <= reach, 0).otherwise(1))
        gone = gone.withColumn("_span", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        spans = gone.groupBy("id", "_span").agg(
            F.min("lo").cast("long").alias("first_word"), F.max("hi").cast("long").alias("last_word"), F.count(F.lit(1)).alias("n_paragraphs"), F.min(F.struct("pos", "class_id", "kept_id")).alias("_f")
        )
        return cut(spans.select(F.col("id").alias(id_col), "first_word", "last_word", "n_paragraphs", F.col("_f.class_id").alias("class_id"), F.col("_f.kept_id").alias("kept_id")))
