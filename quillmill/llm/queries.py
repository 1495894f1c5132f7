"""The operators as queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, decontamination, language, lines, mixing, near_dedup, quality, runs, secrets, substrings, tokens, toxicity
from .common import crc_bucket, cut, read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = language.fit_language_model(docs.filter(~held_out))
    out = language.identify_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")))
    mixed = mixing.mix_sources(sized, size=F.col("size"))
    return mixed.select("doc_id", "size", "mix.source_size", "mix.target", "mix.taken")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS[: secrets.BASE]))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), 3) == 1
    labels = read_table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels.filter(~held_out))
    out = toxicity.score_texts(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    return tokens.document_token_counts(read_table(spark, sf_dir, "documents"), vocabulary)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "score", quality.worth_keeping(F.col("score")).alias("keep"), "posterior", "votes")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(read_table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.filter(F.col("vec_id") % 100 == 0))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text; of one document in ten, drawn by its id, the words from one on are overwritten by what follows that one, over and over.

    With n words, h = crc32 of the decimal id and g = h // 10, rows with h % 10 = 0 begin at word a = g % n
    to repeat p = 1 + (n - a) // (3 + g % 8) words. Rows with a null id, or without words, stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("_w"))
    n = F.size("_w")
    chosen = chosen.withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int"))
    p = (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    head = F.slice("_w", F.lit(1), F.col("_a"))
    times = F.ceil((n - F.col("_a")) / p).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, p), times))
    text = F.array_join(F.slice(F.concat(head, tail), F.lit(1), n), " ")
    return chosen.select("doc_id", F.when(F.col("_a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_periodic_tails(read_table(spark, sf_dir, "documents")))
    # Lengths and periods are below 2^31, so their products are exact.
    above = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, lambda held, r: F.when(held.isNull() | above(r, held), r).otherwise(held))
    shown = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(shown, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("b.length") / F.col("b.period")).alias("exponent_milli")
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", exponent, "runs_sha256", "collapsed_sha256")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str, a_file: str = "/opt/tokenizers/byte_bpe_50k.json", b_file: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    out = alignment.align_tokenizers(read_table(spark, sf_dir, "documents"), a_file, b_file, digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_mix_sources": op2_mix_sources,
    "op3_decontaminate": op3_decontaminate,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_scan_secrets": op7_scan_secrets,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality": op9_quality,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_line_dedup": op12_line_dedup,
    "op13_token_alignment": op13_token_alignment,
    "pipeline": pipeline,
}

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source ASC NULLS LAST) AS i FROM d GROUP BY source),
w AS (
  SELECT *, (CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, words * 2.0::DOUBLE AS bound,
         (sum(words) OVER ())::DOUBLE AS total FROM s),
l AS (
  SELECT *, (total * 1.5::DOUBLE - coalesce(sum(bound) OVER (ORDER BY bound / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY bound / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, words, CASE WHEN best IS NULL THEN bound ELSE least(bound, best * weight) END AS target
  FROM (SELECT *, (SELECT level FROM l WHERE level * weight <= bound ORDER BY bound / weight, i LIMIT 1) AS best FROM l)),
p AS (
  SELECT d.doc_id, d.size, t.words, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, words AS source_size, target,
       (greatest(0, least(size, floor(target)::BIGINT - before)) + greatest(0, least(size, floor(target)::BIGINT - words - before)))::BIGINT AS taken
FROM p
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
n AS (
  SELECT item, len(w)::BIGINT AS l, array_to_string(w, ' ') AS win FROM b WHERE len(w) BETWEEN 1 AND 9
  UNION SELECT item, 10, array_to_string(w[i:i+9], ' ') FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)),
g AS (
  SELECT r, i, l, array_to_string(w[i:i+l-1], ' ') AS win
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM n) WHERE len(w) >= l)),
h AS (SELECT g.r, g.i, g.l, n.item FROM g JOIN n ON g.l = n.l AND g.win = n.win),
c AS (SELECT r, count(DISTINCT j) AS hit FROM (SELECT r, unnest(range(i, i + l)) AS j FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS k, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(k, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
"""

OP12_SQL = r"""
WITH l AS (
  SELECT r, doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
m AS (SELECT k.r, k.doc_id, k.i, k.line, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.last AS gone FROM k LEFT JOIN c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""

ORACLES = {"op2_mix_sources": OP2_SQL, "op3_decontaminate": OP3_SQL, "op12_line_dedup": OP12_SQL}
