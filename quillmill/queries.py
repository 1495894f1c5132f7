"""The library's operators as queries over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import quality
from .functions import text as T
from .oracles import ORACLES
from .operators import dedup, metrics, packing, records, splits, tokens
from .plans import corpus, training
from .session import arrow_bounds, materialized, shared_folder, table
from .sources import formats, objects
from .sources.lines import numbered_lines

CONTEXT, STRIDE, SHARD = 256, 128, 50_000


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_bounds(spark)
    return table(spark, sf_dir, "documents")


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.once(_docs(spark, sf_dir).select("doc_id", "source", "text"), "text", T.clean_text(F.col("text")))


def clean_documents(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("doc_id", "text", F.length("text").alias("characters"))


def composed_documents(spark, sf_dir):
    """Documents with decomposed and full-width letters, carriage returns and invisible characters put in, cleaned."""
    wide = "".join(chr(ord(c) + 0xFEE0) for c in "the")
    text = F.replace(F.replace(F.col("text"), F.lit("the"), F.lit(wide)), F.lit("a"), F.lit("a\u0308"))
    text = F.replace(text, F.lit("\n"), F.lit("\u200b\r\n\x00"))
    return T.once(_docs(spark, sf_dir).select("doc_id", "text"), "text", T.clean_text(text)).select("doc_id", "text")


def quality_flags(spark, sf_dir):
    t = F.col("text")
    return _cleaned(spark, sf_dir).select(
        "doc_id", quality.not_empty(t).alias("not_empty"), quality.long_enough(t).alias("long_enough"),
        quality.mostly_text(t).alias("mostly_text"), quality.no_long_run(t).alias("no_long_run"), quality.accepted(t).alias("accepted"),
    )


def quality_summary(spark, sf_dir):
    rows = corpus.preprocess(_docs(spark, sf_dir).select("source", "text"), F.col("text"))
    return rows.groupBy("source").agg(F.count_if("accepted").alias("processed"), F.count_if(~F.col("accepted")).alias("rejected"))


def byte_dedup(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", T.bytes_hash(F.col("text").cast("binary")).alias("digest"))
    return dedup.first_wins(rows, "digest", ["doc_id"], "is_first")


def content_dedup(spark, sf_dir):
    rows = _cleaned(spark, sf_dir).filter(quality.accepted(F.col("text"))).select("doc_id", T.content_hash(F.col("text")).alias("digest"))
    return dedup.first_wins(rows, "digest", ["doc_id"], "is_first")


def dup_groups(spark, sf_dir):
    out = dedup.duplicate_groups(_docs(spark, sf_dir), T.bytes_hash(F.col("text").cast("binary")), "doc_id")
    return out.select("digest", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), F.size("members").alias("n"))


def split_counts(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(T.split_of(T.content_hash(F.col("text"))).alias("split"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def split_assign(spark, sf_dir):
    digest = T.content_hash(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", digest.alias("digest"), T.split_of(digest).alias("split"))


def source_inventory(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


def simhash(spark, sf_dir):
    out = dedup.simhash(_docs(spark, sf_dir), "doc_id", F.col("text"))
    return out.select("doc_id", "fp", T.hex16(F.col("fp")).alias("hex"))


def near_dup_pairs(spark, sf_dir):
    fps = materialized(dedup.simhash(_docs(spark, sf_dir), "doc_id", F.col("text")))
    return dedup.near_pairs(fps, "doc_id").select("a", "b", F.col("distance").cast("long").alias("distance"))


def _staged(spark, sf_dir):
    return corpus.staged(_docs(spark, sf_dir), id_col="doc_id", raw=F.col("text").cast("binary"), text=F.col("text"), order=["doc_id"])


def corpus_build(spark, sf_dir):
    return corpus.manifest(_staged(spark, sf_dir), "doc_id")


def corpus_stats(spark, sf_dir):
    return corpus.counters(_staged(spark, sf_dir))


def _conversations(spark, sf_dir):
    return records.conversation_records(table(spark, sf_dir, "conversations"), "conversations")


def conversation_records(spark, sf_dir):
    return _conversations(spark, sf_dir)


def json_records(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    told = F.struct(F.transform("t", lambda t: F.struct(t["role"], t["text"].alias("content"))).alias("messages"))
    again = F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("from"), t["text"].alias("value"))).alias("messages"))
    json = F.to_json(F.struct("conv_id", F.array(told).alias("data"), F.struct(F.array(F.array(again)).alias("copies")).alias("nested")))
    found, _ = objects.walk(turns.select("conv_id", F.lit("").alias("where"), json.alias("json")), ["conv_id"])
    return found.select("conv_id", F.col("where").alias("source_id"), "instruction", T.collapse(F.col("input")).alias("input"), "response", "category")


def _read_back(spark, rows, suffix, read):
    """What read() finds in files of lines: rows have file (a number), at (their order in it) and line."""
    with shared_folder(spark, "files") as folder:
        rows.repartition("file").sortWithinPartitions("file", "at").select("file", "line").write.partitionBy("file").text(folder)
        lines = numbered_lines(spark, folder, every_boundary=True)
        name = F.concat(F.regexp_extract("path", r"file=(\d+)", 1), F.lit(suffix)).alias("relative")
        found = materialized(read(lines.select(name, "block", "line_no", "line")))
    file = F.regexp_extract("file", r"\d+", 0).cast("long").alias("file")
    return found.select(file, F.regexp_extract("source_id", r"^\d+", 0).cast("long").alias("source_id"), "instruction", "input", "response", "category")


def jsonl_records(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    line = F.to_json(F.struct(F.struct(F.col("url").alias("Query"), F.col("html").alias("completion")).alias("page")))
    return _read_back(spark, pages.select(F.floor(F.col("page_id") / 100).alias("file"), F.col("page_id").alias("at"), line.alias("line")), ".jsonl", formats.json_lines)


def csv_records(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 500).alias("file"), F.col("p_partkey").alias("at"), "p_name", "p_brand")
    # A field over several lines, with quotes at their ends.
    line = F.concat(F.lit('"'), F.replace("p_name", F.lit(" "), F.lit('""\n')), F.lit('",'), F.col("p_brand"))
    rows = part.select("file", "at", line.alias("line"))
    header = part.select("file").distinct().select("file", F.lit(-1).alias("at"), F.lit("Question,Answer").alias("line"))
    return _read_back(spark, rows.unionByName(header), ".csv", formats.tables)


def text_questions(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), line.alias("line")) for i, line in enumerate((
            F.concat(F.lit("Who is "), F.col("c_name"), F.lit("?")), F.lit("  "), F.concat(F.lit("A customer of the segment "), F.col("c_mktsegment"), F.lit(" it is."))
        ))
    ])).alias("l"))
    rows = asked.select(F.floor(F.col("c_custkey") / 1000).alias("file"), (F.col("c_custkey") * 3 + F.col("l.i")).alias("at"), "l.line")
    return _read_back(spark, rows, ".txt", formats.question_lines)


def conversation_dedup(spark, sf_dir):
    rows = _conversations(spark, sf_dir).withColumn("key", T.dedup_key(F.col("instruction"), F.col("input"), F.col("response")))
    return dedup.first_wins(rows.select("conv_id", "id", "key"), "key", ["conv_id"], "is_first")


def record_splits(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", "id", T.split_of(F.col("id")).alias("split"))


def shard_assign(spark, sf_dir):
    rows = record_splits(spark, sf_dir)
    return splits.sharded(rows, ["conv_id"], 20).select("conv_id", "split", "shard")


def qa_pairs_loose(spark, sf_dir):
    # Documents have no lines that end in a question mark: their sentences stand for lines.
    lines = F.regexp_replace("text", r"\n", "? \n")
    return records.question_answers(_docs(spark, sf_dir).select("doc_id", "text"), lines, min_question=1, min_answer=20).select("doc_id", "line_no", "question", "answer")


def qa_pairs_strict(spark, sf_dir):
    lines = F.regexp_replace("text", r"\n", "? \n")
    return records.question_answers(_docs(spark, sf_dir).select("doc_id", "text"), lines, min_question=10, min_answer=40).select("doc_id", "line_no", "question", "answer")


def paragraph_chunks(spark, sf_dir):
    return records.paragraph_chunks(_docs(spark, sf_dir).select("doc_id", "text"), F.col("text")).select("doc_id", "chunk")


def passage_audit(spark, sf_dir):
    chunks = records.paragraph_chunks(_docs(spark, sf_dir).select("doc_id", "source", "text"), F.col("text"))
    rows = records.passage_records(chunks.select("doc_id", "chunk_no", F.col("source").alias("src"), "chunk"), F.col("src"))
    made = rows.withColumn("rank", F.when(F.col("category") == "grounded_extraction", 0).when(F.col("category") == "grounded_explanation", 1).otherwise(2))
    # Digests go through the shuffle as bytes.
    made = made.select("*", F.unhex(F.sha2("input", 256)).alias("_sha"), F.unhex("id").alias("_id"))
    out = records.distinct_records(made, ["doc_id", "rank", "chunk_no"], ["doc_id", "category", "instruction", "_sha", "_id"])
    return out.select("doc_id", "category", "instruction", F.lower(F.hex("_sha")).alias("input_sha256"), F.lower(F.hex("_id")).alias("id"))


def row_to_text(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", splits.row_to_text(part.columns, dict(part.dtypes)).alias("line"))


def row_split(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    shown = {c: splits.python_text(F.col(c), kind) for c, kind in rows.dtypes}
    return rows.select("c_custkey", splits.row_split(F.col("_metadata.row_index"), shown).alias("split"))


def count_split(spark, sf_dir):
    return splits.count_split(table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


def ratio_split(spark, sf_dir):
    return splits.ratio_split(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])


def prompt_format(spark, sf_dir):
    i, u, r = F.col("instruction"), F.col("input"), F.col("response")
    return _conversations(spark, sf_dir).select("conv_id", T.prompt(i, u).alias("prompt"), T.training_text(i, u, r).alias("training_text"))


def word_frequency(spark, sf_dir):
    return tokens.word_counts(_docs(spark, sf_dir), F.col("text"))


def _vocabulary(spark, sf_dir):
    return tokens.word_vocabulary(tokens.word_counts(_docs(spark, sf_dir), F.col("text")))


def _record_tokens(spark, sf_dir):
    return tokens.record_tokens(materialized(_conversations(spark, sf_dir)), _vocabulary(spark, sf_dir))


def token_stats(spark, sf_dir):
    rows = _record_tokens(spark, sf_dir)
    return rows.select("conv_id", *[c.alias(n) for n, c in tokens.token_stats(F.col("prompt_ids"), F.col("response_ids"), CONTEXT).items()])


def token_summary(spark, sf_dir):
    rows = token_stats(spark, sf_dir)
    most = F.greatest(F.lit(1), F.count(F.lit(1)))
    return rows.agg(
        F.count_if("fits_context").alias("within_context"), F.count_if(~F.col("fits_context")).alias("over_context"),
        (F.coalesce(F.sum("total_tokens"), F.lit(0)) / most).alias("average_tokens"),
        (F.coalesce(F.sum("unk_tokens"), F.lit(0)) / F.greatest(F.lit(1), F.coalesce(F.sum("total_tokens"), F.lit(1)))).alias("unk_rate"),
    )


def rejections(spark, sf_dir):
    rows = _record_tokens(spark, sf_dir)
    stats = tokens.token_stats(F.col("prompt_ids"), F.col("response_ids"), CONTEXT)
    rows = rows.withColumn("key", T.dedup_key(F.col("instruction"), F.col("input"), F.col("response"))).withColumn("fits", stats["fits_context"])
    rows = dedup.first_wins(rows.select("conv_id", "key", "fits"), "key", ["conv_id"], "_first")
    reason = F.when(~F.col("_first"), "duplicate").when(~F.col("fits"), "over_context").otherwise("accepted")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def category_counts(spark, sf_dir):
    return _conversations(spark, sf_dir).groupBy("category", "source").agg(F.count(F.lit(1)).alias("n"))


def _document_tokens(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return materialized(tokens.encode_words(docs, ["doc_id"], F.col("text"), _vocabulary(spark, sf_dir)))


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def lm_windows(spark, sf_dir):
    out = packing.lm_windows(_document_tokens(spark, sf_dir), ["doc_id"], CONTEXT, STRIDE)
    return out.select("k", F.md5(_joined("input_ids")).alias("inputs"), F.md5(_joined("target_ids")).alias("targets"))


def split_lm_windows(spark, sf_dir):
    ids = _document_tokens(spark, sf_dir).join(split_assign(spark, sf_dir).select("doc_id", "split"), "doc_id")
    out = packing.lm_windows(ids, ["doc_id"], CONTEXT, CONTEXT, by="split")
    return out.select("split", "k", F.md5(_joined("input_ids")).alias("inputs"), F.md5(_joined("target_ids")).alias("targets"))


def seq2seq_windows(spark, sf_dir):
    out = packing.seq2seq_windows(_document_tokens(spark, sf_dir), ["doc_id"], CONTEXT, tokens.BOS, tokens.EOS)
    return out.select("k", F.md5(_joined("source")).alias("source"), F.md5(_joined("decoder_input")).alias("decoder_input"), F.md5(_joined("target")).alias("target"))


def _masked(spark, sf_dir):
    x, y = packing.masked_example(F.col("prompt_ids"), F.col("response_ids"), 128)
    return _record_tokens(spark, sf_dir).select("conv_id", x.alias("inputs"), y.alias("labels"))


def _row_windows(spark, sf_dir, name, split, **options):
    texts = training.parquet_texts(spark, f"{sf_dir}/{name}.parquet")
    vocabulary = tokens.word_vocabulary(tokens.word_counts(texts, F.col("text")))
    return training.dataset(texts.filter(F.col("split") == split), lambda t: tokens.word_ids(t, vocabulary), split=split, **options)


def parquet_lm_windows(spark, sf_dir):
    out = _row_windows(spark, sf_dir, "part", "train", context=CONTEXT)
    return out.select("k", F.md5(_joined("input_ids")).alias("inputs"), F.md5(_joined("target_ids")).alias("targets"))


def parquet_seq2seq_windows(spark, sf_dir):
    out = _row_windows(spark, sf_dir, "customer", "validation", kind="seq2seq", context=32)
    return out.select("k", F.md5(_joined("source")).alias("source"), F.md5(_joined("decoder_input")).alias("decoder_input"), F.md5(_joined("target")).alias("target"))


def masked_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), F.when(F.col("o_orderkey") % 3 == 0, -100).otherwise(1).alias("label"), (F.col("o_totalprice").cast("double") / 1e5).alias("loss"))
    return rows.groupBy("batch").agg(F.round(metrics.masked_mean(F.col("loss"), F.col("label")), 9).alias("loss"))


def sft_mask(spark, sf_dir):
    return _masked(spark, sf_dir).select("conv_id", _joined("inputs").alias("inputs"), _joined("labels").alias("labels"))


def pad_batch(spark, sf_dir):
    out = packing.padded(_masked(spark, sf_dir).withColumn("batch", F.floor(F.col("conv_id") / 8)), "batch")
    return out.select("conv_id", "batch", _joined("inputs").alias("inputs"), _joined("labels").alias("labels"))


def perplexity(spark, sf_dir):
    loss = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_discount").cast("double").alias("loss"))
    mean = metrics.mean_loss(F.col("loss"))
    return loss.groupBy("l_returnflag").agg(F.round(mean, 9).alias("mean_loss"), F.round(metrics.perplexity(mean), 9).alias("perplexity"), F.round(metrics.perplexity(mean * 1000, 20.0), 3).alias("clamped"))


def _logits(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row"), F.col("o_orderkey").alias("token"), (F.round(F.col("o_totalprice").cast("double") / 50000, 1)).alias("logit"))


def top_k_filter(spark, sf_dir):
    return metrics.top_k(_logits(spark, sf_dir), 3).select("row", "token", "logit")


def nucleus_filter(spark, sf_dir):
    return metrics.nucleus(_logits(spark, sf_dir), 0.7).select("row", "token", "logit")


NAMES = """clean_documents composed_documents quality_flags quality_summary byte_dedup content_dedup dup_groups split_counts split_assign
source_inventory simhash near_dup_pairs corpus_build corpus_stats conversation_records json_records jsonl_records csv_records text_questions conversation_dedup record_splits
shard_assign qa_pairs_loose qa_pairs_strict paragraph_chunks passage_audit row_to_text row_split count_split ratio_split
prompt_format word_frequency token_stats token_summary rejections category_counts lm_windows split_lm_windows
seq2seq_windows parquet_lm_windows parquet_seq2seq_windows masked_loss sft_mask pad_batch perplexity top_k_filter nucleus_filter""".split()
QUERIES = {n: globals()[n] for n in NAMES}
__all__ = ["NAMES", "ORACLES", "QUERIES"]
