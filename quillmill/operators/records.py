"""Instruction records: from conversations, questions and answers, and passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .dedup import first_rows

# Role and field names, instructions and categories.
USER_ROLES = ("user", "human", "customer", "question")
ASSISTANT_ROLES = ("assistant", "bot", "model", "answer")
CONVERSATION_INSTRUCTION = "Answer the user's request."
QUESTION_INSTRUCTION = "Answer the question accurately."
SOURCE_INSTRUCTION = "Answer the question using only the provided source text."
SFT_CATEGORIES = ("health_information", "simplification", "source_qa", "summarization", "terminology", "medquad_qa")
STRICT_CATEGORIES = ("terminology", "simplification", "summarization", "health_information")
PASSAGE_CATEGORIES = (
    ("grounded_extraction", "Extract the key information from the following medical passage."),
    ("grounded_explanation", "Explain the following passage without adding information not present in it."),
    ("grounded_response", "Provide the relevant source text for this request without inventing facts."),
)
DEFAULT_CATEGORY = "fine_tuning_2"
V2_FIELDS = ("instruction", "input", "response", "category", "source", "source_id")


def v2_record(df: DataFrame, **parts: Column) -> DataFrame:
    """df's other columns with the seven fields of a record; rows without instruction or response go.

    parts: V2_FIELDS; an empty category is the default one.
    """
    made = {f: T.collapse(parts[f]) for f in V2_FIELDS if f != "source"}
    made["source"] = T.slashes(parts["source"])
    made["category"] = F.when(made["category"] != "", made["category"]).otherwise(DEFAULT_CATEGORY)
    out = df.withColumns(made).filter((F.col("instruction") != "") & (F.col("response") != ""))
    return out.withColumn("id", T.record_id({f: F.col(f) for f in V2_FIELDS}))


def builder_record(df: DataFrame, **parts: Column) -> DataFrame:
    """df's other columns with the six fields of a builder record; rows with a blank part go."""
    names = ("instruction", "input", "response", "category", "source")
    out = df.withColumns({f: T.collapse(parts[f]) for f in names})
    out = out.filter((F.col("instruction") != "") & (F.col("input") != "") & (F.col("response") != ""))
    return out.withColumn("id", T.stable_id(*[F.col(f) for f in names]))


def conversation_records(turns: DataFrame, source: str, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A record for each conversation: all user turns, and the last assistant turn after the first of them."""
    said = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("_turn"), F.lower(T.collapse(F.col(role))).alias("_role"), T.collapse(F.col(text)).alias("_text"))
    said = said.filter((F.col("_text") != "") & F.col("_role").isin(*USER_ROLES, *ASSISTANT_ROLES))
    said = said.withColumn("_user", F.col("_role").isin(*USER_ROLES))
    grouped = said.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_user"), F.struct("_turn", "_text")))), lambda t: t["_text"]).alias("_users"),
        F.min(F.when(F.col("_user"), F.col("_turn"))).alias("_first"),
        F.max(F.when(~F.col("_user"), F.struct("_turn", "_text"))).alias("_reply"),
    )
    whole = grouped.filter(F.col("_first").isNotNull() & (F.col("_reply._turn") > F.col("_first")))
    made = v2_record(
        whole, instruction=F.lit(CONVERSATION_INSTRUCTION), input=F.array_join("_users", "\n\n"), response=F.col("_reply._text"),
        category=F.lit("conversation"), source=F.lit(source), source_id=F.col("conv_id"),
    )
    return made.select("conv_id", *V2_FIELDS, "id")


def lines_of(text: Column) -> Column:
    """Collapsed lines that are not blank; all of Python's line boundaries count."""
    parts = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    return F.filter(F.transform(parts, T.collapse), lambda x: x != "")


def question_answers(df: DataFrame, text: Column, *, min_question: int, min_answer: int) -> DataFrame:
    """df's columns with line_no (1 up, of the question among non-blank lines), question and answer: neighbouring lines."""
    keep = df.columns
    lines = df.withColumn("_l", lines_of(text))
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_l") - 1)),
        lambda i: F.struct(i.alias("line_no"), F.get("_l", i - 1).alias("question"), F.get("_l", i).alias("answer")),
    )
    out = lines.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.line_no", "_p.question", "_p.answer")
    return out.filter(F.col("question").endswith("?") & (F.length("question") >= min_question) & (F.length("answer") >= min_answer))


def paragraph_chunks(df: DataFrame, text: Column, *, min_chars: int = 120, max_chars: int = 1800) -> DataFrame:
    """df's columns with chunk and chunk_no (of the paragraph, then within it): paragraphs of at least min_chars; longer ones packed sentence by sentence up to max_chars."""
    keep = df.columns
    out = df.select(*keep, F.posexplode(F.split(text, rf"(?U)\n{T.SPACE}*\n+")).alias("_p", "_b"))
    out = T.once(out, "_b", T.collapse(F.col("_b")))
    out = out.filter(F.length("_b") >= min_chars)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(state: Column, sentence: Column) -> Column:
        full = (state["cur"] != "") & (F.length(state["cur"]) + F.length(sentence) + 1 > max_chars)
        done = F.when(full & (F.length(state["cur"]) >= min_chars), F.concat(state["done"], F.array(state["cur"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(full | (state["cur"] == ""), sentence).otherwise(F.concat(state["cur"], F.lit(" "), sentence)).alias("cur"))

    packed = F.aggregate(F.split("_b", r"(?<=[.!?]) "), start, add, lambda s: F.filter(F.concat(s["done"], F.array(s["cur"])), lambda c: F.length(c) >= min_chars))
    chunks = F.when(F.length("_b") <= max_chars, F.array("_b")).otherwise(packed)
    out = out.select(*keep, "_p", F.posexplode(chunks).alias("_q", "chunk"))
    return out.select(*keep, "chunk", (F.col("_p") * (1 << 32) + F.col("_q")).alias("chunk_no"))


def passage_records(chunks: DataFrame, source: Column) -> DataFrame:
    """Three audit records for each chunk: one for each passage category. A chunk is collapsed once for all."""
    out = T.once(chunks.withColumn("source", T.collapse(source)), "chunk", T.collapse(F.col("chunk"))).filter("chunk <> ''")
    kinds = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(i).alias("instruction")) for c, i in PASSAGE_CATEGORIES])
    out = out.withColumn("_k", F.explode(kinds)).withColumns({"instruction": F.col("_k.instruction"), "input": F.col("chunk"), "response": F.col("chunk"), "category": F.col("_k.category")})
    return out.withColumn("id", T.stable_id(*[F.col(f) for f in ("instruction", "input", "response", "category", "source")])).drop("_k", "chunk")


def distinct_records(records: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """The first record of each (instruction, input, response), in the order of the columns given, in which no two are equal.

    Keys are compared by a digest, with the length of each part, so that no two keys read the same.
    columns: those to keep, if only narrow ones are needed: nothing else is then shuffled, and records are computed once.
    """
    parts = [F.coalesce(F.col(f), F.lit("")) for f in ("instruction", "input", "response")]
    key = F.sha2(F.concat_ws("\n", *[F.octet_length(p) for p in parts], *parts), 256)
    if columns is None:
        return first_rows(records, key, order)
    kept = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *columns)
    return records.groupBy(F.unhex(key).alias("_key")).agg(F.min(kept).alias("_r")).select(*[F.col(f"_r.`{c}`") for c in columns])


def problem(instruction: Column, input_: Column, response: Column, category: Column, categories: tuple[str, ...]) -> Column:
    """Why a strict loader refuses the record; null if it does not."""
    out = F.lit(None).cast("string")
    for name, value in (("category", category), ("response", response), ("input", input_), ("instruction", instruction)):
        out = F.when(value.isNull(), F.lit(f"missing {name}")).when(T.strip(value) == "", F.lit(f"empty {name}")).otherwise(out)
    return F.coalesce(out, F.when(~T.strip(category).isin(*categories), F.lit("unsupported category")))


def same_key_twice(records: DataFrame) -> DataFrame:
    """Keys that occur more than once: empty for a valid set of records."""
    return records.groupBy("instruction", "input", "response").count().filter("count > 1")


def missing_from(records: DataFrame, audit: DataFrame) -> DataFrame:
    """Records whose key the audit set lacks: empty if it is a subset."""
    return records.join(audit.select("instruction", "input", "response"), ["instruction", "input", "response"], "left_anti")


def split_overlap(records: DataFrame) -> DataFrame:
    """Ids that stand in more than one split: empty for disjoint splits."""
    return records.groupBy("id").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")
