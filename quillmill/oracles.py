"""SQL for the queries: DuckDB, over the same tables.

The tables hold no control characters, carriage returns or compatibility characters, so the
SQL leaves those steps of cleaning out; composed_documents puts such characters in before cleaning,
and its SQL what must be left of them.
"""

from __future__ import annotations


def clean(t: str) -> str:
    out = f"regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def split_of(digest: str) -> str:
    bucket = f"(('0x' || substr({digest}, 1, 8))::UBIGINT % 100)"
    return f"CASE WHEN {bucket} < 90 THEN 'train' WHEN {bucket} < 95 THEN 'validation' ELSE 'test' END"


RUN = "coalesce(list_bool_or(list_transform(range(1, len(l) - 7), lambda i: l[i] <> chr(10) AND " + " AND ".join(f"l[i] = l[i+{k}]" for k in range(1, 9)) + ")), false)"
CLEANED = f"c AS (SELECT doc_id, source, {clean('text')} AS text FROM documents)"
FLAGS = f"""
f AS (
  SELECT doc_id, source, text, length(trim(text)) > 0 AS not_empty, length(text) >= 200 AS long_enough,
         length(text) > 0 AND length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) >= 0.70 * length(text) AS mostly_text,
         NOT {RUN} AS no_long_run
  FROM (SELECT *, string_split(text, '') AS l FROM c)),
q AS (SELECT *, not_empty AND long_enough AND mostly_text AND no_long_run AS accepted FROM f)"""

SHINGLES = r"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM {src}),
g AS (SELECT doc_id, array_to_string(w[i:i+2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0)),
h AS (SELECT doc_id, ('0x' || substr(sha256(s), 1, 16))::UBIGINT AS h FROM g),
"""
BITS = " + ".join(f"(CASE WHEN 2 * sum((h >> {i}) & 1) >= count(*) THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END)" for i in range(64))
FP = f"""
fu AS (SELECT doc_id, {BITS} AS u FROM h GROUP BY doc_id),
fp AS (SELECT w.doc_id, coalesce(u, 18446744073709551615::UBIGINT) AS u FROM w LEFT JOIN fu USING (doc_id))"""
SIGNED = "(CASE WHEN u >= 9223372036854775808 THEN (u::HUGEINT - 18446744073709551616)::BIGINT ELSE u::BIGINT END)"

STAGED = f"""
WITH RECURSIVE {CLEANED}, {FLAGS},
b AS (
  SELECT d.doc_id, sha256(d.text) AS file_sha256, row_number() OVER (PARTITION BY sha256(d.text) ORDER BY d.doc_id) = 1 AS first,
         q.accepted, q.text, sha256({collapse("q.text")}) AS content_sha256
  FROM documents d JOIN q ON d.doc_id = q.doc_id),
a AS (SELECT *, row_number() OVER (PARTITION BY content_sha256 ORDER BY doc_id) = 1 AS only_one FROM b WHERE first AND accepted),
u1 AS (SELECT doc_id, text FROM a WHERE only_one), {SHINGLES.format(src="u1")} {FP.strip()},
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM fp x JOIN fp y ON x.doc_id < y.doc_id AND bit_count(xor(x.u, y.u)) <= 12),
o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM (SELECT DISTINCT a AS doc_id FROM p UNION SELECT DISTINCT b FROM p)),
r AS (
  SELECT 0::BIGINT AS n, []::BIGINT[] AS kept, []::BIGINT[] AS gone
  UNION ALL
  SELECT r.n + 1,
         CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.b = o.doc_id AND list_contains(r.kept, p.a)) THEN r.kept ELSE list_append(r.kept, o.doc_id) END,
         CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.b = o.doc_id AND list_contains(r.kept, p.a)) THEN list_append(r.gone, o.doc_id) ELSE r.gone END
  FROM r JOIN o ON o.n = r.n + 1),
z AS (SELECT unnest(gone) AS doc_id FROM (SELECT gone FROM r ORDER BY n DESC LIMIT 1)),
t AS (
  SELECT b.doc_id, b.file_sha256, b.content_sha256, length(b.text) AS characters, fp.u,
         CASE WHEN NOT b.first THEN 'exact_duplicate' WHEN NOT b.accepted THEN 'rejected' WHEN fp.doc_id IS NULL THEN 'content_duplicate'
              WHEN z.doc_id IS NOT NULL THEN 'near_duplicate' ELSE 'accepted' END AS stage
  FROM b LEFT JOIN fp USING (doc_id) LEFT JOIN z USING (doc_id))"""

CONV = f"""
m AS (SELECT conv_id, turn, lower({collapse("role")}) AS role, {collapse("text")} AS text FROM conversations),
n AS (SELECT * FROM m WHERE text <> ''),
us AS (SELECT conv_id, min(turn) AS first, {collapse("string_agg(text, ' ' ORDER BY turn)")} AS input FROM n WHERE role IN ('user', 'human', 'customer', 'question') GROUP BY conv_id),
rp AS (SELECT conv_id, max(turn) AS last, arg_max(text, turn) AS response FROM n WHERE role IN ('assistant', 'bot', 'model', 'answer') GROUP BY conv_id),
e AS (
  SELECT conv_id, 'Answer the user''s request.' AS instruction, input, response, 'conversation' AS category, 'conversations' AS source, conv_id::VARCHAR AS source_id
  FROM us JOIN rp USING (conv_id) WHERE last > first),
rec AS (
  SELECT *, sha256('{{"category": "' || category || '", "input": "' || replace(replace(input, '\\', '\\\\'), '"', '\\"') || '", "instruction": "' || instruction ||
         '", "response": "' || replace(replace(response, '\\', '\\\\'), '"', '\\"') || '", "source": "' || source || '", "source_id": "' || source_id || '"}}') AS id
  FROM e)"""

TOKEN = "regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_\\p{{M}}]+|[^\\p{{L}}\\p{{N}}_\\p{{M}}\\s]+')"
VOCAB = f"""
wc AS (SELECT word, count(*) AS n FROM (SELECT unnest({TOKEN.format(t="text")}) AS word FROM documents) GROUP BY word),
vo AS (SELECT word, (row_number() OVER (ORDER BY n DESC, word) + 3)::INT AS token FROM wc WHERE n >= 2 QUALIFY row_number() OVER (ORDER BY n DESC, word) <= 9996)"""


def tokenized(name: str, src: str, key: str, text: str) -> str:
    """CTE: key and ids of every text of src."""
    return f"""{name} AS (
  SELECT {key}, coalesce(list(coalesce(token, 1) ORDER BY i) FILTER (word IS NOT NULL), []) AS ids
  FROM (SELECT {key}, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END) AS word, unnest(range(1, greatest(1, len(ws)) + 1)) AS i FROM (SELECT {key}, {TOKEN.format(t=text)} AS ws FROM {src}))
  LEFT JOIN vo USING (word) GROUP BY {key})"""


PROMPT = "'### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Input:' || chr(10) || input || chr(10) || chr(10) || '### Response:' || chr(10)"
TOKENS = f"""WITH {CONV.strip()}, {VOCAB.strip()},
pr AS (SELECT conv_id, {PROMPT} AS t FROM rec),
{tokenized("pi", "pr", "conv_id", "t")}, {tokenized("ri", "rec", "conv_id", "response")},
ids AS (SELECT conv_id, list_concat([2], pi.ids) AS p, list_concat(ri.ids, [3]) AS r FROM pi JOIN ri USING (conv_id))"""
STATS = f"""{TOKENS},
st AS (
  SELECT conv_id, len(p)::INT AS prompt_tokens, len(r)::INT AS response_tokens, (len(p) + len(r))::INT AS total_tokens,
         (len(list_filter(p, lambda x: x = 1)) + len(list_filter(r, lambda x: x = 1)))::INT AS unk_tokens, len(p) + len(r) <= 257 AS fits_context
  FROM ids)"""
MASKED = f"""{TOKENS},
k AS (SELECT conv_id, r, CASE WHEN len(r) >= 129 THEN [] WHEN len(p) > 129 - len(r) THEN p[len(p) - (129 - len(r)) + 1:] ELSE p END AS p FROM ids),
x AS (SELECT conv_id, greatest(0, len(p) - 1) AS m, list_concat(p, CASE WHEN len(r) >= 129 THEN r[len(r) - 128:] ELSE r END) AS a FROM k),
y AS (SELECT conv_id, a[:len(a) - 1] AS inputs, list_transform(range(2, len(a) + 1), lambda i: CASE WHEN i - 1 <= m THEN -100 ELSE a[i] END) AS labels FROM x)"""


def stream(by: str, ids: str) -> str:
    """CTE: the tokens of the documents in order, numbered (for each `by`)."""
    part = f"{by}, " if by else ""
    over = f"PARTITION BY {by} " if by else ""
    return f"al AS (SELECT {part}t, row_number() OVER ({over}ORDER BY doc_id, j) - 1 AS pos FROM (SELECT {part}doc_id, unnest({ids}) AS t, unnest(range(1, len({ids}) + 1)) AS j FROM tk WHERE len(ids) > 0))"


def windows(by: str, width: int, stride: int) -> str:
    part = f"{by}, " if by else ""
    first = f"(CASE WHEN pos < {width} THEN 0 ELSE (pos - {width}) // {stride} + 1 END)"
    return f"wi AS (SELECT {part}k, list(t ORDER BY pos) AS v FROM (SELECT {part}t, pos, unnest(range({first}, pos // {stride} + 1)) AS k FROM al) WHERE pos < k * {stride} + {width} GROUP BY {part}k HAVING count(*) = {width})"


CUSTOMER_ROWS = "SELECT *, row_number() OVER () - 1 AS doc_id, sha256((row_number() OVER () - 1)::VARCHAR || ':c_acctbal=' || c_acctbal || chr(31) || 'c_custkey=' || c_custkey || chr(31) || 'c_mktsegment=' || c_mktsegment || chr(31) || 'c_name=' || c_name || chr(31) || 'c_nationkey=' || c_nationkey) AS d FROM customer"
PART_ROWS = "SELECT *, row_number() OVER () - 1 AS doc_id, sha256((row_number() OVER () - 1)::VARCHAR || ':p_brand=' || p_brand || chr(31) || 'p_name=' || p_name || chr(31) || 'p_partkey=' || p_partkey || chr(31) || 'p_retailprice=' || p_retailprice || chr(31) || 'p_size=' || p_size || chr(31) || 'p_type=' || p_type) AS d FROM part"
PART_LINE = "concat_ws(chr(10), 'p_partkey: ' || p_partkey, 'p_name: ' || p_name, 'p_brand: ' || p_brand, 'p_type: ' || p_type, 'p_size: ' || p_size, 'p_retailprice: ' || p_retailprice)"
CUSTOMER_LINE = "concat_ws(chr(10), 'c_custkey: ' || c_custkey, 'c_name: ' || c_name, 'c_nationkey: ' || c_nationkey, 'c_acctbal: ' || c_acctbal, 'c_mktsegment: ' || c_mktsegment)"


def row_tokens(rows: str, line: str, split: str) -> str:
    """CTEs: the tokens of a table's rows as text, by a vocabulary of all of them, and of one split in tk."""
    src = f"rt AS (SELECT doc_id, {line} AS text, {split_of('d')} AS split FROM ({rows}))"
    return f"WITH {src}, {VOCAB.strip().replace('FROM documents', 'FROM rt')}, rs AS (SELECT * FROM rt WHERE split = '{split}'), {tokenized('tk', 'rs', 'doc_id', 'text')}"


DOCTOK = f"WITH {VOCAB.strip()}, {tokenized('tk', 'documents', 'doc_id', 'text')}"
JOINED = "array_to_string({}, ',')"


def qa(q: int, a: int) -> str:
    return f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), '? ' || chr(10)), chr(10)), lambda x: {collapse("x")}), lambda x: x <> '') AS l FROM documents),
p AS (SELECT doc_id, i::INT AS line_no, l[i] AS question, l[i+1] AS answer FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM l))
SELECT * FROM p WHERE ends_with(question, '?') AND length(question) >= {q} AND length(answer) >= {a}"""


CHUNKS = f"""
b AS (SELECT doc_id, source, {collapse("text")} AS b FROM documents),
s AS (SELECT doc_id, source, b, string_split(regexp_replace(b, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS s FROM b WHERE length(b) >= 120),
step AS (
  SELECT doc_id, source, s, 1::BIGINT AS i, '' AS cur, []::VARCHAR[] AS done FROM s WHERE length(b) > 1800
  UNION ALL
  SELECT doc_id, source, s, i + 1,
         CASE WHEN cur = '' OR length(cur) + length(s[i]) + 1 > 1800 THEN s[i] ELSE cur || ' ' || s[i] END,
         CASE WHEN cur <> '' AND length(cur) + length(s[i]) + 1 > 1800 AND length(cur) >= 120 THEN list_append(done, cur) ELSE done END
  FROM step WHERE i <= len(s)),
ch AS (
  SELECT doc_id, source, b AS chunk FROM s WHERE length(b) <= 1800
  UNION ALL SELECT doc_id, source, unnest(CASE WHEN length(cur) >= 120 THEN list_append(done, cur) ELSE done END) FROM step WHERE i = len(s) + 1)"""

DRAW = "SELECT o_custkey AS row, o_orderkey AS token, round(o_totalprice::DOUBLE / 50000, 1) AS logit FROM orders"

ORACLES = {
    "clean_documents": f"WITH {CLEANED} SELECT doc_id, text, length(text)::INT AS characters FROM c",
    "composed_documents": f"SELECT doc_id, {clean("replace(text, 'a', 'ä')")} AS text FROM documents",
    "quality_flags": f"WITH {CLEANED}, {FLAGS} SELECT doc_id, not_empty, long_enough, mostly_text, no_long_run, accepted FROM q",
    "quality_summary": f"WITH {CLEANED}, {FLAGS} SELECT source, count(*) FILTER (accepted) AS processed, count(*) FILTER (NOT accepted) AS rejected FROM q GROUP BY source",
    "byte_dedup": "SELECT doc_id, sha256(text) AS digest, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS is_first FROM documents",
    "content_dedup": f"WITH {CLEANED}, {FLAGS}, d AS (SELECT doc_id, sha256({collapse('text')}) AS digest FROM q WHERE accepted) SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id) = 1 AS is_first FROM d",
    "dup_groups": "SELECT sha256(text) AS digest, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members, count(*)::INT AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "split_counts": f"SELECT {split_of('d')} AS split, count(*) AS n FROM (SELECT sha256({collapse('text')}) AS d FROM documents) GROUP BY 1",
    "split_assign": f"SELECT doc_id, digest, {split_of('digest')} AS split FROM (SELECT doc_id, sha256({collapse('text')}) AS digest FROM documents)",
    "source_inventory": "SELECT source, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source",
    "simhash": f"WITH {SHINGLES.format(src='documents')} {FP.strip()} SELECT doc_id, {SIGNED} AS fp, lower(printf('%016x', u)) AS hex FROM fp",
    "near_dup_pairs": f"WITH {SHINGLES.format(src='documents')} {FP.strip()} SELECT x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.u, y.u))::BIGINT AS distance FROM fp x JOIN fp y ON x.doc_id < y.doc_id AND bit_count(xor(x.u, y.u)) <= 12",
    "corpus_build": f"{STAGED} SELECT doc_id AS source, file_sha256, content_sha256, lower(printf('%016x', u)) AS simhash, characters::INT AS characters, {split_of('content_sha256')} AS split FROM t WHERE stage = 'accepted'",
    "corpus_stats": f"""{STAGED} SELECT count(*) AS total, count(*) FILTER (stage = 'exact_duplicate') AS exact_duplicate, 0::BIGINT AS failed, count(*) FILTER (stage = 'rejected') AS rejected,
        count(*) FILTER (stage = 'content_duplicate') AS content_duplicate, count(*) FILTER (stage = 'near_duplicate') AS near_duplicate, count(*) FILTER (stage = 'accepted') AS accepted,
        {", ".join(f"count(*) FILTER (stage = 'accepted' AND {split_of('content_sha256')} = '{s}') AS {s}" for s in ("train", "validation", "test"))} FROM t""",
    "conversation_records": f"WITH {CONV.strip()} SELECT * FROM rec",
    "json_records": f"WITH {CONV.strip()} SELECT conv_id, w AS source_id, instruction, input, response, category FROM rec, (VALUES ('data[0]'), ('nested.copies[0][0]')) v(w)",
    "jsonl_records": f"""SELECT page_id // 100 AS file, row_number() OVER (PARTITION BY page_id // 100 ORDER BY page_id) AS source_id, 'Answer the question accurately.' AS instruction,
        {collapse("url")} AS input, {collapse("html")} AS response, 'question_answer' AS category FROM pages""",
    "csv_records": """SELECT p_partkey // 500 AS file, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) + 1 AS source_id, 'Answer the question accurately.' AS instruction,
        replace(p_name, ' ', '"') AS input, p_brand AS response, 'question_answer' AS category FROM part""",
    "text_questions": """SELECT c_custkey // 1000 AS file, 2 * row_number() OVER (PARTITION BY c_custkey // 1000 ORDER BY c_custkey) - 1 AS source_id, 'Answer the question accurately.' AS instruction,
        'Who is ' || c_name || '?' AS input, 'A customer of the segment ' || c_mktsegment || ' it is.' AS response, 'question_answer' AS category FROM customer""",
    "conversation_dedup": f"WITH {CONV.strip()}, k AS (SELECT conv_id, id, sha256(lower(instruction) || chr(10) || lower(input) || chr(10) || lower(response)) AS key FROM rec) SELECT *, row_number() OVER (PARTITION BY key ORDER BY conv_id) = 1 AS is_first FROM k",
    "record_splits": f"WITH {CONV.strip()} SELECT conv_id, id, {split_of('id')} AS split FROM rec",
    "shard_assign": f"WITH {CONV.strip()}, s AS (SELECT conv_id, {split_of('id')} AS split FROM rec) SELECT *, (row_number() OVER (PARTITION BY split ORDER BY conv_id) - 1) // 20 AS shard FROM s",
    "qa_pairs_loose": qa(1, 20),
    "qa_pairs_strict": qa(10, 40),
    "paragraph_chunks": f"WITH RECURSIVE {CHUNKS.strip()} SELECT doc_id, chunk FROM ch",
    "passage_audit": f"""WITH RECURSIVE {CHUNKS.strip()}, k AS (SELECT * FROM (VALUES
        (0, 'grounded_extraction', 'Extract the key information from the following medical passage.'),
        (1, 'grounded_explanation', 'Explain the following passage without adding information not present in it.'),
        (2, 'grounded_response', 'Provide the relevant source text for this request without inventing facts.')) AS k(rank, category, instruction)),
        f AS (SELECT *, row_number() OVER (PARTITION BY instruction, chunk ORDER BY doc_id, rank) AS rn FROM ch, k)
        SELECT doc_id, category, instruction, sha256(chunk) AS input_sha256,
               substr(sha256(instruction || chr(10) || chunk || chr(10) || chunk || chr(10) || category || chr(10) || source), 1, 16) AS id FROM f WHERE rn = 1""",
    "row_to_text": "SELECT p_partkey, concat_ws(chr(10), 'p_partkey: ' || p_partkey, 'p_name: ' || p_name, 'p_brand: ' || p_brand, 'p_type: ' || p_type, 'p_size: ' || p_size, 'p_retailprice: ' || p_retailprice) AS line FROM part",
    "row_split": f"SELECT c_custkey, {split_of('d')} AS split FROM ({CUSTOMER_ROWS})",
    "count_split": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS n FROM labels) SELECT doc_id, CASE WHEN i <= greatest(1, trunc(n * 0.9::DOUBLE)) THEN 'train' WHEN i <= greatest(1, trunc(n * 0.9::DOUBLE)) + greatest(1, trunc(n * 0.05::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM r",
    "ratio_split": "WITH r AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS i, count(*) OVER () AS n FROM conversations), b AS (SELECT *, greatest(1, round_even(n * 0.1::DOUBLE, 0)) AS t FROM r) SELECT conv_id, turn, CASE WHEN i <= n - 2 * t THEN 'train' WHEN i <= n - t THEN 'validation' ELSE 'test' END AS split FROM b",
    "prompt_format": f"WITH {CONV.strip()} SELECT conv_id, {PROMPT} AS prompt, '### Instruction' || chr(10) || instruction || chr(10) || chr(10) || '### Input' || chr(10) || input || chr(10) || chr(10) || '### Response' || chr(10) || response AS training_text FROM rec",
    "word_frequency": f"WITH {VOCAB.strip()} SELECT word, n FROM wc",
    "token_stats": f"{STATS} SELECT * FROM st",
    "token_summary": f"{STATS} SELECT count(*) FILTER (fits_context) AS within_context, count(*) FILTER (NOT fits_context) AS over_context, coalesce(sum(total_tokens), 0)::DOUBLE / greatest(1, count(*)) AS average_tokens, coalesce(sum(unk_tokens), 0)::DOUBLE / greatest(1, coalesce(sum(total_tokens), 1)) AS unk_rate FROM st",
    "rejections": f"""{STATS}, kk AS (SELECT conv_id, sha256(lower(instruction) || chr(10) || lower(input) || chr(10) || lower(response)) AS key FROM rec),
        rr AS (SELECT fits_context, row_number() OVER (PARTITION BY key ORDER BY conv_id) AS rn FROM kk JOIN st USING (conv_id))
        SELECT CASE WHEN rn > 1 THEN 'duplicate' WHEN NOT fits_context THEN 'over_context' ELSE 'accepted' END AS reason, count(*) AS n FROM rr GROUP BY 1""",
    "category_counts": f"WITH {CONV.strip()} SELECT category, source, count(*) AS n FROM rec GROUP BY ALL",
    "lm_windows": f"{DOCTOK}, {stream('', 'ids')}, {windows('', 257, 128)} SELECT k, md5({JOINED.format('v[1:256]')}) AS inputs, md5({JOINED.format('v[2:257]')}) AS targets FROM wi",
    "split_lm_windows": f"WITH {VOCAB.strip()}, {tokenized('t0', 'documents', 'doc_id', 'text')}, sp AS (SELECT doc_id, {split_of('d')} AS split FROM (SELECT doc_id, sha256({collapse('text')}) AS d FROM documents)), tk AS (SELECT * FROM t0 JOIN sp USING (doc_id)), {stream('split', 'ids')}, {windows('split', 257, 256)} SELECT split, k, md5({JOINED.format('v[1:256]')}) AS inputs, md5({JOINED.format('v[2:257]')}) AS targets FROM wi",
    "seq2seq_windows": f"{DOCTOK}, {stream('', 'list_append(ids, 3)')}, {windows('', 512, 256)} SELECT k, md5({JOINED.format('v[1:256]')}) AS source, md5({JOINED.format('list_concat([2], v[257:511])')}) AS decoder_input, md5({JOINED.format('v[257:512]')}) AS target FROM wi",
    "parquet_lm_windows": f"{row_tokens(PART_ROWS, PART_LINE, 'train')}, {stream('', 'ids')}, {windows('', 257, 128)} SELECT k, md5({JOINED.format('v[1:256]')}) AS inputs, md5({JOINED.format('v[2:257]')}) AS targets FROM wi",
    "parquet_seq2seq_windows": f"{row_tokens(CUSTOMER_ROWS, CUSTOMER_LINE, 'validation')}, {stream('', 'list_append(ids, 3)')}, {windows('', 64, 32)} SELECT k, md5({JOINED.format('v[1:32]')}) AS source, md5({JOINED.format('list_concat([2], v[33:63])')}) AS decoder_input, md5({JOINED.format('v[33:64]')}) AS target FROM wi",
    "masked_loss": "SELECT o_custkey AS batch, round(avg(o_totalprice::DOUBLE / 1e5) FILTER (o_orderkey % 3 <> 0), 9) AS loss FROM orders GROUP BY o_custkey",
    "sft_mask": f"{MASKED} SELECT conv_id, {JOINED.format('inputs')} AS inputs, {JOINED.format('labels')} AS labels FROM y",
    "pad_batch": f"{MASKED}, z AS (SELECT *, conv_id // 8 AS batch, max(len(inputs)) OVER (PARTITION BY conv_id // 8) AS m FROM y) SELECT conv_id, batch, {JOINED.format('list_concat(inputs, list_transform(range(m - len(inputs)), lambda i: 0))')} AS inputs, {JOINED.format('list_concat(labels, list_transform(range(m - len(labels)), lambda i: -100))')} AS labels FROM z",
    "perplexity": "SELECT l_returnflag, round(avg(l_discount::DOUBLE), 9) AS mean_loss, round(exp(avg(l_discount::DOUBLE)), 9) AS perplexity, round(exp(least(avg(l_discount::DOUBLE) * 1000, 20.0)), 3) AS clamped FROM lineitem GROUP BY l_returnflag",
    "top_k_filter": f"SELECT row, token, logit FROM ({DRAW}) QUALIFY rank() OVER (PARTITION BY row ORDER BY logit DESC) <= 3",
    "nucleus_filter": f"WITH l AS ({DRAW}), e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY row)) AS e FROM l), p AS (SELECT *, e / sum(e) OVER (PARTITION BY row) AS p FROM e), b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY row ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) SELECT row, token, logit FROM b WHERE b <= 0.7",
}
