"""Column functions on text: cleaning, keys, prompts, shingles.

White space is what Python's str methods take for it: Unicode white space and U+001C to U+001F.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\x1C-\x1F]"
#: The same characters.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


#: Characters that composition never changes, whatever stands beside them: ASCII, the letters of Latin, Greek and Cyrillic that
#: have no compatibility form, dashes and quotation marks, and CJK ideographs.
STABLE = r"[\x00-\x9F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0180-\u01C3\u0391-\u03A1\u03A3-\u03CE\u0400-\u0481\u2010\u2012-\u2016\u2018-\u201F\u2020-\u2022\u20AC\u4E00-\u9FFF]"


#: Texts of a batch that are Python's at a time.
AT_ONCE = 64


@F.arrow_udf(StringType())
def _composed(texts: pa.Array) -> pa.Array:
    parts = (texts.slice(i, AT_ONCE).to_pylist() for i in range(0, len(texts), AT_ONCE))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in part], pa.string()) for part in parts)])


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition; there is no such built-in. Texts of STABLE characters alone are not sent to Python."""
    plain = (F.octet_length(text) == F.length(text)) | text.rlike(rf"\A{STABLE}*+\z")  # ASCII alone, which is quickly seen, or STABLE
    return F.coalesce(_composed(F.when(~plain, text)), text)


def line_endings(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def without_controls(text: Column) -> Column:
    """Drops every character of a Unicode category C but line feed and tab."""
    return F.regexp_replace(text, r"[\p{C}&&[^\n\t]]", "")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def tidy_space(text: Column) -> Column:
    """Single spaces within lines, none at their ends, at most one blank line, none at the ends of the text."""
    text = F.regexp_replace(text, r" [ \t]+|\t[ \t]*", " ")  # single spaces are no match, nor are line feeds alone
    text = F.regexp_replace(text, r" *\n +| +\n", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def clean_text(text: Column, compose: bool = True) -> Column:
    """The whole chain. compose=False leaves out nfkc(), the one part that is not built in."""
    return tidy_space(without_controls(line_endings(nfkc(text) if compose else text)))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once, however often what follows refers to it: nothing is pushed below a generator."""
    return df.select(*[df[f"`{c}`"] for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def collapse(text: Column) -> Column:
    """Every run of white space is one space, none at the ends; null is empty."""
    return strip(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), rf"(?U) {SPACE}+|[{SPACE[1:-1]}&&[^ ]]{SPACE}*", " "))


def words(text: Column) -> Column:
    """White-space-separated parts."""
    return F.array_remove(F.split(text, rf"(?U){SPACE}+"), "")


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def bytes_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def content_hash(text: Column) -> Column:
    return F.sha2(collapse(text), 256)


def split_of(digest: Column) -> Column:
    """train (90 %), validation or test (5 % each) by the first 8 hex digits."""
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < 90, "train").when(bucket < 95, "validation").otherwise("test")


def stable_id(instruction: Column, input_: Column, response: Column, category: Column, source: Column) -> Column:
    """16 hex digits."""
    return F.substring(F.sha2(F.concat_ws("\n", instruction, input_, response, category, source), 256), 1, 16)


def dedup_key(instruction: Column, input_: Column, response: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lower(instruction), F.lower(input_), F.lower(response)), 256)


def json_string(text: Column) -> Column:
    """A JSON string as Python's json writes it with ensure_ascii=False."""
    named = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    out = text
    for raw, shown in named.items():
        out = F.replace(out, F.lit(raw), F.lit(shown))
    rare = out
    for code in range(0x20):
        if chr(code) not in named:
            rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1F]"), rare).otherwise(out), F.lit('"'))


def record_id(record: dict[str, Column]) -> Column:
    """64 hex digits of the record as JSON with sorted keys."""
    parts: list[Column] = []
    for i, name in enumerate(sorted(record)):
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{name}": '), json_string(record[name])]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


def prompt(instruction: Column, input_: Column) -> Column:
    """What stands before the response in training and token counts."""
    return F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n### Input:\n"), input_, F.lit("\n\n### Response:\n"))


def training_text(instruction: Column, input_: Column, response: Column) -> Column:
    """A whole example as plain text."""
    return F.concat(F.lit("### Instruction\n"), instruction, F.lit("\n\n### Input\n"), input_, F.lit("\n\n### Response\n"), response)


def article_block(article: Column, abstract: Column) -> Column:
    """Both parts, or the one there is, each followed by a blank line; null if there is none."""
    parts = F.concat_ws("\n\n", *[F.when(strip(c) != "", strip(c)) for c in (article, abstract)])
    return F.when(parts != "", F.concat(parts, F.lit("\n\n")))


def shingles(w: Column, width: int = 3) -> Column:
    """Runs of `width` words; fewer words are one shingle, none none.

    w should be a column of words, not an expression: it would be evaluated for each run.
    """
    run = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - width + 1)), lambda i: F.array_join(F.slice(w, i, width), " "))
    return F.when(F.size(w) > 0, run).otherwise(F.array().cast("array<string>"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex16(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def first_filled(columns: dict[str, str], fields: tuple[str, ...]) -> Column:
    """First of the fields that is not blank, stripped; columns maps lower-cased names to names."""
    found = [F.when(strip(F.col(f"`{columns[f]}`").cast("string")) != "", strip(F.col(f"`{columns[f]}`").cast("string"))) for f in fields if f in columns]
    return F.coalesce(*found, F.lit("")) if found else F.lit("")
