"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns near hits, checksum validation.

One automaton pass finds the keywords of all kinds (in every mix of case where a kind allows
it); a kind's pattern is tried only at its hits, anchored there, from left to right and not
inside the kind's last match. Runs of hexadecimal digits have no keyword; a run pattern finds
them. Kinds with an embedded checksum add a span only where the checksum is right.

Null and empty texts have no spans; repeated rows are scanned each for itself; long texts are
scanned whole; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounds

# Kinds in order of listing, keywords and patterns.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = 3
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SPANS = "array<struct<kind:string,start:int,end:int>>"


def checksum_is_right(token: str) -> bool:
    """The last six characters are the CRC-32 of the 30 before, in base 62."""
    body = token.partition("_")[2]
    value, digits = zlib.crc32(body[:30].encode()), []
    for _ in range(6):
        value, d = divmod(value, 62)
        digits.append(BASE62[d])
    return body[30:] == "".join(reversed(digits))


#: Kind: keywords, whether in either case, pattern, test of a match.
RULES = (
    (ASSIGN_WORDS, True, ASSIGN, lambda m: len(m[2]) >= 12),
    (("AKIA",), False, ACCESS, lambda m: len(m[0]) >= 18),
    ((), False, HEX, lambda m: True),
    (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), False, GITHUB, lambda m: checksum_is_right(m[0])),
    (("npm_",), False, NPM, lambda m: checksum_is_right(m[0])),
)
_automaton = None


def automaton():
    """Built once in a worker: every spelling of a keyword, with its kind and length."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for kind, (keywords, either, _, _) in enumerate(RULES):
            for word in keywords:
                for letters in itertools.product(*({c.lower(), c.upper()} if either else {c} for c in word)):
                    _automaton.add_word("".join(letters), (kind, len(word)))
        _automaton.make_automaton()
    return _automaton


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; kind is an index of KINDS."""
    if not text:
        return []
    out, free = [], [0] * len(KINDS)
    hits = sorted((last - n + 1, kind) for last, (kind, n) in automaton().iter(text))
    for start, kind in hits:
        if start >= free[kind] and (m := RULES[kind][2].match(text, start)):
            free[kind] = m.end()
            if RULES[kind][3](m):
                out.append((start, kind, m.end()))
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each run of overlapping spans replaced by <kind> of the first."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join(parts) + text[at:] if spans else text


def scan_secrets(docs: DataFrame, *, text_col: str = "text", redact: bool = False) -> DataFrame:
    """docs with column `spans` (array of kind, start, end); with redact, text_col is the text without them."""
    arrow_bounds(docs.sparkSession)
    names = [c for c in docs.columns if c != "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = batch.column(names.index(text_col)).to_pylist()
            found = [find_spans(t) for t in texts]
            columns = list(batch.columns)
            if redact:
                columns[names.index(text_col)] = pa.array([t if t is None else redacted(t, s) for t, s in zip(texts, found, strict=True)], pa.string())
            spans = pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in found], kinds)
            yield pa.RecordBatch.from_arrays([*columns, spans], names=[*names, "spans"])

    kept = docs.select(*[docs[f"`{c}`"] for c in names])
    schema = kept.withColumn("spans", F.lit(None).cast(SPANS)).schema
    return kept.mapInArrow(scan, schema)
