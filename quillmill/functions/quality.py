"""Predicates that accept a cleaned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, strip

MIN_CHARS = 200
TEXT_RATIO = 0.70
RUN = 9


def not_empty(text: Column) -> Column:
    return F.length(strip(text)) > 0


def long_enough(text: Column, least: int = MIN_CHARS) -> Column:
    return F.length(strip(text)) >= least


def mostly_text(text: Column, ratio: float = TEXT_RATIO) -> Column:
    """Share of letters, digits and white space; an empty text fails."""
    kept = F.length(F.regexp_replace(text, rf"(?U)[^\p{{L}}\p{{N}}{SPACE[1:-1]}]", ""))
    return (F.length(text) > 0) & (kept >= F.lit(ratio) * F.length(text))


def no_long_run(text: Column, run: int = RUN) -> Column:
    """No character stands `run` times in a row (line feeds may)."""
    return ~F.regexp_like(text, F.lit(rf"(.)\1{{{run - 1},}}"))


def accepted(text: Column) -> Column:
    return not_empty(text) & long_enough(text) & mostly_text(text) & no_long_run(text)
