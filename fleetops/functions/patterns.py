"""Patterns that come from users: refused if they don't compile, stopped if they take too long."""

from __future__ import annotations

import re
import time
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longer patterns are refused.
MOST_PATTERN = 4096


@lru_cache(1024)
def compiled(pattern: str) -> regex.Pattern | None:
    """None for what isn't a pattern. The standard library decides what one is; `regex`, which can be stopped, runs it."""
    if not pattern or "\0" in pattern or len(pattern) > MOST_PATTERN:
        return None
    try:
        re.compile(pattern)
        return regex.compile(pattern)
    except (re.error, regex.error, OverflowError, RecursionError, ValueError):
        return None


def last_found(pattern: str, text: str, seconds: float, longest: int) -> tuple[str, str | None]:
    found = compiled(pattern)
    if found is None:
        return "invalid_regex", None
    last, until = None, time.monotonic() + seconds
    try:
        for m in found.finditer(text, timeout=seconds):
            last = m[0][:longest]
            if time.monotonic() > until:
                return "regex_timeout", None
    except (TimeoutError, MemoryError):
        return "regex_timeout", None
    return ("regex_no_match", None) if last is None else ("passed", last)


def pattern_result(text: Column, pattern: Column, seconds: float = 0.25, longest: int = 120) -> Column:
    """Struct of `reason` and `match` (the last one, cut at `longest` characters) of each row's own pattern:

    passed, regex_no_match, invalid_regex (it doesn't compile, is empty, holds a NUL or is longer than MOST_PATTERN) or
    regex_timeout (more than `seconds` for the row, so no row can hold up the others). A null pattern gives a null struct, a
    null text no match. Python's patterns, as an Arrow-batched UDF: Java's can't be stopped."""

    @F.pandas_udf("reason string, match string")
    def run(texts: pd.Series, patterns: pd.Series) -> pd.DataFrame:
        told = [(None, None) if p is None else ("regex_no_match" if compiled(p) else "invalid_regex", None) if t is None else last_found(p, t, seconds, longest) for t, p in zip(texts, patterns, strict=True)]
        return pd.DataFrame(told, columns=["reason", "match"])

    return F.when(pattern.isNotNull(), run(F.when(pattern.isNotNull(), text), pattern))
