"""Column functions on times, sizes, JSON, digests and log text. All are JVM expressions but `canonical_text`."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON text of declared fields with sorted keys, no spaces and nulls kept. Nested values keep the order of their
    struct. Non-ASCII is not escaped; for free-form documents use canonical_text."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_text():
    """A function of a JSON column: the same document with sorted keys, no spaces, ASCII only; null if it isn't JSON, or
    holds NaN or an infinity."""

    def one(text: str | None) -> str | None:
        def refuse(name: str) -> float:
            raise ValueError(name)

        try:
            return json.dumps(json.loads(text, parse_constant=refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)
        except (TypeError, ValueError, RecursionError):
            return None

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.StringType())


def digest(text: Column) -> Column:
    """SHA-256 in hex of a text's UTF-8 bytes."""
    return F.sha2(text, 256)


def encode_cursor(parts: Sequence[Column]) -> Column:
    """URL-safe base64, without padding, of a JSON array of the parts as text (null stays null)."""
    return F.rtrim(F.translate(F.base64(F.to_json(F.array(*[p.cast("string") for p in parts])).cast("binary")), "+/", "-_"), F.lit("="))


def decode_cursor(cursor: Column, types: Sequence[str], longest: int = 4096) -> Column:
    """The parts of a cursor as a struct _1, _2, ...; null if it is too long, not base64, or not of these types."""
    text = F.translate(cursor, "-_", "+/")
    padded = F.rpad(text, (F.ceil(F.length(text) / 4) * 4).cast("int"), "=")
    whole = F.when((F.length(cursor) <= longest) & cursor.rlike("^[A-Za-z0-9_-]+$"), F.try_to_binary(padded, F.lit("base64")))
    parts = F.from_json(whole.cast("string"), "array<string>")
    cast = [F.try_element_at(parts, F.lit(i + 1)).try_cast(t).alias(f"_{i + 1}") for i, t in enumerate(types)]
    fits = (F.size(parts) == len(types)) & F.forall(F.array(*[c.isNotNull() | F.try_element_at(parts, F.lit(i + 1)).isNull() for i, c in enumerate(cast)]), lambda x: x)
    return F.when(fits, F.struct(*cast))


def json_equal(a: Column, b: Column) -> Column:
    """Equality of two JSON scalars given as text: true never equals 1, 1 equals 1.0, a string only a string. Objects
    and arrays compare by their own text. Null if either isn't JSON."""
    x, y = F.try_parse_json(a), F.try_parse_json(b)
    kind = lambda v: F.when(F.schema_of_variant(v).isin("BOOLEAN", "STRING", "VOID"), F.schema_of_variant(v)).when(F.schema_of_variant(v).rlike("^(ARRAY|OBJECT)"), "NESTED").otherwise("NUMBER")
    number = F.try_variant_get(x, "$", "double") == F.try_variant_get(y, "$", "double")
    same = F.when(kind(x) != kind(y), False).when(kind(x) == "NUMBER", number).otherwise(F.to_json(x) == F.to_json(y))
    return F.when(x.isNotNull() & y.isNotNull(), F.coalesce(same, F.lit(False)))


def json_path(doc: Column, path: str) -> Column:
    """Struct of `found` and `value` (text): a dotted path of object keys; a JSON null is found, with a null value."""
    at = "$" + "".join(f"['{p}']" for p in path.split("."))
    v = F.try_variant_get(F.try_parse_json(doc), at, "variant")
    return F.struct(v.isNotNull().alias("found"), F.when(~F.is_variant_null(v), F.try_variant_get(v, "$", "string")).alias("value"))


def duration_seconds(start: Column, end: Column, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Seconds between two local times given as text; null if either is missing or can't be read."""
    at = lambda c: F.unix_seconds(F.try_to_timestamp(c, F.lit(form)))
    return at(end) - at(start)


def last_match(text: Column, pattern: str, longest: int = 120) -> Column:
    """The last match of the caller's own (Java) pattern, cut at `longest` characters; null if there is none. Patterns that
    come with the data go through `patterns.pattern_result`, which refuses bad ones and stops slow ones."""
    return F.substring(F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(-1)), 1, longest)


#: Fixed value: how a training log tells its progress.
PROGRESS = r"(?iU)(?:epoch|trial|iter|step)\s*[:/#= ]\s*(\d+)\s*(?:/|of\s+)?\s*(\d+)?"
#: Fixed value: what ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def progress(text: Column, lines: int = 200, tail_bytes: int = 256 << 10) -> Column:
    """"n/m" of the first progress mark in the newest line that has one, among the last lines of the last tail_bytes; m is
    ? if it isn't told. Null if there is none."""
    tail = F.substring(text.cast("binary"), -tail_bytes, tail_bytes).cast("string")
    split = F.split(F.regexp_replace(tail, f"(?:{LINE_END})\\z", ""), LINE_END)
    last = F.slice(split, F.greatest(F.lit(1), F.size(split) - lines + 1), F.lit(lines))
    line = F.try_element_at(F.filter(last, lambda x: x.rlike(PROGRESS)), F.lit(-1))
    done, goal = (F.regexp_extract(line, PROGRESS, g) for g in (1, 2))
    return F.when(line.isNotNull(), F.concat_ws("/", done, F.when(goal == "", "?").otherwise(goal)))


def log_excerpt(text: Column, marker: str, around: int = 3, longest: int = 4096) -> Column:
    """The first line that contains a marker (a Java pattern) with the lines around it; of more than `longest` characters
    the last ones. Null if no line does."""

    def cut(lines: Column) -> Column:
        hit = F.array_position(F.transform(lines, lambda x: x.rlike(marker)), True)
        return F.when(hit > 0, F.array_join(F.slice(lines, F.greatest(F.lit(1), hit - around).cast("int"), (F.least(hit - 1, F.lit(around)) + around + 1).cast("int")), "\n"))

    # as variables of outer lambdas the lines and the excerpt are made once
    part = F.transform(F.array(F.split(text, "\n")), cut)
    short = F.transform(part, lambda p: F.when(F.length(p) > longest, F.substring(p, -longest, longest)).otherwise(p))
    return short[0]


def mib_to_gib(mib: Column, digits: int = 2) -> Column:
    """Rounded half to even."""
    return F.bround(mib / 1024, digits)


def gib_to_bytes(gib: Column) -> Column:
    """Rounded up, so that a request is never understated."""
    return F.ceil(gib * (1 << 30)).cast("long")


def profile_key(project: Column, key: Column) -> Column:
    """A key of its own for each project and key, whatever characters they hold; null without a key."""
    return F.when(key.isNotNull(), F.to_json(F.array(project, key)))


def completion_key(fields: dict[str, Column]) -> Column:
    """The digest that names one completion of a job: of its id, version, context, retries, start and allocation."""
    return digest(canonical_json(fields))


def fingerprint(required: dict[str, Column], optional: dict[str, Column]) -> Column:
    """The content key of a task: the digest of all inputs, or null if a required one is missing (such a task can't be
    skipped)."""
    whole = digest(canonical_json(required | optional))
    missing = F.lit(False)
    for c in required.values():
        missing = missing | c.isNull()
    return F.when(~missing, whole)


def load_after(used: Column, asked: Column, capacity: Column) -> Column:
    """(used + asked) / capacity; 0 if the capacity isn't known."""
    return F.when(capacity > 0, (used + asked) / capacity).otherwise(0.0)


def state_filter_text(status: Column) -> Column:
    """Statuses that wait for a reason are shown as pending."""
    return F.when(status.startswith("waiting_"), "pending").otherwise(status)


def backoff_remaining(retries: Column, finished: Column, now: Column | int, wait: int = 30) -> Column:
    """Seconds until a retried job may start again: what is left of `wait` since it ended; 0 for a first attempt."""
    left = F.greatest(F.lit(0), F.lit(wait) - (F.lit(now) - finished))
    return F.when((F.coalesce(retries, F.lit(0)) <= 0) | finished.isNull(), 0).otherwise(left)
