"""Pages, tails and best candidates: sorts with limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def after(order: Sequence[tuple[str, bool]], cursor: Sequence) -> Column:
    """Rows strictly after the cursor in an order of (column, ascending) pairs; columns hold no nulls."""
    out, equal = F.lit(False), F.lit(True)
    for (c, up), v in zip(order, cursor, strict=True):
        out = out | (equal & (F.col(c) > F.lit(v) if up else F.col(c) < F.lit(v)))
        equal = equal & (F.col(c) == F.lit(v))
    return out


def keyset_page(df: DataFrame, order: Sequence[tuple[str, bool]], limit: int, cursor: Sequence | None = None) -> DataFrame:
    """One page of at most limit + 1 rows: `extra` marks the row that says there is more. The order must end in a unique
    column. Each task keeps limit + 1 rows; nothing is sorted as a whole."""
    rows = df if cursor is None else df.filter(after(order, cursor))
    by = [F.asc(c) if up else F.desc(c) for c, up in order]
    page = rows.orderBy(*by).limit(limit + 1)
    # the last of limit + 1 rows in the opposite order
    back = [F.desc(c) if up else F.asc(c) for c, up in order]
    last = page.orderBy(*back).limit(1).select(*[F.col(c).alias(f"_{c}") for c, _ in order])
    size = page.agg(F.count("*").alias("_n"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c, _ in order]
    flagged = page.join(last, on, "left").crossJoin(size)  # one row
    return flagged.withColumn("extra", (F.col("_n") > limit) & F.col(f"_{order[0][0]}").isNotNull()).select(*df.columns, "extra")


def status_page(batches: DataFrame, jobs: DataFrame, batch: str, batch_order: Sequence[tuple[str, bool]], job_order: Sequence[tuple[str, bool]], batch_limit: int, job_limit: int, batch_cursor: Sequence | None = None, job_cursor: Sequence | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of batches, and a page of the jobs of those batches only, each with its own cursor."""
    top = keyset_page(batches, batch_order, batch_limit, batch_cursor).filter(~F.col("extra")).drop("extra")
    of = jobs.join(top.select(batch), batch, "left_semi")
    return top, keyset_page(of, job_order, job_limit, job_cursor)


def anchored_page(df: DataFrame, seq: str, limit: int, lower: int, upper: int, filters: Column | None = None) -> DataFrame:
    """Rows with lower < seq <= upper that meet the filters, in order of seq: rows appended after the first page was
    read (beyond upper) don't shift later pages. Raises LookupError if the anchor row `lower` is gone."""
    if lower and not df.filter(F.col(seq) == lower).limit(1).count():
        raise LookupError(f"the row {seq} = {lower} that the last page ended with is gone")
    some = df.filter((F.col(seq) > lower) & (F.col(seq) <= upper))
    return (some if filters is None else some.filter(filters)).orderBy(seq).limit(limit)


def tail_lines(text: Column, n: int) -> Column:
    """The last n lines of a text, as an array; a final line end opens no line of its own. Null gives null."""
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    return F.slice(lines, F.greatest(F.lit(1), F.size(lines) - n + 1), F.lit(n))


def best_card(candidates: DataFrame, request: str | Sequence[str], allowed: str, preferred: str, load: str, position: str, card: str) -> DataFrame:
    """For each request, or each kind of them by the columns that tell it, of its allowed cards the preferred first, then
    the least loaded, then the first in position: `best`, and `n_allowed`."""
    key = F.struct((~F.coalesce(F.col(preferred), F.lit(False))).alias("p"), F.col(load), F.col(position))
    ok = F.coalesce(F.col(allowed), F.lit(False))
    return candidates.groupBy(*([request] if isinstance(request, str) else request)).agg(F.min_by(F.when(ok, F.col(card)), F.when(ok, key)).alias("best"), F.count_if(ok).alias("n_allowed"))
