"""Unicode-aware building blocks.

Java's ``\\s``, ``\\d`` and Spark's ``trim`` know ASCII only, while notices are
full of ideographic spaces and full-width digits. The helpers here cover the
whole Unicode white-space set plus U+001C..U+001F.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

# The characters that count as white space.
_SPACE_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
    (0x3000, 0x3000),
)
SPACES = "".join(chr(c) for lo, hi in _SPACE_RANGES for c in range(lo, hi + 1))
# The same set as the inside of a Java character class.
SPACE_CLASS = "".join(
    f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" if lo != hi else f"\\x{{{lo:X}}}"
    for lo, hi in _SPACE_RANGES
)
WS = f"[{SPACE_CLASS}]"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Inside a higher-order function Spark does not share repeated
    subexpressions, so an expression written twice runs twice.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def built_once(make: Callable[[], Column]) -> Callable[[], Column]:
    """Build a large argument-free expression once per Spark application.

    Describing it takes thousands of calls to the JVM, which a streaming job
    would repeat for every micro-batch.
    """
    made: dict[str, Column] = {}

    @wraps(make)
    def cached() -> Column:
        app = SparkContext.getOrCreate().applicationId
        if app not in made:
            made.clear()
            made[app] = make()
        return made[app]
    return cached


def none_if_empty(col: Column) -> Column:
    return F.when(col != "", col)


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor ''; '' when there is none."""
    return F.coalesce(*[none_if_empty(c) for c in cols], F.lit(""))


def contains_any(col: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | col.contains(word)
    return out


def truncate(col: Column, limit: int, tail: str = "...") -> Column:
    return F.when(F.length(col) > limit,
                  F.concat(F.substring(col, 1, limit), F.lit(tail))).otherwise(col)


def filled(arr: Column) -> Column:
    """Trimmed, non-empty elements, order kept."""
    return F.filter(F.transform(arr, strip), lambda x: x != "")


def split_filled(col: Column, pattern: str) -> Column:
    return filled(F.split(text_or_empty(col), pattern))


def string_array(*values: str) -> Column:
    if values:
        return F.array(*[F.lit(v) for v in values])
    return F.array().cast("array<string>")


def last(arr: Column) -> Column:
    """Last element or null."""
    return F.try_element_at(arr, F.lit(-1))


def first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def like_text(col: Column, q: str) -> Column:
    """``LIKE '%q%'`` ignoring case; ``%`` and ``_`` in q stay wildcards.

    Text without letters that have case and without wildcards becomes a plain
    ``contains``, which Parquet row-group filters understand. With wildcards the parts
    between ``%`` are looked for in turn, each once: as the regular expression of
    ``LIKE``, ``%%a%b%`` takes the square of a long text that does not match.
    """
    if "%" in q or "_" in q:
        parts = ["".join("." if c == "_" else c if c.isalnum() else "\\" + c for c in part)
                 for part in q.lower().split("%") if part]
        return F.lower(col).rlike("(?s)\\A" + "".join(f"(?>.*?{part})" for part in parts))
    if q.lower() == q.upper():
        return col.contains(q)
    return col.ilike("%" + q.replace("\\", "\\\\") + "%")
