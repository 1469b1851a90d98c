"""Pages by the last row seen: page 10,000 costs what page 1 costs.

An offset makes every task keep offset + limit rows and sends them all to one; a cursor is a
filter, which reaches the scan, and every task keeps limit rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F


def ordering(keys: Sequence[str]) -> list[Column]:
    """Sort columns; "-name" is descending with nulls last, "name" ascending with nulls first."""
    return [F.desc_nulls_last(k[1:]) if k[0] == "-" else F.asc_nulls_first(k) for k in keys]


def cursor_of(row: Row, keys: Sequence[str]) -> tuple:
    """What names a row's place in the order."""
    return tuple(row[k.removeprefix("-")] for k in keys)


def _past(key: str, value) -> Column:
    """Strictly behind ``value`` in the order of one column."""
    col = F.col(key.removeprefix("-"))
    if key[0] == "-":
        return F.lit(False) if value is None else (col < F.lit(value)) | col.isNull()
    return col.isNotNull() if value is None else col > F.lit(value)


def beyond(keys: Sequence[str], cursor: Sequence) -> Column:
    """Rows behind the cursor: behind it in one column and level with it in all before."""
    if len(keys) != len(cursor):
        raise ValueError(f"a cursor over {list(keys)} has {len(keys)} values")
    ways, level = [], F.lit(True)
    for key, value in zip(keys, cursor):
        ways.append(level & _past(key, value))
        col = F.col(key.removeprefix("-"))
        level = level & (col.isNull() if value is None else col == F.lit(value))
    return reduce(lambda a, b: a | b, ways)


def seek(df: DataFrame, keys: Sequence[str], cursor: Sequence | None = None, limit: int = 50) -> DataFrame:
    """The next ``limit`` rows behind the cursor, the first ones without it.

    The keys together must be unique; rows level in all of them would be passed over at the
    edge of a page.
    """
    rest = df if cursor is None else df.filter(beyond(keys, cursor))
    return rest.orderBy(*ordering(keys)).limit(limit)
