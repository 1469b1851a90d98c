"""Column helpers over the arrays made by ``html_blocks``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.chars import first

Predicate = Callable[[Column], Column]


def other_columns(blocks: DataFrame) -> list[str]:
    return [c for c in blocks.columns if c not in ("els", "texts", "tables")]


def els() -> Column:
    return F.col("els")


def inside(el: Column) -> Column:
    """Descendants of an element, in document order."""
    return F.slice(F.col("els"), el["pos"] + 2, el["last"] - el["pos"])


def runs_of(el: Column) -> Column:
    """Text runs of an element."""
    return F.slice(F.col("texts"), el["t0"] + 1, el["t1"] - el["t0"])


def text_of(el: Column, sep: str = "") -> Column:
    return F.array_join(runs_of(el)["s"], sep)


def plain_text(el: Column) -> Column:
    return text_of(el)


def raw_text(runs: Column) -> Column:
    """Runs joined as written: a space only where white space stood."""
    return F.array_join(F.transform(
        runs, lambda r: F.when(r["gap"], F.concat(F.lit(" "), r["s"])).otherwise(r["s"])), "")


def lines_text(runs: Column) -> Column:
    """As ``raw_text``, with a line break wherever a tag that is no inline one stood."""
    return F.array_join(F.transform(runs, lambda r: F.concat(
        F.when(r["apart"], "\n").when(r["gap"], " ").otherwise(""), r["s"])), "")


def visible(items: Column) -> Column:
    """Elements or runs outside navigation, headers, footers and asides."""
    return F.filter(items, lambda x: ~x["chrome"])


def tag_is(*names: str) -> Predicate:
    return lambda e: e["tag"].isin(*names)


def has_class(name: str) -> Predicate:
    return lambda e: F.coalesce(
        F.concat(F.lit(" "), e["cls"], F.lit(" ")).contains(f" {name} "), F.lit(False))


def class_like(pattern: str) -> Predicate:
    return lambda e: F.coalesce(e["cls"].rlike(f"(?i){pattern}"), F.lit(False))


def id_like(pattern: str) -> Predicate:
    return lambda e: F.coalesce(e["id"].rlike(f"(?i){pattern}"), F.lit(False))


def both(*preds: Predicate) -> Predicate:
    def test(e: Column) -> Column:
        out = preds[0](e)
        for p in preds[1:]:
            out = out & p(e)
        return out
    return test


def find_all(items: Column, pred: Predicate) -> Column:
    return F.filter(items, pred)


def find(items: Column, pred: Predicate) -> Column:
    """First matching element or null."""
    return first(F.filter(items, pred))
