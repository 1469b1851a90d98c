"""Tables of a page: grid cells, key/value pairs, field mapping, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.chars import built_once, first, last, let, text_or_empty
from . import dom

# Label -> (category, field), in matching order.
FIELD_LABELS = (
    ("采购项目名称", "project_info", "name"),
    ("项目名称", "project_info", "name"),
    ("品目", "project_info", "category"),
    ("行政区域", "project_info", "region"),
    ("公告时间", "project_info", "publish_date"),
    ("公告日期", "project_info", "publish_date"),
    ("采购单位", "buyer", "name"),
    ("采购人", "buyer", "name"),
    ("采购单位地址", "buyer", "address"),
    ("采购人地址", "buyer", "address"),
    ("采购单位联系方式", "buyer", "contact"),
    ("采购人联系方式", "buyer", "contact"),
    ("代理机构名称", "agent", "name"),
    ("代理机构", "agent", "name"),
    ("代理机构地址", "agent", "address"),
    ("代理机构联系方式", "agent", "contact"),
    ("供应商名称", "supplier", "name"),
    ("中标人", "supplier", "name"),
    ("中标单位", "supplier", "name"),
    ("供应商地址", "supplier", "address"),
    ("中标人地址", "supplier", "address"),
    ("总中标金额", "amount", "total"),
    ("中标金额", "amount", "bid"),
    ("成交金额", "amount", "bid"),
    ("评审专家名单", "experts", ""),
    ("评审专家", "experts", ""),
    ("项目联系人", "contacts", "name"),
    ("项目联系电话", "contacts", "phone"),
    ("联系人", "contacts", "name"),
    ("联系电话", "contacts", "phone"),
)
SUMMARY_FIELDS = tuple(dict.fromkeys(
    (c, f) for _, c, f in FIELD_LABELS))


def _key(category: str, field: str) -> str:
    return f"{category}.{field}" if field else category


def is_header(e: Column) -> Column:
    return (e["tag"] == "th") | dom.has_class("title")(e)


def summary_div() -> Column:
    return dom.find(dom.els(), dom.both(dom.tag_is("div"), dom.has_class("table")))


@built_once
def summary_table() -> Column:
    """Element of the first table in the first div of class 'table', or null."""
    return let(summary_div(), lambda d: dom.find(dom.inside(d), dom.tag_is("table")))


def table_cells(blocks: DataFrame) -> DataFrame:
    """One row per run of grid columns a cell fills, for every table.

    A cell that spans rows appears once in each of them; ``col`` is its first
    column there and ``width`` the number of columns it fills.
    """
    kept = dom.other_columns(blocks)
    carried = F.struct(*[F.col(c) for c in kept]).alias("_p")
    per_table = blocks.select(carried, "els", "texts", F.posexplode("tables").alias("table_no", "_t"))
    # Resolve each run to its cell before exploding, so that the element and
    # text arrays are not repeated per cell.
    def resolved(run: Column) -> Column:
        return let(F.col("els")[run["el"]], lambda e: F.struct(
            run["src_row"].alias("src_row"), run["col"].alias("col"), run["width"].alias("width"),
            e["colspan"].alias("colspan"), e["rowspan"].alias("rowspan"),
            is_header(e).alias("is_header"), dom.text_of(e).alias("text")))

    rows = per_table.select(
        "_p", "table_no",
        F.posexplode(F.transform(F.col("_t.rows"), lambda row: F.transform(row, resolved)))
        .alias("row", "_runs"))
    return (rows.select("_p", "table_no", "row", F.explode("_runs").alias("_c"))
            .select("_p.*", "table_no", "row", "_c.*"))


def table_profile(blocks: DataFrame) -> DataFrame:
    """Size and span profile of every table."""
    kept = dom.other_columns(blocks)

    def profile(t: Column) -> Column:
        inner = dom.inside(F.col("els")[t["el"]])
        cells = F.filter(inner, lambda e: e["tag"].isin("td", "th") & (
            F.col("els")[e["parent"]]["tag"] == "tr"))
        return let(cells, lambda c: F.struct(
            F.size(t["rows"]).alias("total_rows"),
            F.coalesce(F.array_max(c["colspan"]), F.lit(0)).alias("max_cols"),
            F.exists(c, lambda e: e["colspan"] > 1).alias("has_colspan"),
            F.exists(c, lambda e: e["rowspan"] > 1).alias("has_rowspan"),
            F.size(F.filter(c, is_header)).alias("header_rows")))

    both_spans = F.col("has_colspan") & F.col("has_rowspan")
    any_span = F.col("has_colspan") | F.col("has_rowspan")
    return (blocks.select(*kept, F.posexplode(F.transform("tables", profile)).alias("table_no", "_t"))
            .select(*kept, "table_no", "_t.*")
            .filter("total_rows > 0")
            .withColumn("complexity", F.when(both_spans, "high").when(any_span, "medium")
                        .otherwise("simple")))


@built_once
def key_values() -> Column:
    """Key/value pairs of the summary table, row by row: array<struct<key,value>>."""
    grid = let(summary_table(), lambda t: first(
        F.filter(F.col("tables"), lambda x: x["el"] == t["pos"])))["rows"]

    def cell(run: Column) -> Column:
        return let(F.col("els")[run["el"]], lambda e: F.struct(
            dom.text_of(e).alias("text"), run["width"].alias("width"), run["col"].alias("col"),
            e["colspan"].alias("colspan"), is_header(e).alias("is_header")))

    def own_cells(runs: Column) -> Column:
        """Non-empty cells written in the same source row as the leftmost one."""
        src = F.when(first(runs)["col"] == 0, first(runs)["src_row"])
        return F.filter(F.transform(F.filter(runs, lambda r: r["src_row"] == src), cell),
                        lambda c: c["text"] != "")

    def pair(cells: Column) -> Column:
        head = first(cells)
        rest = F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))["text"]
        # A key over two columns is met again as the first later cell.
        later = F.when(head["width"] > 1, F.concat(F.array(head["text"]), rest)).otherwise(rest)
        return F.when(head["is_header"] & (head["colspan"] <= 2), F.struct(
            F.regexp_replace(head["text"], "[：:]+$", "").alias("key"),
            F.array_join(F.array_distinct(later), " ").alias("value")))

    pairs = F.transform(F.transform(grid, own_cells), pair)
    return F.coalesce(F.filter(pairs, lambda p: p["value"] != ""),
                      F.array().cast("array<struct<key:string,value:string>>"))


# The labels as one constant: array<struct<label, field>>.
_RULES = "array(" + ", ".join(
    f"struct('{label}' AS label, '{_key(category, field)}' AS field)"
    for label, category, field in FIELD_LABELS) + ")"


def field_of(key: Column) -> Column:
    """'category.field' of a label: exact match, else the first label in order
    where either text contains the other; null when none does (X5)."""
    rules = F.expr(_RULES)
    exact = F.filter(rules, lambda r: r["label"] == key)
    loose = F.filter(rules, lambda r: key.contains(r["label"]) | r["label"].contains(key))
    return F.coalesce(first(exact)["field"], first(loose)["field"])


def summary_fields(pairs: Column) -> Column:
    """struct<category struct<field>> from key/value pairs.

    A repeated key keeps its first position and its last value; among keys of
    one field the last position wins.
    """
    mapped = F.filter(F.transform(pairs, lambda p: F.struct(
        p["key"].alias("key"), p["value"].alias("value"), field_of(p["key"]).alias("field"))),
        lambda p: p["field"].isNotNull())

    def value(m: Column, category: str, field: str) -> Column:
        mine = F.filter(m, lambda p: p["field"] == _key(category, field))
        return let(mine, lambda x: text_or_empty(let(
            last(F.array_distinct(x["key"])),
            lambda k: last(F.filter(x, lambda p: p["key"] == k))["value"])))

    def build(m: Column) -> Column:
        groups: dict[str, list[Column]] = {}
        for category, field in SUMMARY_FIELDS:
            groups.setdefault(category, []).append(
                value(m, category, field).alias(field or category))
        return F.struct(*[(F.struct(*cols) if category != "experts" else cols[0]).alias(category)
                          for category, cols in groups.items()])

    return let(mapped, build)
