"""Stored page -> columnar page: the one job that needs Python.

``html_blocks`` adds three columns to a page table and drops the markup:

* ``els``    array of elements in document order. An element owns the slice of
             ``els`` up to ``last`` (its descendants) and the slice of
             ``texts`` from ``t0`` up to ``t1`` (its text), so no text is
             stored twice however deep the markup nests.
* ``texts``  array of text runs; ``gap`` tells whether white space separated
             the run from the previous one, ``apart`` whether a tag that is no inline one did.
* ``tables`` one entry per table with its rows laid out on the grid.

Everything downstream is column expressions over these arrays: a page never
leaves its row, so no later step has to shuffle page text by page.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right, insort
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, functions as F, types as T

# The parser travels with the task: executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

RUN = T.StructType([
    T.StructField("el", T.IntegerType()),       # index of the cell in els
    T.StructField("src_row", T.IntegerType()),  # row the cell was written in
    T.StructField("col", T.IntegerType()),      # first grid column of the run
    T.StructField("width", T.IntegerType()),    # grid columns the run fills
])
TABLE = T.StructType([
    T.StructField("el", T.IntegerType()),
    T.StructField("rows", T.ArrayType(T.ArrayType(RUN, False), False)),
])
ELEMENT = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("t0", T.IntegerType()),
    T.StructField("t1", T.IntegerType()),
    T.StructField("chrome", T.BooleanType()),   # inside nav, header, footer, aside
    T.StructField("tag", T.StringType()),
    T.StructField("cls", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("href", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("colspan", T.IntegerType()),
    T.StructField("rowspan", T.IntegerType()),
])
TEXT = T.StructType([
    T.StructField("s", T.StringType()),
    T.StructField("gap", T.BooleanType()),
    T.StructField("chrome", T.BooleanType()),
    T.StructField("apart", T.BooleanType()),
])
BLOCK_FIELDS = [
    T.StructField("els", T.ArrayType(ELEMENT, False)),
    T.StructField("texts", T.ArrayType(TEXT, False)),
    T.StructField("tables", T.ArrayType(TABLE, False)),
]

# Pages parsed at once: their elements take many times the memory of their markup.
PART_ROWS = 64
PART_BYTES = 1 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S)
_ATTR = re.compile(
    r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
_INT = re.compile(r"\s*\+?(\d+)\s*\Z")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template"))
_CHROME = frozenset(("nav", "header", "footer", "aside"))
# These do not end a word or a number; a browser draws them within a line.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby "
                    "s samp small span strike strong sub sup time tt u var wbr".split()) | _HIDDEN
_KEPT_ATTRS = frozenset(("class", "id", "href", "name", "content", "colspan", "rowspan"))

# A start tag first closes these when they are innermost (omitted end tags).
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
_FONT = frozenset("b i u s tt big small strike".split())
_P = frozenset(("p", "head"))
_CELL = frozenset("td th p span font a b u".split())
_ROW = frozenset("td th tr p caption col colgroup".split())
_CLOSED_BY = {
    "p": _P | _HEADINGS | _FONT,
    "li": _P | _HEADINGS | {"li", "address", "pre"},
    "td": _CELL, "th": _CELL, "tr": _ROW,
    "tbody": _ROW | {"tbody", "thead", "tfoot"},
    "thead": _ROW | {"tbody", "thead", "tfoot"},
    "tfoot": _ROW | {"tbody", "thead", "tfoot"},
    "dt": frozenset("p dt dd".split()), "dd": frozenset("p dt dd".split()),
    "a": frozenset("a"), "option": frozenset(("option",)),
    "body": frozenset("head style script title".split()),
    **dict.fromkeys(_HEADINGS, _P | _HEADINGS),
    **dict.fromkeys("div ul ol dl table form hr pre address blockquote center fieldset "
                    "article section main nav header footer aside".split(), _P),
}
# An end tag does not reach past an element of a higher rank.
_RANK = {"p": 10, "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180,
         "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}


def _span(value: str | None) -> int:
    """colspan / rowspan; unreadable values and 0 count as 1."""
    found = _INT.match(value) if value else None
    return max(int(found.group(1)), 1) if found else 1


def parse_page(html: str) -> tuple[list[list], list[list]]:
    """One page -> (elements, text runs), see ELEMENT and TEXT."""
    els: list[list] = [[0, -1, 0, 0, 0, False, "#root"] + [None] * 5 + [1, 1]]
    texts: list[list] = []
    stack = [0]
    buf: list[str] = []
    gap = apart = False
    end = 0

    def flush() -> None:
        nonlocal gap, apart
        if not buf:
            return
        raw = "".join(buf)
        buf.clear()
        body = raw.strip()
        if not body:
            gap = True
            return
        texts.append([body, gap or raw[0].isspace(), els[stack[-1]][5], apart])
        gap, apart = raw[-1].isspace(), False

    def close() -> None:
        el = els[stack.pop()]
        el[2], el[4] = len(els) - 1, len(texts)

    tokens = _TOKEN.finditer(html)
    for m in tokens:
        if m.start() < end:          # markup inside a script or style
            continue
        if m.start() > end:
            chunk = html[end:m.start()]
            buf.append(unescape(chunk) if "&" in chunk else chunk)
        end = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:              # comment or declaration
            flush()
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            rank = _RANK.get(tag, 100)
            for at in range(len(stack) - 1, 0, -1):
                name = els[stack[at]][6]
                if name == tag:
                    flush()
                    apart = apart or any(els[i][6] not in _INLINE for i in stack[at:])
                    while len(stack) > at:
                        close()
                    break
                if _RANK.get(name, 100) > rank:
                    break
            continue
        flush()
        apart = apart or tag not in _INLINE
        closes = _CLOSED_BY.get(tag)
        if closes:
            while len(stack) > 1 and els[stack[-1]][6] in closes:
                close()
        raw_attrs = m["attrs"] if m["tag"] else m["attrs2"]
        attrs: dict[str, str] = {}
        if raw_attrs and not raw_attrs.isspace():
            for a in _ATTR.finditer(raw_attrs):
                key = a[1].lower()
                if key in _KEPT_ATTRS and key not in attrs:
                    value = a[2] or a[3] or a[4] or ""
                    attrs[key] = unescape(value) if "&" in value else value
        cls = attrs.get("class")
        pos = len(els)
        parent = stack[-1]
        els.append([pos, parent, pos, len(texts), len(texts),
                    els[parent][5] or tag in _CHROME, tag,
                    " ".join(cls.split()) if cls is not None else None,
                    attrs.get("id"), attrs.get("href"), attrs.get("name"), attrs.get("content"),
                    _span(attrs.get("colspan")), _span(attrs.get("rowspan"))])
        if tag in _VOID or (raw_attrs and _SELF_CLOSED.search(raw_attrs)):
            continue
        if tag in _HIDDEN:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, end)
            end = stop.end() if stop else len(html)
            continue
        stack.append(pos)
    if end < len(html):
        chunk = html[end:]
        buf.append(unescape(chunk) if "&" in chunk else chunk)
    flush()
    while stack:
        close()
    return els, texts


def lay_out(rows: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int, int]]]:
    """Cells (el, colspan, rowspan) per row -> runs (el, src_row, col, width) per grid row.

    A cell starts at the next free column of its row. It fills what earlier
    cells left free in every row it spans; what exceeds the widest row is cut.
    """
    width = max((sum(c[1] for c in row) for row in rows), default=0)
    reaching: list[tuple[int, int, int, int, int]] = []  # el, src_row, col, end, last_row
    grid = []
    for r, row in enumerate(rows):
        reaching = [c for c in reaching if c[4] >= r]
        taken = sorted((c[2], c[3]) for c in reaching)
        col = 0
        for el, colspan, rowspan in row:
            for lo, hi in taken:
                if lo <= col < hi:
                    col = hi
            if col >= width:
                break
            reaching.append((el, r, col, min(col + colspan, width), r + rowspan - 1))
            col += colspan
        runs: list[tuple[int, int, int, int]] = []
        painted: list[tuple[int, int]] = []   # by cells from rows above, in column order
        for el, src, lo, hi, _ in reaching:
            at = lo
            for a, b in painted:
                if a < hi and b > at:
                    if a > at:
                        runs.append((el, src, at, a - at))
                    at = max(at, b)
            if at < hi:
                runs.append((el, src, at, hi - at))
            if src < r:               # cells of one row never overlap each other
                insort(painted, (lo, hi))
        grid.append(sorted(runs, key=lambda run: run[2]))
    return grid


def page_tables(els: list[list]) -> list[tuple[int, list]]:
    """(table element, grid rows) for every table, nested ones included."""
    tables = [(e[0], e[2]) for e in els if e[6] == "table"]
    if not tables:
        return []
    rows: dict[int, list[tuple[int, int, int]]] = {e[0]: [] for e in els if e[6] == "tr"}
    for e in els:
        if e[6] in ("td", "th") and e[1] in rows:
            rows[e[1]].append((e[0], e[12], e[13]))
    starts, cells = list(rows), list(rows.values())
    return [(pos, lay_out(cells[bisect_right(starts, pos):bisect_right(starts, last)]))
            for pos, last in tables]


def _list_array(per_page: list[list], element: pa.DataType) -> pa.Array:
    """Per-page lists of field lists -> Arrow list<struct>, built column-wise."""
    offsets, flat = [0], []
    for items in per_page:
        flat.extend(items)
        offsets.append(len(flat))
    columns = zip(*flat) if flat else [()] * element.num_fields
    structs = pa.StructArray.from_arrays(
        [pa.array(list(c), type=element.field(i).type) for i, c in enumerate(columns)],
        fields=list(element))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)


def _parts(batch: pa.RecordBatch, html: str) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of a batch, each time at most PART_ROWS with PART_BYTES of markup, or one page."""
    lengths = pc.fill_null(pc.binary_length(batch.column(html)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start == PART_ROWS or size + n > PART_BYTES):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def html_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the markup column by ``els``, ``texts`` and ``tables``.

    However many rows a batch of the session holds, a worker keeps the elements of one part of it.
    """
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType(kept + BLOCK_FIELDS)
    kept_names = [f.name for f in kept]

    def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i32 = pa.int32()
        el_type = pa.struct([(f.name, {T.IntegerType: i32, T.BooleanType: pa.bool_(),
                                       T.StringType: pa.string()}[type(f.dataType)])
                             for f in ELEMENT.fields])
        text_type = pa.struct([("s", pa.string()), ("gap", pa.bool_()), ("chrome", pa.bool_()),
                               ("apart", pa.bool_())])
        run_type = pa.struct([(f.name, i32) for f in RUN.fields])
        table_type = pa.list_(pa.struct([("el", i32), ("rows", pa.list_(pa.list_(run_type)))]))
        for batch in (part for b in batches for part in _parts(b, html)):
            parsed = [parse_page(h) if h else ([], []) for h in batch.column(html).to_pylist()]
            tables = [[{"el": el, "rows": [[dict(zip(("el", "src_row", "col", "width"), run))
                                            for run in row] for row in rows]}
                       for el, rows in page_tables(els)] for els, _ in parsed]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept_names] + [
                    _list_array([p[0] for p in parsed], el_type),
                    _list_array([p[1] for p in parsed], text_type),
                    pa.array(tables, type=table_type)],
                names=kept_names + ["els", "texts", "tables"])

    readable = pages.select(*kept_names, F.make_valid_utf8(html).alias(html))
    return readable.mapInArrow(parse_batches, schema)
