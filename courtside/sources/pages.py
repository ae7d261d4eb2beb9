"""Row extraction from stored web pages (one page per row, whole html text).

List items and comments are a regex over the page column plus ``posexplode``.
Tables are read in one pass over a page's tags, page by page inside the tasks: the
tables around a tag are a stack, and cells are laid on a grid by their column and
row spans. That pass is Python over Arrow batches, linear in the page; the rest is
built-in expressions.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get the reader itself: no machine has to have this package

# (?is): any case, and a dot crosses line ends, as hidden tables do
LIST_ITEM = r"(?is)<li(?:\s[^>]*)?>(.*?)</li>"
COMMENT = r"(?is)<!--(.*?)-->"
TAG = r"(?s)<[^>]*>"


def extract_list_items(pages: DataFrame, pattern: str = LIST_ITEM, group: int = 1,
                       exclude: str | None = "G-League", date_format: str | None = None,
                       since=None) -> DataFrame:
    """(P05) one row per list item: (page_id, pos, item), the item's text with
    its tags taken off (linked or not, with attributes or not). Items matching
    ``exclude`` are dropped; with ``date_format``, the item text is parsed as a
    date ('MMMM d, yyyy') into ``item_date`` and kept on/after ``since``."""
    items = (pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), group)))
             .select("page_id", F.col("pos").cast("long").alias("pos"),
                     F.trim(F.regexp_replace("col", TAG, "")).alias("item")))
    if exclude:
        items = items.where(~F.col("item").rlike(exclude))
    if date_format:
        items = items.withColumn("item_date", F.try_to_date("item", date_format))
        if since is not None:
            items = items.where(F.col("item_date") >= F.lit(since).cast("date"))
    return items


def comment_blocks(pages: DataFrame) -> DataFrame:
    """(P06) bodies of html comments (where the source hides its tables)."""
    return (pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(COMMENT), 1)))
            .select("page_id", F.col("pos").cast("long").alias("pos"), F.col("col").alias("body")))


def table_cells(pages: DataFrame, ncol: int, cell: str = r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]>") -> DataFrame:
    """(P05) cells of html tables unwound into rows by column count:
    (page_id, row, col, text) with row = pos div ncol, col = pos mod ncol."""
    cells = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(cell), 1)))
    return cells.select("page_id", (F.col("pos") / ncol).cast("long").alias("row"),
                        (F.col("pos") % ncol).cast("long").alias("col"), F.col("col").alias("text"))


# ---------------------------------------------------------------- tables by their tags

# a comment, a tag, a text, or a '<' that begins none of these
TOKEN = r"(?s)<!--.*?-->|<[/a-zA-Z!?][^>]*>|[^<]+|<"
TABLE_TAGS = ("table", "/table", "tr", "/tr", "td", "/td", "th", "/th")
MAX_SPAN = 1000  # browsers read larger column spans as this; a row span is as long as it says
# The character references of html that texts commonly hold.
REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


_TOKEN, _TAG, _SPACE = re.compile(TOKEN), re.compile(r"</?[a-zA-Z]+"), re.compile(r"\s+", re.ASCII)
_SPANS = {name: re.compile(rf"(?i)\s{name}\s*=\s*[\"']?\s*(\d+)", re.ASCII) for name in ("colspan", "rowspan")}
LINES = "array<array<struct<row:bigint,col:bigint,text:string,head:boolean>>>"
BATCH_CELLS = 50_000  # cells after which a task hands on the tables it has read


def plain_text(text: str) -> str:
    """Character references read, runs of white space to one space, ends trimmed."""
    if "&" in text:
        for name, c in REFERENCES.items():  # '&amp;' last, or '&amp;lt;' would become '<'
            text = text.replace(name, c)
    return _SPACE.sub(" ", text).strip(" ")


def _span(token: str, name: str) -> int:
    found = _SPANS[name].search(token)
    n = int(found[1].lstrip("0")[:11] or 0) if found else 1
    return max(n, 1) if n < 1 << 31 else 1


def tables_of(html: str) -> dict[int, list]:
    """A page's tables in one pass over its tags: place of the table's tag ->
    rows from the top as (row, cells), a cell being [wide, high, head, texts]."""
    tables, open_, rest = {}, [], None  # open_: the tables around, each [place, row, cell, rows]
    for place, found in enumerate(_TOKEN.finditer(html)):
        token = found[0]
        if token[0] != "<" or token == "<":  # a '<' that begins no tag is text
            if rest is not None:
                rest.append(token)
            continue
        tag = _TAG.match(token)
        tag = tag[0][1:].lower() if tag else ""
        if tag not in TABLE_TAGS:  # comments too
            continue
        if tag == "table":
            open_.append([place, 0, None, []])
        elif not open_:
            continue
        elif tag == "/table":  # an end tag that closes none counts for nothing
            done = open_.pop()
            if done[3]:
                tables[done[0]] = done[3]
        elif tag in ("td", "th"):
            top = open_[-1]
            top[2] = [min(_span(token, "colspan"), MAX_SPAN), _span(token, "rowspan"), tag == "th", []]
            if not top[3] or top[3][-1][0] != top[1]:
                top[3].append((top[1], []))
            top[3][-1][1].append(top[2])
        else:
            open_[-1][2] = None
            open_[-1][1] += tag == "tr"
        rest = open_[-1][2][3] if open_ and open_[-1][2] else None
    tables.update((t[0], t[3]) for t in open_ if t[3])
    return tables


def laid(rows: list) -> list:
    """Rows of cells on their grid, each a list of (rows left, text, head) or
    None: the cells of a row take, from the left, the columns that no cell from
    above still stands in."""
    held, out = [], []
    for row, cells in rows:
        units = [unit for wide, high, head, texts in cells for unit in [(high, plain_text("".join(texts)), head)] * wide]
        line, used = [], 0
        while used < len(units) or len(line) < len(held):
            above = held[len(line)] if len(line) < len(held) else None
            if above:
                line.append(above)
            elif used < len(units):
                line.append(units[used])
                used += 1
            else:
                line.append(None)
        while line[-1] is None:
            line.pop()
        out.append((row - 1, line))
        held = [(x[0] - 1, x[1], x[2]) if x and x[0] > 1 else None for x in line]
    return out


def page_grids(pages: DataFrame, ids: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """(O04, P05) every table of every page: (ids..., table, lines), ``table`` the
    place of its tag in the page and ``lines`` its rows from the top, each an
    array of <row, col, text, head>.

    A nested table is a table of its own, and its text is not its outer cell's.
    End tags may be missing. A cell that spans columns or rows stands in each of
    them. Text outside of cells is dropped, as are rows without a cell. Pages that
    repeat an id are read one by one. A page without a table (or null) has no row."""
    pages = pages.select(*ids, F.col(html).cast("binary").alias("__html")).where(F.col("__html").isNotNull())
    schema = StructType(pages.schema.fields[:-1]).add("table", "long").add("lines", StructType.fromDDL(f"x {LINES}")[0].dataType)
    target = to_arrow_schema(schema)

    def grids(batch, found):
        """A batch of the tables ``found``: (row of the page in ``batch``, place, rows on the grid)."""
        at, row, text, head, col, line_ends, table_ends = [], [], [], [], [], [0], [0]
        for page, _, lines in found:
            at.append(page)
            for n, line in lines:
                row += [n] * len(line)
                col += range(len(line))
                text += [x and x[1] for x in line]
                head += [x and x[2] for x in line]
                line_ends.append(len(row))
            table_ends.append(len(line_ends) - 1)
        kind = target.field("lines").type
        cells = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((row, col, text, head), kind.value_type.value_type)],
                                           fields=list(kind.value_type.value_type))
        lines = pa.ListArray.from_arrays(pa.array(line_ends, pa.int32()), cells, type=kind.value_type)
        made = [pa.array([t for _, t, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(table_ends, pa.int32()), lines, type=kind)]
        return pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at, pa.int64())) for c in range(len(target) - 2)] + made, schema=target)

    def read(batches):
        for batch in batches:
            found, size = [], 0
            for page, data in enumerate(batch.column(len(target) - 2)):
                for place, rows in tables_of(data.as_py().decode("utf-8", "replace")).items():
                    found.append((page, place, laid(rows)))
                    size += sum(len(line) for _, line in found[-1][2])
                if size >= BATCH_CELLS:
                    yield grids(batch, found)
                    found, size = [], 0
            if found:
                yield grids(batch, found)

    return pages.mapInArrow(read, schema)


def page_table_cells(pages: DataFrame, ids: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """(O04) the grids' cells as rows: (ids..., table, row, col, text, head)."""
    grids = page_grids(pages, ids, html)
    cells = grids.select(*ids, "table", F.explode(F.flatten("lines")).alias("c"))
    return cells.where("c.text is not null").select(*ids, "table", "c.*")


def page_table_records(pages: DataFrame, columns: dict[str, str], ids: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """(P05, P06) rows of the tables whose heading has all of ``columns`` (output
    name -> heading): (ids..., table, row, output columns...).

    The heading is the last of the rows of heading cells at a table's top; rows
    of heading cells alone that come later repeat it and are dropped. Of
    headings that occur twice the first counts. Where a row's line is shorter
    than the heading, the rest is null."""
    def heading(line):
        return F.forall(line, lambda x: F.coalesce(x["head"], F.lit(True)))

    g = page_grids(pages, ids, html).withColumn("first", F.array_position(F.transform("lines", heading), F.lit(False)).cast("int"))
    g = g.where("first > 1").withColumn("names", F.transform(F.get("lines", F.col("first") - 2), lambda x: x["text"]))
    g = g.where(" and ".join(["true"] + [f"array_contains(names, {_quoted(h)})" for h in columns.values()]))
    rows = g.select(*ids, "table", "names", F.explode(F.filter("lines", lambda line: ~heading(line))).alias("line"))
    found = [F.get("line", F.array_position("names", F.lit(h)).cast("int") - 1)["text"].alias(name) for name, h in columns.items()]
    return rows.select(*ids, "table", F.col("line")[0]["row"].alias("row"), *found)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
