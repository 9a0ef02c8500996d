"""Roster tables in stored web pages: a streaming table reader and the rules of a roster row.

A reader follows the tags of a page once. Tables, rows and cells are a stack, so tables may be nested (a row or text
belongs to every table, row and cell that is open around it) and end tags may be missing, as browsers allow: a row ends
the one before it in its table, a cell the one before it in its row. Text of scripts, styles and comments is left out.
Pages are read where they are stored, one at a time; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The headers that make a table a roster, and how many of a table's first header cells may hold them.
HEADERS = ("no.", "pos.", "nation", "player")
HEADER_CELLS = 8
MIN_CELLS = 4
TARGET = "GK"
FIELDS = "table_no int, row_no int, jersey_number string, position_code string, nationality string, player_name string, is_target boolean, error string"
CELL, ROW, TABLE = ("td", "th"), ("tr",), ("table",)
SILENT = ("script", "style", "template")


class _Node:
    __slots__ = ("cells", "heads", "kind", "rows", "texts", "wanted")

    def __init__(self, kind: str):
        self.kind, self.texts, self.cells, self.rows, self.heads, self.wanted = kind, [], [], [], [], False


class TableReader(HTMLParser):
    """`tables` after feeding a page: those of class `css`, each a node with its rows of cells and header cells in page order."""

    def __init__(self, css: str | None):
        super().__init__(convert_charrefs=True)
        self.css, self.open, self.tables, self.silent = css, [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag in TABLE:
            node = _Node("table")
            node.wanted = self.css is None or self.css in (dict(attrs).get("class") or "").split()
            self.open.append(node)
            if node.wanted:
                self.tables.append(node)
        elif tag in ROW and self._unwind(ROW):
            node = _Node("tr")
            for t in self._around("table"):
                t.rows.append(node)
            self.open.append(node)
        elif tag in CELL and self._unwind(CELL):
            node = _Node("td")
            for r in self._around("tr"):
                r.cells.append(node)
            if tag == "th":
                for t in self._around("table"):
                    t.heads.append(node)
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in TABLE + ROW + CELL:
            kind = "td" if tag in CELL else tag
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].kind == kind:
                    del self.open[i:]
                    return
                if self.open[i].kind == "table":
                    return

    def handle_data(self, data):
        text = data.strip()
        if text and not self.silent:
            for c in self._around("td"):
                c.texts.append(text)

    def _around(self, kind: str) -> list[_Node]:
        return [n for n in self.open if n.kind == kind]

    def _unwind(self, tags: tuple[str, ...]) -> bool:
        """Ends what a new row or cell ends in the innermost table; false outside of tables."""
        while self.open and self.open[-1].kind != "table" and (tags == ROW or self.open[-1].kind == "td"):
            self.open.pop()
        return bool(self.open)


def _text(cell: _Node) -> str:
    return " ".join(cell.texts)


def roster_rows(html: str, css: str | None = "wikitable") -> list[tuple]:
    """Rows of FIELDS; one with an error if no table has the headers."""
    reader = TableReader(css)
    reader.feed(html)
    reader.close()
    out, found = [], 0
    for table in reader.tables:
        if not set(HEADERS) <= {_text(c).lower() for c in table.heads[:HEADER_CELLS]}:
            continue
        found += 1
        for number, row in enumerate(table.rows):
            values = [_text(c) for c in row.cells]
            if len(values) < MIN_CELLS or values[0].lower() in ("no.", "no") and values[1].lower().startswith("pos"):
                continue
            jersey, position, nation, player = values[:MIN_CELLS]
            if player and player.lower() != "player":
                code = position.upper() or None
                out.append((found - 1, number, jersey or None, code, nation.split()[-1] if nation else None, player, code == TARGET, None))
    return out if found else [(None,) * 7 + (f"no table with headers {', '.join(HEADERS)}",)]


def read_rosters(pages: DataFrame, css: str | None = "wikitable") -> DataFrame:
    """`pages` (page_id, html) to a row for each roster row, or one with `error` for a page without a roster; a null page has none."""
    schema = T.StructType([pages.schema["page_id"], *T.DataType.fromDDL(f"struct<{FIELDS.replace(' ', ': ').replace(',:', ',')}>").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), *[pa.string()] * 4, pa.bool_(), pa.string()]
        for batch in batches:
            for i in range(batch.num_rows):  # a page at a time: one may hold a large table
                rows = roster_rows(batch.column("html")[i].as_py() or "", css)
                if rows:
                    ids = pa.concat_arrays([batch.column("page_id").slice(i, 1)] * len(rows))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=schema.names)

    return pages.select("page_id", F.col("html").cast("string").alias("html")).mapInArrow(read, schema)
