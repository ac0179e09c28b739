"""Groups of table rows that must stay together: HTML rows that share a cell by rowspan, and rows of a rectangular text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "group int, first_row int, last_row int, begin int, end int"


class _Rows(HTMLParser):
    """Begin, end and longest rowspan of each row of the outermost table."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.lines = [0]
        for line in text.splitlines(keepends=True):
            self.lines.append(self.lines[-1] + len(line))
        self.depth, self.rows, self.cells = 0, [], []
        self.feed(text)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.rows.append([self._at(), None, 1])
            self.cells.append([])
        elif self.depth == 1 and tag in ("td", "th") and self.rows:
            wide, span = ((int(v) if (v := dict(attrs).get(name) or "1").isdigit() and int(v) else 1) for name in ("colspan", "rowspan"))
            self.rows[-1][2] = max(self.rows[-1][2], span)
            self.cells[-1].append((wide, span))

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth -= 1
        elif self.depth == 1 and tag == "tr" and self.rows and self.rows[-1][1] is None:
            self.rows[-1][1] = self._at() + len("</tr>")


def whole_grid(cells: list[list[tuple[int, int]]]) -> bool:
    """Whether rows of cells (columns, rows that they cover) fill a rectangle: each row as wide as the first, and no cell beyond the last."""
    reach: dict[int, int] = {}  # columns covered from above, and for how many more rows
    width = None
    for row in cells:
        at, new = 0, {}
        for wide, span in row:
            while reach.get(at, 0):
                at += 1
            for c in range(at, at + wide):
                if reach.get(c, 0):
                    return False
                new[c] = span
            at += wide
        covered = {c for c, n in reach.items() if n} | set(new)
        if covered != set(range(len(covered))) or len(covered) != (width if width is not None else len(covered)):
            return False
        width = len(covered)
        reach = {c: n - 1 for c, n in {**{c: n for c, n in reach.items() if n}, **new}.items()}
    return not any(reach.values())


def table_groups(text: str) -> list[tuple[int, int, int, int, int]]:
    """html_groups() or text_groups(), as the text is."""
    return html_groups(text) if "<table" in text.lower() else text_groups(text)


def html_groups(text: str) -> list[tuple[int, int, int, int, int]]:
    """group, first and last row (from 1), and their characters: rows tied by cells that reach over them, transitively. A table with a
    row that isn't closed, or whose cells don't fill a rectangle, is one group."""
    found = _Rows(text)
    rows = found.rows
    if not rows:
        return []
    if any(end is None for _, end, _ in rows) or not whole_grid(found.cells):
        return [(1, 1, len(rows), 0, len(text))]
    out, first, reach = [], 0, 0
    for i, (_, _, span) in enumerate(rows):
        reach = max(reach, i + span - 1)
        if reach == i:
            out.append((len(out) + 1, first + 1, i + 1, rows[first][0], rows[i][1]))
            first, reach = i + 1, i + 1
    return out


def text_groups(text: str) -> list[tuple[int, int, int, int, int]]:
    """The same for tab-separated text: a group for each row where all rows have as many cells, two at least; else one group. Quoted
    cells may hold line ends."""
    ends, cells, quoted = [], [1], False
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif c == "\t" and not quoted:
            cells[-1] += 1
        elif c == "\n" and not quoted:
            ends.append(i + 1)
            cells.append(1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    else:
        cells.pop()
    if not text:
        return []
    if quoted or len(set(cells)) > 1 or cells[0] < 2:
        return [(1, 1, len(ends), 0, len(text))]
    return [(i + 1, i + 1, i + 1, b, e) for i, (b, e) in enumerate(zip([0, *ends], ends))]


def row_groups(tables: DataFrame) -> DataFrame:
    """The groups of each row of tables(table_id, text), with where they stand in the text. Null texts have none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for table_id, text in zip(part["table_id"], part["text"]):
                out += [(table_id, *g) for g in table_groups(text)]
            yield pd.DataFrame(out, columns=["table_id", "group", "first_row", "last_row", "begin", "end"])

    kind = tables.schema["table_id"].dataType.simpleString()
    return tables.select("table_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"table_id {kind}, {SCHEMA}")
