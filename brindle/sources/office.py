"""Word and Excel packages as blocks, with the standard library's ZIP and XML readers inside map tasks.

A file is a row of files(); a task opens one package at a time. Packages beyond the limits, or that don't open, give one row with
a reason and no blocks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

#: Limits of a package: members, unpacked bytes.
MEMBERS, UNPACKED = 10_000, 512 << 20

# The namespaces of both formats.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

SCHEMA = "path string, block_index int, block_type string, section string, text string, reason string"


def _opened(content: bytes) -> zipfile.ZipFile:
    package = zipfile.ZipFile(io.BytesIO(content))
    infos = package.infolist()
    if len(infos) > MEMBERS or sum(i.file_size for i in infos) > UNPACKED:
        raise ValueError("package too large")
    return package


def _tree(package: zipfile.ZipFile, name: str) -> ElementTree.Element:
    data = package.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("declarations in a part")
    return ElementTree.fromstring(data)


def docx_blocks(content: bytes) -> list[tuple[str, str, str]]:
    """block_type, section and text of paragraphs and tables in reading order. Headings (style or outline level) are titles; the titles
    above, joined by " / ", are the section. A table is tab-separated text; of cells merged downwards the first counts."""
    package = _opened(content)
    levels: dict[str, int] = {}
    if "word/styles.xml" in package.namelist():
        for style in _tree(package, "word/styles.xml").iter(f"{_W}style"):
            outline = style.find(f"{_W}pPr/{_W}outlineLvl")
            if outline is not None:
                levels[style.get(f"{_W}styleId")] = int(outline.get(f"{_W}val")) + 1
    words = lambda node: "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in node.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    path: dict[int, str] = {}
    out = []
    for node in _tree(package, "word/document.xml").find(f"{_W}body"):
        section = " / ".join(path[k] for k in sorted(path))
        if node.tag == f"{_W}p":
            text = words(node).strip()
            if not text:
                continue
            style, outline = node.find(f"{_W}pPr/{_W}pStyle"), node.find(f"{_W}pPr/{_W}outlineLvl")
            level = int(outline.get(f"{_W}val")) + 1 if outline is not None else levels.get(style.get(f"{_W}val"), 0) if style is not None else 0
            if 1 <= level <= 9:
                path = {k: v for k, v in path.items() if k < level} | {level: text}
                out.append(("title", " / ".join(path[k] for k in sorted(path)), text))
            else:
                out.append(("text", section, text))
        elif node.tag == f"{_W}tbl":
            rows = []
            for row in node.findall(f"{_W}tr"):
                cells = []
                for cell in row.findall(f"{_W}tc"):
                    merged = cell.find(f"{_W}tcPr/{_W}vMerge")
                    cells.append("" if merged is not None and merged.get(f"{_W}val") != "restart" else " ".join(words(cell).split()))
                rows.append("\t".join(cells))
            out.append(("table", section, "\n".join(rows)))
    return out


def xlsx_blocks(content: bytes) -> list[tuple[str, str, str]]:
    """A table block for each sheet that has cells, its name as section. Formulas stay text; empty cells at the ends are dropped."""
    package = _opened(content)
    shared = []
    if "xl/sharedStrings.xml" in package.namelist():
        shared = ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in _tree(package, "xl/sharedStrings.xml").findall(f"{_S}si")]
    targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in _tree(package, "xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in _tree(package, "xl/workbook.xml").iter(f"{_S}sheet"):
        rows: list[list[str]] = []
        for row in _tree(package, f"xl/{targets[sheet.get(f'{_R}id')]}").iter(f"{_S}row"):
            cells: list[str] = []
            for cell in row.findall(f"{_S}c"):
                at = 0
                for c in re.match("[A-Z]+", cell.get("r") or "A").group():
                    at = at * 26 + ord(c) - 64
                cells += [""] * (max(at, len(cells) + 1) - 1 - len(cells))
                formula, value = cell.find(f"{_S}f"), cell.find(f"{_S}v")
                raw = value.text or "" if value is not None else "".join(t.text or "" for t in cell.iter(f"{_S}t"))
                cells.append(f"={formula.text}" if formula is not None and formula.text else shared[int(raw)] if cell.get("t") == "s" else raw)
            while cells and not cells[-1]:
                cells.pop()
            rows.append([" ".join(c.split()) for c in cells])
        while rows and not rows[-1]:
            rows.pop()
        if any(rows):
            out.append(("table", sheet.get("name"), "\n".join("\t".join(r) for r in rows)))
    return out


_READERS = {"docx": docx_blocks, "xlsx": xlsx_blocks}


def office(found: DataFrame) -> DataFrame:
    """Blocks of the docx and xlsx rows of found(path, kind, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, kind, content in zip(part["path"], part["kind"], part["content"]):
                try:
                    rows = [(path, i, *b, None) for i, b in enumerate(_READERS[kind](bytes(content)), 1)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, AttributeError) as e:
                    rows = [(path, 0, None, None, None, f"{type(e).__name__}: {e}"[:200])]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return found.where(found["kind"].isin(*_READERS)).select("path", "kind", "content").mapInPandas(run, SCHEMA)
