"""Text of .xlsx and .docx archives, from bytes."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

MAX_COLUMN = 16_384


def _name(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _all(element, name: str):
    return (e for e in element.iter() if _name(e) == name)


def _texts(element) -> str:
    return "".join(e.text or "" for e in _all(element, "t"))


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA1."""
    n = 0
    for c in re.match("[A-Za-z]*", reference)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_text(content: bytes) -> str:
    """Each sheet under its name, rows as tab-joined cells at their columns."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        files = z.namelist()
        shared = [_texts(s) for s in _all(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in files else []
        names = [s.get("name", "") for s in _all(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet")] if "xl/workbook.xml" in files else []
        for i, path in enumerate(sorted(f for f in files if re.fullmatch(r"xl/worksheets/[^/]+\.xml", f))):
            rows = []
            for row in _all(ElementTree.fromstring(z.read(path)), "row"):
                cells: list[str] = []
                for cell in (c for c in row if _name(c) == "c"):
                    at = min(column_number(cell.get("r", "")), MAX_COLUMN) if cell.get("r") else len(cells)
                    value = next((v.text or "" for v in _all(cell, "v")), "")
                    kind = cell.get("t")
                    if kind == "s":
                        value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                    elif kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    elif kind == "inlineStr":
                        value = _texts(cell)
                    cells += [""] * (at - len(cells)) + [value]
                if any(c.strip() for c in cells):
                    rows.append("\t".join(cells))
            if rows:
                out.append("\n".join([f"=== Sheet: {names[i] if i < len(names) else f'Sheet{i + 1}'} ===", *rows]))
    return "\n\n".join(out)


def _paragraph(p) -> str:
    parts = []
    for e in p.iter():
        if _name(e) == "t":
            parts.append(e.text or "")
        elif _name(e) == "tab":
            parts.append("\t")
        elif _name(e) in ("br", "cr"):
            parts.append("\n")
    return "".join(parts).strip()


def docx_text(content: bytes) -> str:
    """Paragraphs, and tables as lines of tab-joined cells, separated by blank lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(_all(ElementTree.fromstring(z.read("word/document.xml")), "body"))
    out = []
    for child in body:
        if _name(child) == "p":
            out.append(_paragraph(child))
        elif _name(child) == "tbl":
            rows = [[" ".join(filter(None, (_paragraph(p) for p in _all(c, "p")))) for c in r if _name(c) == "tc"] for r in _all(child, "tr")]
            out.append("\n".join("\t".join(r) for r in rows))
    return "\n\n".join(x for x in out if x)
