"""Workbooks as zipped XML: reading cells as text, writing plain sheets."""

from __future__ import annotations

import io
import json
import re
import shutil
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Number formats that show dates: the built-in ones, and codes with date letters outside quotes and brackets.
DATE_IDS = frozenset([*range(14, 23), 27, 30, 36, 45, 46, 47, 50, 57])


@dataclass
class Sheet:
    name: str
    cells: dict[int, dict[int, str]] = field(default_factory=dict)  # row -> column -> text, from 1
    widths: dict[int, float] = field(default_factory=dict)
    hidden: list[int] = field(default_factory=list)
    heights: dict[int, float] = field(default_factory=dict)
    freeze: tuple[int, int] | None = None  # rows, columns
    merges: list[str] = field(default_factory=list)
    styles: dict[int, dict[int, int]] = field(default_factory=dict)  # row -> column -> index


def head_error(data: bytes, name: str) -> str | None:
    """Why bytes are no zip container (S11), None if they may be one."""
    if not data:
        return f"{name}: the file is empty"
    if len(data) < 4:
        return f"{name}: the file is cut short ({len(data)} bytes)"
    return None if data[:2] == b"PK" else f"{name}: not an Office Open XML file"


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def parse_area(text: str) -> dict | None:
    """``Sheet!$A$2:$XFC$2025`` as numbers."""
    m = re.fullmatch(r"(?:'?((?:[^']|'')*?)'?!)?\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?", text.strip())
    if not m:
        return None
    c, r = sorted((column_number(m[2]), column_number(m[4] or m[2]))), sorted((int(m[3]), int(m[5] or m[3])))
    return {"sheet": m[1], "first_col": c[0], "last_col": c[1], "first_row": r[0], "last_row": r[1], "cols": c[1] - c[0] + 1, "rows": r[1] - r[0] + 1}


def narrowed(area: str, dimension: str) -> str:
    """A named area cut to the sheet's used range, its start kept."""
    a, d = parse_area(area), parse_area(dimension)
    if not a or not d:
        return area
    last_col, last_row = max(a["first_col"], min(a["last_col"], d["last_col"])), max(a["first_row"], min(a["last_row"], d["last_row"]))
    sheet = area.rpartition("!")[0]
    return (sheet + "!" if sheet else "") + f"${column_letters(a['first_col'])}${a['first_row']}:${column_letters(last_col)}${last_row}"


def number_text(raw: str | float) -> str:
    """Whole numbers without a fraction; beyond 17 characters, 15 significant digits."""
    x = float(raw)
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    text = repr(x)
    return text if len(text) <= 17 else f"{x:.15g}"


def date_text(serial: float, base_1904: bool = False) -> str:
    """A serial day number as a date; the time only where there is one, seconds only if any."""
    start = datetime(1904, 1, 1) if base_1904 else datetime(1899, 12, 30)
    at = start + timedelta(seconds=round(serial * 86400))
    if at.hour == at.minute == at.second == 0:
        return at.strftime("%Y-%m-%d")
    return at.strftime("%Y-%m-%d %H:%M:%S" if at.second else "%Y-%m-%d %H:%M")


def _is_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    return bool(re.search(r"[ymdhs]", bare, re.I)) and bare.lower() != "general"


def _string(node) -> str:
    return "".join(t.text or "" for t in node.iter(M + "t"))


class Workbook:
    """Names of the sheets, and each sheet when asked for."""

    def __init__(self, data: bytes | BinaryIO, name: str = "workbook") -> None:
        """Of bytes, or of an open file that can be sought in, of which only the parts asked for are read."""
        if isinstance(data, bytes):
            if error := head_error(data, name):
                raise ValueError(error)
            data = io.BytesIO(data)
        self.zip = zipfile.ZipFile(data)
        names = set(self.zip.namelist())
        book = self.book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.paths = {s.get("name"): "xl/" + rels[s.get(R + "id")].removeprefix("/xl/").removeprefix("xl/") for s in book.iter(M + "sheet")}
        self.sheet_names = list(self.paths)
        props = book.find(M + "workbookPr")
        self.base_1904 = props is not None and props.get("date1904") in ("1", "true")
        self.strings = [_string(si) for si in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        self.dates: list[bool] = []
        self.style_sheet = None
        if "xl/styles.xml" in names:
            styles = self.style_sheet = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
            codes = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(M + "numFmt")}
            formats = styles.find(M + "cellXfs")
            ids = [int(x.get("numFmtId") or 0) for x in formats] if formats is not None else []
            self.dates = [i in DATE_IDS or _is_date(codes.get(i, "")) for i in ids]

    def cell_text(self, c) -> str:
        """Cell content as text (F10): runs joined, formulas by their result, else as written."""
        kind, v, f = c.get("t") or "n", c.find(M + "v"), c.find(M + "f")
        if kind == "inlineStr":
            return _string(c)
        if v is None or v.text is None:
            return f"={f.text}" if f is not None and f.text else ""
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return "TRUE" if v.text == "1" else "FALSE"
        if kind in ("str", "e", "d"):
            return v.text
        style = int(c.get("s") or 0)
        return date_text(float(v.text), self.base_1904) if style < len(self.dates) and self.dates[style] else number_text(v.text)

    def rows(self, name: str, max_rows: int | None = None, columns: set[int] | None = None, meta: Sheet | None = None) -> Iterator[tuple[int, dict[int, str]]]:
        """Rows (number, column -> text) as the sheet is read, none of which is kept.

        Stops behind ``max_rows`` rows; cells of other ``columns`` are not
        turned into text. ``meta`` collects what the sheet says besides cells.
        """
        row_no = seen = 0
        data = None
        for event, node in ElementTree.iterparse(self.zip.open(self.paths[name]), ("start", "end")):
            if event == "start":
                data = node if node.tag == M + "sheetData" else data
                continue
            if node.tag == M + "row":
                row_no = int(node.get("r") or row_no + 1)
                if max_rows is not None and seen >= max_rows:
                    return
                seen += 1
                if meta is not None and node.get("ht"):
                    meta.heights[row_no] = float(node.get("ht"))
                col, cells = 0, {}
                for c in node.iter(M + "c"):
                    ref = re.match(r"[A-Z]+", c.get("r") or "")
                    col = column_number(ref[0]) if ref else col + 1
                    if columns is None or col in columns:
                        cells[col] = self.cell_text(c)
                        if meta is not None and c.get("s"):
                            meta.styles.setdefault(row_no, {})[col] = int(c.get("s"))
                yield row_no, cells
                data.clear()
            elif meta is None:
                continue
            elif node.tag == M + "col":
                for n in range(int(node.get("min")), min(int(node.get("max")), int(node.get("min")) + 16383) + 1):
                    meta.widths[n] = float(node.get("width") or 9)
                    if node.get("hidden") in ("1", "true"):
                        meta.hidden.append(n)
            elif node.tag == M + "pane" and node.get("state") in ("frozen", "frozenSplit"):
                meta.freeze = (int(float(node.get("ySplit") or 0)), int(float(node.get("xSplit") or 0)))
            elif node.tag == M + "mergeCell":
                meta.merges.append(node.get("ref"))

    def used(self, name: str) -> str:
        """The range from A1 to the last row and column with text, as ``A1:C9``; A1 for an empty sheet."""
        last_row = last_col = 1
        for r, row in self.rows(name):
            filled = [c for c, v in row.items() if v.strip()]
            if filled:
                last_row, last_col = r, max(last_col, *filled)
        return f"A1:{column_letters(last_col)}{last_row}"

    def areas(self) -> Iterator[tuple[str, str, str]]:
        """(name, area, area cut to what its sheet uses) of the workbook's names for areas of one sheet."""
        known: dict[str, str] = {}
        for node in self.book.iter(M + "definedName"):
            area = (node.text or "").strip()
            told = parse_area(area)
            sheet = told["sheet"].replace("''", "'") if told and told["sheet"] else None
            if sheet in self.paths:
                if sheet not in known:
                    known[sheet] = self.used(sheet)
                yield node.get("name"), area, narrowed(area, known[sheet])

    def alone(self, name: str) -> bytes:
        """A workbook of one sheet and what it needs, as this one names it."""
        out = io.BytesIO()
        book = ElementTree.fromstring(ElementTree.tostring(self.book))
        sheets = book.find(M + "sheets")
        for s in list(sheets):
            if s.get("name") != name:
                sheets.remove(s)
        shared = {"xl/sharedStrings.xml", "xl/styles.xml", "xl/_rels/workbook.xml.rels"} & set(self.zip.namelist())
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            z.writestr("xl/workbook.xml", ElementTree.tostring(book))
            for part in [*sorted(shared), self.paths[name]]:
                with self.zip.open(part) as source, z.open(part, "w", force_zip64=True) as target:
                    shutil.copyfileobj(source, target, 1 << 20)
        return out.getvalue()

    def sheet(self, name: str, max_rows: int | None = None) -> Sheet:
        out = Sheet(name)
        out.cells.update(self.rows(name, max_rows, meta=out))
        return out

    def formats(self, name: str, header_rows: int = 1) -> Formats:
        """What a report takes over of a sheet (R7): widths, hidden columns, heights and styles of the header rows, panes."""
        meta = Sheet(name)
        for _ in self.rows(name, columns=None, meta=meta):
            meta.styles = {r: x for r, x in meta.styles.items() if r <= header_rows}
        styles = {c: self.style(i) for r in range(1, header_rows + 1) for c, i in meta.styles.get(r, {}).items()}
        return Formats(dict(meta.widths), sorted(set(meta.hidden)), {r: h for r, h in meta.heights.items() if r <= header_rows}, meta.freeze, {c: x for c, x in styles.items() if x})

    def style(self, index: int) -> dict[str, str]:
        """A cell style by its parts (font, fill, border, alignment as XML; number format as code), free of the workbook's numbering."""
        if self.style_sheet is None:
            return {}
        held = self.style_sheet.find(M + "cellXfs")
        if held is None or not 0 <= index < len(held):
            return {}
        xf, out = held[index], {}
        for part, group in PARTS.items():
            found = self.style_sheet.find(M + group)
            n = int(xf.get(f"{part}Id") or 0)
            if found is not None and n < len(found) and len(found[n]):
                out[part] = plain_xml(found[n])
        code = int(xf.get("numFmtId") or 0)
        if code:
            named = {int(f.get("numFmtId")): f.get("formatCode") for f in self.style_sheet.iter(M + "numFmt")}
            out["number"] = named.get(code, f"#{code}")
        aligned = xf.find(M + "alignment")
        return out | ({"alignment": plain_xml(aligned)} if aligned is not None else {})


PARTS = {"font": "fonts", "fill": "fills", "border": "borders"}


def plain_xml(node) -> str:
    """An element without its name space's prefix, as the writer embeds it."""
    text = ElementTree.tostring(node, encoding="unicode")
    text = re.sub(r'\sxmlns(:\w+)?="[^"]*"', "", text)
    return re.sub(r"(</?)\w+:", r"\1", text).replace(" />", "/>").strip()


@dataclass
class Formats:
    """Formats of a sheet: columns and rows from 1, styles of header cells by column."""

    widths: dict[int, float] = field(default_factory=dict)
    hidden: list[int] = field(default_factory=list)
    heights: dict[int, float] = field(default_factory=dict)
    freeze: tuple[int, int] | None = None
    styles: dict[int, dict[str, str]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps([list(self.widths.items()), self.hidden, list(self.heights.items()), self.freeze, list(self.styles.items())])

    @classmethod
    def from_json(cls, text: str) -> Formats:
        widths, hidden, heights, freeze, styles = json.loads(text)
        return cls(dict(widths), hidden, dict(heights), tuple(freeze) if freeze else None, dict(styles))

    def mapped(self, columns: list[int | None]) -> Formats:
        """For a table whose column k (from 1) shows the source's column ``columns[k - 1]`` (None: its own)."""
        pick = lambda held: {k: held[c] for k, c in enumerate(columns, 1) if c in held}
        return Formats(pick(self.widths), [k for k, c in enumerate(columns, 1) if c in self.hidden], dict(self.heights), self.freeze, pick(self.styles))


class StyleTable:
    """The styles of a new workbook: parts from any source, equal ones merged, numbered as they come."""

    BOLD = {"font": "<font><b/></font>"}

    def __init__(self) -> None:
        self.parts = {"font": ["<font/>"], "fill": ["<fill/>"], "border": ["<border/>"]}
        self.codes: dict[str, int] = {}
        self.formats: list[str] = ["<xf/>"]

    def _part(self, kind: str, xml: str | None) -> int:
        if not xml:
            return 0
        held = self.parts[kind]
        if xml not in held:
            held.append(xml)
        return held.index(xml)

    def number(self, style: dict[str, str]) -> int:
        """The index of a style in the new workbook."""
        ids = {k: self._part(k, style.get(k)) for k in PARTS}
        code = style.get("number")
        if code and code.startswith("#"):
            ids["numFmt"] = int(code[1:])
        elif code:
            ids["numFmt"] = self.codes.setdefault(code, 164 + len(self.codes))
        said = "".join(f' {k}Id="{n}" apply{k[0].upper() + k[1:] if k != "numFmt" else "NumberFormat"}="1"' for k, n in ids.items() if n)
        aligned = style.get("alignment")
        xf = f'<xf{said} applyAlignment="1">{aligned}</xf>' if aligned else f"<xf{said}/>"
        if xf not in self.formats:
            self.formats.append(xf)
        return self.formats.index(xf)

    def xml(self) -> str:
        codes = "".join(f'<numFmt numFmtId="{n}" formatCode="{escape(c, {chr(34): "&quot;"})}"/>' for c, n in self.codes.items())
        groups = "".join(f'<{PARTS[k]} count="{len(x)}">{"".join(x)}</{PARTS[k]}>' for k, x in self.parts.items())
        return f'<styleSheet xmlns="{M.strip("{}")}">{f"<numFmts count={chr(34)}{len(self.codes)}{chr(34)}>{codes}</numFmts>" if codes else ""}{groups}<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(self.formats)}">{"".join(self.formats)}</cellXfs></styleSheet>'


def merged_headers(rows: list[dict[int, str]], width: int) -> list[str]:
    """Header names of several rows (S15): non-empty parts joined, a number where there are none, repeats counted."""
    seen: dict[str, int] = {}
    out = []
    for c in range(1, width + 1):
        parts = [p for p in ((r.get(c) or "").strip() for r in rows) if p]
        name = " / ".join(parts) or f"列{c}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}#{seen[name]}")
    return out


def extract(sheet: Sheet, header_start: int = 1, header_end: int | None = None) -> dict:
    """Rows above, headers, rows with their numbers (S14); blank rows are passed over."""
    header_end = max(header_start, header_end or header_start)
    width = max((c for row in sheet.cells.values() for c, v in row.items() if v.strip()), default=0)
    line = lambda r: [sheet.cells.get(r, {}).get(c, "") for c in range(1, width + 1)]
    body = [r for r in sorted(sheet.cells) if r > header_end and any(v.strip() for v in sheet.cells[r].values())]
    return {
        "above": [line(r) for r in range(1, header_start)],
        "headers": merged_headers([sheet.cells.get(r, {}) for r in range(header_start, header_end + 1)], width),
        "rows": [line(r) for r in body],
        "row_numbers": body,
    }


def guess_header(preview: list[list[str]]) -> int:
    """The most header-like of the first five rows, from 1 (S17): filled, not numeric, distinct."""
    best, best_score = 1, -1.0
    for i, row in enumerate(preview[: min(5, max(1, len(preview) - 1))]):
        filled = [v.strip() for v in row if v and v.strip()]
        if not filled:
            continue
        words = sum(not re.match(r"[+-]?(\d|\.\d)", v) for v in filled)
        score = len(filled) + 2 * words + 10 * len(set(filled)) / len(filled)
        if score > best_score:
            best, best_score = i + 1, score
    return best


def write(sheets: dict[str, tuple[list[str], list[list]]], widths: dict[str, list[float]] | None = None, freeze_header: bool = True, formats: dict[str, Formats] | None = None, areas: dict[str, str] | None = None) -> bytes:
    """A workbook of text sheets {name: (headers, rows)} with bold headers, widths and a frozen first row.

    ``formats`` gives sheets the formats of a source: what they do not say
    keeps the default. Their styles are merged into one table. ``areas``
    are names for areas.
    """
    table = StyleTable()
    bold = table.number(StyleTable.BOLD)
    out = io.BytesIO()
    names = list(sheets)
    main, rel = M.strip("{}"), R.strip("{}")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr(
            "[Content_Types].xml",
            '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{parts}</Types>',
        )
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
        named = "".join(f'<definedName name="{escape(k, {chr(34): "&quot;"})}">{escape(v)}</definedName>' for k, v in (areas or {}).items())
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets>{f"<definedNames>{named}</definedNames>" if named else ""}</workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">{links}<Relationship Id="s" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        for i, name in enumerate(names, 1):
            headers, rows = sheets[name]
            own = (formats or {}).get(name) or Formats()
            wide = dict(enumerate((widths or {}).get(name) or auto_widths(headers, rows), 1)) | {c: w for c, w in own.widths.items() if c <= len(headers)}
            hidden = set(own.hidden)
            cols = "".join(f'<col min="{c}" max="{c}" width="{w:g}" customWidth="1"{" hidden=" + chr(34) + "1" + chr(34) if c in hidden else ""}/>' for c, w in sorted(wide.items()))
            down, right = own.freeze or ((1, 0) if freeze_header else (0, 0))
            split = f' xSplit="{right}"' * bool(right) + f' ySplit="{down}"' * bool(down)
            pane = f'<sheetViews><sheetView workbookViewId="0"><pane{split} topLeftCell="{column_letters(right + 1)}{down + 1}" state="frozen"/></sheetView></sheetViews>' if split else ""
            styled = {c: table.number(x) for c, x in own.styles.items()}
            body = []
            for r, row in enumerate([headers, *rows], 1):
                style = (lambda c: f' s="{styled.get(c, bold)}"') if r == 1 else (lambda c: "")
                cells = "".join(f'<c r="{column_letters(c)}{r}" t="inlineStr"{style(c)}><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for c, v in enumerate(row, 1) if v is not None and v != "")
                high = f' ht="{own.heights[r]:g}" customHeight="1"' if r in own.heights else ""
                body.append(f'<row r="{r}"{high}>{cells}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}">{pane}{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{"".join(body)}</sheetData></worksheet>')
        z.writestr("xl/styles.xml", table.xml())
    return out.getvalue()


def auto_widths(headers: list[str], rows: list[list]) -> list[float]:
    """Column widths by content (G15): wide characters count two, between 8 and 60, plus 2.5."""
    size = lambda v: sum(2 if ord(c) > 0x2E7F else 1 for c in str(v or ""))
    return [max(8, min(60, max(size(v) for v in (h, *(r[c] for r in rows))))) + 2.5 for c, h in enumerate(headers)]
