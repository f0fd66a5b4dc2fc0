"""Workbooks (.xlsx, .xlsm): a data source with a partition per sheet, package inspection, and a writer. Standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import date, datetime
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import functions as F

from ..functions.scalar import EPOCH, format_kind
from ..functions.values import ALIASES, CELL, ERRORS
from ..plans.formula import column_letters, column_number, parse, render

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: The built-in number formats that are dates or percentages.
BUILTIN = {9: "0%", 10: "0.00%", 14: "m/d/yyyy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 49: "@"}
SCHEMA = "sheet string, row int, col int, formula string, k tinyint, n double, s string, format string, array string"


class UnreadableWorkbook(ValueError):
    """The file is no workbook that can be read."""


def _open(path: str) -> zipfile.ZipFile:
    if not re.search(r"\.xls[xm]$", path.lower()):
        raise UnreadableWorkbook(f"{path}: only .xlsx and .xlsm can be read")
    try:
        return zipfile.ZipFile(path.removeprefix("file://"))
    except zipfile.BadZipFile as e:
        raise UnreadableWorkbook(f"{path}: damaged or not a workbook") from e


def inspect(path: str) -> dict:
    """Sheets (name, part, state), defined names, epoch, tables, merged ranges, macros, pivots and external links."""
    with _open(path) as z:
        files = set(z.namelist())
        book = ET.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        part = lambda t: t.lstrip("/") if t.startswith("/") else "xl/" + t
        sheets = [{"name": s.get("name"), "part": part(rels[s.get(_R)]), "state": s.get("state", "visible")} for s in book.iter(f"{_M}sheet")]
        props = book.find(f"{_M}workbookPr")
        merged = {}
        for s in sheets:
            merged[s["name"]] = re.findall(r'<mergeCell[^>]*ref="([^"]+)"', z.read(s["part"]).decode("utf-8", "replace"))
        tables = [{"name": t.get("displayName"), "ref": t.get("ref")} for f in sorted(files) if f.startswith("xl/tables/") for t in [ET.fromstring(z.read(f))]]
        pivots = [{"name": p.get("name"), "ref": p.find(f"{_M}location").get("ref")} for f in sorted(files) if re.match(r"xl/pivotTables/pivotTable\d+\.xml", f) for p in [ET.fromstring(z.read(f))]]
        found = {
            "sheets": sheets, "names": {d.get("name"): d.text for d in book.iter(f"{_M}definedName")}, "date1904": props is not None and props.get("date1904") in ("1", "true"),
            "merged": merged, "tables": tables, "pivots": pivots, "macros": "xl/vbaProject.bin" in files, "links": any(f.startswith("xl/externalLinks/") for f in files),
        }
    found["warnings"] = [w for w, on in (("macros are ignored", found["macros"]), ("pivots are read as values", found["pivots"]), ("links to other files aren't followed", found["links"])) if on]
    return found


def _styles(z: zipfile.ZipFile) -> list[str]:
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") for f in root.iter(f"{_M}numFmt")}
    xfs = root.find(f"{_M}cellXfs")
    return [own.get(i) or BUILTIN.get(i, "General") for i in (int(x.get("numFmtId", 0)) for x in (xfs if xfs is not None else ()))]


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_M}si")]


def read_sheet(path: str, name: str, part: str):
    """Rows of ``SCHEMA`` of one sheet, streamed. Shared formulas are written out, array formulas belong to each of their cells."""
    with _open(path) as z:
        styles, strings = _styles(z), _shared(z)
        shared: dict[str, tuple] = {}
        arrays: list[tuple] = []
        with z.open(part) as file:
            for _, e in ET.iterparse(file):
                if e.tag != f"{_M}c":
                    if e.tag == f"{_M}row":
                        e.clear()
                    continue
                letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", e.get("r")).groups()
                row, col, kind = int(digits), column_number(letters), e.get("t", "n")
                f, v = e.find(f"{_M}f"), e.find(f"{_M}v")
                formula, array = None, None
                if f is not None:
                    formula = f.text
                    if f.get("t") == "shared":
                        if f.text:
                            shared[f.get("si")] = (f.text, row, col)
                        else:
                            text, r0, c0 = shared[f.get("si")]
                            formula = render(parse(text, r0, c0), (row, col))
                    if f.get("t") == "array" and f.get("ref"):
                        arrays.append((f.text, *re.fullmatch(r"([A-Z]+)(\d+)(?::([A-Z]+)(\d+))?", f.get("ref")).groups()))
                for text, a, b, c, d in arrays:
                    if column_number(a) <= col <= column_number(c or a) and int(b) <= row <= int(d or b):
                        formula, array = text, f"{a}{b}:{c or a}{d or b}"
                raw = v.text if v is not None else None
                k, n, s = 0, None, None
                if kind == "s" and raw is not None:
                    k, s = 2, strings[int(raw)]
                elif kind == "inlineStr":
                    k, s = 2, "".join(t.text or "" for t in e.iter(f"{_M}t"))
                elif kind == "str" and raw is not None:
                    k, s = 2, raw
                elif kind == "b" and raw is not None:
                    k, n = 3, float(raw)
                elif kind == "e" and raw is not None:
                    k, s = 4, ALIASES.get(raw, raw if raw in ERRORS else "#VALUE!")
                elif kind == "d" and raw is not None:
                    k, n = 1, float((datetime.fromisoformat(raw).date() - EPOCH).days)
                elif raw is not None:
                    k, n = 1, float(raw)
                style = int(e.get("s", 0))
                if k or formula:
                    yield name, row, col, formula, k, n, s, styles[style] if style < len(styles) else "General", array
                e.clear()


class _Sheet(InputPartition):
    def __init__(self, name: str, part: str):
        self.name, self.part = name, part


class _Reader(DataSourceReader):
    def __init__(self, path: str, only: list[str] | None):
        self.path, self.only = path, only

    def partitions(self):
        return [_Sheet(s["name"], s["part"]) for s in inspect(self.path)["sheets"] if self.only is None or s["name"] in self.only]

    def read(self, partition):
        yield from read_sheet(self.path, partition.name, partition.part)


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load(path)``; option ``sheets``: names, separated by bars. The path must be readable on every executor."""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        only = self.options.get("sheets")
        return _Reader(self.options["path"], only.split("|") if only else None)


def read_workbook(spark: SparkSession, path: str, sheets: list[str] | None = None) -> DataFrame:
    """Cells as the engine takes them: sheet, row, col, formula, c (cached value or constant), format, array."""
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook")
    if sheets:
        reader = reader.option("sheets", "|".join(sheets))
    return reader.load(path).select("sheet", "row", "col", "formula", F.struct("k", "n", "s").cast(CELL).alias("c"), "format", "array")


def write_workbook(path: str, sheets: dict[str, list[tuple]], cover: dict | None = None) -> None:
    """Writes rows (row, col, value, format or None, formula or None) by sheet; ``cover`` is a first sheet of names and values.

    Values: None, numbers, bools, text, error names, dates. Names of sheets are cut to 31 characters and told apart by ~2, ~3 ...
    """
    if cover:
        sheets = {"About": [x for i, (k, v) in enumerate(cover.items(), 1) for x in ((i, 1, k, None, None), (i, 2, v, None, None))], **sheets}
    formats: dict[str, int] = {}
    taken: list[str] = []
    for name in sheets:
        base = short = re.sub(r"[\[\]:*?/\\]", " ", name)[:31] or "Sheet"
        n = 2
        while short.lower() in (t.lower() for t in taken):
            tail = f"~{n}"
            short, n = base[: 31 - len(tail)] + tail, n + 1
        taken.append(short)

    def style(f: str | None) -> str:
        return "" if not f or f == "General" else f' s="{formats.setdefault(f, len(formats) + 1)}"'

    def cell(row: int, col: int, v, f, formula) -> str:
        at, body = f"{column_letters(col)}{row}", f"<f>{escape(formula)}</f>" if formula else ""
        if isinstance(v, (date, datetime)):
            v, f = float(((v.date() if isinstance(v, datetime) else v) - EPOCH).days), f or "d mmm yyyy"
        if v is None:
            return f'<c r="{at}"{style(f)}>{body}</c>' if body or f else ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"{style(f)}>{body}<v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"{style(f)}>{body}<v>{v!r}</v></c>'
        if v in ERRORS:
            return f'<c r="{at}" t="e"{style(f)}>{body}<v>{v}</v></c>'
        if formula:
            return f'<c r="{at}" t="str"{style(f)}>{body}<v>{escape(v)}</v></c>'
        return f'<c r="{at}" t="inlineStr"{style(f)}><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = _M[1:-1], _R[1 : -3]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i, rows in enumerate(sheets.values(), 1):
            out, at = io.StringIO(), None
            for row in sorted(rows, key=lambda r: r[:2]):
                if row[0] != at:
                    out.write(("</row>" if at is not None else "") + f'<row r="{row[0]}">')
                    at = row[0]
                out.write(cell(*row))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{xml}<worksheet xmlns="{main}"><sheetData>{out.getvalue()}{"</row>" if at is not None else ""}</sheetData></worksheet>')
        ids = range(1, len(taken) + 1)
        z.writestr("xl/workbook.xml", f'{xml}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(t)} sheetId="{i}" r:id="rId{i}"/>' for i, t in zip(ids, taken)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{xml}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + f'<Relationship Id="rId{len(taken) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        codes = list(formats)
        z.writestr("xl/styles.xml", f'{xml}<styleSheet xmlns="{main}"><numFmts count="{len(codes)}">' + "".join(f'<numFmt numFmtId="{164 + i}" formatCode={quoteattr(c)}/>' for i, c in enumerate(codes)) + '</numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellXfs count="' + str(len(codes) + 1) + '"><xf numFmtId="0"/>' + "".join(f'<xf numFmtId="{164 + i}" applyNumberFormat="1"/>' for i in range(len(codes))) + "</cellXfs></styleSheet>")
        z.writestr("_rels/.rels", f'{xml}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'{xml}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in ids) + "</Types>")


def show_csv(value, number_format: str | None) -> str:
    """A cell in CSV: dates as ISO, whole numbers without padding, TRUE and FALSE."""
    from datetime import timedelta

    if value is None:
        return ""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        if format_kind(number_format) == "date":
            return (EPOCH + timedelta(days=int(value))).isoformat()
        return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)
    return str(value)
