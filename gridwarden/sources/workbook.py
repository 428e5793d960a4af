"""Workbooks in the Office Open XML format as cells, read on executors with zipfile and expat.

A file that fails a safety check becomes a row of the inspections with a reason, not a failed job.
"""

from __future__ import annotations

import io
import itertools
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.functions.formula import LAST_COL, LAST_ROW, FormulaError, column_number, features, translate
from gridwarden.runtime import ship_package

#: Rows of a table that are handed on at once.
BATCH = 10_000
#: Limits, in bytes but for the entries and the ratio.
LIMITS = {"file": 100 << 20, "entries": 10_000, "total": 1000 << 20, "entry": 100 << 20, "xml": 50 << 20, "ratio": 100}
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
TYPES = "{http://schemas.openxmlformats.org/package/2006/content-types}"
LINKS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Content types of the main part, formula kinds that aren't plain, built-in number formats.
SPREADSHEET = {"application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml": "xlsx", "application/vnd.ms-excel.sheet.macroenabled.main+xml": "xlsm"}
NOT_PLAIN = ("shared", "array", "dataTable")
FORMATS = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@"}
CELLS = "workbook string, sheet string, row long, col int, coord string, data_type string, txt string, num double, formula string, style_id int, hidden boolean"
INSPECTION = "workbook string, ok boolean, reason string, entries int, has_vba boolean, external_relationships array<string>, format string"
SHEETS = (
    "workbook string, sheet string, position int, state string, protected boolean, declared string, top long, left long, pane string, pane_rows double, pane_cols double, pane_top long, pane_left long, zoom int, default_width double, default_height double"
)
SIZES = "workbook string, sheet string, axis string, first long, last long, size double, hidden boolean, outlined boolean, style_id int"
STRUCTURES = "workbook string, sheet string, kind string, name string, detail string, min_row long, max_row long, min_col long, max_col long"
STYLES = "workbook string, style_id int, number_format string, size double, bold boolean, wrap boolean, align string, has_fill boolean, left string, right string, top string, bottom string"


class Unsafe(ValueError):
    """The package isn't read; the message says why."""


def checked_name(name: str) -> str:
    if not name or "\0" in name or "\\" in name or name.startswith("/") or "://" in name or any(p in (".", "..", "") for p in name.rstrip("/").split("/")):
        raise Unsafe(f"member name {name!r}")
    return name


def parse_xml(data: bytes) -> ElementTree.Element:
    """Parses without document types and entities."""
    if len(data) > LIMITS["xml"]:
        raise Unsafe("an XML part is too large")
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", data.replace(b"\0", b""), re.I):
        raise Unsafe("a document type or entity")
    try:
        return ElementTree.fromstring(data)
    except (ElementTree.ParseError, expat.ExpatError) as e:
        raise Unsafe("XML that is not well-formed") from e


def opened(name: str, data: bytes) -> zipfile.ZipFile:
    """The package, once sizes, names, ratios and required parts are checked; nothing is decompressed before."""
    if not name.lower().endswith((".xlsx", ".xlsm")):
        raise Unsafe("extension")
    if len(data) > LIMITS["file"]:
        raise Unsafe("file size")
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError) as e:
        raise Unsafe("not a zip archive") from e
    infos = z.infolist()
    if len(infos) > LIMITS["entries"]:
        raise Unsafe("too many entries")
    names = [checked_name(i.filename) for i in infos]
    if len({n.lower() for n in names}) != len(names):
        raise Unsafe("duplicate members")
    for i in infos:
        if i.flag_bits & 1:
            raise Unsafe("encryption")
        if (i.external_attr >> 28) == 0xA:
            raise Unsafe("a symbolic link")
        if i.file_size > LIMITS["entry"] or i.file_size > LIMITS["ratio"] * max(1, i.compress_size) and i.file_size > 1 << 16:
            raise Unsafe("a member's size or ratio")
    if sum(i.file_size for i in infos) > LIMITS["total"]:
        raise Unsafe("total size")
    for part in ("[Content_Types].xml", "xl/workbook.xml"):
        if part not in names:
            raise Unsafe(f"no {part}")
    return z


def read_part(z: zipfile.ZipFile, name: str, most: int | None = None) -> bytes:
    """A member's bytes; a member longer than it claims, or than the limit, isn't read to its end."""
    most = LIMITS["xml"] if most is None else most
    if z.getinfo(name).file_size > most:
        raise Unsafe("an XML part is too large")
    with z.open(name) as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise Unsafe("an XML part is too large")
    return data


def declared_format(z: zipfile.ZipFile) -> str | None:
    """xlsx or xlsm by the declared content types, None if they say neither. A part or extension of two types is refused."""
    root = parse_xml(read_part(z, "[Content_Types].xml"))
    if root.tag != f"{TYPES}Types":
        raise Unsafe("the root of the content types")
    said: dict[tuple[str, str], str] = {}
    for d in root:
        kind = d.get("ContentType", "").strip().lower()
        part, extension = d.get("PartName", "").strip().lstrip("/"), d.get("Extension", "").strip().lstrip(".").lower()
        key = ("part", part) if d.tag == f"{TYPES}Override" and part else ("extension", extension) if d.tag == f"{TYPES}Default" and extension else None
        if key and said.setdefault(key, kind) != kind:
            raise Unsafe(f"two content types of {key[1]}")
    main = said.get(("part", "xl/workbook.xml"), said.get(("extension", "xml"), ""))
    return SPREADSHEET.get(main, "xlsm" if "macroenabled" in main else None)


def checked_relations(z: zipfile.ZipFile) -> tuple[list[str], bool]:
    """(external targets, whether one names a macro project) of all relationship parts. Internal targets must exist."""
    members, outside, vba = set(z.namelist()), set(), False
    for path in members:
        if path.endswith(".rels"):
            root = parse_xml(read_part(z, path))
            if root.tag != f"{LINKS}Relationships":
                raise Unsafe(f"the root of {path}")
            folder = posixpath.dirname(posixpath.dirname(path))
            for r in root.iter(f"{LINKS}Relationship"):
                target = r.get("Target", "")
                vba |= r.get("Type", "").lower().endswith("/vbaproject")
                if r.get("TargetMode", "Internal") == "External":
                    outside.add(target)
                else:
                    place = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                    if place not in members:
                        raise Unsafe(f"{path} points to {place!r}, which is not there")
    return sorted(outside), vba


def relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """(target, mode) by id of a part's relationships; internal targets are resolved."""
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    out = {}
    for r in parse_xml(read_part(z, path)):
        mode = r.get("TargetMode", "Internal")
        target = r.get("Target", "")
        if mode == "Internal":
            target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        out[r.get("Id", "")] = (target, mode)
    return out


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in parse_xml(read_part(z, "xl/sharedStrings.xml")).iter(f"{MAIN}si")]


def yes(text: str | None) -> bool:
    return text in ("1", "true")


def number(text: str | None) -> float | None:
    try:
        return float(text) if text is not None else None
    except ValueError:
        return None


def place(text: str | None) -> tuple[int | None, int | None]:
    """(row, col) of an address; nulls for none or one beyond the sheet."""
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?([1-9]\d*)", text or "")
    row, col = (int(m[2]), column_number(m[1])) if m else (0, 0)
    return (row, col) if 1 <= row <= LAST_ROW and 1 <= col <= LAST_COL else (None, None)


def box(text: str | None) -> tuple[int | None, int | None, int | None, int | None]:
    """(min_row, max_row, min_col, max_col) of a range, whole columns and rows widened; nulls for what is none."""
    a, _, b = (text or "").partition(":")
    rows, cols = re.fullmatch(r"\$?(\d+):\$?(\d+)", text or ""), re.fullmatch(r"\$?([A-Za-z]{1,3}):\$?([A-Za-z]{1,3})", text or "")
    if rows:
        lo, hi = sorted(map(int, rows.groups()))
        return lo, hi, 1, LAST_COL
    if cols:
        lo, hi = sorted(map(column_number, cols.groups()))
        return 1, LAST_ROW, lo, hi
    (r1, c1), (r2, c2) = place(a), place(b or a)
    if r1 is None or r2 is None or c1 is None or c2 is None:
        return None, None, None, None
    return min(r1, r2), max(r1, r2), min(c1, c2), max(c1, c2)


def stored_cells(root: ElementTree.Element) -> Iterator[tuple[int, int, ElementTree.Element, ElementTree.Element]]:
    """(row, col, row element, cell element) of a sheet; missing addresses follow the one before."""
    row_at = 0
    for row in root.iter(f"{MAIN}row"):
        row_at = int(row.get("r") or row_at + 1)
        col_at = 0
        for c in row.iter(f"{MAIN}c"):
            col_at = place(c.get("r"))[1] or col_at + 1
            yield row_at, col_at, row, c


def formula_of(c: ElementTree.Element, row: int, col: int, shared: dict[str, tuple[str, int, int]]) -> str | None:
    """The formula of a cell, those that share another's moved to their place; None for none or if it can't be moved."""
    f = c.find(f"{MAIN}f")
    if f is None:
        return None
    if f.text:
        if f.get("t") == "shared":
            shared[f.get("si", "")] = (f"={f.text}", row, col)
        return f"={f.text}"
    if f.get("t") == "shared" and f.get("si", "") in shared:
        try:
            return translate(*shared[f.get("si", "")], row, col)
        except FormulaError:
            return None
    return None


def sheet_cells(root: ElementTree.Element, strings: list[str], sheet: str, state: str) -> Iterator[tuple]:
    hidden_cols = [(int(c.get("min", 0)), int(c.get("max", 0))) for c in root.iter(f"{MAIN}col") if yes(c.get("hidden"))]
    shared: dict[str, tuple[str, int, int]] = {}
    for row_at, col_at, row, c in stored_cells(root):
        kind, value = c.get("t", "n"), c.findtext(f"{MAIN}v")
        if kind == "s" and value is not None and value.isdigit() and int(value) < len(strings):
            value = strings[int(value)]
        elif kind == "inlineStr":
            kind, value = "s", "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
        elif kind == "str":
            kind = "s"
        num = number(value) if kind == "n" else None
        if kind == "n" and value is not None and num is None:
            kind = "s"
        text = formula_of(c, row_at, col_at, shared)
        calculated = c.find(f"{MAIN}f") is not None
        hidden = yes(row.get("hidden")) or state != "visible" or any(a <= col_at <= b for a, b in hidden_cols)
        if value is not None or calculated or c.get("s"):
            yield sheet, row_at, col_at, c.get("r") or "", "f" if calculated else kind, value, num, text, int(c.get("s", 0)), hidden


def worksheets(z: zipfile.ZipFile) -> Iterator[tuple[int, str, str, str]]:
    """(position, name, state, part) of a workbook's sheets; chart sheets and lost ones are left out."""
    targets = relations(z, "xl/workbook.xml")
    for i, s in enumerate(parse_xml(read_part(z, "xl/workbook.xml")).iter(f"{MAIN}sheet")):
        target, mode = targets.get(s.get(f"{RELATION}id", ""), ("", ""))
        if mode == "Internal" and target in z.namelist():
            yield i, s.get("name", ""), s.get("state", "visible"), target


def sheet_roots(z: zipfile.ZipFile) -> Iterator[tuple[int, str, str, str, ElementTree.Element]]:
    for i, name, state, part in worksheets(z):
        root = parse_xml(read_part(z, part))
        if root.tag == f"{MAIN}worksheet":
            yield i, name, state, part, root


def cell_rows(z: zipfile.ZipFile) -> Iterator[tuple]:
    strings = shared_strings(z)
    for _, name, state, _, root in sheet_roots(z):
        yield from sheet_cells(root, strings, name, state)


def sheet_rows(z: zipfile.ZipFile) -> Iterator[tuple]:
    for i, name, state, _, root in sheet_roots(z):
        part = lambda tag: root.find(f"{MAIN}{tag}") if root.find(f"{MAIN}{tag}") is not None else ElementTree.Element(tag)  # noqa: E731, B023
        view = next(root.iter(f"{MAIN}sheetView"), ElementTree.Element("none"))
        pane = view.find(f"{MAIN}pane")
        top, left = place(view.get("topLeftCell", "A1"))
        of_pane = (pane.get("state", "split"), number(pane.get("ySplit", "0")), number(pane.get("xSplit", "0")), *place(pane.get("topLeftCell"))) if pane is not None else (None,) * 5
        zoom, plain = number(view.get("zoomScale")), part("sheetFormatPr")
        protected = yes(part("sheetProtection").get("sheet"))
        yield name, i, state, protected, part("dimension").get("ref"), top, left, *of_pane, int(zoom) if zoom else None, number(plain.get("defaultColWidth")), number(plain.get("defaultRowHeight"))


def size_rows(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Columns and rows with a size, hidden, grouped or styled; a row's height only if it is set."""
    for _, name, _, _, root in sheet_roots(z):
        for c in root.iter(f"{MAIN}col"):
            yield name, "col", int(c.get("min", 0)), int(c.get("max", 0)), number(c.get("width")), yes(c.get("hidden")), yes(c.get("collapsed")) or c.get("outlineLevel", "0") != "0", int(c.get("style", 0))
        at = 0
        for r in root.iter(f"{MAIN}row"):
            at = int(r.get("r") or at + 1)
            grouped = yes(r.get("collapsed")) or r.get("outlineLevel", "0") != "0"
            if r.get("ht") or yes(r.get("hidden")) or grouped:
                yield name, "row", at, at, number(r.get("ht")), yes(r.get("hidden")), grouped, int(r.get("s", 0))


def name_ranges(text: str) -> Iterator[tuple[str | None, str]]:
    """(sheet, range) of each part of a defined name's text."""
    for x in re.findall(r"(?:'(?:[^']|'')*'|[^,'])+", text.strip().removeprefix("=")):
        lost = x.strip().upper().endswith("#REF!")
        sheet, body = (x.strip()[:-5].removesuffix("!"), "#REF!") if lost else x.strip().rpartition("!")[::2]
        yield sheet.strip("'").replace("''", "'") or None, body


def name_rows(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Defined names, one row per range they name. detail: the range as written; sheet: the one named, else the name's own."""
    book = parse_xml(read_part(z, "xl/workbook.xml"))
    order = [s.get("name", "") for s in book.iter(f"{MAIN}sheet")]
    for n in book.iter(f"{MAIN}definedName"):
        name, own = n.get("name", ""), n.get("localSheetId", "")
        scope = order[int(own)] if own.isdigit() and int(own) < len(order) else None
        kind = {"_xlnm.Print_Area": "print_area", "_xlnm.Print_Titles": "print_titles"}.get(name, "name")
        for sheet, body in name_ranges(n.text or ""):
            yield sheet or scope, kind, name, body, *box(body)


def structure_rows(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Everything that a sheet holds besides cells, as boxes: merges, filters, validations, conditional formats, links,
    breaks, tables, comments, drawings, and formulas that aren't plain."""
    for _, sheet, _, part, root in sheet_roots(z):
        for tag, kind in (("mergeCell", "merge"), ("autoFilter", "filter"), ("hyperlink", "link"), ("protectedRange", "protected"), ("ignoredError", "ignored")):
            for x in root.iter(f"{MAIN}{tag}"):
                for ref in (x.get("ref") or x.get("sqref") or "").split():
                    yield sheet, kind, x.get("name"), ref, *box(ref)
        for x in root.iter(f"{MAIN}dataValidation"):
            rule = "|".join((x.get("type", "none"), x.get("operator", ""), x.findtext(f"{MAIN}formula1") or "", x.findtext(f"{MAIN}formula2") or ""))
            for ref in x.get("sqref", "").split():
                yield sheet, "validation", rule, ref, *box(ref)
        for x in root.iter(f"{MAIN}conditionalFormatting"):
            rule = "|".join(f"{r.get('type', '')} {r.findtext(f'{MAIN}formula') or ''}" for r in x.iter(f"{MAIN}cfRule"))
            for ref in x.get("sqref", "").split():
                yield sheet, "conditional", rule, ref, *box(ref)
        for tag, at in (("rowBreaks", "row"), ("colBreaks", "col")):
            for x in root.findall(f"{MAIN}{tag}/{MAIN}brk"):
                n = x.get("id", "0")
                yield sheet, "break", at, n, *((int(n), int(n), 1, LAST_COL) if at == "row" else (1, LAST_ROW, int(n), int(n)))
        for row, col, _, c in stored_cells(root):
            f = c.find(f"{MAIN}f")
            if f is not None:
                seen = features(f"={f.text or ''}")
                if f.get("t") in NOT_PLAIN or f.get("ref") or seen["external"] or seen["unsupported"]:
                    yield sheet, "formula", f.get("t"), f.get("ref") or c.get("r"), *(box(f.get("ref")) if f.get("ref") else (row, row, col, col))
        for target, mode in relations(z, part).values():
            if mode == "Internal" and target in z.namelist() and target.endswith(".xml"):
                yield from related_rows(z, sheet, target)
    yield from name_rows(z)


def related_rows(z: zipfile.ZipFile, sheet: str, part: str) -> Iterator[tuple]:
    root = parse_xml(read_part(z, part))
    tag = root.tag.rpartition("}")[2]
    if tag == "table":
        yield sheet, "table", root.get("name"), root.get("ref"), *box(root.get("ref"))
    elif tag == "comments":
        for c in root.iter(f"{MAIN}comment"):
            yield sheet, "comment", None, c.get("ref"), *box(c.get("ref"))
    elif tag == "wsDr":  # an anchor's corners count from zero; one without a second corner covers its first
        for anchor in root:
            corners = [[int(x.findtext(n) or 0) + 1 for n in (f"{x.tag.rpartition('}')[0]}}}row", f"{x.tag.rpartition('}')[0]}}}col")] for x in anchor if x.tag.endswith(("}from", "}to"))]
            kind = anchor.tag.rpartition("}")[2]
            yield sheet, "drawing", kind, None, *((corners[0][0], corners[-1][0], corners[0][1], corners[-1][1]) if corners else (None,) * 4)


def style_rows(z: zipfile.ZipFile) -> Iterator[tuple]:
    if "xl/styles.xml" not in z.namelist():
        yield 0, "General", 11.0, False, False, None, False, None, None, None, None
        return
    root = parse_xml(read_part(z, "xl/styles.xml"))
    every = lambda path: root.findall("/".join(MAIN + x for x in path.split("/")))
    formats = FORMATS | {int(n.get("numFmtId", 0)): n.get("formatCode", "") for n in every("numFmts/numFmt")}
    fonts, fills, borders = every("fonts/font"), every("fills/fill"), every("borders/border")
    pick = lambda items, x, key: items[int(x.get(key, 0))] if int(x.get(key, 0)) < len(items) else ElementTree.Element("none")
    for i, x in enumerate(every("cellXfs/xf")):
        font, fill, border = pick(fonts, x, "fontId"), pick(fills, x, "fillId"), pick(borders, x, "borderId")
        size, bold, pattern, how = font.find(f"{MAIN}sz"), font.find(f"{MAIN}b"), fill.find(f"{MAIN}patternFill"), x.find(f"{MAIN}alignment")
        filled = fill.find(f"{MAIN}gradientFill") is not None or pattern is not None and pattern.get("patternType", "none") != "none"
        sides = [side_text(border.find(f"{MAIN}{s}")) for s in ("left", "right", "top", "bottom")]
        fmt = int(x.get("numFmtId", 0))
        yield i, formats.get(fmt, f"format {fmt}"), number(size.get("val")) if size is not None else None, bold is not None and bold.get("val", "1") in ("1", "true"), how is not None and yes(how.get("wrapText")), how.get("horizontal") if how is not None else None, filled, *sides


def side_text(side: ElementTree.Element | None) -> str | None:
    """A drawn side as its style and color; null for none."""
    if side is None or side.get("style", "none") == "none":
        return None
    color = side.find(f"{MAIN}color")
    return " ".join([side.get("style", ""), *(f"{k}={v}" for k, v in sorted(color.attrib.items()))] if color is not None else [side.get("style", "")])


def inspect(name: str, data: bytes) -> tuple:
    """A row of the inspections. format: xlsx if the name, the declared type and the parts all say so; everything else that is
    safe is read, as xlsm, and never repaired."""
    try:
        z = opened(name, data)
        for n in z.namelist():
            if n.endswith((".xml", ".rels", ".vml")):
                parse_xml(read_part(z, n))
        said, (outside, linked) = declared_format(z), checked_relations(z)
        vba = linked or said == "xlsm" or any(n.lower().endswith("vbaproject.bin") for n in z.namelist())
        plain = said == "xlsx" and not vba and name.lower().endswith(".xlsx")
        return name, True, None, len(z.namelist()), vba, outside, "xlsx" if plain else "xlsm"
    except (Unsafe, zipfile.BadZipFile, OSError, RuntimeError, KeyError) as e:
        return name, False, str(e) or type(e).__name__, None, None, [], None


def files(spark: SparkSession, path: str) -> DataFrame:
    ship_package(spark)
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), "content")


def read_inspections(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a path or glob: whether it is safe to read, and why not."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([inspect(n, bytes(c)) for n, c in zip(pdf["name"], pdf["content"], strict=True)], columns=[x.split()[0] for x in INSPECTION.split(", ")])

    return files(spark, path).mapInPandas(rows, INSPECTION)


def read_table(spark: SparkSession, path: str, schema: str, rows_of) -> DataFrame:
    """What rows_of(package) yields for every safe workbook of a path or glob; unsafe ones give nothing."""
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for n, c in zip(pdf["name"], pdf["content"], strict=True):
                if inspect(n, bytes(c))[1]:
                    found = rows_of(opened(n, bytes(c)))
                    while batch := list(itertools.islice(found, BATCH)):
                        yield pd.DataFrame([(n, *x) for x in batch], columns=names, dtype=object)

    return files(spark, path).mapInPandas(rows, schema)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The stored cells of every safe workbook of a path or glob."""
    return read_table(spark, path, CELLS, cell_rows)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Sheets with their state, protection, declared dimension and saved view."""
    return read_table(spark, path, SHEETS, sheet_rows)


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Columns and rows with a size of their own, hidden or grouped, as spans."""
    return read_table(spark, path, SIZES, size_rows)


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """Merges, tables, filters, validations, conditional formats, names, print ranges, comments, links, breaks, drawings and
    formulas that aren't plain, as boxes."""
    return read_table(spark, path, STRUCTURES, structure_rows)


def read_styles(spark: SparkSession, path: str) -> DataFrame:
    """Cell styles by id, as far as rules look at them."""
    return read_table(spark, path, STYLES, style_rows)
