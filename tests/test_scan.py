"""A whole scan of two workbooks that differ in one cell."""

from gridwarden.plans.scan import release, scan
from tests.test_engine import MAIN, TYPES, package

XLSX = f'<Types xmlns="{TYPES}"><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/></Types>'


def sheet(odd: int) -> str:
    def row(r: int) -> str:
        total = f'<c r="C{r}"><f>A{r}+B{r}</f><v>{3 * r}</v></c>' if r != 8 else '<c r="C8"><v>7</v></c>'
        double = f'<c r="D{r}"><f>A{r}*2</f></c>' if r != 5 else ""
        share = f'<c r="E{r}"><f>B{r}/{3 if r == odd else 4}</f></c>'
        return f'<row r="{r}"><c r="A{r}"><v>{r}</v></c><c r="B{r}"><v>{r * 2}</v></c>{total}{double}{share}</row>'

    rows = "".join(row(r) for r in range(1, 21))
    lost = '<row r="22" hidden="1"><c r="A22" t="inlineStr"><is><t>#REF!</t></is></c></row>'
    return f'<worksheet xmlns="{MAIN}"><dimension ref="A1:E22"/><sheetViews><sheetView topLeftCell="A10"/></sheetViews><sheetData>{rows}{lost}</sheetData></worksheet>'


def test_scan(spark, tmp_path):
    names = "<definedNames><definedName name='Gone'>Old!$A$1</definedName><definedName name='Fine'>Data!$A$1</definedName><definedName name='Out'>[Book.xlsx]S!$A$1</definedName></definedNames>"
    (tmp_path / "a.xlsx").write_bytes(package(sheet=sheet(11), types=XLSX, names=names))
    (tmp_path / "b.xlsx").write_bytes(package(sheet=sheet(0), types=XLSX))
    done = scan(spark, str(tmp_path))
    found = done.findings().collect()
    common = {("WL003", "D5"), ("WL004", "C8"), ("WL008", "22:22"), ("WL011", "A22"), ("WL020", "A10")}
    assert {(r["rule_id"], r["location"]) for r in found if r["workbook"] == "b.xlsx"} == common
    assert {(r["rule_id"], r["location"]) for r in found if r["workbook"] == "a.xlsx"} == common | {("WL002", "E11"), ("WL013", "Gone"), ("WL009", "Out")}
    patches = {(r["kind"], r["cell"], r["after"], r["safe"]) for r in done.patches().where("workbook = 'b.xlsx'").collect()}
    assert patches == {("create_formula", "D5", '{"formula":"=A5*2"}', True), ("set_formula", "C8", '{"formula":"=A8+B8"}', True), ("set_sheet_view", "A10", '{"origin":"A1"}', False)}
    release(done.book)
