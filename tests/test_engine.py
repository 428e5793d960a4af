import datetime
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gridwarden.functions import labels, width
from gridwarden.functions.formula import FormulaError, features, reaches_other_rows, signature, spans, tokens, translate
from gridwarden.functions.identity import stable_id
from gridwarden.functions.text import numeric_text
from gridwarden.operators import assertions, policy, repair, rules, runs
from gridwarden.plans.report import sarif
from gridwarden.sources.workbook import Unsafe, inspect, parse_xml, read_inspections, read_sheets, read_sizes, read_structures, read_styles, read_workbooks


def test_copies_share_a_signature():
    assert signature("=A1+$B$2+C$3+$D4", 5, 5) == signature("=B2+$B$2+D$3+$D5", 6, 6)
    assert signature("=sum( A1:B2 )", 3, 3) == "SUM(R[-2]C[-2]:R[-1]C[-1])"
    assert "'DETAIL DATA'!R[-3]C[-2]:R[-1]C[-1]" in signature("=SUM('Detail Data'!A2:B4)", 5, 3)


def test_translation():
    assert translate("=A1+$B1+C$3+$D$4", 5, 5, 7, 6) == "=B3+$B3+D$3+$D$4"
    assert translate('="Table1[Amount]"', 1, 1, 2, 2) == '="Table1[Amount]"'
    assert translate("=SUM(A1:A9)*1.5E+3", 10, 1, 10, 2) == "=SUM(B1:B9)*1.5E+3"
    for formula in ("='[Budget.xlsx]Plan'!A1", "=SUM(Table1[Amount])", "=FILTER(A1:A3,B1:B3=1)", "=_xlfn._xlws.FILTER(A1:A3,B1:B3=1)"):
        with pytest.raises(FormulaError):
            translate(formula, 1, 1, 2, 1)
    with pytest.raises(FormulaError):
        translate("=A1", 2, 1, 1, 1)
    with pytest.raises(FormulaError):
        tokens("A1")


def test_features():
    f = features("=OFFSET(A1,1,0)+NOW()+SUM(B:B)+'[Book.xlsx]S'!C1")
    assert f["volatile"] == ["OFFSET", "NOW"] and f["whole_column"] and f["external"] == ["'[Book.xlsx]S'!C1"]
    f = features('="#REF! NOW() Table1[Amount] [Book.xlsx]S!A1 B:B"')
    assert not (f["broken"] or f["volatile"] or f["external"] or f["whole_column"] or f["unsupported"])
    f = features("=#REF!+NOW()+SUM(B:B)+SUM(Table1[Amount])")
    assert f["broken"] == ["#REF!"] and f["volatile"] == ["NOW"] and f["unsupported"] == "structured reference"


def test_stable_id(spark):
    got = spark.range(1).select(stable_id("finding", F.lit("WL1"), F.lit(None), F.lit("é\"x"))).first()[0]
    body = json.dumps(["WL1", None, 'é"x'], separators=(",", ":"), ensure_ascii=False)
    assert got == "finding-" + hashlib.sha256(body.encode()).hexdigest()[:16]


def test_numeric_text(spark):
    texts = [" 12 ", "1,234", "1,23", "007", "0.5", "-3", "(3)", "1234567890123456", ".5", "", None, "x", "1/2", "5."]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(numeric_text(F.col("t"))).collect()]
    assert got == [12.0, 1234.0, None, None, 0.5, None, None, None, 0.5, None, None, None, None, 5.0]


def test_regions_and_bands(spark):
    cells = [("s", r, c) for r in range(1, 5) for c in range(1, 4)] + [("s", 40, 26)]
    got = runs.regions(spark.createDataFrame(cells, "sheet string, row int, col int")).collect()
    assert [tuple(r) for r in got] == [("s", 1, 4, 1, 3, 12, 1.0)]
    band = runs.bands(spark.createDataFrame([("B", r) for r in (2, 3, 5, 6, 20)], "col string, row int"), ["col"], "row").collect()
    assert [tuple(r) for r in band] == [("B", 2, 6, 4, 0.8)]
    assert runs.bands(spark.createDataFrame([("B", r) for r in (1, 3, 5, 7, 9)], "col string, row int"), ["col"], "row").count() == 0
    snake = [("t", r, c) for r in range(20) for c in ((0, 1, 2) if r % 4 == 0 else (2,) if r % 4 == 1 else (0, 1, 2) if r % 4 == 2 else (0,))]
    for block_rows in (1, 3, 1000):
        got = runs.regions(spark.createDataFrame(snake, "sheet string, row int, col int"), block_rows=block_rows).collect()
        assert [tuple(r) for r in got] == [("t", 0, 19, 0, 2, 40, 40 / 60)]
    assert runs.regions(spark.createDataFrame([], "sheet string, row int, col int")).count() == 0


def test_adjacent_outliers_are_left_alone(spark):
    def found(odd):
        cells = spark.createDataFrame([(1, p, "b" if p in odd else "a") for p in range(20)], "band int, pos int, signature string")
        return sorted(r["location"] for r in rules.formula_outliers(cells, "s", F.col("pos").cast("string")).collect())

    assert found({5}) == ["5"] and found({5, 12}) == ["12", "5"] and found({5, 6}) == [] and found(set()) == []


def test_assertions_on_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, ""), (9.0, " ")], "x double, s string")
    assert assertions.numeric_bounds(df, "x", 0, 5).first()["violations"] == 2
    assert assertions.nonblank(df, "s").first()["violations"] == 1
    for check in (assertions.unique(df.limit(0), "s"), assertions.nonblank(df.limit(0), "s"), assertions.allowed_values(df.limit(0), "s", ["a"])):
        assert check.first()["passed"]


def test_policy(spark):
    found = spark.createDataFrame([("old", "WL001", "error", "A1"), ("waived", "WL010", "info", "Data!B2"), ("new", "WL001", "error", None)], "id string, rule_id string, severity string, location string")
    base = spark.createDataFrame([("old",)], "id string")
    waivers = [policy.Waiver(("WL010",), ("D*",)), policy.Waiver(("WL001",), (), datetime.date(2026, 8, 18))]
    out = policy.classify(found, waivers, base, datetime.date(2026, 8, 19), new_only=True)
    assert {r["id"]: r["status"] for r in out.collect()} == {"old": "baseline", "waived": "suppressed", "new": "new"}
    assert policy.summary(out).first().asDict() == {"total": 3, "active": 1, "suppressed": 1, "known": 1, "new": 1}
    assert policy.weighted_score(found).first()[0] == 31
    assert json.loads(sarif(found, "book.xlsx"))["runs"][0]["results"]


def test_band_with_a_blank_and_a_literal(spark):
    rows = [(1, p, None if p in (3, 6, 0) else "s", "7" if p == 6 else None) for p in range(10)]
    got = rules.band_gaps(spark.createDataFrame(rows, "band int, pos int, signature string, value string"), "s", F.col("pos").cast("string")).collect()
    assert sorted((r["rule_id"], r["location"]) for r in got) == [("WL003", "3"), ("WL004", "6")]


def test_patches_lose_and_multiply_no_cells(spark):
    cells = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "k int, txt string")
    patches = spark.createDataFrame([(1, "a", "x"), (3, "c", "y"), (3, "c", "z"), (4, "other", "w"), (9, None, "new"), (10, "gone", "v")], "k int, before string, after string")
    got = repair.apply_to_cells(cells, patches, ["k"]).collect()
    assert sorted((r["k"], str(r["txt"])) for r in got) == [(1, "x"), (2, "None"), (3, "c"), (4, "d"), (9, "new")]


def test_waivers_need_a_dimension(spark):
    with pytest.raises(ValueError):
        policy.Waiver(expires=datetime.date(2026, 1, 1))
    found = spark.createDataFrame([("a", "WL001", "error", "A1", "Data"), ("b", "WL001", "error", "A1", None)], "id string, rule_id string, severity string, location string, sheet string")
    out = policy.classify(found, [policy.Waiver(sheets=("D?t*",)), policy.Waiver(ids=("b",))], None, datetime.date(2026, 8, 19))
    assert {r["id"]: r["waiver"] for r in out.collect()} == {"a": 0, "b": 1}


def test_a_check_that_fails_stops_no_other(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "num double")
    got = assertions.evaluated({"sum": lambda: assertions.total(df, "sum", 1.0), "lost": lambda: assertions.nonblank(df, "nothing"), "zero": lambda: assertions.total(df.limit(0), "zero", 0.0)}, df).collect()
    assert [(r["passed"], r["violations"]) for r in got] == [(True, 0), (False, None), (True, 0)] and got[1]["assertion"].startswith("lost: ")


def test_aggregates_and_rows():
    assert reaches_other_rows("=SUM(A1:A9)", 10) and not reaches_other_rows("=SUM(A10:D10)", 10) and not reaches_other_rows('="SUM(A1)"', 10)
    assert reaches_other_rows("=SUM(Sheet2!C:C)", 10) and not reaches_other_rows("=A1+SUM(B10)", 10) and reaches_other_rows("=SUM(A1", 3)
    assert spans("=SUM($A$1:B9)+Sheet2!C1+D4") == [(1, 1, 9, 2), (4, 4, 4, 4)]


def test_text_measures():
    assert width.display_units("ab c\t,") == 3 + 0.5 + 4 + 0.8 and width.display_units("表") == 2
    assert width.font_factor("a", None, False) == 1 and width.font_factor("表", 100, True) == 2.5 * 1.08 * 1.04
    assert [width.wrapped_lines(t, 10, 1.0) for t in ("", "aaaa bbbb", "aaaa bbbb cccc", "a" * 25, "aaaaaaaaa bb")] == [1, 1, 2, 3, 2]
    assert width.measure("one\r\ntwo longer", 11, False, False, 8.43)[1:] == (2, 2 * 13.75 + 2)


def test_labels(spark):
    assert labels.template("  Ｔotal  １２ of\t34 ") == "total <n> of <n>"
    texts = [("Sub-Total", True), ("totals", False), ("Manual override", True), ("期末余额", True), (None, False)]
    df = spark.createDataFrame(texts, "t string, want boolean")
    assert df.where(labels.summary_label(F.col("t")) != F.col("want")).count() == 0
    assert df.where(labels.summary_label(F.col("t"), overrides=False)).count() == 2


def test_atomic_groups(spark):
    rows = [("a", "set_formula", "s", "A1", True, 0.99, None), ("b", "copy_style", "s", "A2", True, 0.99, "g"), ("c", "copy_style", "s", "A3", False, 0.99, "g"), ("d", "set_column_width", "s", "B", True, 0.9, None)]
    patches = spark.createDataFrame(rows, "id string, kind string, sheet string, cell string, safe boolean, confidence double, atomic_group string")
    assert [r["id"] for r in repair.select_safe(patches).collect()] == ["a"]
    ids = spark.createDataFrame([("b",), ("d",)], "id string")
    assert repair.select_ids(patches, ids).count() == 0
    assert [r["id"] for r in repair.select_ids(patches, ids, layout=True).collect()] == ["d"]


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
LINKS = "http://schemas.openxmlformats.org/package/2006/relationships"


def package(extra=None, sheet=None, types=None, names="", links=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", types or f'<Types xmlns="{TYPES}"/>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets>{names}</workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="' + LINKS + '"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>Hello</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet or f'<worksheet xmlns="{MAIN}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2.5</v></c></row><row r="3" hidden="1"><c r="B3"><f>B1*2</f><v>5</v></c></row></sheetData></worksheet>')
        for k, v in (extra or {}).items():
            z.writestr(k, v)
    return out.getvalue()


def test_workbook_source(spark, tmp_path):
    (tmp_path / "good.xlsx").write_bytes(package())
    (tmp_path / "evil.xlsx").write_bytes(package({"../x.xml": "<a/>"}))
    (tmp_path / "text.xlsx").write_bytes(b"no zip")
    seen = {r["workbook"]: r["ok"] for r in read_inspections(spark, str(tmp_path)).collect()}
    assert seen == {"good.xlsx": True, "evil.xlsx": False, "text.xlsx": False}
    cells = {(r["row"], r["col"]): (r["data_type"], r["txt"], r["num"], r["formula"], r["hidden"]) for r in read_workbooks(spark, str(tmp_path)).collect()}
    assert cells == {(1, 1): ("s", "Hello", None, None, False), (1, 2): ("n", "2.5", 2.5, None, False), (3, 2): ("f", "5", 5.0, "=B1*2", True)}


def test_package_checks():
    with pytest.raises(Unsafe):
        parse_xml(b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>')
    assert not inspect("a.txt", package())[1]
    assert not inspect("a.xlsx", package({"xl/bad.xml": "<a>"}))[1]
    assert inspect("a.xlsx", package({"xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships xmlns="{LINKS}"><Relationship Id="r" Target="http://x" TargetMode="External"/></Relationships>'}))[5] == ["http://x"]


def test_content_types_and_relationships():
    main = '<Override PartName="/xl/workbook.xml" ContentType="{}"/>'
    said = lambda *kinds: f'<Types xmlns="{TYPES}">{"".join(main.format(k) for k in kinds)}</Types>'
    xlsx, xlsm = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml", "application/vnd.ms-excel.sheet.macroEnabled.main+xml"
    assert inspect("a.xlsx", package(types=said(xlsx)))[6] == "xlsx" and inspect("a.xlsm", package(types=said(xlsm)))[6] == "xlsm"
    assert inspect("a.xlsx", package())[6] == inspect("a.xlsx", package(types=said(xlsm)))[6] == inspect("a.xlsm", package(types=said(xlsx)))[6] == "xlsm"
    assert inspect("a.xlsx", package({"xl/vbaProject.bin": "x"}, types=said(xlsx)))[4:7] == (True, [], "xlsm")
    for bad in (said(xlsx, xlsm), "<Types/>"):
        assert not inspect("a.xlsx", package(types=bad))[1]
    lost = f'<Relationships xmlns="{LINKS}"><Relationship Id="r" Target="../gone.xml"/></Relationships>'
    assert "gone" in inspect("a.xlsx", package({"xl/worksheets/_rels/sheet1.xml.rels": lost}))[2]
    assert not inspect("a.xlsx", package({"xl/worksheets/_rels/sheet1.xml.rels": "<Relationships/>"}))[1]


def test_workbook_structures(spark, tmp_path):
    sheet = f'''<worksheet xmlns="{MAIN}"><dimension ref="A1:D9"/><sheetViews><sheetView topLeftCell="B7" zoomScale="150"><pane ySplit="2" state="frozen" topLeftCell="A9"/></sheetView></sheetViews>
    <sheetFormatPr defaultRowHeight="15"/><cols><col min="2" max="3" width="20.5" hidden="1"/></cols><sheetData><row r="1" ht="30"><c r="A1" s="1"><f t="shared" ref="A1:A3" si="0">B1*2</f><v>2</v></c></row>
    <row r="2"><c r="A2"><f t="shared" si="0"/><v>4</v></c></row><row r="3"><c r="A3"><f t="shared" si="0"/><v>6</v></c><c r="D3"><f t="array" ref="D3:D4">SUM(A1:A3)</f></c></row></sheetData>
    <sheetProtection sheet="1"/><autoFilter ref="A1:D9"/><mergeCells><mergeCell ref="C8:D9"/></mergeCells><conditionalFormatting sqref="A1:A3 C1"><cfRule type="expression"><formula>A1&gt;3</formula></cfRule></conditionalFormatting>
    <dataValidations><dataValidation type="list" sqref="B1:B9"><formula1>"a,b"</formula1></dataValidation></dataValidations><rowBreaks><brk id="5"/></rowBreaks></worksheet>'''
    names = "<definedNames><definedName name='Rate'>Data!$B$2</definedName><definedName name='_xlnm.Print_Area' localSheetId='0'>Data!$A$1:$D$9,Data!$F:$G</definedName><definedName name='Lost'>#REF!</definedName></definedNames>"
    table = f'<table xmlns="{MAIN}" name="T" ref="A1:B3"/>'
    styles = f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="0.000"/></numFmts><fonts><font><sz val="11"/></font><font><b/><sz val="14"/></font></fonts><fills><fill/><fill><patternFill patternType="solid"/></fill></fills><borders><border/><border><left style="thin"><color rgb="FF"/></left><top style="none"/></border></borders><cellXfs><xf numFmtId="0"/><xf numFmtId="164" fontId="1" fillId="1" borderId="1"><alignment wrapText="1" horizontal="right"/></xf></cellXfs></styleSheet>'
    rels = f'<Relationships xmlns="{LINKS}"><Relationship Id="r" Target="../tables/t.xml"/></Relationships>'
    (tmp_path / "b.xlsx").write_bytes(package({"xl/styles.xml": styles, "xl/tables/t.xml": table, "xl/worksheets/_rels/sheet1.xml.rels": rels}, sheet, names=names))
    path = str(tmp_path)
    assert {(r["coord"], r["formula"], r["num"]) for r in read_workbooks(spark, path).collect()} == {("A1", "=B1*2", 2.0), ("A2", "=B2*2", 4.0), ("A3", "=B3*2", 6.0), ("D3", "=SUM(A1:A3)", None)}
    s = read_sheets(spark, path).first()
    assert (s["protected"], s["declared"], s["top"], s["left"], s["pane"], s["pane_rows"], s["pane_top"], s["zoom"], s["default_width"]) == (True, "A1:D9", 7, 2, "frozen", 2.0, 9, 150, None)
    assert {(r["axis"], r["first"], r["last"], r["size"], r["hidden"]) for r in read_sizes(spark, path).collect()} == {("col", 2, 3, 20.5, True), ("row", 1, 1, 30.0, False)}
    got = sorted((r["kind"], str(r["name"]), r["detail"], r["min_row"], r["max_row"], r["min_col"], r["max_col"]) for r in read_structures(spark, path).collect())
    assert got == [
        ("break", "row", "5", 5, 5, 1, 16384), ("conditional", "expression A1>3", "A1:A3", 1, 3, 1, 1), ("conditional", "expression A1>3", "C1", 1, 1, 3, 3), ("filter", "None", "A1:D9", 1, 9, 1, 4), ("formula", "array", "D3:D4", 3, 4, 4, 4),
        ("formula", "shared", "A1:A3", 1, 3, 1, 1), ("formula", "shared", "A2", 2, 2, 1, 1), ("formula", "shared", "A3", 3, 3, 1, 1), ("merge", "None", "C8:D9", 8, 9, 3, 4), ("name", "Lost", "#REF!", None, None, None, None), ("name", "Rate", "$B$2", 2, 2, 2, 2),
        ("print_area", "_xlnm.Print_Area", "$A$1:$D$9", 1, 9, 1, 4), ("print_area", "_xlnm.Print_Area", "$F:$G", 1, 1048576, 6, 7), ("table", "T", "A1:B3", 1, 3, 1, 2), ("validation", 'list||"a,b"|', "B1:B9", 1, 9, 2, 2),
    ]
    plain, own = sorted(read_styles(spark, path).collect(), key=lambda r: r["style_id"])
    assert plain["number_format"] == "General" and not plain["has_fill"] and plain["left"] is None
    assert (own["number_format"], own["size"], own["bold"], own["wrap"], own["align"], own["has_fill"], own["left"], own["top"]) == ("0.000", 14.0, True, True, "right", True, "thin rgb=FF", None)
