"""The commands on small workbooks; exit codes are part of their contract."""

import json

from gridwarden.cli import main
from tests.test_engine import package
from tests.test_scan import XLSX, sheet

CONFIG = """version: 2
workbook: {max_critical_findings: 0}
keys: [{sheet: Data, range: B1:B20}]
assertions:
  - {id: total, type: equals, left: "SUM(Data!A1:A20)", right: 210}
  - {id: bounds, type: numeric_bounds, sheet: Data, range: A1:A20, minimum: 1, maximum: 20}
  - {id: same, type: unique, sheet: Data, range: A1:A20}
  - {id: filled, type: nonblank, sheet: Data, range: D4:D6}
  - {id: broken, type: equals, left: "A1+B1", right: 3}
"""


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.xlsx").write_bytes(package(sheet=sheet(11), types=XLSX))
    (tmp_path / "b.xlsx").write_bytes(package(sheet=sheet(0).replace('<c r="C8"><v>7</v>', '<c r="C8"><v>9</v>'), types=XLSX))
    (tmp_path / "evil.xlsx").write_bytes(b"no zip")
    (tmp_path / "c.yml").write_text(CONFIG)
    a, b, out = str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx"), tmp_path / "out"
    assert main(["scan", a, "--out", str(out), "--new-only"]) == 2 and main(["scan"]) == 2 and main(["scan", str(tmp_path / "evil.xlsx"), "--out", str(out)]) == 3
    assert main(["test", a, "--config", str(tmp_path / "c.yml")]) == 1
    said = capsys.readouterr().out
    assert all(f"pass {x}" in said for x in ("total", "bounds", "same", "max_critical_findings")) and "FAIL filled (1)" in said and "FAIL broken: " in said
    assert main(["diff", a, b, "--out", str(tmp_path / "d.html")]) == 0
    cells = json.loads((tmp_path / "d.json").read_text())["Cells"]
    assert [(c["row"], c["col"], c["field"], c["before"], c["after"]) for c in cells] == [(8, 3, "value", "7", "9"), (11, 5, "formula", "=B11/3", "=B11/4")]
    assert main(["scan", a, "--out", str(out), "--fail-on", "error"]) == 1
    found = json.loads((out / "findings.json").read_text())
    assert found["findings"][0]["severity"] == "error" and found["summary"]["total"] == len(found["findings"]) == 6
    assert json.loads((out / "results.sarif").read_text())["version"] == "2.1.0" and json.loads((out / "snapshot.json").read_text())["cells"] and "<table>" in (out / "report.html").read_text()
