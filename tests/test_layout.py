import pandas as pd
from pyspark.sql import functions as F

from gridwarden.functions.formula import LAST_COL, LAST_ROW, reach
from gridwarden.operators import layout


def test_reach():
    assert reach("=SUM($B$2:A1)+'It''s'!C3") == (False, [(None, 1, 1, 2, 2), ("it's", 3, 3, 3, 3)])
    assert reach("=SUM(B:C)+SUM(3:2)") == (False, [(None, 1, 2, LAST_ROW, 3), (None, 2, 1, 3, LAST_COL)])
    assert reach("='[Book.xlsx]S'!A1") == (False, [])
    for blind in ("=OFFSET(A1,1,1)", "=Rate*2", "=SUM(Table1[Amount])", "=SUM(Jan:Mar!A1)"):
        assert reach(blind)[0]


def test_trimming():
    full = [(r, 1, 6) for r in range(2, 8)]
    frame = lambda rows: pd.DataFrame(rows, columns=["row", "start", "end"])
    assert layout.trimmed(frame([(1, 1, 2), *full, (8, 5, 6)]), (1, 8, 1, 6)) == (2, 7, 1, 6)
    assert layout.trimmed(frame([(r, 1, 7 if r == 4 else 6) for r in range(2, 8)]), (2, 7, 1, 7)) == (2, 7, 1, 6)
    assert layout.trimmed(frame([(r, r, r) for r in range(1, 9)]), (1, 8, 1, 8)) is None


def test_room_beside_a_text(spark):
    rows = [("s", 1, 2, True, None, None), ("s", 1, 5, True, None, None), ("s", 2, 2, True, None, "thin"), ("s", 3, 2, True, None, None), ("s", 3, 3, False, "thin", None), ("s", 4, 2, True, None, None), ("s", 4, 4, False, None, "thin")]
    cells = spark.createDataFrame(rows, "sheet string, row int, col int, filled boolean, left string, right string")
    columns = spark.createDataFrame([("s", 3, 10.0, False), ("s", 4, 20.0, True)], "sheet string, col int, width double, hidden boolean")
    edges = layout.column_edges(columns, spark.createDataFrame([("s", 5)], "sheet string, max_col int"))
    got = {r["row"]: (r["room_left"], r["room_right"]) for r in layout.overflow_room(cells, edges).where("col = 2").collect()}
    assert got == {1: (8.43, 10.0), 2: (8.43, 0.0), 3: (8.43, 0.0), 4: (8.43, 10.0)}


def bordered(spark, rows, density=1.0):
    cells = spark.createDataFrame(rows, "sheet string, row long, col long, left string, right string, top string, bottom string")
    regions = spark.createDataFrame([("s", 1, 5, 1, 5, density)], "sheet string, min_row long, max_row long, min_col long, max_col long, density double")
    boxes = layout.bordered_boxes(cells.select("sheet", "row", "col", F.coalesce("left", "right", "top", "bottom").isNotNull().alias("bordered")), regions)
    return sorted((r["row"], r["col"], r["side"], r["share"], r["source"]) for r in layout.border_gaps(cells, boxes, cells).collect())


def test_border_gaps(spark):
    def table(without=(), gone=()):
        return [("s", r, c, *["thin" if (r, c, side) not in without else None for side in layout.SIDES]) for r in range(1, 6) for c in range(1, 6) if (r, c) not in gone]

    assert bordered(spark, table()) == []
    assert bordered(spark, table({(2, 2, "right")})) == []  # its neighbour draws the line
    assert bordered(spark, table({(2, 2, "right"), (2, 3, "left")})) == [(2, 2, "right", 1.0, "B1")]
    assert bordered(spark, table({(2, 2, "right"), (2, 3, "left"), (2, 3, "bottom"), (3, 3, "top")})) == [(2, 3, "bottom", 1.0, "A2"), (2, 3, "left", 1.0, "C1")]
    assert [g[1:4] for g in bordered(spark, table({(5, c, "bottom") for c in (1, 2)}))] == [(1, "bottom", 0.75), (2, "bottom", 0.75)]
    assert bordered(spark, table({(5, c, "bottom") for c in (1, 2, 3)})) == []
    hole = table({(2, 2, "right"), (4, 2, "right")}, {(3, 3)})
    assert all(g[:2] != (3, 3) for g in bordered(spark, hole))
    assert bordered(spark, [], 1.0) == []


def test_tails_and_whole_columns(spark):
    box = "sheet string, min_row long, max_row long, min_col long, max_col long"
    tails = spark.createDataFrame([("A", 10, 12, 5, 5), ("B", 10, 500_000, 5, 5), ("C", 10, 12, 5, 5)], box)
    met = layout.intersecting(tails, spark.createDataFrame([("A", 1, 1_048_576, 5, 7), ("B", 400_000, 400_001, 1, 9), ("C", 13, 20, 1, 9)], box)).collect()
    assert sorted(r["sheet"] for r in met) == ["A", "B"]
    formulas = spark.createDataFrame([("C", "=SUM(E:E)"), ("A", None), ("A", "=c!E1")], "sheet string, formula string")
    got = {r["sheet"]: (r["structure"], r["reached"]) for r in layout.blocked_tails(tails, tails.limit(0), formulas).collect()}
    assert got == {"A": (False, False), "B": (False, False), "C": (False, True)}
    blind = formulas.unionByName(spark.createDataFrame([("A", '=INDIRECT("A1")')], formulas.schema))
    assert all(r["reached"] for r in layout.blocked_tails(tails, tails.limit(0), blind).collect())
    assert layout.blocked_tails(tails.limit(0), tails, formulas).count() == 0
