"""Queries of the layout rules, with DuckDB SQL that computes the rule on the same planted sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwarden.operators import layout
from gridwarden.plans.registry import query, sql_finding, table


def column_finding(rule: str, sheet: str, location: str, told_by: str = "NULL") -> str:
    """SQL of a finding's id where the sheet is a column."""
    return f"'finding-' || substr(sha256(to_json(['{rule}', {sheet}, {location}, {told_by}])::VARCHAR), 1, 16)"


# Names of parts in column B, eight rows a sheet: aligned in four ways, beside values, borders and wide columns.
TEXTS = """t AS (SELECT p_partkey AS k, 's' || (p_partkey // 8) AS sheet, p_partkey % 8 + 1 AS row, CASE WHEN p_partkey % 6 = 5 THEN p_name || chr(10) || p_name ELSE p_name END AS text, ['general', 'right', 'center', 'left'][1 + p_partkey % 4] AS align FROM part),
m AS (SELECT *, text LIKE '%' || chr(10) || '%' AS lines, (length(split_part(text, chr(10), 1)) - 0.5 * (length(split_part(text, chr(10), 1)) - length(replace(split_part(text, chr(10), 1), ' ', '')))) + 1.0 AS width FROM t),
r AS (SELECT *, CASE WHEN k % 3 = 0 THEN 0.0 WHEN k % 5 = 0 THEN 6.0 WHEN k % 2 = 0 THEN 6.0 END AS room_right, CASE WHEN k % 7 = 0 THEN 0.0 ELSE 3.0 END AS room_left FROM m),
i AS (SELECT *, CASE WHEN lines AND 29.5 > 2.0 + CASE WHEN k % 4 = 1 THEN 27.0 WHEN k % 4 = 3 THEN 28.0 END THEN 'vertical' WHEN NOT lines AND width >= 1.1 * 8.43 AND CASE align WHEN 'right' THEN room_left < width - 8.43 WHEN 'center' THEN room_left < width - 8.43 OR coalesce(room_right < width - 8.43, false) ELSE coalesce(room_right < width - 8.43, false) END THEN 'horizontal' END AS issue FROM r)"""


def planted_texts(spark, d):
    """Column A is 3 wide, B the default, C 6, D the default. Some C hold a value, some B a right border and a value of C is
    far behind it, some D hold a value; some A have a right border. Every sixth text has two lines, below a row of a set height."""
    k = F.col("p_partkey")
    part = table(spark, d, "part").select(k, "p_name", F.concat(F.lit("s"), F.floor(k / 8).cast("string")).alias("sheet"), (k % 8 + 1).alias("row"))
    name = F.when(k % 6 == 5, F.concat("p_name", F.lit("\n"), "p_name")).otherwise(F.col("p_name"))
    none = F.lit(None).cast("string")
    cell = lambda col, filled, left, right: F.struct(F.lit(col).alias("col"), filled.alias("filled"), left.alias("left"), right.alias("right"))
    cells = part.withColumn("c", F.explode(F.array(
        cell(1, F.lit(False), none, F.when(k % 7 == 0, "thin")), cell(2, F.lit(True), none, none), cell(3, k % 3 == 0, none, F.when(k % 5 == 0, "thin")), cell(4, k % 2 == 0, none, none),
    ))).select("p_partkey", "sheet", "row", name.alias("text"), "c.*")
    columns = part.select("sheet").distinct().withColumn("c", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(w).alias("width")) for c, w in ((1, 3.0), (3, 6.0))]))).select("sheet", "c.*", F.lit(False).alias("hidden"))
    edges = layout.column_edges(columns, part.select("sheet", F.lit(4).alias("max_col")).distinct())
    texts = layout.overflow_room(cells, edges).where("col = 2")
    align = F.element_at(F.array(*map(F.lit, ("general", "right", "center", "left"))), (1 + k % 4).cast("int"))
    height = F.when(k % 4 == 1, 27.0).when(k % 4 == 3, 28.0)
    return texts.select("sheet", "row", "col", "text", F.lit(None).cast("double").alias("size"), F.lit(False).alias("bold"), F.lit(False).alias("wrap"), align.alias("align"), F.lit(8.43).alias("room"), height.alias("height"), F.lit(False).alias("merged"), "room_left", "room_right")


@query(f"WITH {TEXTS} SELECT {column_finding('WL016', 'sheet', chr(39) + 'B' + chr(39) + ' || row', 'issue')} AS id, 'WL016' AS rule_id, 'warning' AS severity, 'B' || row AS location, 0.96 AS confidence, sheet, issue FROM i WHERE issue IS NOT NULL")
def text_risks(spark, d):
    return layout.text_findings(layout.text_risks(planted_texts(spark, d)))


@query(
    f"WITH {TEXTS}, g AS (SELECT sheet, count(*) AS n, max(width) AS most, min(row) AS row FROM i WHERE issue = 'horizontal' GROUP BY sheet HAVING count(*) >= 3 AND max(width) <= 40),"
    " p AS (SELECT sheet, row, greatest(ceil(most * 4) / 4, ceil(8.93 * 4) / 4) AS value FROM g) SELECT sheet, row, value FROM p WHERE value > 8.43 + 0.25"
)
def width_patches(spark, d):
    risks = layout.text_risks(planted_texts(spark, d))
    return layout.text_patches(risks).where("kind = 'set_column_width'").select("sheet", "row", "value")


@query(f"WITH {TEXTS}, v AS (SELECT sheet, row, bool_or(issue = 'horizontal') AS wraps FROM i WHERE issue = 'vertical' GROUP BY ALL) SELECT sheet, row, 29.5 AS value FROM v")
def height_patches(spark, d):
    """Rows of two lines each, which need 29.5 points; no text runs over in those rows."""
    risks = layout.text_risks(planted_texts(spark, d)).where("issue = 'vertical'")
    return layout.text_patches(risks).where("kind = 'set_row_height' AND atomic_group IS NULL").select("sheet", "row", "value")


# Tables of five rows and four columns, all sides thin but for some.
BORDERS = """p AS (SELECT p_partkey // 20 AS b, p_partkey % 20 AS spot FROM part),
c AS (SELECT 's' || b AS sheet, 1 + spot // 4 AS row, 1 + spot % 4 AS col, CASE WHEN (b % 3 = 0 AND spot = 10) OR (b % 6 = 0 AND spot = 2) THEN NULL ELSE 'thin' END AS l,
   CASE WHEN (b % 3 IN (0, 1) AND spot = 9) OR (b % 6 = 0 AND spot = 1) THEN NULL ELSE 'thin' END AS r, CASE WHEN b % 7 = 3 AND spot < 2 THEN NULL ELSE 'thin' END AS t, CASE WHEN (b % 3 = 2 AND spot = 17) OR (b % 5 = 0 AND spot = 18) THEN NULL ELSE 'thin' END AS u FROM p),
s AS (SELECT sheet, row, col, unnest([{'side': 'left', 'own': l, 'way': 'v', 'ar': row, 'ac': col - 1}, {'side': 'right', 'own': r, 'way': 'v', 'ar': row, 'ac': col}, {'side': 'top', 'own': t, 'way': 'h', 'ar': row - 1, 'ac': col}, {'side': 'bottom', 'own': u, 'way': 'h', 'ar': row, 'ac': col}]) AS x FROM c),
e AS (SELECT sheet, x.way, x.ar, x.ac, max(x.own) AS style FROM s GROUP BY ALL),
q AS (SELECT s.sheet, row, col, x.side, e.way, e.ar, e.ac, e.style, CASE WHEN x.side IN ('left', 'right') THEN col ELSE row END AS line, count(*) FILTER (e.style IS NULL) OVER (PARTITION BY s.sheet, row, col) AS missing FROM s JOIN e ON e.sheet = s.sheet AND e.way = x.way AND e.ar = x.ar AND e.ac = x.ac),
n AS (SELECT sheet, side, line, count(*) - 1 AS others, count(style) AS drawn FROM q GROUP BY ALL),
h AS (SELECT q.*, drawn / others AS share FROM q JOIN n USING (sheet, side, line) WHERE q.style IS NULL AND others >= 2 AND drawn >= 2 AND drawn >= 0.75 * others),
g AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY sheet, way, ar, ac ORDER BY missing DESC, row, col) = 1)"""


def planted_borders(spark, d):
    """Lines missing from both cells, from one only, in two rows of a column, in one cell and in two of a row's foot or head."""
    k = F.col("p_partkey")
    b, at = F.floor(k / 20), k % 20
    side = lambda bare: F.when(~bare, "thin")
    cells = table(spark, d, "part").select(
        F.concat(F.lit("s"), b.cast("string")).alias("sheet"), (1 + F.floor(at / 4)).alias("row"), (1 + at % 4).alias("col"), side((b % 3 == 0) & (at == 10) | (b % 6 == 0) & (at == 2)).alias("left"),
        side((b % 3).isin(0, 1) & (at == 9) | (b % 6 == 0) & (at == 1)).alias("right"), side((b % 7 == 3) & (at < 2)).alias("top"), side((b % 3 == 2) & (at == 17) | (b % 5 == 0) & (at == 18)).alias("bottom"),
    )
    boxes = cells.groupBy("sheet").agg(F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col")).withColumn("density", F.lit(1.0))
    bordered = layout.bordered_boxes(cells.select("sheet", "row", "col", F.coalesce(*layout.SIDES).isNotNull().alias("bordered")), boxes)
    return layout.border_gaps(cells, bordered, cells)


@query(f"WITH {BORDERS}, f AS (SELECT sheet, chr(CAST(64 + col AS INT)) || row AS location, round(min(share), 6) AS confidence, string_agg(side, ',' ORDER BY list_position(['left', 'right', 'top', 'bottom'], side)) AS sides FROM g GROUP BY sheet, row, col) SELECT {column_finding('WL017', 'sheet', 'location', 'sides')} AS id, 'WL017' AS rule_id, 'warning' AS severity, location, confidence, sheet, sides FROM f")
def border_edges(spark, d):
    return layout.border_findings(planted_borders(spark, d))


@query(f"WITH {BORDERS}, w AS (SELECT *, min(share) OVER (PARTITION BY sheet, row, col) AS least FROM g) SELECT sheet, row, col, side, share AS confidence FROM w WHERE least >= 0.95")
def border_patches(spark, d):
    return layout.border_patches(planted_borders(spark, d)).select("sheet", "row", "col", "side", "confidence")


# Tails.
BLANKS = "c AS (SELECT p_partkey // 20 AS b, 10 * (p_partkey // 20) + (p_partkey % 20) // 4 AS row, CASE (p_partkey // 20) % 4 WHEN 1 THEN 7 ELSE 8 END + p_partkey % 4 AS col FROM part WHERE (p_partkey // 20) % 4 < 2 OR ((p_partkey // 20) % 4 = 2 AND p_partkey % 20 IN (3, 7)) OR ((p_partkey // 20) % 4 = 3 AND p_partkey % 20 IN (3, 7, 11)))"


@query(f"WITH {BLANKS} SELECT min(row) AS min_row, max(row) AS max_row, min(col) AS min_col, max(col) AS max_col, count(*) AS cells FROM c GROUP BY b HAVING count(*) BETWEEN 3 AND 4096 AND (max(col) = 11 OR max(row) = (SELECT max(row) FROM c))")
def whitespace_tail(spark, d):
    """Blocks of white space right of a content of six columns: some touch the last column, some don't, some have two cells."""
    k = F.col("p_partkey")
    b, at = F.floor(k / 20), k % 20
    kept = (b % 4 < 2) | (b % 4 == 2) & at.isin(3, 7) | (b % 4 == 3) & at.isin(3, 7, 11)
    cells = table(spark, d, "part").where(kept).select(F.lit("s").alias("sheet"), (10 * b + F.floor(at / 4)).alias("row"), (F.when(b % 4 == 1, 7).otherwise(8) + k % 4).alias("col"))
    box = lambda rows, cols: spark.range(1).select(F.lit("s").alias("sheet"), *[F.lit(x).cast("long").alias(n) for n, x in zip(layout.BOX, (1, rows, 1, cols), strict=True)])
    shown = layout.envelope(spark.range(1, 7).select(F.lit("s").alias("sheet"), F.lit(1).alias("row"), F.col("id").alias("col"), F.lit(True).alias("shown")), box(10**6, 6))
    bounds = layout.bounds_without(cells, cells.limit(0))
    return layout.whitespace_tails(cells, shown, bounds).drop("sheet")


@query(
    "WITH s AS (SELECT s_suppkey AS k, 'Sheet ' || s_suppkey AS sheet FROM supplier), b AS (SELECT *, k % 3 = 0 AS structure, coalesce((k - 1) % 4 = 0 AND (k - 1) IN (SELECT s_suppkey FROM supplier), false) AS reached, k % 11 <> 5 AND NOT k % 13 = 4 AND k % 5 <> 1 AND k % 17 <> 2 AS fine FROM s)"
    f" SELECT {column_finding('WL021', 'sheet', chr(39) + 'E10:E12' + chr(39))} AS id, 'WL021' AS rule_id, 'warning' AS severity, 'E10:E12' AS location, CASE WHEN fine AND NOT structure AND NOT reached THEN 0.99 ELSE 0.90 END AS confidence, sheet, fine AND NOT structure AND NOT reached AS remove FROM b"
)
def whitespace_findings(spark, d):
    """A tail in each sheet; some meet a merge, to some a formula of the sheet before reaches, some sheets are hidden or protected."""
    k = F.col("s_suppkey")
    supplier = table(spark, d, "supplier").select(k, F.concat(F.lit("Sheet "), k.cast("string")).alias("sheet"))
    box = lambda df, *at: df.select("sheet", *[F.lit(x).cast("long").alias(n) for n, x in zip(layout.BOX, at, strict=True)])
    formulas = supplier.where(k % 4 == 0).select("sheet", F.concat(F.lit("=SUM('sheet "), (k + 1).cast("string"), F.lit("'!$E$11:F99)+E1")).alias("formula"))
    tails = layout.blocked_tails(box(supplier, 10, 12, 5, 5), box(supplier.where(k % 3 == 0), 12, 13, 5, 6), formulas)
    sheets = supplier.select("sheet", F.when(k % 11 == 5, "hidden").otherwise("visible").alias("state"), (k % 13 == 4).alias("protected"), (k % 5 != 1).alias("declared"), (k % 17 == 2).alias("formatting_tail"))
    return layout.whitespace_findings(tails, sheets)


@query(
    "WITH s AS (SELECT s_suppkey AS k, 'Sheet ' || s_suppkey AS sheet, 20 + s_suppkey % 4 AS dr, CASE WHEN s_suppkey % 6 = 0 THEN NULL WHEN s_suppkey % 6 = 1 THEN 9 ELSE 8 END AS dc FROM supplier), h AS (SELECT *, coalesce(dc = 8 AND dr >= 21 AND dr <= 22, false) AS holds FROM s)"
    f" SELECT {column_finding('WL018', 'sheet', chr(39) + 'E10:H13,E20:H21' + chr(39))} AS id, 'WL018' AS rule_id, 'warning' AS severity, 'E10:H13,E20:H21' AS location, CASE WHEN holds THEN 0.99 ELSE 0.90 END AS confidence, sheet, holds AND k % 3 <> 0 AND k % 7 <> 1 AS clear FROM h"
)
def used_range(spark, d):
    """Two tails in each sheet, with declared dimensions that hold, are too small, too large or missing."""
    k = F.col("s_suppkey")
    supplier = table(spark, d, "supplier").select(k, F.concat(F.lit("Sheet "), k.cast("string")).alias("sheet"))
    box = lambda df, *at: df.select("sheet", *[F.lit(x).cast("long").alias(n) for n, x in zip(layout.BOX, at, strict=True)])
    tails = layout.blocked_tails(box(supplier, 20, 21, 5, 8).unionByName(box(supplier, 10, 13, 5, 8)), box(supplier.where(k % 3 == 0), 1, 1_048_576, 8, 8))
    declared_col = F.when(k % 6 == 1, 9).when(k % 6 != 0, 8)
    sheets = supplier.select("sheet", (k % 7 == 1).alias("protected"), (20 + k % 4).alias("declared_row"), declared_col.alias("declared_col"), F.lit(22).alias("last_row"), F.lit(8).alias("last_col"), F.lit(5).alias("content_row"))
    return layout.used_range(tails, sheets)


@query(
    "WITH c AS (SELECT c_custkey AS k, 'S' || c_custkey AS sheet, 1 + k % 3 AS top0, CASE k % 5 WHEN 0 THEN 'frozen' WHEN 1 THEN 'split' END AS pane, 1 + k % 4 AS seen, CASE k % 4 WHEN 0 THEN NULL ELSE 40 + 35 * (k % 7) END AS zoom, 60.0 + 37 * (k % 11) AS width, 90.0 + 150 * (k % 8) AS height, 10 + 12 * (k % 4) AS rows FROM customer),"
    " z AS (SELECT *, coalesce(zoom, 100) AS saved, CAST(floor(110.0 / width * 20) * 5 AS BIGINT) AS wide, CAST(floor(360.0 / height * 20) * 5 AS BIGINT) AS high, top0 + CASE WHEN pane = 'frozen' THEN 2 ELSE 0 END AS want, rows <= 40 AS small FROM c),"
    " b AS (SELECT *, CASE WHEN least(wide, high) >= 50 THEN least(400, wide, high) WHEN high < 50 AND wide >= 50 AND zoom IS NOT NULL AND saved > 100 THEN least(400, wide) END AS best, seen > want AND coalesce(pane, 'frozen') = 'frozen' AS off FROM z),"
    " t AS (SELECT *, CASE WHEN coalesce(pane, 'frozen') = 'frozen' AND NOT (off AND pane IS NOT NULL) AND saved > best AND saved > greatest(50, best - 5) THEN greatest(50, best - 5) END AS zoom_to FROM b WHERE k % 9 <> 0 AND (off OR coalesce(saved > best, false) OR (small AND wide < 50)))"
    f" SELECT {column_finding('WL020', 'sheet', chr(39) + 'A' + chr(39) + ' || seen')} AS id, 'WL020' AS rule_id, 'warning' AS severity, 'A' || seen AS location, 0.99 AS confidence, sheet, CASE WHEN pane IS NULL AND (off OR zoom_to IS NOT NULL) THEN 'A' || top0 END AS origin, CAST(zoom_to AS INT) AS zoom_to FROM t"
)
def saved_views(spark, d):
    """Customers as sheets of many sizes, zooms, panes and first rows; every ninth is hidden."""
    k = F.col("c_custkey")
    top = 1 + k % 3
    pane = F.when(k % 5 == 0, "frozen").when(k % 5 == 1, "split")
    sheets = table(spark, d, "customer").select(
        F.concat(F.lit("S"), k.cast("string")).alias("sheet"), F.when(k % 9 == 0, "hidden").otherwise("visible").alias("state"), top.alias("min_row"), (top + 9 + 12 * (k % 4)).alias("max_row"), F.lit(1).alias("min_col"), F.lit(5).alias("max_col"),
        F.when(k % 5 == 0, 1).otherwise(1 + k % 4).alias("top"), F.lit(1).alias("left"), pane.alias("pane"), F.when(k % 5 == 0, 2.0).alias("pane_rows"), F.lit(None).cast("double").alias("pane_cols"),
        (1 + k % 4).alias("pane_top"), F.lit(1).alias("pane_left"), F.when(k % 4 != 0, 40 + 35 * (k % 7)).alias("zoom"), F.concat(k.cast("string"), F.lit("w")).alias("place"), (60.0 + 37 * (k % 11)).alias("width"), (90.0 + 150 * (k % 8)).alias("height"),
    )
    return layout.saved_views(sheets.drop("place"))
