"""Layout: texts that don't fit, gaps in borders, tails that inflate a sheet, and saved views away from the content.

Sheets' structures (merges, tables, filters, validations, conditional formats, print ranges, names) come as one table of
boxes(sheet, kind, min_row, max_row, min_col, max_col), columns and rows with set sizes as tables of their own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.functions.formula import LAST_COL, reached
from gridwarden.functions.identity import stable_id
from gridwarden.functions.width import COLUMN, ROW, text_size
from gridwarden.operators.rules import findings
from gridwarden.operators.runs import address, components, content_bounds, overlapping
from gridwarden.runtime import ship_package

#: What counts as too wide or too high, the widest column and highest row proposed, the window assumed for
#: a view, the least zoom proposed, and the sizes of white space tails.
WIDE, HIGH, MOST_WIDTH, MOST_HEIGHT = 1.10, 2.0, 40.0, 409.5
VIEW_WIDTH, VIEW_HEIGHT, LEAST_ZOOM, MOST_ZOOM = 110.0, 360.0, 50, 400
LEAST_TAIL, MOST_TAIL = 3, 4096
BOX = ("min_row", "max_row", "min_col", "max_col")


def named(sheet: Column | None) -> Column:
    """The sheet's name in ids: the column sheet unless another is given, as where sheet tells workbooks apart too."""
    return sheet if sheet is not None else F.col("sheet")


def up(x: Column, step: float) -> Column:
    return F.ceil(x / step) * step


# Texts that don't fit


def column_edges(columns: DataFrame, last: DataFrame) -> DataFrame:
    """(sheet, col, width, begin, finish): where each column up to last(sheet, max_col) is drawn, from the set widths of
    columns(sheet, col, width, hidden). A hidden column takes no room. At most 16,384 rows a sheet, as the format has."""
    every = last.select("sheet", F.explode(F.sequence(F.lit(1), F.least(F.col("max_col"), F.lit(LAST_COL)).cast("int"))).alias("col"))
    known = columns.select("sheet", F.col("col").cast("int").alias("col"), F.col("width").alias("__width"), F.col("hidden").alias("__hidden"))
    wide = F.coalesce("__width", F.lit(COLUMN))
    drawn = F.when(F.coalesce("__hidden", F.lit(False)), 0.0).otherwise(wide)
    finish = F.sum(drawn).over(Window.partitionBy("sheet").orderBy("col").rowsBetween(Window.unboundedPreceding, 0))
    return every.join(known, ["sheet", "col"], "left").select("sheet", "col", wide.alias("width"), drawn.alias("__drawn"), finish.alias("finish")).withColumn("begin", F.col("finish") - F.col("__drawn")).drop("__drawn")


def overflow_room(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """cells with room_left and room_right: the width that a text may run over on each side before a value, a drawn
    border or the sheet's side stops it. cells(sheet, row, col, filled, left, right); edges: column_edges()."""
    at = cells.join(edges.select("sheet", "col", "begin", "finish"), ["sheet", "col"])
    line = Window.partitionBy("sheet", "row").orderBy("col")
    after, before = line.rowsBetween(1, Window.unboundedFollowing), line.rowsBetween(Window.unboundedPreceding, -1)
    # What a cell puts in the way of texts that come from the left, and of those that come from the right.
    stop_right = F.when(F.col("filled") | F.col("left").isNotNull(), F.col("begin")).when(F.col("right").isNotNull(), F.col("finish"))
    stop_left = F.when(F.col("filled") | F.col("right").isNotNull(), F.col("finish")).when(F.col("left").isNotNull(), F.col("begin"))
    right = F.when(F.col("right").isNotNull(), F.col("finish")).otherwise(F.min(stop_right).over(after))
    left = F.when(F.col("left").isNotNull(), F.col("begin")).otherwise(F.max(stop_left).over(before))
    return at.withColumn("room_right", right - F.col("finish")).withColumn("room_left", F.col("begin") - F.coalesce(left, F.lit(0.0))).drop("begin", "finish")


def text_risks(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, issue, width, room, height, needs): visible texts that are cut. cells(sheet, row, col, text, size,
    bold, wrap, align, room: the width of the cell or its merge, height: the set height of its row or null, merged,
    room_left, room_right: as overflow_room() gives them, null for no stop). issue: vertical, lines that a set height cuts;
    horizontal, one line that has no room to run over. needs: the height that the wrapped text takes."""
    lines = F.col("text").rlike("[\r\n]")
    sized = cells.withColumn("__as_is", text_size(cells, F.col("text"), F.col("size"), F.col("bold"), F.col("wrap"), F.col("room")))
    high = (F.col("wrap") | lines) & (F.col("__as_is.lines") >= 2) & (F.col("__as_is.height") > F.col("height") + HIGH)
    more = F.col("__as_is.width") - F.col("room")
    tight = lambda side: F.coalesce(F.col(side) < more, F.lit(False))
    align = F.lower(F.coalesce("align", F.lit("general")))
    stopped = F.when(F.col("merged"), more > 0).when(align == "right", tight("room_left")).when(align.isin("center", "centercontinuous", "distributed"), tight("room_left") | tight("room_right")).otherwise(tight("room_right"))
    long = ~F.col("wrap") & ~lines & (F.col("__as_is.width") >= WIDE * F.col("room")) & stopped
    hit = sized.withColumn("issue", F.when(F.coalesce(high, F.lit(False)), "vertical").when(F.coalesce(long, F.lit(False)), "horizontal")).where(F.col("issue").isNotNull())
    wrapped = text_size(cells, F.col("text"), F.col("size"), F.col("bold"), F.lit(True), F.col("room"))
    return hit.select("sheet", "row", "col", "issue", "merged", F.col("__as_is.width").alias("width"), "room", "height", F.when(F.col("issue") == "vertical", F.col("__as_is.height")).otherwise(wrapped["height"]).alias("needs"))


def text_findings(risks: DataFrame, sheet: Column | None = None) -> DataFrame:
    """WL016 over text_risks()."""
    return findings(risks, "WL016", "warning", named(sheet), address(F.col("row"), F.col("col")), 0.96, "issue", told_by=F.col("issue"))


def text_patches(risks: DataFrame) -> DataFrame:
    """(sheet, row, col, kind, value, atomic_group): a column with three texts or more that run over, and need no more than
    the widest column proposed, becomes as wide as they ask; other rows become as high as their texts ask, wrapped ones together with the wrapping."""
    single = (F.col("issue") == "horizontal") & ~F.col("merged")
    columns = risks.where(single).groupBy("sheet", "col").agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("most"), F.max("room").alias("now"), F.min("row").alias("row"))
    target = F.greatest(up(F.col("most"), 0.25), up(F.col("now") + 0.5, 0.25))
    wider = columns.withColumn("value", target).where((F.col("n") >= 3) & (F.col("most") <= MOST_WIDTH) & (target > F.col("now") + 0.25))
    rest = risks.join(wider.select("sheet", "col", F.lit(True).alias("__wider")), ["sheet", "col"], "left")
    rest = rest.where(~(F.coalesce("__wider", F.lit(False)) & (F.col("issue") == "horizontal")))
    rows = rest.groupBy("sheet", "row").agg(up(F.max("needs"), 0.5).alias("value"), F.coalesce(F.max("height"), F.lit(ROW)).alias("now"), F.max_by("col", F.struct("needs", -F.col("col"))).alias("col"), F.bool_or(F.col("issue") == "horizontal").alias("wraps"))
    group = F.when(F.col("wraps"), stable_id("atomic", F.lit("WL016"), F.col("sheet"), F.col("row")))
    higher = rows.withColumn("atomic_group", group).withColumn("fits", (F.col("value") <= MOST_HEIGHT) & (F.col("value") > F.col("now") + 0.5))
    wrap = rest.where("issue = 'horizontal'").select("sheet", "row", F.col("col").alias("__col"), "needs").join(higher, ["sheet", "row"]).where(F.col("fits") | (F.col("needs") <= F.col("now") + 0.5))
    out = ("sheet", "row", "col", "kind", "value", "atomic_group")
    return (
        wider.withColumn("kind", F.lit("set_column_width")).withColumn("atomic_group", F.lit(None).cast("string")).select(*out)
        .unionByName(higher.where("fits").withColumn("kind", F.lit("set_row_height")).select(*out))
        .unionByName(wrap.select("sheet", "row", F.col("__col").alias("col"), F.lit("set_wrap_text").alias("kind"), F.lit(None).cast("double").alias("value"), "atomic_group"))
    )


# Borders


def trimmed(lines: pd.DataFrame, box: tuple[int, int, int, int], least: float = 0.75) -> tuple[int, int, int, int] | None:
    """The box without outer lines that are filled less than `least`, first row, last row, first column, last column in
    turn, as long as one is; None below three lines. lines: runs (row, start, end) of filled cells, sorted."""
    top, bottom, left, right = box
    by_row: dict[int, list[tuple[int, int]]] = {}
    for row, start, end in lines.itertuples(index=False):
        by_row.setdefault(row, []).append((start, end))

    def across(row: int) -> float:
        return sum(max(0, min(e, right) - max(s, left) + 1) for s, e in by_row.get(row, ())) / (right - left + 1)

    def down(col: int) -> float:
        return sum(any(s <= col <= e for s, e in by_row.get(row, ())) for row in range(top, bottom + 1)) / (bottom - top + 1)

    while bottom - top >= 2 and right - left >= 2:
        if across(top) < least:
            top += 1
        elif across(bottom) < least:
            bottom -= 1
        elif down(left) < least:
            left += 1
        elif down(right) < least:
            right -= 1
        else:
            return top, bottom, left, right
    return None


def bordered_boxes(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """(sheet, box, confidence): regions(sheet, box, density), trimmed, that are at least three by three, twelve cells, filled
    to 0.75 and bordered to 0.60. cells(sheet, row, col, bordered): those filled or styled, visible and in no merge.

    The trimming goes one line at a time, so one task takes a region, as runs along its rows."""
    ship_package(cells.sparkSession)
    named = regions.select("sheet", *BOX, F.col("density").alias("__density"))
    line = Window.partitionBy("sheet", *BOX, "row").orderBy("col")
    inside = overlapping(cells.select("sheet", "row", "col"), named)
    grouped = inside.withColumn("__run", F.col("col") - F.row_number().over(line)).groupBy("sheet", *BOX, "__density", "row", "__run").agg(F.min("col").cast("long").alias("start"), F.max("col").cast("long").alias("end"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        box = trimmed(pdf[["row", "start", "end"]].sort_values(["row", "start"]), tuple(int(pdf[c].iloc[0]) for c in BOX))
        return pd.DataFrame([(pdf["sheet"].iloc[0], *box, pdf["__density"].iloc[0])] if box else [], columns=["sheet", *BOX, "__density"])

    kept = grouped.withColumn("row", F.col("row").cast("long")).groupBy("sheet", *BOX).applyInPandas(cut, "sheet string, min_row long, max_row long, min_col long, max_col long, __density double")
    area = (F.col("max_row") - F.col("min_row") + 1) * (F.col("max_col") - F.col("min_col") + 1)
    filled = overlapping(cells, kept).groupBy("sheet", *BOX, "__density").agg((F.count(F.lit(1)) / F.first(area)).alias("__filled"), (F.count(F.when(F.col("bordered"), 1)) / F.first(area)).alias("__drawn"))
    return filled.where((area >= 12) & (F.col("__filled") >= 0.75) & (F.col("__drawn") >= 0.60)).select("sheet", *BOX, F.least("__density", "__filled").alias("confidence"))


#: Sides of a cell: the line it lies on as (direction, rows back, columns back), and whether peers lie down the column.
SIDES = {"left": ("v", 0, 1, True), "right": ("v", 0, 0, True), "top": ("h", 1, 0, False), "bottom": ("h", 0, 0, False)}


def cell_sides(cells: DataFrame) -> DataFrame:
    """(cells' columns, side, own, way, at_row, at_col): the four sides of each cell and the grid line each lies on."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("own"), F.lit(w).alias("way"), (F.col("row") - r).alias("at_row"), (F.col("col") - c).alias("at_col"), F.lit(down).alias("down")) for s, (w, r, c, down) in SIDES.items()])
    return cells.withColumn("__s", F.explode(sides)).select(*[c for c in cells.columns if c not in SIDES], "__s.*")


def border_gaps(cells: DataFrame, boxes: DataFrame, drawn: DataFrame) -> DataFrame:
    """(sheet, row, col, side, share, expected, source): sides drawn from neither cell though parallel ones of the same row or
    column are drawn alike, two or more and 0.75 of them. cells(sheet, row, col, left, right, top, bottom): filled or styled,
    visible, in no merge, each side a text or null. boxes: bordered_boxes(). drawn: all cells with their sides, hidden or not.

    An edge that two cells share is reported once, for the cell with more sides missing, then the upper, then the left one. An
    empty place inside a box of confidence 0.95, among four such cells, counts as a cell without sides."""
    edge = ["sheet", "way", "at_row", "at_col"]
    seen = cell_sides(drawn.select("sheet", "row", "col", *SIDES)).where(F.col("own").isNotNull()).groupBy(*edge).agg(F.max("own").alias("style"))
    inside = overlapping(cells.select("sheet", "row", "col", *SIDES), boxes).withColumn("real", F.lit(True))
    box = [*BOX, "confidence"]
    steps = F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    around = inside.select("sheet", *box, F.explode(steps).alias("p")).select("sheet", *box, "p.row", "p.col").groupBy("sheet", *box, "row", "col").agg(F.count(F.lit(1)).alias("n"))
    within = F.col("row").between(F.col("min_row") + 1, F.col("max_row") - 1) & F.col("col").between(F.col("min_col") + 1, F.col("max_col") - 1)
    holes = around.where((F.col("n") == 4) & (F.col("confidence") >= 0.95) & within).join(cells.select("sheet", "row", "col"), ["sheet", "row", "col"], "left_anti").drop("n")
    holes = holes.withColumns({s: F.lit(None).cast("string") for s in SIDES}).withColumn("real", F.lit(False))
    sides = cell_sides(inside.unionByName(holes)).join(seen, edge, "left").drop("own")
    own = Window.partitionBy("sheet", "row", "col", *BOX)
    sides = sides.withColumn("missing", F.count(F.when(F.col("style").isNull(), 1)).over(own)).withColumn("line", F.when(F.col("down"), F.col("col")).otherwise(F.col("row")))
    inner = F.when(F.col("side") == "left", F.col("col") > F.col("min_col")).when(F.col("side") == "right", F.col("col") < F.col("max_col")).when(F.col("side") == "top", F.col("row") > F.col("min_row")).otherwise(F.col("row") < F.col("max_row"))
    by = ["sheet", *BOX, "side", "line"]
    real = sides.where("real")
    peers = real.groupBy(*by).agg(F.count(F.lit(1)).alias("population"))
    styles = real.where(F.col("style").isNotNull()).groupBy(*by, "style").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "col")).alias("first"))
    modal = styles.groupBy(*by).agg(F.max("n").alias("n"), F.max_by(F.struct("style", "first"), F.struct(F.col("n"), -F.col("first.row"), -F.col("first.col"))).alias("top"))
    others = F.col("population") - F.col("real").cast("long")
    open_ = sides.where(F.col("style").isNull()).drop("style").withColumn("inner", inner)
    to = F.col("side")
    far = F.struct((F.col("row") + F.when(to == "top", -1).when(to == "bottom", 1).otherwise(0)).alias("row"), (F.col("col") + F.when(to == "left", -1).when(to == "right", 1).otherwise(0)).alias("col"))
    neighbour = cells.select("sheet", F.struct(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).alias("far"), F.lit(True).alias("backed")).distinct()
    open_ = open_.withColumn("far", F.struct(far["row"].cast("long").alias("row"), far["col"].cast("long").alias("col"))).join(neighbour, ["sheet", "far"], "left").where(~F.col("inner") | F.col("backed"))
    agreed = open_.join(peers, by).join(modal, by).withColumn("share", F.col("n") / others).where((others >= 2) & (F.col("n") >= 2) & (F.col("share") >= 0.75))
    once = F.row_number().over(Window.partitionBy(*edge).orderBy(F.desc("missing"), "row", "col"))
    return agreed.withColumn("__n", once).where("__n = 1").select("sheet", "row", "col", "side", "share", F.col("top.style").alias("expected"), address(F.col("top.first.row"), F.col("top.first.col")).alias("source"))


def border_findings(gaps: DataFrame, sheet: Column | None = None) -> DataFrame:
    """WL017 over border_gaps(): one finding a cell, of its least share."""
    order = F.array(*map(F.lit, SIDES))
    cells = gaps.groupBy("sheet", "row", "col").agg(F.min("share").alias("share"), F.collect_set("side").alias("__sides"))
    sides = F.concat_ws(",", F.filter(order, lambda s: F.array_contains(F.col("__sides"), s)))
    return findings(cells, "WL017", "warning", named(sheet), address(F.col("row"), F.col("col")), F.round("share", 6), sides.alias("sides"), told_by=sides)


def border_patches(gaps: DataFrame) -> DataFrame:
    """(sheet, row, col, kind, side, source, confidence, atomic_group): a copied edge for each gap of a cell whose least
    share is 0.95 or more, atomic if there are several."""
    own = Window.partitionBy("sheet", "row", "col")
    sure = gaps.withColumn("__least", F.min("share").over(own)).withColumn("__n", F.count(F.lit(1)).over(own)).where(F.col("__least") >= 0.95)
    group = F.when(F.col("__n") > 1, stable_id("atomic-border", F.lit("WL017"), F.col("sheet"), address(F.col("row"), F.col("col"))))
    return sure.select("sheet", "row", "col", F.lit("copy_border").alias("kind"), "side", "source", F.col("share").alias("confidence"), group.alias("atomic_group"))


# Tails


def envelope(cells: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """(sheet, box) of what a sheet shows: cells(sheet, row, col, shown) that show something, and structures' boxes. White space
    shows nothing."""
    return content_bounds(cells.where("shown"), boxes)


def whitespace_tails(cells: DataFrame, shown: DataFrame, bounds: DataFrame) -> DataFrame:
    """(sheet, box, cells): components of cells(sheet, row, col) that hold literal white space, are visible and in no merge,
    beyond the envelope shown(sheet, box), of 3 to 4,096 cells, and touch the last row or column of bounds(sheet, box)."""
    limits = shown.select("sheet", F.col("max_row").alias("__row"), F.col("max_col").alias("__col"))
    beyond = cells.join(limits, "sheet").where((F.col("row") > F.col("__row")) | (F.col("col") > F.col("__col")))
    last = bounds.select("sheet", F.col("max_row").alias("__row"), F.col("max_col").alias("__col"))
    found = components(beyond.select("sheet", "row", "col")).join(last, "sheet")
    return found.where(F.col("cells").between(LEAST_TAIL, MOST_TAIL) & ((F.col("max_row") == F.col("__row")) | (F.col("max_col") == F.col("__col")))).select("sheet", *BOX, "cells")


def bounds_without(cells: DataFrame, gone: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """content_bounds() of cells(sheet, row, col) without gone(sheet, row, col). A sheet left empty has no row."""
    return content_bounds(cells.join(gone.select("sheet", "row", "col"), ["sheet", "row", "col"], "left_anti"), merges)


def intersecting(boxes: DataFrame, others: DataFrame, bin_rows: int = 1024) -> DataFrame:
    """boxes(sheet, box, ...) that intersect any of others(sheet, box): an equi-join on bins of rows. A box over more than
    64 bins, such as a whole column, is compared apart by sheet, so it isn't copied a thousand times."""
    named = others.select("sheet", *[F.col(c).alias(f"__{c}") for c in BOX])
    bins = lambda a, b: F.sequence(F.floor(F.col(a) / bin_rows), F.floor(F.col(b) / bin_rows))
    large = lambda a, b: F.floor(F.col(b) / bin_rows) - F.floor(F.col(a) / bin_rows) > 64
    meet = (F.col("min_row") <= F.col("__max_row")) & (F.col("max_row") >= F.col("__min_row")) & (F.col("min_col") <= F.col("__max_col")) & (F.col("max_col") >= F.col("__min_col"))
    keyed = boxes.withColumn("__id", F.struct("sheet", *BOX))
    here, tall = keyed.where(~large("min_row", "max_row")), keyed.where(large("min_row", "max_row"))
    there, high = named.where(~large("__min_row", "__max_row")), named.where(large("__min_row", "__max_row"))
    near = here.withColumn("__bin", F.explode(bins("min_row", "max_row"))).join(there.withColumn("__bin", F.explode(bins("__min_row", "__max_row"))), ["sheet", "__bin"]).where(meet).select("__id")
    by_sheet = here.join(high.distinct(), "sheet").where(meet).select("__id").unionByName(tall.join(named.distinct(), "sheet").where(meet).select("__id"))
    return keyed.join(near.unionByName(by_sheet).distinct(), "__id", "left_semi").drop("__id")


def workbook_of(sheet: Column) -> Column:
    """What stands before a NUL in a sheet's key, with the NUL: the workbook, if the key names one. Else empty."""
    return F.regexp_extract(sheet, "(?s)^(.*\0)?", 0)


def folded(sheet: Column) -> Column:
    """A sheet's key with its own name in lower case, as formulas may write it."""
    return F.concat(workbook_of(sheet), F.lower(F.substring_index(sheet, "\0", -1)))


def formula_reach(formulas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boxes, blind) of formulas(sheet, formula): the rectangles they refer to on any sheet of their workbook, sheets
    folded(), and the workbooks with a formula that can't be followed. One analysis per distinct formula text and sheet."""
    each = formulas.where(F.col("formula").isNotNull()).select("sheet", "formula").distinct()
    known = each.withColumn("__r", reached(each, F.col("formula")))
    boxes = known.select("sheet", F.explode("__r.boxes").alias("b"))
    boxes = boxes.select(F.when(F.col("b.sheet").isNull(), folded(F.col("sheet"))).otherwise(F.concat(workbook_of(F.col("sheet")), "b.sheet")).alias("sheet"), *[f"b.{c}" for c in BOX])
    return boxes, known.where("__r.blind").select(workbook_of(F.col("sheet")).alias("__workbook"), F.lit(True).alias("blind")).distinct()


def blocked_tails(tails: DataFrame, structures: DataFrame, formulas: DataFrame | None = None) -> DataFrame:
    """tails(sheet, box, ...) with structure: it meets one of structures(sheet, box); and reached: a formula reaches it, or one
    of the workbook's formulas can't be followed. Without formulas reached is false."""
    met = intersecting(tails, structures).select("sheet", *BOX, F.lit(True).alias("structure"))
    out = tails.join(met, ["sheet", *BOX], "left").withColumn("structure", F.coalesce("structure", F.lit(False)))
    if formulas is None:
        return out.withColumn("reached", F.lit(False))
    boxes, blind = formula_reach(formulas)
    hit = intersecting(tails.select(folded(F.col("sheet")).alias("sheet"), *BOX), boxes).select(F.col("sheet").alias("__sheet"), *BOX, F.lit(True).alias("__hit"))
    out = out.withColumn("__sheet", folded(F.col("sheet"))).withColumn("__workbook", workbook_of(F.col("sheet")))
    out = out.join(hit, ["__sheet", *BOX], "left").join(blind, "__workbook", "left")
    return out.withColumn("reached", F.coalesce("__hit", "blind", F.lit(False))).drop("__sheet", "__workbook", "__hit", "blind")


def ranges_text() -> Column:
    a, b = address(F.col("min_row"), F.col("min_col")), address(F.col("max_row"), F.col("max_col"))
    return F.when(a == b, a).otherwise(F.concat_ws(":", a, b))


def used_range(tails: DataFrame, sheets: DataFrame, sheet: Column | None = None) -> DataFrame:
    """WL018 over tails(sheet, box, structure): one finding a sheet, its tails in order. sheets(sheet, protected,
    declared_row, declared_col: the last ones as declared, or null; last_row, last_col: as stored; content_row: the last
    row with content). confidence 0.99 if the declared ones hold, else 0.90. clear: a patch may clear the tail."""
    met = tails.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("min_row", "min_col", ranges_text().alias("range")))).alias("__r"), F.bool_or("structure").alias("structure"), F.max("max_row").alias("__last"))
    holds = F.coalesce((F.col("declared_col") == F.col("last_col")) & (F.col("declared_row") >= F.greatest("content_row", "__last")) & (F.col("declared_row") <= F.col("last_row")), F.lit(False))
    clear = holds & ~F.col("structure") & ~F.col("protected")
    return findings(met.join(sheets, "sheet"), "WL018", "warning", named(sheet), F.concat_ws(",", "__r.range"), F.when(holds, 0.99).otherwise(0.90), clear.alias("clear"))


def whitespace_findings(tails: DataFrame, sheets: DataFrame, sheet: Column | None = None) -> DataFrame:
    """WL021 over tails(sheet, box, structure, reached): one finding a sheet. sheets(sheet, state, protected, declared: the declared
    dimension holds, formatting_tail: it has one). remove: a patch may remove the tail; only then the confidence is 0.99."""
    met = tails.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("min_row", "min_col", ranges_text().alias("range")))).alias("__r"), F.bool_or(F.col("structure") | F.col("reached")).alias("__bad"))
    remove = (F.col("state") == "visible") & ~F.col("protected") & F.col("declared") & ~F.col("formatting_tail") & ~F.col("__bad")
    return findings(met.join(sheets, "sheet"), "WL021", "warning", named(sheet), F.concat_ws(",", "__r.range"), F.when(remove, 0.99).otherwise(0.90), remove.alias("remove"))


# Saved views


def size_changes(patches: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """(sheet, more_width, more_height): how much larger a sheet is drawn once text_patches() are made. columns(sheet, col,
    width, hidden), rows(sheet, row, height, hidden_row): those with a size of their own; hidden ones don't grow."""
    asked = patches.where(F.col("value").isNotNull())
    wide = asked.where("kind = 'set_column_width'").groupBy("sheet", F.col("col").cast("int").alias("col")).agg(F.max("value").alias("value"))
    high = asked.where("kind = 'set_row_height'").groupBy("sheet", F.col("row").cast("long").alias("row")).agg(F.max("value").alias("value"))
    wide = wide.join(columns.select("sheet", F.col("col").cast("int").alias("col"), F.col("width").alias("now"), F.col("hidden").alias("off")), ["sheet", "col"], "left").withColumn("now", F.coalesce("now", F.lit(COLUMN)))
    high = high.join(rows.select("sheet", F.col("row").cast("long").alias("row"), F.col("height").alias("now"), F.col("hidden_row").alias("off")), ["sheet", "row"], "left").withColumn("now", F.coalesce("now", F.lit(ROW)))
    more = F.when(F.coalesce("off", F.lit(False)), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("value") - F.col("now")))
    both = wide.select("sheet", more.alias("w"), F.lit(0.0).alias("h")).unionByName(high.select("sheet", F.lit(0.0).alias("w"), more.alias("h")))
    return both.groupBy("sheet").agg(F.sum("w").alias("more_width"), F.sum("h").alias("more_height"))


def saved_views(sheets: DataFrame, sheet: Column | None = None) -> DataFrame:
    """WL020 over sheets(sheet, state, box: of the visible layout, top, left: the saved first cell, pane: null, frozen or another,
    pane_rows, pane_cols, pane_top, pane_left, zoom: null for 100, width, height: of the visible layout with the sizes that other
    patches ask): visible sheets whose view starts beyond the content or is zoomed more than the content allows. origin and
    zoom_to: what a patch would set, null for nothing."""
    at_row, at_col = F.col("min_row"), F.col("min_col")
    frozen = F.coalesce(F.col("pane") == "frozen", F.lit(False))
    broken = F.col("pane").isNotNull() & ((F.coalesce("pane_rows", F.lit(0.0)) < 0) | (F.coalesce("pane_cols", F.lit(0.0)) < 0) | F.isnan(F.coalesce("pane_rows", F.lit(0.0))) | F.isnan(F.coalesce("pane_cols", F.lit(0.0))))
    odd = frozen & ((F.coalesce("pane_rows", F.lit(0.0)) % 1 != 0) | (F.coalesce("pane_cols", F.lit(0.0)) % 1 != 0))
    row = F.when(frozen, F.coalesce("pane_top", "top")).otherwise(F.col("top"))
    col = F.when(frozen, F.coalesce("pane_left", "left")).otherwise(F.col("left"))
    want_row = at_row + F.when(frozen, F.coalesce("pane_rows", F.lit(0.0))).otherwise(0.0)
    want_col = at_col + F.when(frozen, F.coalesce("pane_cols", F.lit(0.0))).otherwise(0.0)
    off = ((row > want_row) | (col > want_col)) & (F.col("pane").isNull() | frozen)
    fit = lambda room, size: F.when(F.col(size) > 0, F.floor(F.lit(room) / F.col(size) * 20) * 5).otherwise(F.lit(100))
    wide, high, saved = fit(VIEW_WIDTH, "width"), fit(VIEW_HEIGHT, "height"), F.coalesce("zoom", F.lit(100))
    small = (F.col("max_row") - at_row < 40) & (F.col("max_col") - at_col < 20)
    whole = F.when(F.least(wide, high) >= LEAST_ZOOM, F.least(F.lit(MOST_ZOOM), wide, high))
    scrolled = F.when((high < LEAST_ZOOM) & (wide >= LEAST_ZOOM) & F.col("zoom").isNotNull() & (saved > 100), F.least(F.lit(MOST_ZOOM), wide))
    best = F.coalesce(whole, scrolled)
    large = F.coalesce(saved > best, F.lit(False))
    no_fit = small & (wide < LEAST_ZOOM)
    hit = sheets.where((F.col("state") == "visible") & ~broken & ~odd & (off | large | no_fit))
    aim = F.greatest(F.lit(LEAST_ZOOM), best - 5)
    zoom_to = F.when((F.col("pane").isNull() | frozen & ~off) & large & (saved > aim), aim)
    origin = F.when(F.col("pane").isNull() & (off | zoom_to.isNotNull()), address(at_row, at_col))
    return findings(hit, "WL020", "warning", named(sheet), address(row, col), 0.99, origin.alias("origin"), zoom_to.cast("int").alias("zoom_to"))


