"""Runs over positions, and regions of adjoining cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.runtime import ship_package


def runs(df: DataFrame, by: list[str], pos: str, gaps: int = 0) -> DataFrame:
    """(by, start, end, n): maximal runs of distinct positions, at most `gaps` of them missing between neighbours."""
    w = Window.partitionBy(*by).orderBy(pos)
    new = F.coalesce((F.col(pos) - F.lag(pos).over(w) > gaps + 1).cast("int"), F.lit(1))
    numbered = df.select(*by, pos).distinct().withColumn("__new", new)
    numbered = numbered.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "__run").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("n")).drop("__run")


def bands(formulas: DataFrame, by: list[str], pos: str, least: int = 3) -> DataFrame:
    """Formula bands: runs of at least `least` formulas with at most one position missing in all; with a confidence, the
    share of positions that are filled."""
    span = F.col("end") - F.col("start") + 1
    found = runs(formulas, by, pos, gaps=1).withColumn("confidence", F.col("n") / span)
    return found.where((F.col("n") >= least) & (span - F.col("n") <= 1))


def formula_bands(formulas: DataFrame) -> DataFrame:
    """(sheet, kind, min_row, max_row, min_col, max_col, n, confidence) of bands along rows and along columns of formulas(sheet, row, col)."""
    across = bands(formulas, ["sheet", "row"], "col")
    down = bands(formulas, ["sheet", "col"], "row")
    as_rows = across.select("sheet", F.lit("formula_row").alias("kind"), F.col("row").alias("min_row"), F.col("row").alias("max_row"), F.col("start").alias("min_col"), F.col("end").alias("max_col"), "n", "confidence")
    return as_rows.unionByName(down.select("sheet", F.lit("formula_column").alias("kind"), F.col("start").alias("min_row"), F.col("end").alias("max_row"), F.col("col").alias("min_col"), F.col("col").alias("max_col"), "n", "confidence"))


def address(row, col):
    """A1 address of a row and a column, both columns of numbers."""
    letters = lambda n: F.chr((n - 1) % 26 + 65)
    one, two = F.floor((col - 1) / 26), F.floor((col - 27) / 676)
    return F.concat(F.when(two >= 1, letters(two)).otherwise(""), F.when(one >= 1, letters(one)).otherwise(""), letters(col), row.cast("string"))


def address_ranges(cells: DataFrame, vertical: bool = False) -> DataFrame:
    """(sheet, range): cells(sheet, row, col) as A1 runs along rows, or along columns; lossless."""
    line, pos = ("col", "row") if vertical else ("row", "col")
    found = runs(cells, ["sheet", line], pos)
    first = address(F.col("start"), F.col("col")) if vertical else address(F.col("row"), F.col("start"))
    last = address(F.col("end"), F.col("col")) if vertical else address(F.col("row"), F.col("end"))
    return found.select("sheet", F.when(F.col("n") == 1, first).otherwise(F.concat(first, F.lit(":"), last)).alias("range"))


def number_ranges(numbers: DataFrame, by: list[str], number: str) -> DataFrame:
    """(by, range): numbers as "a" or "a:b"."""
    one = F.col("start").cast("string")
    return runs(numbers, by, number).select(*by, F.when(F.col("n") == 1, one).otherwise(F.concat_ws(":", one, F.col("end").cast("string"))).alias("range"))


def content_bounds(cells: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """(sheet, min_row, max_row, min_col, max_col) of the cells(sheet, row, col) with a value and of merges(sheet, the same four)."""
    boxes = cells.select("sheet", *[F.col(c).cast("long").alias(n) for c, n in (("row", "min_row"), ("row", "max_row"), ("col", "min_col"), ("col", "max_col"))])
    if merges is not None:
        boxes = boxes.unionByName(merges.select("sheet", *[F.col(c).cast("long").alias(c) for c in ("min_row", "max_row", "min_col", "max_col")]))
    return boxes.groupBy("sheet").agg(F.min("min_row").alias("min_row"), F.max("max_row").alias("max_row"), F.min("min_col").alias("min_col"), F.max("max_col").alias("max_col"))


#: Rows of a sheet whose runs one task joins.
BLOCK_ROWS = 20_000
BOX = "min_row long, max_row long, min_col long, max_col long, cells long, blocked long"


def joined(rows: list[int], start: list[int], end: list[int]) -> list[int]:
    """For runs sorted by row and start, the first run of the 4-neighbour component of each."""
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    above = 0
    for i in range(len(rows)):
        while rows[above] < rows[i] - 1 or rows[above] == rows[i] - 1 and end[above] < start[i]:
            above += 1
        j = above
        while j < i and rows[j] == rows[i] - 1 and start[j] <= end[i]:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
            j += 1
    return [find(i) for i in range(len(rows))]


def components(cells: DataFrame, blocked: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(sheet, box, cells, blocked) of the 4-neighbour components of cells(sheet, row, col); blocked counts cells so marked.

    Cells are compressed to runs along rows. Runs are joined within blocks of rows, one task each; what touches the first
    or last row of a block is then joined across blocks, by those rows' runs only. So no task holds a sheet's cells.
    """
    ship_package(cells.sparkSession)
    flat = runs(cells, ["sheet", "row"], "col").select("sheet", *[F.col(c).cast("long").alias(c) for c in ("row", "start", "end", "n")])
    if blocked:
        own = cells.where(F.col(blocked)).select("sheet", F.col("row").cast("long").alias("row"), F.col("col").alias("c")).distinct()
        hit = flat.join(own, ["sheet", "row"]).where(F.col("c").between(F.col("start"), F.col("end"))).groupBy("sheet", "row", "start").agg(F.count(F.lit(1)).alias("blocked"))
        flat = flat.join(hit, ["sheet", "row", "start"], "left").fillna(0, ["blocked"])
    else:
        flat = flat.withColumn("blocked", F.lit(0).cast("long"))
    flat = flat.withColumn("block", F.floor(F.col("row") / block_rows).cast("long"))
    edge = "edge array<struct<row:long,start:long,end:long>>"

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "start"]).reset_index(drop=True)
        pdf["part"] = joined(pdf["row"].tolist(), pdf["start"].tolist(), pdf["end"].tolist())
        first = int(pdf["block"].iloc[0]) * block_rows
        border = pdf[pdf["row"].isin([first, first + block_rows - 1])]
        edges = {k: g[["row", "start", "end"]].to_dict("records") for k, g in border.groupby("part")}
        out = pdf.groupby("part").agg(min_row=("row", "min"), max_row=("row", "max"), min_col=("start", "min"), max_col=("end", "max"), cells=("n", "sum"), blocked=("blocked", "sum")).reset_index()
        return out.assign(sheet=pdf["sheet"].iloc[0], block=pdf["block"].iloc[0], edge=[edges.get(k, []) for k in out["part"]])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = sorted((e["row"], e["start"], e["end"], i) for i, own in enumerate(pdf["edge"]) for e in own)
        root = list(range(len(pdf)))

        def find(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        for k, first in enumerate(joined(*[[x[c] for x in lines] for c in range(3)])):
            a, b = find(lines[k][3]), find(lines[first][3])
            root[max(a, b)] = min(a, b)
        out = pdf.assign(part=[find(i) for i in range(len(pdf))]).groupby("part").agg(min_row=("min_row", "min"), max_row=("max_row", "max"), min_col=("min_col", "min"), max_col=("max_col", "max"), cells=("cells", "sum"), blocked=("blocked", "sum"))
        return out.reset_index(drop=True).assign(sheet=pdf["sheet"].iloc[0])

    parts = flat.groupBy("sheet", "block").applyInPandas(within, f"sheet string, block long, part long, {BOX}, {edge}")
    box = ["sheet", *[x.split()[0] for x in BOX.split(", ")]]
    inner = parts.where(F.size("edge") == 0).select(*box)
    return inner.unionByName(parts.where(F.size("edge") > 0).drop("block", "part").groupBy("sheet").applyInPandas(across, f"sheet string, {BOX}").select(*box))


def regions(cells: DataFrame, least: int = 6, density: float = 0.5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Data regions of cells(sheet, row, col): 4-neighbour components with at least `least` cells, 2 rows, 2 columns and
    the given density."""
    found = components(cells, block_rows=block_rows).drop("blocked")
    high, wide = F.col("max_row") - F.col("min_row") + 1, F.col("max_col") - F.col("min_col") + 1
    return found.withColumn("density", F.col("cells") / (high * wide)).where((F.col("cells") >= least) & (high >= 2) & (wide >= 2) & (F.col("density") >= density))


def formatting_tails(cells: DataFrame, content: DataFrame, rows_off: int = 25, cols_off: int = 8, least: int = 16, density: float = 0.5) -> DataFrame:
    """(sheet, box, cells): components of styled blank cells(sheet, row, col, blocked) far right of or below the content(sheet, box).

    blocked: the row or column of the cell is hidden, grouped or of a set height; one such cell keeps its component.
    """
    limits = content.select("sheet", F.col("max_row").alias("last_row"), F.col("max_col").alias("last_col"))
    far = cells.join(limits, "sheet").where((F.col("col") >= F.col("last_col") + cols_off) | (F.col("row") >= F.col("last_row") + rows_off))
    found = components(far.select("sheet", "row", "col", "blocked"), "blocked").join(limits, "sheet")
    area = (F.col("max_row") - F.col("min_row") + 1) * (F.col("max_col") - F.col("min_col") + 1)
    apart = (F.col("min_col") >= F.col("last_col") + cols_off) | (F.col("min_row") >= F.col("last_row") + rows_off)
    return found.where((F.col("blocked") == 0) & (F.col("cells") >= least) & (F.col("cells") / area >= density) & apart).drop("blocked", "last_row", "last_col")


def smallest_containing(points: DataFrame, boxes: DataFrame, bin_rows: int = 1024) -> DataFrame:
    """points(sheet, row, col) with the box that holds each and is least by area, then top, then left; none: left out."""
    held = overlapping(points, boxes, bin_rows)
    area = (F.col("max_row") - F.col("min_row") + 1) * (F.col("max_col") - F.col("min_col") + 1)
    box = F.struct("min_row", "max_row", "min_col", "max_col")
    return held.groupBy(*points.columns).agg(F.min_by(box, F.struct(area, "min_row", "min_col")).alias("box"))


def nearest_header(cells: DataFrame, by: list[str], row: str, text: str, reach: int = 8) -> DataFrame:
    """cells with header: the nearest non-blank text at most `reach` rows above."""
    w = Window.partitionBy(*by).orderBy(row).rangeBetween(-reach, -1)
    return cells.withColumn("header", F.last(text, ignorenulls=True).over(w))


def nearest_peers(cells: DataFrame, peers: DataFrame, by: list[str], pos: str, k: int = 8, reach: int = 10) -> DataFrame:
    """(by, pos, peer, rank): the k nearest peers within `reach` positions, ties to the smaller one.

    The range join is an equi-join on bins as wide as the reach.
    """
    left = cells.select(*by, F.col(pos).alias("pos")).withColumn("bin", F.explode(F.array(*[F.floor(F.col("pos") / reach) + d for d in (-1, 0, 1)])))
    right = peers.select(*by, F.col(pos).alias("peer")).withColumn("bin", F.floor(F.col("peer") / reach))
    near = left.join(right, [*by, "bin"]).where((F.col("peer") != F.col("pos")) & (F.abs(F.col("peer") - F.col("pos")) <= reach))
    rank = F.row_number().over(Window.partitionBy(*by, "pos").orderBy(F.abs(F.col("peer") - F.col("pos")), "peer"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(*by, "pos", "peer", "rank")


def overlapping(points: DataFrame, boxes: DataFrame, bin_rows: int = 1024) -> DataFrame:
    """points(sheet, row, col) with boxes(sheet, min_row, max_row, min_col, max_col, ...) that hold them: rows are
    binned, so the join is an equi-join and skew is split."""
    binned = boxes.withColumn("bin", F.explode(F.sequence(F.floor(F.col("min_row") / bin_rows), F.floor(F.col("max_row") / bin_rows))))
    inside = F.col("row").between(F.col("min_row"), F.col("max_row")) & F.col("col").between(F.col("min_col"), F.col("max_col"))
    return points.withColumn("bin", F.floor(F.col("row") / bin_rows)).join(binned, ["sheet", "bin"]).where(inside).drop("bin")
