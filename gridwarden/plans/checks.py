"""Assertions of a configuration over a scanned workbook."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.config import Config, UsageError, range_box, rule_ids
from gridwarden.operators import assertions, rules
from gridwarden.plans.scan import Book, place, sheet_name

SUM = re.compile(r"(?i)SUM\((?P<sheet>'(?:[^']|'')+'|[^'!]+)!(?P<range>\$?[A-Z]{1,3}\$?\d+:\$?[A-Z]{1,3}\$?\d+)\)\Z")
CELL = re.compile(r"(?i)(?P<sheet>'(?:[^']|'')+'|[^'!]+)!(?P<range>\$?[A-Z]{1,3}\$?\d+)\Z")


def cells_of(b: Book, sheet: str, area: str) -> DataFrame:
    """The stored cells of a rectangle; a formula stands for its stored value."""
    top, bottom, left, right = range_box(area)
    return b.cells.where((sheet_name() == sheet) & F.col("row").between(top, bottom) & F.col("col").between(left, right))


def with_blanks(b: Book, sheet: str, area: str) -> DataFrame:
    """Every place of a rectangle, of which there are at most 100,000, with its cell if there is one."""
    top, bottom, left, right = range_box(area)
    spots = b.cells.sparkSession.range(top, bottom + 1).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(left), F.lit(right))).alias("col"))
    return spots.join(cells_of(b, sheet, area), ["row", "col"], "left")


def value(b: Book, text: str) -> DataFrame:
    """One row, one column: a number, a cell's value, or a sum. A sum ignores texts, truth values and blanks; an error, or a
    formula without a stored value, makes it null, which equals nothing."""
    try:
        return b.cells.sparkSession.range(1).select(F.lit(float(text)).alias("value"))
    except ValueError:
        pass
    total, cell = SUM.match(text.strip()), CELL.match(text.strip())
    found = total or cell
    if not found:
        raise UsageError(f"{text!r} is no number, cell or sum")
    sheet = found["sheet"].removeprefix("'").removesuffix("'").replace("''", "'")
    cells = cells_of(b, sheet, found["range"])
    if cell:
        return cells.agg(F.max("num").alias("value"))
    bad = (F.col("data_type") == "e") | F.col("formula").isNotNull() & F.col("txt").isNull() | rules.is_error(F.col("data_type"), F.col("txt"))
    return cells.agg(F.when(~F.coalesce(F.bool_or(bad), F.lit(False)), F.coalesce(F.sum("num"), F.lit(0.0))).alias("value"))


def check(b: Book, active: DataFrame, c: dict) -> DataFrame:
    name, kind = c["id"], c["type"]
    if kind == "no_findings":
        return assertions.no_findings(active, list(rule_ids(c.get("rules") or [])), name)
    if kind == "equals":
        return assertions.equals(value(b, str(c["left"])), value(b, str(c["right"])), float(c.get("tolerance") or 0), name)
    sheet, area = c["sheet"], c["range"]
    if kind == "unique":
        typed = cells_of(b, sheet, area) if c.get("ignore_blank", True) else with_blanks(b, sheet, area)
        key = F.concat_ws("\0", F.coalesce("data_type", F.lit("blank")), F.coalesce(F.col("num").cast("string"), "txt", F.lit("")))
        return assertions.unique(typed.where(F.lit(not c.get("ignore_blank", True)) | F.col("txt").isNotNull()).select(key.alias("key")), "key", name)
    cells = with_blanks(b, sheet, area)
    if kind == "nonblank":
        return assertions.nonblank(cells.select(F.coalesce("formula", "txt").alias("txt")), "txt", name)
    if kind == "allowed_values":
        texts = [str(v) for v in c.get("values") or [] if isinstance(v, str)]
        numbers = [float(v) for v in c.get("values") or [] if isinstance(v, (int, float))]
        bad = ~F.coalesce(F.col("num").isin(numbers) if numbers else F.lit(False), F.lit(False)) & ~F.coalesce((F.col("data_type") == "s") & F.col("txt").isin(texts) if texts else F.lit(False), F.lit(False))
        return assertions.result(cells, name, F.count(F.when(bad, 1)))
    return assertions.numeric_bounds(cells.select(F.when((F.col("data_type") == "n") & F.col("formula").isNull(), F.col("num")).alias("num")), "num", c.get("minimum"), c.get("maximum"), name)


def run(b: Book, active: DataFrame, config: Config) -> DataFrame:
    """(assertion, passed, violations) of the thresholds and all assertions; one that can't be evaluated fails alone."""
    out = [assertions.thresholds(active, config.thresholds)] if config.thresholds else []
    for c in config.assertions:
        try:
            out.append(check(b, active, c))
        except (UsageError, KeyError, TypeError, ValueError) as e:
            out.append(assertions.failed(c["id"], str(e), b.cells))
    if not out:
        return assertions.failed("none", "", b.cells).limit(0)
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def duplicate_keys(b: Book, config: Config) -> list[DataFrame]:
    """WL012 for each configured key range, as findings; the location names the cells, in order."""
    out = []
    for k in config.keys:
        blank = k.get("ignore_blank", True)
        cells = (cells_of if blank else with_blanks)(b, k["sheet"], k["range"])
        cells = cells.where(F.col("txt").isNotNull()) if blank else cells.withColumn("sheet", F.max("sheet").over(rules.Window.partitionBy(F.lit(0))))  # at most 100,000 cells
        same = F.struct(F.coalesce("data_type", F.lit("blank")), "num", F.when(F.col("num").isNull(), F.col("txt")))
        found = cells.withColumn("__key", same).withColumn("__at", F.struct("row", "col", place().alias("cell"))).groupBy("sheet", "__key").agg(F.array_sort(F.collect_list("__at")).alias("__at")).where(F.size("__at") > 1)
        out.append(rules.findings(found, "WL012", "error", sheet_name(), F.concat_ws(",", "__at.cell"), 1.0))
    return out
