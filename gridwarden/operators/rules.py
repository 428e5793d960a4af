"""Anomaly rules: cells or formulas in, findings out. Most take a majority within a group and report what differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.functions.formula import other_rows, own_spans, translated
from gridwarden.functions.identity import finding_id, stable_id
from gridwarden.functions.labels import identifier_header, measure_header, summary_label
from gridwarden.functions.text import integer_digits, is_error, numeric_text
from gridwarden.functions.width import COLUMN, identifier_width


def findings(df: DataFrame, rule: str, severity: Column | str, sheet: Column | str, location: Column, confidence: Column | float, *more: Column, told_by: Column | None = None) -> DataFrame:
    """Findings of a rule; told_by tells apart several of them at one place. A column sheet of df is kept."""
    severity = F.lit(severity) if isinstance(severity, str) else severity
    confidence = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return df.select(finding_id(rule, sheet, location, told_by).alias("id"), F.lit(rule).alias("rule_id"), severity.alias("severity"), location.alias("location"), confidence.cast("double").alias("confidence"), *own_sheet(df), *more)


def own_sheet(df: DataFrame) -> list[Column]:
    return [F.col("sheet")] if "sheet" in df.columns else []


def consensus(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with total, modal (its most frequent value, smallest on a tie) and modal_n, per group. Null values count."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.max_by(F.col(value), F.struct("n", F.struct(F.col(value)))).alias("modal"), F.max("n").alias("modal_n"))
    return df.join(best, by)


def duplicate_keys(df: DataFrame, sheet: str, keys: list[str]) -> DataFrame:
    """WL012: a key that occurs more than once; keys with a null are skipped. One row per key, pre-aggregated."""
    counted = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)
    return findings(counted, "WL012", "error", sheet, F.concat_ws(":", *keys), 1.0, F.col("occurrences"))


def outliers(df: DataFrame, by: list[str], pos: str, value: str, least: int, share: float) -> DataFrame:
    """Rows that differ from a modal value of at least `share`, in groups of at least `least` and with no two of them adjacent."""
    agreed = consensus(df, by, value).where((F.col("total") >= least) & (F.col("modal_n") >= share * F.col("total")))
    odd = agreed.where(~F.col(value).eqNullSafe(F.col("modal")))
    gap = F.col(pos) - F.lag(pos).over(Window.partitionBy(*by).orderBy(pos))
    odd = odd.withColumn("__gap", gap)
    near = F.min("__gap").over(Window.partitionBy(*by))
    return odd.withColumn("__near", near).where(F.coalesce(F.col("__near") > 1, F.lit(True))).drop("__gap", "__near")


def formula_outliers(cells: DataFrame, sheet: Column | str, location: Column) -> DataFrame:
    """WL002 over cells(band, pos, signature), and boundary if boundary_aggregates() told it: formulas that break a band's
    pattern. Boundary aggregates are left out, and bands with a formula that has no signature."""
    if "boundary" in cells.columns:
        cells = cells.where(~F.col("boundary"))
    unsigned = F.max(F.col("signature").isNull()).over(Window.partitionBy("band"))
    cells = cells.withColumn("__unsigned", unsigned).where(~F.col("__unsigned")).drop("__unsigned")
    odd = outliers(cells, ["band"], "pos", "signature", 4, 0.8)
    return findings(odd, "WL002", "warning", sheet, location, F.round(F.col("modal_n") / F.col("total"), 6), F.col("modal").alias("expected"))


def band_holes(cells: DataFrame) -> DataFrame:
    """(band, kind, pos, modal) over cells(band, pos, signature, value): the only blank, or the only literal, strictly inside a
    band whose formulas, three or more, agree in at least 0.9. Blanks and literals are counted apart, so a band may have both."""
    ends = Window.partitionBy("band")
    inside = (F.col("pos") > F.min("pos").over(ends)) & (F.col("pos") < F.max("pos").over(ends))
    kind = F.when(F.col("signature").isNotNull(), "formula").when(F.col("value").isNull(), "blank").otherwise("literal")
    seen = cells.select("band", "pos", inside.alias("inside"), "signature", kind.alias("kind"))
    agreed = consensus(seen.where("kind = 'formula'").select("band", "signature"), ["band"], "signature").where((F.col("total") >= 3) & (F.col("modal_n") >= 0.9 * F.col("total"))).select("band", "modal").distinct()
    holes = seen.where(F.col("inside") & (F.col("kind") != "formula")).groupBy("band", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos")).where(F.col("n") == 1)
    return holes.join(agreed, "band").select("band", "kind", "pos", "modal")


def band_gaps(cells: DataFrame, sheet: Column | str, location: Column) -> DataFrame:
    """WL003 and WL004 over band_holes(). If sheet is a column, band is a struct with one, and the findings keep it."""
    hit = band_holes(cells)
    if not isinstance(sheet, str):
        hit = hit.withColumn("sheet", F.col("band.sheet"))
    rule = F.when(F.col("kind") == "blank", "WL003").otherwise("WL004")
    parts = [findings(hit.where(rule == name), name, "error", sheet, location, 0.99, F.col("modal").alias("expected")) for name in ("WL003", "WL004")]
    return parts[0].unionByName(parts[1])


def translated_consensus(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(band, pos, formula, source): what the formulas of sources(band, row, col, coord, formula) become when they are copied to
    targets(band, pos, to_row, to_col), if two or more can be, and all give the same. source: the least address, as text."""
    both = sources.join(targets, "band")
    moved = both.withColumn("moved", translated(both, F.col("formula"), F.col("row"), F.col("col"), F.col("to_row"), F.col("to_col"))).where(F.col("moved").isNotNull())
    per = moved.groupBy("band", "pos").agg(F.count(F.lit(1)).alias("n"), F.min("moved").alias("formula"), F.max("moved").alias("other"), F.min("coord").alias("source"))
    return per.where((F.col("n") >= 2) & (F.col("formula") == F.col("other"))).select("band", "pos", "formula", "source")


def fill_patches(found: DataFrame, proposals: DataFrame, sheet: str) -> DataFrame:
    """Patches for findings(id, rule_id, band, pos, coord) of band gaps: a blank gets the proposed formula, a literal is replaced by it.

    Only blanks are safe; a literal may be meant, so a person decides."""
    both = found.join(proposals, ["band", "pos"])
    kind = F.when(F.col("rule_id") == "WL003", "create_formula").otherwise("set_formula")
    patch = stable_id("patch", kind, F.lit(sheet), F.col("coord"), F.col("formula"))
    return both.select(patch.alias("id"), F.col("id").alias("finding"), kind.alias("kind"), F.lit(sheet).alias("sheet"), F.col("coord").alias("cell"), F.col("formula").alias("after"), "source", (F.col("rule_id") == "WL003").alias("safe"), F.lit(0.99).alias("confidence"))


def boundary_aggregates(cells: DataFrame) -> DataFrame:
    """cells(band, kind, row, col, formula, min_row, max_row, min_col, max_col: the band's) with boundary: the formula stands
    at an end of its band and refers to exactly the rest of it."""
    box = lambda top, left, bottom, right: F.struct(*[x.cast("int").alias(n) for x, n in ((top, "min_row"), (left, "min_col"), (bottom, "max_row"), (right, "max_col"))])
    row, col = F.col("row"), F.col("col")
    ends = (
        ("formula_row", col == F.col("min_col"), box(row, col + 1, row, F.col("max_col"))),
        ("formula_row", col == F.col("max_col"), box(row, F.col("min_col"), row, col - 1)),
        ("formula_column", row == F.col("min_row"), box(row + 1, col, F.col("max_row"), col)),
        ("formula_column", row == F.col("max_row"), box(F.col("min_row"), col, row - 1, col)),
    )
    hit = F.lit(False)
    for kind, at_end, rest in ends:
        hit = hit | ((F.col("kind") == kind) & at_end & F.array_contains("__spans", rest))
    return cells.withColumn("__spans", own_spans(cells, F.col("formula"))).withColumn("boundary", hit).drop("__spans")


def summary_rows(cells: DataFrame, overrides: bool = True) -> DataFrame:
    """(sheet, row) of cells(sheet, row, txt, formula) that sum others up: by a label, or by an aggregate over other rows."""
    says = summary_label(F.col("txt"), overrides) & F.col("formula").isNull()
    reaches = other_rows(cells, F.col("formula"), F.col("row"))
    return cells.withColumn("__hit", says | reaches).groupBy("sheet", "row").agg(F.bool_or("__hit").alias("hit")).where("hit").drop("hit")


def sum_boundaries(cells: DataFrame, sheet: Column | str) -> DataFrame:
    """WL005 over cells(row, col, letter, num, formula): a SUM of its own column that stops two rows above itself, with
    a number in the row that it leaves out."""
    by = ["sheet"] if "sheet" in cells.columns else []
    part = lambda i: F.regexp_extract("formula", r"^=SUM\(\$?([A-Z]{1,3})\$?(\d+):\$?([A-Z]{1,3})\$?(\d+)\)$", i)
    sums = cells.where(F.col("formula").rlike(r"^=SUM\(\$?[A-Z]{1,3}\$?\d+:\$?[A-Z]{1,3}\$?\d+\)$")).select(*by, "row", "col", "letter", part(1).alias("c1"), part(2).cast("long").alias("a"), part(3).alias("c2"), part(4).cast("long").alias("b"))
    sums = sums.where((F.col("c1") == F.col("letter")) & (F.col("c2") == F.col("letter")) & (F.col("a") < F.col("b")) & (F.col("b") + 1 == F.col("row") - 1))
    skipped = cells.where(F.col("num").isNotNull() & F.col("formula").isNull()).select(*by, (F.col("row") + 1).alias("row"), "col")
    return findings(sums.join(skipped, [*by, "row", "col"], "left_semi"), "WL005", "warning", sheet, F.concat("letter", F.col("row").cast("string")), 0.96)


def numeric_texts(cells: DataFrame, sheet: Column | str, location: Column) -> DataFrame:
    """WL006 over cells(grp, num, txt): text that spells a number in a column where numbers are 0.75 or more."""
    w = cells.groupBy("grp").agg(F.count("num").alias("__numbers"), F.count(F.coalesce(F.col("num").cast("string"), F.col("txt"))).alias("__filled"))
    hit = cells.join(w, "grp").where((F.col("__numbers") >= 3) & (F.col("__numbers") >= 0.75 * F.col("__filled")) & F.col("num").isNull() & numeric_text(F.col("txt")).isNotNull())
    sure = F.when(F.col("__numbers") >= 0.85 * F.col("__filled"), 0.97).otherwise(0.90)
    return findings(hit, "WL006", "warning", sheet, location, sure, numeric_text(F.col("txt")).alias("value"))


def formula_findings(cells: DataFrame, sheet: Column | str, location: Column) -> DataFrame:
    """WL001, WL009 and WL010 over cells with features: broken, external, volatile or whole-column references. One pass."""
    f = lambda n: F.col(f"features.{n}")
    loud = f("whole_column") | F.arrays_overlap(f("volatile"), F.array(F.lit("OFFSET"), F.lit("INDIRECT")))
    found = (("WL001", F.size(f("broken")) > 0, F.lit("error")), ("WL009", F.size(f("external")) > 0, F.lit("warning")), ("WL010", (F.size(f("volatile")) > 0) | f("whole_column"), F.when(loud, "warning").otherwise("info")))
    each = F.array(*[F.when(hit, F.struct(F.lit(rule).alias("rule_id"), severity.alias("severity"))) for rule, hit, severity in found])
    named = F.lit(sheet).alias("__named")
    hits = cells.where(F.col("features").isNotNull()).select(named, *own_sheet(cells), location.alias("location"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x"))
    name = stable_id("finding", F.col("x.rule_id"), F.col("__named"), F.col("location"), F.lit(None))
    return hits.select(name.alias("id"), "x.rule_id", "x.severity", "location", F.lit(1.0).alias("confidence"), *own_sheet(cells))


def hidden_data(lines: DataFrame, sheet: Column | str, label: Column | None = None) -> DataFrame:
    """WL008 over lines(row, hidden, filled, formulas): hidden rows that hold values; a formula among them is a warning.
    Hidden spans of columns go the same way, with a label that names them."""
    hit = lines.where(F.col("hidden") & (F.col("filled") > 0))
    label = label if label is not None else F.concat(F.col("row").cast("string"), F.lit(":"), F.col("row").cast("string"))
    return findings(hit, "WL008", F.when(F.col("formulas") > 0, "warning").otherwise("info"), sheet, label, 1.0)


def hidden_sheets(sheets: DataFrame) -> DataFrame:
    """WL008 over sheets(sheet, state, filled): sheets that aren't visible and hold values."""
    hit = sheets.where((F.col("state") != "visible") & (F.col("filled") > 0))
    name = stable_id("finding", F.lit("WL008"), F.col("sheet"), F.lit(None), F.lit(None))
    return hit.select(name.alias("id"), F.lit("WL008").alias("rule_id"), F.lit("warning").alias("severity"), "sheet", F.lit(1.0).alias("confidence"))


def error_cells(cells: DataFrame, sheet: Column | str, location: Column) -> DataFrame:
    """WL011 over cells(data_type, txt)."""
    return findings(cells.where(is_error(F.col("data_type"), F.col("txt"))), "WL011", "error", sheet, location, 1.0)


#: A range as names write it: cells, whole columns or whole rows, with or without marks.
RANGE = r"^\$?[A-Za-z]{1,3}\$?[1-9]\d*(:\$?[A-Za-z]{1,3}\$?[1-9]\d*)?$|^\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}$|^\$?[1-9]\d*:\$?[1-9]\d*$"


def broken_names(names: DataFrame, sheets: DataFrame, sheet: Column | str = "names") -> DataFrame:
    """WL013 over names(name, target, range): a lost reference, a target that is no sheet(target) of the workbook, or a
    range that can't be read. range is null where only the sheet is known."""
    known = sheets.select(F.col("target").alias("__known")).distinct()
    lost = F.coalesce(F.upper("range").contains("#REF!"), F.lit(False))
    unreadable = F.coalesce(~F.col("range").rlike(RANGE), F.lit(False))
    reason = F.when(lost, "lost reference").when(F.col("__known").isNull(), "missing sheet").when(unreadable, "bad range")
    hit = names.join(known, F.col("target") == F.col("__known"), "left").withColumn("reason", reason).where(F.col("reason").isNotNull())
    return findings(hit, "WL013", "error", sheet, F.col("name"), 1.0, F.col("reason"))


def merges_in_data(merges: DataFrame, regions: DataFrame, sheet: Column | str, location: Column | None = None) -> DataFrame:
    """WL014: merges that overlap a region, unless in its first row only. Rows are binned for the join."""
    bins = lambda df: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("min_row") / 1024), F.floor(F.col("max_row") / 1024))))
    r = bins(regions.select("sheet", *[F.col(c).alias(f"r_{c}") for c in ("min_row", "max_row", "min_col", "max_col")], "min_row", "max_row")).drop("min_row", "max_row")
    both = bins(merges).join(r, ["sheet", "bin"])
    over = (F.col("min_row") <= F.col("r_max_row")) & (F.col("max_row") >= F.col("r_min_row")) & (F.col("min_col") <= F.col("r_max_col")) & (F.col("max_col") >= F.col("r_min_col"))
    head = (F.col("min_row") == F.col("r_min_row")) & (F.col("max_row") == F.col("r_min_row"))
    hit = both.where(over & ~head).select(*([] if isinstance(sheet, str) else ["sheet"]), "min_row", "max_row", "min_col", "max_col").distinct()
    location = location if location is not None else F.concat_ws(":", "min_row", "min_col", "max_row", "max_col")
    return findings(hit, "WL014", "warning", sheet, location, 0.9)


def validation_outliers(cells: DataFrame, sheet: Column | str, location: Column) -> DataFrame:
    """WL015 over cells(grp, validation): one cell of a column lacks the validation of 0.75 or more."""
    agreed = consensus(cells, ["grp"], "validation").where((F.col("total") >= 4) & (F.col("modal_n") >= 3) & F.col("modal").isNotNull() & (F.col("modal_n") >= 0.75 * F.col("total")) & (F.col("total") - F.col("modal_n") == 1))
    odd = agreed.where(~F.col("validation").eqNullSafe(F.col("modal")))
    return findings(odd, "WL015", "warning", sheet, location, F.round(F.col("modal_n") / F.col("total"), 6))


def long_identifiers(cells: DataFrame, sheet: Column | str, location: Column) -> DataFrame:
    """WL019 over cells(num, number_format, header, hidden, width): visible whole numbers of ten digits or more under General
    in any case, below a header of identifiers that isn't one of measures; beyond 15 digits an error. Up to 11 digits a
    column that is wide enough shows them; width is null for the default."""
    digits = integer_digits(F.col("num"))
    asked = identifier_width(F.length(digits), F.length(digits) + F.lit(1.0))
    shown = (F.length(digits) <= 11) & (F.coalesce("width", F.lit(COLUMN)) >= asked - 0.25)
    named = identifier_header(F.col("header")) & ~measure_header(F.col("header"))
    plain = F.lower(F.trim(F.coalesce("number_format", F.lit("General")))) == "general"
    hit = cells.where(plain & (F.length(digits) >= 10) & named & ~F.coalesce("hidden", F.lit(False)) & ~shown)
    return findings(hit, "WL019", F.when(F.length(digits) > 15, "error").otherwise("warning"), sheet, location, 0.99)


def style_outliers(cells: DataFrame, sheet: Column | str, location: Column) -> DataFrame:
    """WL007 over cells(grp, pos, style): styles that differ from 0.8 of a column."""
    odd = outliers(cells, ["grp"], "pos", "style", 5, 0.8)
    return findings(odd, "WL007", "info", sheet, location, F.round(F.col("modal_n") / F.col("total"), 6))
