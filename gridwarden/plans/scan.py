"""A scan: workbooks in, findings and patches out, all workbooks of a path in one job.

Operators know sheets by one column. Here it holds workbook and sheet name with a NUL between them, which neither can
contain, so nothing is compared across workbooks; ids are made of the sheet's own name.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwarden.functions.formula import EXTERNAL, signature_column, with_features
from gridwarden.functions.identity import stable_id
from gridwarden.functions.width import COLUMN, ROW
from gridwarden.operators import layout, rules, runs
from gridwarden.operators.runs import address
from gridwarden.sources import workbook as source

BOX = layout.BOX


def sheet_name() -> Column:
    return F.substring_index(F.col("sheet"), "\0", -1)


def place() -> Column:
    return address(F.col("row"), F.col("col"))


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("sheet", F.concat("workbook", F.lit("\0"), "sheet"))


@dataclass(frozen=True)
class Book:
    """The tables of some workbooks, and what several rules derive from them."""

    cells: DataFrame
    sheets: DataFrame
    sizes: DataFrame
    structures: DataFrame
    kept: list[DataFrame] = field(default_factory=list)

    def keep(self, df: DataFrame) -> DataFrame:
        """df on executors, until release(): several rules start from it."""
        self.kept.append(df.persist())
        return df

    @cached_property
    def valued(self) -> DataFrame:
        """Cells with a value or a formula; literal white space is none."""
        return self.cells.where(F.col("formula").isNotNull() | F.col("num").isNotNull() | (F.trim(F.coalesce("txt", F.lit(""))) != ""))

    @cached_property
    def merges(self) -> DataFrame:
        return self.boxes("merge")

    @cached_property
    def unmerged(self) -> DataFrame:
        """Visible cells in no merge that hold a value or have a style."""
        inside = runs.overlapping(self.cells.select("sheet", "row", "col"), self.merges).select("sheet", "row", "col")
        filled = (F.trim(F.coalesce("txt", F.lit(""))) != "") | F.col("formula").isNotNull() | (F.col("style_id") != 0)
        return self.keep(self.cells.where(~F.col("hidden") & filled).join(inside, ["sheet", "row", "col"], "left_anti"))

    @cached_property
    def regions(self) -> DataFrame:
        return self.keep(runs.regions(self.valued))

    @cached_property
    def columns(self) -> DataFrame:
        """(sheet, col, width, hidden) of columns with a size of their own."""
        spans = self.sizes.where("axis = 'col'").withColumn("col", F.explode(F.sequence("first", F.least("last", F.lit(16_384).cast("long")))))
        return spans.groupBy("sheet", "col").agg(F.first("size").alias("width"), F.bool_or("hidden").alias("hidden"))

    @cached_property
    def heights(self) -> DataFrame:
        return self.sizes.where("axis = 'row'").select("sheet", F.col("first").alias("row"), F.col("size").alias("height"), F.col("hidden").alias("hidden_row"), "outlined")

    @cached_property
    def below_headers(self) -> DataFrame:
        """Cells of regions below their first row, with grp: the region and the column."""
        held = runs.overlapping(self.valued, self.regions.select("sheet", *BOX)).where(F.col("row") > F.col("min_row"))
        return self.keep(held.withColumn("grp", F.struct("sheet", "min_row", "min_col", "col")).drop(*BOX))

    @cached_property
    def in_bands(self) -> DataFrame:
        """Every position of every formula band, with its cell if there is one."""
        bands = runs.formula_bands(self.cells.where(F.col("formula").isNotNull()))
        odd = self.structures.where("kind = 'formula' AND name IS DISTINCT FROM 'shared' AND min_row IS NOT NULL").select("sheet", *BOX)
        bad = layout.intersecting(bands.select("sheet", *[F.col(c).cast("long").alias(c) for c in BOX]), odd)
        fine = bands.join(bad.select("sheet", *BOX), ["sheet", *BOX], "left_anti")
        across = F.col("kind") == "formula_row"
        from_, to = F.when(across, F.col("min_col")).otherwise(F.col("min_row")), F.when(across, F.col("max_col")).otherwise(F.col("max_row"))
        at = F.explode(F.sequence(from_.cast("long"), to.cast("long")))
        spots = fine.withColumn("pos", at).withColumn("row", F.when(across, F.col("min_row")).otherwise(F.col("pos")).cast("long")).withColumn("col", F.when(across, F.col("pos")).otherwise(F.col("min_col")).cast("int"))
        signed = self.cells.withColumn("signature", signature_column(self.cells, F.col("formula"), F.col("row"), F.col("col"))).select("sheet", "row", "col", "formula", "signature", F.col("txt").alias("value"))
        return self.keep(spots.withColumn("band", F.struct("sheet", "kind", *BOX)).join(signed, ["sheet", "row", "col"], "left"))

    def boxes(self, *kinds: str) -> DataFrame:
        return self.structures.where(F.col("kind").isin(*kinds) & F.col("min_row").isNotNull()).select("sheet", *BOX)


def read(spark: SparkSession, path: str) -> Book:
    """The tables of all safe workbooks of a path or glob. They are kept in executors' memory and on their disks, since every
    rule reads them; what is lost is read again. Call release() when done."""
    styles = source.read_styles(spark, path)
    cells = source.read_workbooks(spark, path).join(styles, ["workbook", "style_id"], "left").withColumn("hidden", F.coalesce("hidden", F.lit(False)))
    tables = (cells, source.read_sheets(spark, path), source.read_sizes(spark, path), source.read_structures(spark, path))
    kept = [keyed(t).persist() for t in tables]
    return Book(*kept, kept=kept)


def release(b: Book) -> None:
    for t in b.kept:
        t.unpersist()


# Findings


def of_formulas(b: Book) -> list[DataFrame]:
    name = sheet_name()
    spots = b.in_bands
    written = rules.boundary_aggregates(spots.where(F.col("formula").isNotNull()))
    gaps = rules.band_gaps(spots, F.substring_index(F.col("band.sheet"), "\0", -1), address(F.when(F.col("band.kind") == "formula_row", F.col("band.min_row")).otherwise(F.col("pos")), F.when(F.col("band.kind") == "formula_row", F.col("pos")).otherwise(F.col("band.min_col"))))
    sums = b.cells.withColumn("letter", F.regexp_extract(place(), "^[A-Z]+", 0))
    return [rules.formula_findings(with_features(b.cells), name, place()), rules.formula_outliers(written, name, place()), gaps, rules.sum_boundaries(sums, name)]


def of_columns(b: Book) -> list[DataFrame]:
    name, plain = sheet_name(), b.below_headers
    rest = plain.join(rules.summary_rows(b.valued), ["sheet", "row"], "left_anti")
    checked = runs.overlapping(rest.select("sheet", "row", "col"), b.structures.where("kind = 'validation' AND min_row IS NOT NULL").select("sheet", *BOX, F.col("name").alias("validation")))
    checked = checked.groupBy("sheet", "row", "col").agg(F.min("validation").alias("validation"))
    style = F.to_json(F.struct("number_format", "size", "bold", "wrap", "align", "has_fill", "left", "right", "top", "bottom"))
    heads = runs.nearest_header(b.valued.withColumn("__text", F.when(F.col("data_type") == "s", F.col("txt"))), ["sheet", "col"], "row", "__text")
    heads = heads.where(F.col("formula").isNull()).join(b.columns.select("sheet", "col", "width"), ["sheet", "col"], "left")
    return [
        rules.numeric_texts(rest.where(F.col("formula").isNull()), name, place()), rules.style_outliers(rest.withColumn("style", style).withColumn("pos", F.col("row")), name, place()),
        rules.validation_outliers(plain.join(checked, ["sheet", "row", "col"], "left"), name, place()), rules.long_identifiers(heads, name, place()), rules.error_cells(b.cells, name, place()),
    ]


def of_structures(b: Book) -> list[DataFrame]:
    name = sheet_name()
    per_row = b.valued.groupBy("sheet", "row").agg(F.count(F.lit(1)).alias("filled"), F.count("formula").alias("formulas"))
    lines = b.heights.where("hidden_row").join(per_row, ["sheet", "row"]).withColumn("hidden", F.lit(True))
    per_col = b.valued.groupBy("sheet", "col").agg(F.count(F.lit(1)).alias("filled"), F.count("formula").alias("formulas"))
    spans = b.sizes.where("axis = 'col' AND hidden").select("sheet", "first", "last", "hidden").join(per_col, "sheet").where(F.col("col").between(F.col("first"), F.col("last")))
    spans = spans.groupBy("sheet", "first", "last", "hidden").agg(F.sum("filled").alias("filled"), F.sum("formulas").alias("formulas"))
    letters = lambda c: F.regexp_extract(address(F.lit(1), F.col(c)), "^[A-Z]+", 0)
    merged = F.concat_ws(":", address(F.col("min_row"), F.col("min_col")), address(F.col("max_row"), F.col("max_col")))
    names = b.structures.where("kind IN ('name', 'print_area', 'print_titles')").select("workbook", "sheet", "name", "detail")
    known = b.sheets.select(F.col("sheet").alias("target"))
    # A name of a mere constant has no range and no sheet; it is neither broken nor external.
    reach = names.where(F.col("sheet").isNotNull() | F.upper("detail").contains("#REF!")).select(F.coalesce("sheet", F.concat("workbook", F.lit("\0"))).alias("sheet"), "name", F.col("sheet").alias("target"), F.regexp_replace("detail", " ", "").alias("range"))
    outside = F.substring_index(F.col("sheet"), "\0", -1).contains("[") | F.col("detail").rlike(EXTERNAL.pattern)
    external = names.where(F.coalesce(outside, F.lit(False))).withColumn("sheet", F.concat("workbook", F.lit("\0")))
    shut = b.sheets.join(b.valued.groupBy("sheet").agg(F.count(F.lit(1)).alias("filled")), "sheet").where("state <> 'visible'")
    return [
        rules.hidden_data(lines, name), rules.hidden_data(spans, name, F.concat_ws(":", letters("first"), letters("last"))), rules.findings(shut, "WL008", "warning", name, F.lit(None).cast("string"), 1.0),
        rules.broken_names(reach.where(~F.coalesce(F.col("sheet").contains("["), F.lit(False))), known, F.lit(None).cast("string")).drop("reason"), rules.findings(external, "WL009", "warning", F.lit(None).cast("string"), F.col("name"), 1.0),
        rules.merges_in_data(b.merges, b.regions, name, merged),
    ]


def risks(b: Book) -> DataFrame:
    last = b.cells.groupBy("sheet").agg(F.max("col").alias("__col")).join(b.merges.groupBy("sheet").agg(F.max("max_col").alias("__merge")), "sheet", "left").select("sheet", (F.greatest("__col", F.coalesce("__merge", F.lit(0))) + 1).alias("max_col"))
    edges = layout.column_edges(b.columns, last)
    cells = b.cells.withColumn("filled", F.col("txt").isNotNull() | F.col("formula").isNotNull())
    beside = layout.overflow_room(cells, edges).where(~F.col("hidden") & (F.col("data_type") == "s") & F.col("txt").isNotNull())
    a, z = (edges.select("sheet", F.col("col").cast("long").alias(c), F.col(x).alias(f"__{x}")) for c, x in (("min_col", "begin"), ("max_col", "finish")))
    wide = b.merges.join(a, ["sheet", "min_col"]).join(z, ["sheet", "max_col"]).select("sheet", F.col("min_row").alias("row"), F.col("min_col").cast("int").alias("col"), (F.col("__finish") - F.col("__begin")).alias("__wide"))
    sized = beside.join(edges.select("sheet", "col", "width"), ["sheet", "col"]).join(wide, ["sheet", "row", "col"], "left").join(b.heights.select("sheet", "row", "height"), ["sheet", "row"], "left")
    merged = F.col("__wide").isNotNull()
    return layout.text_risks(sized.select("sheet", "row", "col", F.col("txt").alias("text"), "size", F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("wrap", F.lit(False)).alias("wrap"), "align", F.greatest(F.coalesce("__wide", "width"), F.lit(1.0)).alias("room"), F.when(merged, F.coalesce("height", F.lit(ROW))).otherwise(F.col("height")).alias("height"), merged.alias("merged"), "room_left", "room_right"))


def gaps(b: Book) -> DataFrame:
    cells = b.unmerged
    drawn = cells.select("sheet", "row", "col", F.coalesce(*layout.SIDES).isNotNull().alias("bordered"))
    return layout.border_gaps(cells.select("sheet", "row", "col", *layout.SIDES), layout.bordered_boxes(drawn, b.regions), b.cells)


def shown(b: Book) -> Column:
    """Whether a cell shows something: a value, a border, a fill; white space doesn't."""
    blank = F.coalesce((F.trim("txt") == "") & F.col("formula").isNull(), F.lit(False))
    return ~blank & (F.col("txt").isNotNull() | F.col("formula").isNotNull() | F.coalesce("has_fill", F.lit(False)) | F.coalesce(*layout.SIDES).isNotNull())


SHOWN = ("merge", "table", "filter", "validation", "conditional", "comment", "link")
GUARDS = (*SHOWN, "print_area", "print_titles", "name", "break", "drawing", "protected", "ignored")


def tails(b: Book) -> tuple[DataFrame, DataFrame]:
    """(formatting tails, white space tails), both with what blocks them."""
    content = runs.content_bounds(b.valued, b.merges)
    odd_rows = b.heights.select("sheet", "row", F.lit(True).alias("__row"))
    odd_cols = b.sizes.where("axis = 'col' AND (hidden OR outlined)").withColumn("col", F.explode(F.sequence("first", F.least("last", F.lit(16_384).cast("long"))))).select("sheet", "col", F.lit(True).alias("__col")).distinct()
    bare = b.cells.where(F.col("txt").isNull() & F.col("formula").isNull() & (F.col("style_id") != 0)).join(odd_rows, ["sheet", "row"], "left").join(odd_cols, ["sheet", "col"], "left")
    formats = runs.formatting_tails(bare.select("sheet", "row", "col", (F.coalesce("__row", F.lit(False)) | F.coalesce("__col", F.lit(False))).alias("blocked")), content)
    blank = b.cells.where(~F.col("hidden") & (F.trim("txt") == "") & F.col("formula").isNull())
    blank = blank.join(runs.overlapping(blank.select("sheet", "row", "col"), b.merges).select("sheet", "row", "col"), ["sheet", "row", "col"], "left_anti")
    spaces = layout.whitespace_tails(blank, layout.envelope(b.cells.withColumn("shown", shown(b)), b.boxes(*SHOWN)), layout.content_bounds(b.cells))
    guards = b.boxes(*GUARDS)
    formulas = b.cells.where(F.col("formula").isNotNull()).select("sheet", "formula")
    return layout.blocked_tails(formats, guards), layout.blocked_tails(spaces, guards, formulas)


def extents(b: Book) -> DataFrame:
    """(sheet, box, ...) per sheet: where its visible layout lies and how large it is drawn with set sizes."""
    box = runs.content_bounds(b.cells.where(~F.col("hidden") & shown(b)), b.boxes(*SHOWN))
    cols = box.withColumn("col", F.explode(F.sequence("min_col", F.least("max_col", F.lit(16_384).cast("long"))))).select("sheet", "col")
    wide = cols.join(b.columns.select("sheet", F.col("col").cast("long").alias("col"), "width", "hidden"), ["sheet", "col"], "left").where(~F.coalesce("hidden", F.lit(False)))
    wide = wide.groupBy("sheet").agg(F.sum(F.coalesce("width", F.lit(COLUMN))).alias("width"))
    # Rows without a size of their own are counted, not listed.
    own = b.heights.join(box.select("sheet", "min_row", "max_row"), "sheet").where(F.col("row").between(F.col("min_row"), F.col("max_row")))
    own = own.groupBy("sheet").agg(F.sum(F.when(~F.col("hidden_row"), F.coalesce("height", F.lit(ROW))).otherwise(0.0)).alias("__set"), F.count(F.lit(1)).alias("__n"))
    high = (F.col("max_row") - F.col("min_row") + 1 - F.coalesce("__n", F.lit(0))) * ROW + F.coalesce("__set", F.lit(0.0))
    return box.join(wide, "sheet", "left").join(own, "sheet", "left").withColumn("height", high).withColumn("width", F.coalesce("width", F.lit(0.0))).drop("__set", "__n")


def declared(b: Book, formats: DataFrame) -> DataFrame:
    """Sheets with their declared, stored and content bounds, and whether they have a formatting tail."""
    last = lambda i: F.regexp_extract("declared", r"(?:^|:)\$?([A-Z]+)\$?(\d+)$", i)
    letters = F.aggregate(F.split(last(1), ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))
    stored = layout.content_bounds(b.cells, b.merges).select("sheet", F.col("max_row").alias("last_row"), F.col("max_col").alias("last_col"))
    content = layout.content_bounds(b.valued, b.merges).select("sheet", F.col("max_row").alias("content_row"))
    out = b.sheets.withColumn("declared_row", last(2).try_cast("long")).withColumn("declared_col", F.when(last(1) != "", letters).cast("long"))
    has = formats.select("sheet", F.lit(True).alias("__has")).distinct()
    out = out.join(stored, "sheet", "left").join(content, "sheet", "left").join(has, "sheet", "left").withColumn("formatting_tail", F.coalesce("__has", F.lit(False)))
    holds = F.coalesce((F.col("declared_row") == F.col("last_row")) & (F.col("declared_col") == F.col("last_col")), F.lit(False))
    return out.select("sheet", "state", "protected", "declared_row", "declared_col", "last_row", "last_col", "content_row", "formatting_tail", holds.alias("declared"))


@dataclass(frozen=True)
class Scan:
    """The layout parts of a scan, made once: findings and patches both come from them."""

    book: Book

    @cached_property
    def risks(self) -> DataFrame:
        return self.book.keep(risks(self.book))

    @cached_property
    def gaps(self) -> DataFrame:
        return self.book.keep(gaps(self.book))

    @cached_property
    def tails(self) -> tuple[DataFrame, DataFrame]:
        return tuple(map(self.book.keep, tails(self.book)))

    @cached_property
    def views(self) -> DataFrame:
        """WL020, over the sizes that the patches of texts ask for."""
        planned = layout.text_patches(self.risks)
        size = layout.size_changes(planned, self.book.columns, self.book.heights)
        both = extents(self.book).join(size, "sheet", "left")
        grown = both.withColumn("width", F.col("width") + F.coalesce("more_width", F.lit(0.0))).withColumn("height", F.col("height") + F.coalesce("more_height", F.lit(0.0)))
        return self.book.keep(layout.saved_views(self.book.sheets.join(grown, "sheet"), sheet_name()))

    def layout_findings(self) -> list[DataFrame]:
        formats, spaces = self.tails
        about, name = declared(self.book, formats), sheet_name()
        return [layout.text_findings(self.risks, name), layout.border_findings(self.gaps, name), layout.used_range(formats, about, name), layout.whitespace_findings(spaces, about, name), self.views]

    def findings(self) -> DataFrame:
        """(id, rule_id, severity, workbook, sheet, location, confidence), each once."""
        parts = [*of_formulas(self.book), *of_columns(self.book), *of_structures(self.book), *self.layout_findings()]
        every = reduce(DataFrame.unionByName, [p.select("id", "rule_id", "severity", "sheet", "location", "confidence") for p in parts])
        where = F.substring_index("sheet", "\0", 1), F.nullif(sheet_name(), F.lit(""))
        return every.withColumns({"workbook": where[0], "sheet": where[1]}).dropDuplicates(["workbook", "id"]).select("id", "rule_id", "severity", "workbook", "sheet", "location", "confidence")

    def patches(self) -> DataFrame:
        """(id, kind, workbook, sheet, cell, after, source, safe, confidence, atomic_group): proposals for unprotected sheets of
        workbooks that may be repaired."""
        b, none = self.book, F.lit(None).cast("string")
        body = lambda *cols: F.to_json(F.struct(*cols))
        fills = self.fills().withColumn("atomic_group", none)
        texts = layout.text_patches(self.risks).select("sheet", place().alias("cell"), "kind", body(F.col("value")).alias("after"), none.alias("source"), F.lit(0.96).alias("confidence"), "atomic_group")
        edges = layout.border_patches(self.gaps).select("sheet", place().alias("cell"), "kind", body(F.col("side")).alias("after"), "source", "confidence", "atomic_group")
        views = self.views.where("origin IS NOT NULL OR zoom_to IS NOT NULL").select("sheet", F.col("location").alias("cell"), F.lit("set_sheet_view").alias("kind"), body(F.col("origin"), F.col("zoom_to")).alias("after"), none.alias("source"), F.lit(0.99).alias("confidence"), none.alias("atomic_group"))
        formats, spaces = self.tails
        about = declared(b, formats)
        clear = layout.used_range(formats, about, sheet_name()).where("clear").withColumn("kind", F.lit("clear_formatting_tail"))
        remove = layout.whitespace_findings(spaces, about, sheet_name()).where("remove").withColumn("kind", F.lit("remove_whitespace_tail_cells"))
        cleaned = [t.select("sheet", F.lit("A1").alias("cell"), "kind", body(F.col("location")).alias("after"), none.alias("source"), F.lit(0.99).alias("confidence"), none.alias("atomic_group")) for t in (clear, remove)]
        every = reduce(DataFrame.unionByName, [fills, texts, edges, views, *cleaned])
        free = b.sheets.where(~F.col("protected")).select("sheet")
        safe = F.col("kind").isin("create_formula", "set_formula", "set_numeric", "copy_style") & (F.col("confidence") >= 0.95)
        out = every.join(free, "sheet", "left_semi").withColumn("id", stable_id("patch", F.col("kind"), sheet_name(), F.col("cell"), F.col("after"))).withColumn("safe", safe)
        return out.withColumns({"workbook": F.substring_index("sheet", "\0", 1), "sheet": sheet_name()}).select("id", "kind", "workbook", "sheet", "cell", "after", "source", "safe", "confidence", "atomic_group")

    def fills(self) -> DataFrame:
        """Formulas for blanks and literals of bands, where all that can be moved there agree."""
        spots = self.book.in_bands.withColumn("coord", place())
        holes = rules.band_holes(spots).select("band", "pos", "kind")
        hit = holes.join(spots.where("formula IS NULL").select("band", "pos", "sheet", "row", "col", "coord"), ["band", "pos"])
        moved = rules.translated_consensus(spots.where("formula IS NOT NULL").select("band", "row", "col", "coord", "formula"), hit.select("band", "pos", F.col("row").alias("to_row"), F.col("col").alias("to_col")))
        kind = F.when(F.col("kind") == "blank", "create_formula").otherwise("set_formula")
        return hit.join(moved, ["band", "pos"]).select("sheet", F.col("coord").alias("cell"), kind.alias("kind"), F.to_json(F.struct("formula")).alias("after"), "source", F.lit(0.99).alias("confidence"))


def scan(spark: SparkSession, path: str) -> Scan:
    """A scan of the workbooks of a path or glob; nothing is computed before its findings or patches are."""
    return Scan(read(spark, path))
