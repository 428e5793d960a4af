"""Semantic differences of two cell tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cell_changes(before: DataFrame, after: DataFrame, key: list[str], fields: dict[str, str]) -> DataFrame:
    """(key, field, severity, before, after): one row per field that differs, null-safe; a cell on one side only differs
    in each field that it has there. fields gives a severity for each. One full outer join, no self-union."""
    old = before.select(*key, *[F.col(f).cast("string").alias(f"__b_{f}") for f in fields])
    new = after.select(*key, *[F.col(f).cast("string").alias(f"__a_{f}") for f in fields])
    changes = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(s).alias("severity"), F.col(f"__b_{f}").alias("before"), F.col(f"__a_{f}").alias("after")) for f, s in fields.items()])
    rows = old.join(new, key, "full").select(*key, F.explode(changes).alias("c")).select(*key, "c.*")
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


def list_changes(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    """(cols, change): distinct items removed or added."""
    old, new = before.select(*cols).distinct(), after.select(*cols).distinct()
    return old.join(new, cols, "left_anti").withColumn("change", F.lit("removed")).unionByName(new.join(old, cols, "left_anti").withColumn("change", F.lit("added")))


def renamed_sheets(before: DataFrame, after: DataFrame) -> DataFrame:
    """(old, new) over sheets(sheet, content): sheets gone and come whose content hash pairs them one to one."""
    gone = before.join(after.select("sheet"), "sheet", "left_anti")
    come = after.join(before.select("sheet"), "sheet", "left_anti")
    alone = lambda df, name: df.groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.min("sheet").alias(name)).where(F.col("n") == 1).drop("n")
    return alone(gone, "old").join(alone(come, "new"), "content").select("old", "new")


def sheet_contents(cells: DataFrame) -> DataFrame:
    """(sheet, content): a digest of a sheet's cells that doesn't depend on their order: two sums of 64-bit hashes."""
    h = lambda seed: F.sum(F.xxhash64("row", "col", "txt", F.lit(seed)).cast("decimal(38,0)"))
    return cells.groupBy("sheet").agg(F.concat_ws(":", F.count(F.lit(1)), h(1), h(2)).alias("content"))


def finding_sets(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, state): resolved, remaining or new."""
    both = before.select("id", F.lit(True).alias("b")).distinct().join(after.select("id", F.lit(True).alias("a")).distinct(), "id", "full")
    return both.select("id", F.when(F.col("a").isNull(), "resolved").when(F.col("b").isNull(), "new").otherwise("remaining").alias("state"))


def latest_by(df: DataFrame, by: list[str], *order) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") == 1).drop("__n")


def map_changes(before: DataFrame, after: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, entry, before, after): entries of a map column that differ, null-safe; an entry on one side only differs."""
    rows = lambda df, side: df.select(*key, F.explode(column).alias("entry", side))
    both = rows(before, "before").join(rows(after, "after"), [*key, "entry"], "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def summarised(changes: DataFrame, by: list[str], most: int) -> DataFrame:
    """(by, n, first): groups of changes(by, place) beyond `most` as one row each with their least places; smaller ones as they are."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("place"))
    counted = changes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    first = changes.withColumn("__r", rank).where(F.col("__r") <= most).groupBy(*by).agg(F.array_sort(F.collect_list("place")).alias("first"))
    return counted.join(first, by)
