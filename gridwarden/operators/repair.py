"""Patches: selecting, merging, and applying them to a cell table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Patch kinds that change layout and need consent.
LAYOUT = ("set_column_width", "set_row_height", "set_wrap_text", "set_shrink_to_fit", "set_sheet_view", "copy_border", "clear_formatting_tail", "remove_whitespace_tail_cells")


def select_safe(patches: DataFrame, least: float = 0.95) -> DataFrame:
    """Safe patches of enough confidence; an atomic group goes in whole or not at all."""
    fit = F.col("safe") & (F.col("confidence") >= least)
    groups = patches.where(F.col("atomic_group").isNotNull()).groupBy("atomic_group").agg(F.bool_and(fit).alias("whole"))
    joined = patches.join(groups, "atomic_group", "left")
    return joined.where(fit & F.coalesce("whole", F.lit(True))).drop("whole")


def select_ids(patches: DataFrame, ids: DataFrame, layout: bool = False) -> DataFrame:
    """Patches named by ids(id), with the groups they belong to complete; layout ones only with consent."""
    named = patches.join(ids.select("id").distinct(), "id", "left_semi")
    n = named.groupBy("atomic_group").agg(F.count(F.lit(1)).alias("got"))
    full = patches.where(F.col("atomic_group").isNotNull()).groupBy("atomic_group").agg(F.count(F.lit(1)).alias("all"))
    whole = n.join(full, "atomic_group").where(F.col("got") == F.col("all")).select("atomic_group")
    out = named.where(F.col("atomic_group").isNull()).unionByName(named.join(whole, "atomic_group", "left_semi").select(*named.columns))
    return out if layout else out.where(~F.col("kind").isin(*LAYOUT))


def conflicts(patches: DataFrame) -> DataFrame:
    """(sheet, cell, domain, n): targets that several patches of one domain change."""
    domain = F.when(F.col("kind").isin("set_formula", "create_formula", "set_numeric", "set_text", "extend_sum"), "value").when(F.col("kind").isin("copy_style", "copy_border"), "style").otherwise("layout")
    return patches.withColumn("domain", domain).groupBy("sheet", "cell", "domain").agg(F.countDistinct("id").alias("n")).where(F.col("n") > 1)


def coalesce_widths(patches: DataFrame) -> DataFrame:
    """Of the width requests for a column that are in no atomic group, the widest; ties to the smaller id."""
    single = F.col("atomic_group").isNull() & (F.col("kind") == "set_column_width")
    rank = F.row_number().over(Window.partitionBy("sheet", "cell", single).orderBy(F.desc("width"), "id"))
    return patches.withColumn("__n", rank).where(~single | (F.col("__n") == 1)).drop("__n")


def apply_to_cells(cells: DataFrame, patches: DataFrame, key: list[str]) -> DataFrame:
    """cells with txt replaced by after, where the patch's before still holds; others keep theirs. A patch whose before is
    null makes a cell that isn't there. Cells that several patches change are in conflict: none of those is applied, so
    no cell is lost or multiplied."""
    one = patches.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.first("before").alias("__before"), F.first("after").alias("__after")).where(F.col("__n") == 1).drop("__n")
    old = cells.withColumn("__cell", F.lit(True))
    joined = old.join(one.withColumn("__hit", F.lit(True)), key, "full")
    fresh = F.col("__hit") & F.col("txt").eqNullSafe(F.col("__before"))
    there = joined.withColumn("__fresh", F.coalesce(fresh, F.lit(False))).where(F.coalesce("__cell", F.lit(False)) | F.col("__fresh") & F.col("__after").isNotNull())
    return there.withColumn("txt", F.when(F.col("__fresh"), F.col("__after")).otherwise(F.col("txt"))).select(*cells.columns)


def identity_conflicts(patches: DataFrame) -> DataFrame:
    """Ids that stand for patches of different content."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(patches.columns) if c != "id"]))
    return patches.withColumn("__body", body).groupBy("id").agg(F.countDistinct("__body").alias("n")).where(F.col("n") > 1)
