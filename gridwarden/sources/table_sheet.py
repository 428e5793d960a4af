"""Any table seen as a sheet: one row per stored cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def as_cells(df: DataFrame, sheet: str, key: str, columns: list[str] | None = None) -> DataFrame:
    """(sheet, row, col, header, t, num, txt) of the columns, in long form, for a dense unique key from 0.

    The header is row 1, so the record of key k is row k + 2: no window numbers the rows. t is n, s, b or d; nulls
    are blank and stored nowhere. One pass, no shuffle.
    """
    names = columns or df.columns
    kinds = dict(df.dtypes)
    parts = []
    for i, c in enumerate(df.columns):
        if c in names:
            kind = kinds[c]
            t = "n" if kind in NUMERIC or kind.startswith("decimal") else "b" if kind == "boolean" else "d" if kind in ("date", "timestamp", "timestamp_ntz") else "s"
            num = F.col(c).cast("double") if t == "n" else F.lit(None).cast("double")
            parts.append(F.struct(F.lit(i + 1).alias("col"), F.lit(c).alias("header"), F.lit(t).alias("t"), num.alias("num"), F.col(c).cast("string").alias("txt")))
    cells = df.select((F.col(key) + 2).cast("long").alias("row"), F.explode(F.array(*parts)).alias("c"))
    return cells.select(F.lit(sheet).alias("sheet"), "row", "c.*").where(F.col("txt").isNotNull())
