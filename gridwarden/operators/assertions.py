"""Assertions over columns, each one row: name, passed, violations. Aggregates only; nothing is collected."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result(df: DataFrame, name: str, violations: Column) -> DataFrame:
    n = F.coalesce(violations, F.lit(0)).cast("long")
    return df.agg(n.alias("violations")).select(F.lit(name).alias("assertion"), (F.col("violations") == 0).alias("passed"), "violations")


def unique(df: DataFrame, col: str, name: str = "unique") -> DataFrame:
    """Violations: values, other than null, that occur more than once."""
    return result(df.where(F.col(col).isNotNull()).groupBy(col).count(), name, F.count(F.when(F.col("count") > 1, 1)))


def allowed_values(df: DataFrame, col: str, allowed: list, name: str = "allowed_values") -> DataFrame:
    """Violations: rows whose value isn't in the list; null isn't."""
    return result(df, name, F.count(F.when(~F.coalesce(F.col(col).isin(*allowed), F.lit(False)), 1)))


def nonblank(df: DataFrame, col: str, name: str = "nonblank") -> DataFrame:
    """Violations: nulls and empty texts; a space is not blank."""
    return result(df, name, F.count(F.when(F.col(col).isNull() | (F.col(col).cast("string") == ""), 1)))


def numeric_bounds(df: DataFrame, col: str, low: float | None = None, high: float | None = None, name: str = "numeric_bounds") -> DataFrame:
    """Violations: rows that are null or outside the bounds given."""
    bad = F.col(col).isNull()
    if low is not None:
        bad = bad | (F.col(col) < low)
    if high is not None:
        bad = bad | (F.col(col) > high)
    return result(df, name, F.count(F.when(bad, 1)))


def equals(left: DataFrame, right: DataFrame, tolerance: float = 0.0, name: str = "equals") -> DataFrame:
    """Two one-row, one-column frames, equal within a tolerance; a null equals nothing."""
    both = left.select(F.col(left.columns[0]).alias("value")).unionByName(right.select(F.col(right.columns[0]).alias("value")))
    return result(both, name, F.when((F.count("value") == 2) & (F.max("value") - F.min("value") <= tolerance), 0).otherwise(1))


def no_findings(found: DataFrame, rules: list[str], name: str = "no_findings") -> DataFrame:
    """Violations: active findings of the rules, of any rule if none are given."""
    hit = F.col("rule_id").isin(*rules) if rules else F.lit(True)
    return result(found, name, F.count(F.when(hit, 1)))


def thresholds(found: DataFrame, most: dict[str, int]) -> DataFrame:
    """One row per severity: passed if it has at most so many findings. One aggregation for all."""
    counts = found.agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in most])
    each = [F.struct(F.lit(f"max_{s}_findings").alias("assertion"), (F.col(s) <= n).alias("passed"), F.col(s).alias("violations")) for s, n in most.items()]
    return counts.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def failed(name: str, reason: str, df: DataFrame) -> DataFrame:
    """The row of an assertion that could not be evaluated: not passed, its violations unknown."""
    return df.sparkSession.range(1).select(F.lit(f"{name}: {reason}").alias("assertion"), F.lit(False).alias("passed"), F.lit(None).cast("long").alias("violations"))


def evaluated(checks: dict[str, Callable[[], DataFrame]], df: DataFrame) -> DataFrame:
    """All checks, one row each; one that can't be planned, by a missing column for instance, fails with its reason and
    doesn't stop the others."""
    rows = []
    for name, check in checks.items():
        try:
            rows.append(check())
        except AnalysisException as e:
            rows.append(failed(name, e.getCondition() or "error", df))
    return reduce(DataFrame.unionByName, rows)


def total(cells: DataFrame, name: str, expected: float, tolerance: float = 0.0) -> DataFrame:
    """Whether the numbers of cells(num) add up to what is expected; texts and blanks count nothing."""
    return equals(cells.agg(F.coalesce(F.sum("num"), F.lit(0.0)).alias("x")), cells.sparkSession.range(1).select(F.lit(float(expected)).alias("x")), tolerance, name)
