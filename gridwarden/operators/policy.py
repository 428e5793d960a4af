"""Baselines and waivers: which findings are active."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks and weights of severities.
RANK = {"info": 0, "warning": 1, "error": 2, "critical": 3}
WEIGHT = {"info": 1, "warning": 5, "error": 15, "critical": 35}


@dataclass(frozen=True)
class Waiver:
    """All dimensions given must match, one pattern of each suffices. It is valid on its last day. One without any
    dimension would match everything and is refused."""

    rules: tuple[str, ...] = ()
    locations: tuple[str, ...] = ()
    expires: date | None = None
    ids: tuple[str, ...] = ()
    sheets: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not (self.rules or self.locations or self.ids or self.sheets):
            raise ValueError("a waiver names an id, a rule, a sheet or a location")


def glob(pattern: str) -> str:
    """A case-sensitive glob with *, ? and [] as a Java regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        end = pattern.find("]", i + 1) if c == "[" else -1
        if c == "*":
            out += "(?s:.*)"
        elif c == "?":
            out += "(?s:.)"
        elif end > 0:
            own, i = pattern[i:end].replace("\\", "\\\\"), end + 1
            out += "[" + ("^" + own[1:] if own[0] == "!" else own) + "]"
        else:
            out += re.escape(c)
    return f"^{out}$"


def matches(w: Waiver) -> Column:
    """Whether a finding(id, rule_id, location, and sheet if the waiver names one) is meant; a null place is none."""
    parts = [F.col(c).isin(*own) for c, own in (("id", w.ids), ("rule_id", w.rules)) if own]
    for c, patterns in (("sheet", w.sheets), ("location", w.locations)):
        if patterns:
            parts.append(F.coalesce(F.col(c).rlike("|".join(map(glob, patterns))), F.lit(False)))
    return reduce(Column.__and__, parts)


def classify(findings: DataFrame, waivers: list[Waiver], baseline: DataFrame | None, as_of: date, new_only: bool = False) -> DataFrame:
    """findings with waiver (place of the first valid one that matches) and status: suppressed, baseline, new or active.

    Waivers are few and come from a file, so they are expressions; the baseline(id) is joined.
    """
    first = F.lit(None).cast("int")
    for i, w in reversed(list(enumerate(waivers))):
        if w.expires is None or w.expires >= as_of:
            first = F.when(matches(w), F.lit(i)).otherwise(first)
    out = findings.withColumn("waiver", first)
    if baseline is None:
        return out.withColumn("status", F.when(F.col("waiver").isNotNull(), "suppressed").otherwise("active"))
    known = baseline.select(F.col("id").alias("__known")).distinct()
    out = out.join(known, F.col("id") == F.col("__known"), "left")
    old = F.lit("baseline") if new_only else F.lit("active")
    return out.withColumn("status", F.when(F.col("waiver").isNotNull(), "suppressed").when(F.col("__known").isNotNull(), old).otherwise("new")).drop("__known")


def summary(classified: DataFrame) -> DataFrame:
    count = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return classified.agg(F.count(F.lit(1)).alias("total"), count("active", "new").alias("active"), count("suppressed").alias("suppressed"), count("baseline").alias("known"), count("new").alias("new"))


def weighted_score(findings: DataFrame) -> DataFrame:
    weight = F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv])
    return findings.agg(F.coalesce(F.sum(F.element_at(weight, F.col("severity"))), F.lit(0)).cast("long").alias("score"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def gate(findings: DataFrame, at_least: str) -> DataFrame:
    """failed: whether any active finding is of that severity or above."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    return findings.agg(F.coalesce(F.max(F.element_at(rank, F.col("severity"))) >= RANK[at_least], F.lit(False)).alias("failed"))
