"""Quality rules by document, and by host with empirical-Bayes shrinkage.

Documents are judged by base rules. For each rule, failures are aggregated by host; the spread of host rates gives an
empirical beta prior, and a host's rate is shrunk towards it, so a host of few documents is not condemned by them.
Documents of a host whose shrunk rate of any rule exceeds the limit go as well.
"""

from __future__ import annotations

from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAPS, fresh, maybe_broadcast, prepare, stored

SYMBOLS = "#*$%&|<>"
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
WINDOW = 5


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words found twice or more, its first place included."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(islice(words, i, None) for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, often = set(), set()
    for w in windows:
        (often if w in seen else seen).add(w)
    total, reach = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + width - max(i, reach)
            reach = i + width
    return total


def text_metrics(text: str | None) -> tuple[int, ...]:
    """The columns of METRICS for one whole text; all 0 for a null or empty one."""
    if not text:
        return (0,) * 6
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, WORD_GAPS))
    lines = [x for x in text.split("\n") if x.strip(WORD_GAPS)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def metrics_of(texts: pd.Series) -> pd.DataFrame:
    names = [x.split()[0] for x in METRICS.split(", ")]
    return pd.DataFrame([text_metrics(t) for t in texts], columns=names).astype("int64")


def rule_failures(m: str = "rules") -> dict[str, Column]:
    """The rules whose failures are counted by host; base: those that fail a document by themselves."""
    c = lambda name: F.col(f"{m}.{name}")
    return {
        "base": (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words")),
        "symbols": 100 * c("n_symbols") > 20 * c("word_chars"),
        "dup_lines": 100 * c("n_dup_lines") > 50 * c("n_lines"),
    }


def shrunk_rates(hosts: DataFrame, rules: list[str]) -> DataFrame:
    """hosts(host, n, one count per rule) with a rate per rule, shrunk to a beta prior fitted by moments.

    With pooled rate m and variance v of host rates beyond what sampling explains, the prior weighs
    s = m (1 - m) / v - 1 documents; s is held between 1 and 1e6, the latter if hosts don't differ.
    One row of sums comes to the driver.
    """
    total, n = F.sum("n"), F.count(F.lit(1))
    sums = [F.sum(r).alias(f"{r}_k") for r in rules] + [F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_q") for r in rules]
    row = hosts.agg(total.alias("total"), n.alias("hosts"), *sums).first()
    out = hosts
    for r in rules:
        if not row["total"]:
            m, s = 0.0, 1.0
        else:
            m = row[f"{r}_k"] / row["total"]
            between = row[f"{r}_q"] / row["total"] - m * m - m * (1 - m) * (row["hosts"] - 1) / row["total"]
            s = min(1e6, max(1.0, m * (1 - m) / between - 1)) if between > 0 else 1e6
        out = out.withColumn(f"{r}_rate", (F.col(r) + F.lit(m * s)) / (F.col("n") + F.lit(s)))
    return out


def host_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep: list[str] | None = None, limit: float = 0.5, out_col: str = "rules") -> DataFrame:
    """The columns `keep` (all, if not given) and a struct out_col: the metrics, base_failed, host_rate (the highest
    shrunk rate of a rule), host_failed and kept.

    A null text has no words and fails the base rules; null hosts count as one host. Repeated rows count as often as
    they occur. An empty table gives an empty result. A column named out_col is replaced. Hot hosts are pre-aggregated.
    """
    prepare(docs.sparkSession)
    keep = [c for c in (keep if keep is not None else docs.columns) if c != out_col]
    host, m, its = fresh(docs.columns, "host", "m", "its")
    metrics = F.pandas_udf(metrics_of, METRICS)(F.col(f"`{text_col}`").cast("string"))
    measured = stored(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{host_col}`").cast("string").alias(host), metrics.alias(m)), "rules-metrics")
    failures = rule_failures(m)
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x.cast("long")).alias(r) for r, x in failures.items()])
    rates = shrunk_rates(stored(hosts, "rules-hosts"), list(failures))
    rates = rates.select(F.struct("host", F.greatest(*[F.col(f"{r}_rate") for r in failures]).alias("rate")).alias(its))
    joined = measured.join(maybe_broadcast(rates, f"{its}.host"), F.col(host).eqNullSafe(F.col(f"{its}.host")))
    rate = F.col(f"{its}.rate")
    bad = rate > F.lit(limit)
    out = F.struct(f"{m}.*", failures["base"].alias("base_failed"), rate.alias("host_rate"), bad.alias("host_failed"), (~failures["base"] & ~bad).alias("kept"))
    return joined.select(*[F.col(f"`{c}`") for c in keep], out.alias(out_col))
