"""Language identification by Bayesian evidence fusion.

log posterior = tempered log likelihood of the text (character trigrams) + log likelihoods of the declared markup
language and of the address suffix + log prior of the host. The reliability of declarations and suffixes and the priors
come from grouped aggregation over all pages; a host's prior is smoothed towards its domain's, and that towards the
corpus's, so a host of one page says little.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, prepare, stored

BUCKETS = 1 << 15
#: Labelled texts that the trigram model is fitted on, and languages that it knows, at most.
SAMPLE, LANGUAGES = 3_000, 64
#: Trigrams that a text counts for, at most: neighbours are not independent, so longer texts are tempered to this.
WEIGHT = 60.0
#: Pages that the level above weighs in a smoothed prior.
SMOOTH = 5.0
_HIDDEN = re.compile(r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"(?s)<[^>]*>")
_LETTERS = re.compile(r"[^\W\d_]+")


def page_text(html: str | None) -> str:
    """What a page shows, by and large: without scripts, styles, comments, tags and entities."""
    plain = _TAG.sub(" ", _HIDDEN.sub(" ", html or ""))
    return re.sub(r"&#?\w+;", " ", plain)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the character trigrams of a text's words, lower-cased and padded with a space."""
    words = _LETTERS.findall(text.lower())
    if not words:
        return np.zeros(0, np.int64)
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1]) * np.uint64(0x85EBCA77) + codes[2:]
    h = (h ^ (h >> np.uint64(15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # a row for each language, a column for each bucket

    def evidence(self, text: str) -> list[float]:
        """Tempered log likelihood by language; all 0 for a text without letters."""
        t = trigrams(text)
        if not len(t) or not self.languages:
            return [0.0] * len(self.languages)
        return (self.logs[:, t].mean(1) * min(len(t), WEIGHT)).tolist()


def fit(texts: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> TextModel:
    """Trigram frequencies by language from at most `sample` texts, chosen by a hash of the id; null languages are left out."""
    prepare(texts.sparkSession)
    chosen = texts.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    few = chosen.select("id").orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = chosen.join(F.broadcast(few.distinct()), "id")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in frames:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                total[lang] = total.get(lang, 0) + np.bincount(trigrams(text or ""), minlength=BUCKETS)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "b": at, "n": c[at]})

    counted = stored(chosen.select("lang", "text").mapInPandas(count, "lang string, b int, n long"), "lang-counts")
    names = sorted(r["lang"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect())
    counts = np.full((len(names), BUCKETS), 0.5)
    for r in counted.where(F.col("lang").isin(names)).groupBy("lang", "b").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[names.index(r["lang"]), r["b"]] += r["n"]
    return TextModel(names, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))


def reliability(pages: DataFrame, column: str, names: list[str]) -> DataFrame:
    """P(value | language) for each value of a declared column, smoothed, as an array by language; from grouped counts."""
    counts = pages.where(F.col(column).isNotNull()).groupBy(column).agg(*[F.count(F.when(F.col("guess") == i, 1)).alias(f"n{i}") for i in range(len(names))])
    totals = pages.groupBy().agg(*[F.count(F.when((F.col("guess") == i) & F.col(column).isNotNull(), 1)) for i in range(len(names))]).first()
    logs = [F.log((F.col(f"n{i}") + 0.5) / F.lit(totals[i] + 0.5 * (len(names) + 1))) for i in range(len(names))]
    return counts.select(F.col(column).alias(f"__{column}"), F.array(*logs).alias(f"{column}_log"))


def smoothed_priors(pages: DataFrame, names: list[str]) -> DataFrame:
    """Log priors by host: counts by host, smoothed to those of its domain, smoothed to those of all pages."""
    n = range(len(names))
    totals = pages.groupBy().agg(*[F.count(F.when(F.col("guess") == i, 1)) for i in n]).first()
    base = [(totals[i] + 1) / (sum(totals[j] for j in n) + len(names)) for i in n]
    hosts = pages.groupBy("host", "domain").agg(*[F.count(F.when(F.col("guess") == i, 1)).alias(f"n{i}") for i in n])
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"m{i}") for i in n]).withColumnRenamed("domain", "__domain")
    both = hosts.join(domains, F.col("domain").eqNullSafe(F.col("__domain")))
    m_total, n_total = sum((F.col(f"m{i}") for i in n), F.lit(0)), sum((F.col(f"n{i}") for i in n), F.lit(0))
    logs = []
    for i in n:
        domain = (F.col(f"m{i}") + F.lit(SMOOTH * base[i])) / (m_total + F.lit(SMOOTH))
        logs.append(F.log((F.col(f"n{i}") + F.lit(SMOOTH) * domain) / (n_total + F.lit(SMOOTH))))
    return both.select(F.col("host").alias("__host"), F.array(*logs).alias("host_log"))


def declared_language(html: Column) -> Column:
    """The primary subtag of the html element's lang attribute, lower-cased; null without one."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return F.when(found != "", found)


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (id_col, if not given) with lang, confidence (its posterior), text_lang and declared_lang.

    Null or empty html has no text evidence and no declaration, a url that can't be parsed no suffix and the null host;
    the priors then decide. Ties go to the language that sorts first. Repeated rows count as often as they occur.
    Without languages in the model, lang is null. Other columns are not read. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    prepare(spark)
    names, keep = model.languages, keep if keep is not None else [id_col]
    shared = spark.sparkContext.broadcast(model)

    def evidence(html: pd.Series) -> pd.Series:
        return pd.Series([shared.value.evidence(page_text(x)) for x in html], dtype=object)

    html, url = F.col(f"`{html_col}`").cast("string"), F.col(f"`{url_col}`").cast("string")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    base = pages.select(*[F.col(f"`{c}`") for c in keep], F.when(host != "", host).alias("host"), declared_language(html).alias("declared"), F.pandas_udf(evidence, "array<double>")(html).alias("text_log"))
    if not names:
        return base.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.col("declared").alias("declared_lang"))
    labels_ = F.split("host", r"\.")
    base = base.withColumn("suffix", F.element_at(labels_, -1)).withColumn("domain", F.array_join(F.slice(labels_, F.greatest(F.lit(1), F.size(labels_) - 1), 2), "."))
    seen = F.array_max("text_log") > F.array_min("text_log") if len(names) > 1 else F.lit(True)
    base = stored(base.withColumn("guess", F.when(seen, F.array_position("text_log", F.array_max("text_log")) - 1)), "lang-evidence")
    zero = F.array(*[F.lit(0.0)] * len(names))
    out = base
    for column in ("declared", "suffix"):
        table = reliability(base, column, names)
        out = out.join(maybe_broadcast(table, f"__{column}"), F.col(column) == F.col(f"__{column}"), "left")
    priors = smoothed_priors(base, names)
    out = out.join(maybe_broadcast(priors, "__host"), F.col("host").eqNullSafe(F.col("__host")), "left")
    total = F.col("text_log")
    for c in ("declared_log", "suffix_log", "host_log"):
        total = F.zip_with(total, F.coalesce(F.col(c), zero), lambda a, b: a + b)
    out = out.withColumn("all_log", total).withColumn("top", F.array_max("all_log"))
    name = F.array(*[F.lit(x) for x in names])
    share = F.lit(1.0) / F.aggregate(F.transform("all_log", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    lang = F.element_at(name, F.array_position("all_log", F.col("top")).cast("int"))
    text_lang = F.when(F.col("guess").isNotNull(), F.element_at(name, (F.col("guess") + 1).cast("int")))
    return out.select(*[F.col(f"`{c}`") for c in keep], lang.alias("lang"), share.alias("confidence"), text_lang.alias("text_lang"), F.col("declared").alias("declared_lang"))
