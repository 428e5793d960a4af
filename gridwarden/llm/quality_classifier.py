"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + w.x + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]): all pairwise interactions in time
linear in the words of a text. Words enter by hash; each statistic enters by the bin that it falls in.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAPS, prepare
from .learning import held_out, labelled

#: Word buckets, bins of a statistic, and rank of the interactions.
BUCKETS, BINS, RANK = 1 << 14, 12, 8
STATS = ("words", "chars", "mean_word", "upper", "symbols", "bangs", "digits", "pipes", "other", "distinct", "pairs", "long_word", "lines", "dup_lines", "n_chars")
WIDTH = BUCKETS + BINS * len(STATS)
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 6_000


def text_features(text: str | None, n_chars: float | None) -> np.ndarray:
    """Feature indices of one whole text: its distinct word buckets, then one bin for each statistic."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    n, size = len(words), max(1, len(text))
    distinct = set(words)
    own = np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct)) % BUCKETS
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    of = lambda chars: counts[np.frombuffer(chars, np.uint8)].sum() / size
    lines = [x for x in text.split("\n") if x.strip(WORD_GAPS)]
    step = max(1, n)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
    longest = words.count(max(distinct, key=lambda w: (len(w), w))) if distinct else 0  # how often the longest word occurs
    values = (
        math.log2(n + 1) / 14, math.log2(size) / 18, len(raw) / step / 16, of(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") * 2, of(b"#*$%&<>@^~") * 5, of(b"!?") * 10, of(b"0123456789") * 5,
        of(b"|") * 20, counts[128:].sum() / size, len(distinct) / step, pairs, longest / step, len(lines) / step * 5, 1 - len(set(lines)) / max(1, len(lines)), math.log2(max(n_chars or size, 0) + 1) / 18,
    )
    bins = [BUCKETS + BINS * j + min(BINS - 1, max(0, int(v * BINS))) for j, v in enumerate(values)]
    return np.concatenate([np.unique(own), np.array(bins, np.int64)]).astype(np.int32)


def strengths(features: np.ndarray) -> np.ndarray:
    """Feature values: words share a length of one, statistics count one each."""
    words = len(features) - len(STATS)
    x = np.ones(len(features), np.float32)
    x[:words] = 1 / math.sqrt(words) if words else 0
    return x


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, features: np.ndarray) -> float:
        x = strengths(features)
        v = self.factors[features] * x[:, None]
        z = self.bias + float(self.linear[features] @ x) + 0.5 * float((v.sum(0) ** 2).sum() - (v * v).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 8, rate: float = 0.1, decay: float = 2e-4, batch: int = 128, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad over minibatches. Without rows of both labels: a constant, their share (0.5 if none)."""
    share = float(np.clip(labels.mean(), 0.02, 0.98)) if len(labels) else 0.5
    rng = np.random.default_rng(seed)
    m = Machine(math.log(share / (1 - share)), np.zeros(WIDTH, np.float32), rng.normal(0, 0.02, (WIDTH, RANK)).astype(np.float32))
    if len(set(labels.tolist())) < 2:
        m.factors[:] = 0
        return m
    seen_w, seen_v = np.full(WIDTH, 1e-6, np.float32), np.full((WIDTH, RANK), 1e-6, np.float32)
    values = [strengths(r) for r in rows]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            own = order[at : at + batch]
            sizes = np.array([len(rows[i]) for i in own])
            idx, x = np.concatenate([rows[i] for i in own]), np.concatenate([values[i] for i in own])
            starts, doc = np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(own)), sizes)
            v = m.factors[idx] * x[:, None]
            sums = np.add.reduceat(v, starts)
            z = m.bias + np.add.reduceat(m.linear[idx] * x, starts) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((v * v).sum(1), starts))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]).astype(np.float32)[doc]
            used, place = np.unique(idx, return_inverse=True)
            gw = np.bincount(place, g * x) + decay * m.linear[used]
            each = (g * x)[:, None] * (sums[doc] - v)
            gv = np.stack([np.bincount(place, each[:, f]) for f in range(RANK)], 1) + decay * m.factors[used]
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            m.linear[used] -= rate * gw / np.sqrt(seen_w[used])
            m.factors[used] -= 0.3 * rate * gv / np.sqrt(seen_v[used])
    return m


def features_of(texts: pd.Series, n_chars: pd.Series) -> pd.Series:
    return pd.Series([text_features(t, None if pd.isna(n) else n).tobytes() for t, n in zip(texts, n_chars, strict=True)], dtype=object)


def size_column(docs: DataFrame):
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Machine:
    """Fits on at most `sample` labelled documents outside the held-out fifth; their features, not texts, reach the driver."""
    prepare(docs.sparkSession)
    chosen = labelled(docs.select(id_col, text_col, *[c for c in ("n_chars",) if c in docs.columns]), labels, label_col, id_col, sample)
    got = chosen.select(F.xxhash64(id_col).alias("k"), "__label", F.pandas_udf(features_of, "binary")(F.col(text_col), size_column(docs)).alias("f")).toPandas()
    got = got.assign(f=got["f"].map(bytes)).sort_values(["k", "f"])
    return train([np.frombuffer(f, np.int32) for f in got["f"]], got["__label"].to_numpy(np.float32))


def score(docs: DataFrame, machine: Machine, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of every whole text, higher for better.

    Null and empty texts are scored by their statistics; a null n_chars counts as the text's length. Repeated rows
    score alike. A column named out_col is replaced.
    """
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def scored(texts: pd.Series, n_chars: pd.Series) -> pd.Series:
        return pd.Series([model.value.score(text_features(t, None if pd.isna(n) else n)) for t, n in zip(texts, n_chars, strict=True)], dtype="float64")

    return docs.withColumn(out_col, scored(F.col(f"`{text_col}`").cast("string"), size_column(docs)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, score and predicted (1 from the threshold on). An empty table gives an empty result."""
    scored = score(docs, fit(docs, labels, "quality", id_col, text_col, sample), text_col)
    return scored.withColumns({"held_out": held_out(F.col(f"`{id_col}`")), "predicted": (F.col("score") >= threshold).cast("int")})
