"""MinHash near-duplicates of documents: many universal hash minima, banding, signature check, exact check on full
sets, and components by alternating large-star and small-star.

Documents of equal sets are one node. With 32 bands of 4 minima a pair of similarity 0.75 is missed with a probability
of 5e-6; only documents that share a band have their sets built for the exact check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_ids, drop_stored, prepare, stored
from .linking import agreeing, band_keys, joined_pairs, link, mixed, remaining_edges, shared_buckets, similar

WIDTH = 5
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Signatures that agree in a smaller share than this are 5 standard deviations below a similarity of 0.75.
SIGNATURE_LEAST = 0.55
_RNG = np.random.default_rng(5)
_WORD = _RNG.integers(1, 1 << 62, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint32)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence if it is shorter; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    if n <= 0:
        return np.unique(mixed((h * _WORD[: len(h)]).sum(keepdims=True) + np.uint64(len(h))))
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += h[i : i + n] * _WORD[i]
    return np.unique(mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash a x + b modulo 2^32 over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (_A[:, None] * x[None, at : at + 2048] + _B[:, None]).min(1), out=least)
    return least


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, the set's 128-bit key and its signature; the latter null for an empty set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            keys = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
            sigs = [signature(s).tobytes() if len(s) else None for s in sets]
            cols = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_shingles", "key", "sig"])

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return plain.mapInArrow(rows, "id long, n_shingles long, key binary, sig binary")


def signature_keys(signatures: pa.Array) -> np.ndarray:
    return band_keys(np.frombuffer(b"".join(signatures.to_pylist()), np.uint32).reshape(-1, MINIMA), BANDS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 75) -> DataFrame:
    """id_col, n_shingles, component_id (least id reachable over links of similarity share / 100 or more) and kept.

    Words are split at ASCII white space and A-Z lower-cased. Null and empty texts have an empty set and are linked
    with nothing. Rows that repeat an id are one document. A null id is a component of its own, null, and kept. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    table = stored(sketched(docs, id_col, text_col), "minhash-sketch")
    usable = table.where(F.col("key").isNotNull() & F.col("id").isNotNull())
    nodes = stored(usable.groupBy("key").agg(F.min(F.struct("id", "sig")).alias("n")).select("key", "n.id", "n.sig"), "minhash-nodes")
    members = stored(shared_buckets(nodes.select("id", "sig"), signature_keys, BANDS), "minhash-buckets")
    ids = stored(members.select("id").distinct(), "minhash-ids")
    sigs = stored(nodes.select("id", "sig").join(bounded_ids(ids), "id"), "minhash-signatures")
    wanted = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(bounded_ids(ids), "id")

    def as_set(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).tobytes() for t in texts], dtype=object)

    sets = stored(wanted.select("id", F.pandas_udf(as_set, "binary")("text").alias("set")), "minhash-sets")

    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        return agreeing(x, y, np.uint32)

    def similar_sets(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), share) for a, b in zip(x, y, strict=True)], dtype=bool)

    def verify(pairs: DataFrame) -> DataFrame:
        close = joined_pairs(pairs, sigs, "sig").where(F.pandas_udf(agree, "double")("x", "y") >= SIGNATURE_LEAST).select("a", "b")
        close = stored(close, "minhash-close")
        return joined_pairs(close, sets, "set").where(F.pandas_udf(similar_sets, "boolean")("x", "y")).select("a", "b").distinct()

    def remaining(rows: DataFrame) -> DataFrame:
        contents = sets.select("id", F.col("set").alias("s"))
        return remaining_edges(rows.join(sigs, "id"), contents, lambda s: np.frombuffer(s, np.uint64), np.uint32, BANDS, share, SIGNATURE_LEAST)

    comp = link(members, verify, remaining)
    by_key = stored(nodes.join(comp, "id", "left").select("key", F.coalesce("component", "id").alias("component_id")), "minhash-classes")
    drop_stored(members, sets)
    own = usable.join(by_key, "key").groupBy("id").agg(F.min("component_id").alias("component_id")).withColumnRenamed("id", "__id")
    out = table.join(own, F.col("id") == F.col("__id"), "left").withColumn("component_id", F.coalesce("component_id", "id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))
