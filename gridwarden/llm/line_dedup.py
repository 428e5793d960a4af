"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard verification, components.

Equal lines are one node, found by a 128-bit hash, so line texts are not shuffled for it. Distinct lines get signatures
of their character shingles and band keys; candidates come by stars within buckets and are verified on the lines' whole
shingle sets. Of each component the line that occurs first stays; every other occurrence goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAPS, bounded_ids, drop_stored, fresh, prepare, stored
from .linking import agreeing, band_keys, joined_pairs, link, mixed, remaining_edges, shared_buckets, similar

#: Characters of a shingle; bands and minima of each: a pair of similarity 0.8 is missed with a probability of 2.5e-6.
WIDTH, BANDS, ROWS = 8, 18, 3
SHARE = 80
#: A pair of similarity 0.8 agrees in fewer of the 54 minima than this share with a probability of 2e-6.
SIGNATURE_LEAST = 0.53
_RNG = np.random.default_rng(29)
#: WIDTH is a power of two: the hash of a shingle is made of those of its halves, with a factor for each doubling.
_HALF = _RNG.integers(1, 1 << 62, WIDTH.bit_length() - 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
#: Components whose heads may be broadcast, so that a large one isn't one task's: 32 bytes each.
HEAD_ROWS = 200_000
#: Characters whose shingles are hashed at once: they stay in a core's cache.
CHUNK = 1 << 14


def shingles(codes: np.ndarray) -> np.ndarray:
    """Hashes of the shingles that start at each character but the last WIDTH - 1."""
    if len(codes) < WIDTH:
        return np.zeros(0, np.uint64)
    total = codes.astype(np.uint64)
    for i, factor in enumerate(_HALF):
        after = total[1 << i :] * factor
        after += total[: len(after)]
        total = after
    return mixed(total)


def line_set(line: str) -> np.ndarray:
    """Sorted distinct shingle hashes of a line; of the padded line if it is shorter than a shingle."""
    found = shingles(np.frombuffer(line.ljust(WIDTH, "\0").encode("utf-32-le", "surrogatepass"), np.uint32))
    found.sort()
    return found[np.r_[True, found[1:] != found[:-1]]]


def line_signatures(lines: list[str]) -> np.ndarray:
    """The least values of the universal hashes a x + b modulo 2^32, a row for each line; many lines at a time.

    Their lower halves are kept: equal minima have equal ones, others in one case of 65,536.
    """
    out = np.empty((len(lines), BANDS * ROWS), np.uint16)
    at = 0
    while at < len(lines):
        own, size = [], 0
        while at + len(own) < len(lines) and (not own or size < CHUNK):
            own.append(lines[at + len(own)].ljust(WIDTH, "\0"))
            size += len(own[-1])
        codes = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(x) for x in own])
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        x = (shingles(np.r_[codes, np.zeros(WIDTH - 1, np.uint32)]) >> np.uint64(32)).astype(np.uint32)
        whole = np.arange(len(codes)) <= np.repeat(starts + lengths - WIDTH, lengths)
        x, starts = x[whole], starts - (WIDTH - 1) * np.arange(len(own))
        h = np.empty_like(x)
        for k in range(BANDS * ROWS):
            np.multiply(x, _A[k], out=h)
            np.add(h, _B[k], out=h)
            out[at : at + len(own), k] = np.minimum.reduceat(h, starts).astype(np.uint16)
        at += len(own)
    return out


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """The lines with a word, and their numbers from 0."""
    return [(j, line) for j, line in enumerate((text or "").split("\n")) if line.strip(WORD_GAPS)]


def hashes(lines: list[str]) -> np.ndarray:
    """128 bits of each line, in two columns."""
    return np.frombuffer(b"".join([xxhash.xxh128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]), np.int64).reshape(-1, 2)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """For docs(doc, th, text): a row (doc, th, line, h1, h2) for each line with a word, its 128-bit hash in two."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, j, line) for i, text in enumerate(batch.column(2).to_pylist()) for j, line in lines_of(text)]
            if found:
                owner, number, lines = zip(*found, strict=True)
                h, at = hashes(lines), pa.array(owner)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["doc", "th", "line", "h1", "h2"])

    return docs.select("doc", "th", "text").mapInArrow(rows, "doc long, th long, line int, h1 long, h2 long")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """For docs(doc, th, text): a row (h1, h2, doc, line, th, n, sig) for each distinct line with a word: where it comes
    first, how often it occurs, and its signature.

    Lines are counted within each batch first, so a line of very many documents is one row for each batch. Their
    rows are then sorted, not gathered: a task holds one line at a time.
    """
    names = ["h1", "h2", "doc", "line", "th", "n", "sig"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, j, line) for i, text in enumerate(batch.column(2).to_pylist()) for j, line in lines_of(text)]
            if found:
                owner, number, lines = zip(*found, strict=True)
                h, line = hashes(lines), np.array(number, np.int32)
                doc, th = (batch.column(i).to_numpy(zero_copy_only=False)[list(owner)] for i in (0, 1))
                order = np.lexsort((th, line, doc, h[:, 1], h[:, 0]))
                head = np.r_[True, (h[order[1:]] != h[order[:-1]]).any(1)]
                first, n = order[head], np.diff(np.r_[np.flatnonzero(head), len(order)])
                sigs = line_signatures([lines[i] for i in first.tolist()])
                cols = [h[first, 0], h[first, 1], doc[first], line[first], th[first], n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([x.tobytes() for x in sigs], pa.binary())], names=names)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # lines of the last h1 so far, whose counts may grow
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([held, batch] if held else [batch]).combine_chunks()
            h1, h2, doc, line, th, n = (table.column(c).to_numpy() for c in names[:-1])
            order = np.lexsort((th, line, doc, h2, h1))
            head = np.flatnonzero(np.r_[True, (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])])
            own = table.take(pa.array(order[head])).set_column(5, "n", pa.array(np.add.reduceat(n[order], head)))
            own = own.combine_chunks().to_batches()[0]
            last = int(np.searchsorted(h1[order[head]], h1[order[-1]]))
            held = own.slice(last)
            yield own.slice(0, last)
        if held:
            yield held

    schema = "h1 long, h2 long, doc long, line int, th long, n long, sig binary"
    counted = docs.select("doc", "th", "text").mapInArrow(rows, schema)
    return counted.repartition("h1").sortWithinPartitions("h1").mapInArrow(heads, schema)


def signature_keys(signatures: pa.Array) -> np.ndarray:
    return band_keys(np.frombuffer(b"".join(signatures.to_pylist()), np.uint16).reshape(-1, BANDS * ROWS), BANDS)


def line_texts(docs: DataFrame) -> DataFrame:
    """(id, text): the lines asked for of docs(doc, th, text, wanted), wanted a list of (line, id)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines = text.split("\n")
                line, own = (wanted.values.field(i).to_pylist() for i in (0, 1))
                ids += own
                out += [lines[j] for j in line]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["id", "text"])

    return docs.select("text", "wanted").mapInArrow(rows, "id long, text string")


def removals(docs: DataFrame, id_col: str, text_col: str, share: int = SHARE) -> DataFrame:
    """(doc, th, gone): for each document that loses lines, the numbers of those, from 0, in order.

    th tells texts of one id apart; doc stands for a null id with the least long.
    """
    prepare(docs.sparkSession)
    plain = keyed(docs, id_col, text_col)
    place = F.struct("doc", "line", "th")
    nodes = stored(distinct_lines(plain).withColumn("id", F.monotonically_increasing_id()), "lines-distinct")
    members = stored(shared_buckets(nodes.select("id", "sig"), signature_keys, BANDS), "lines-buckets")
    ids = stored(members.select("id").distinct(), "lines-ids")
    sigs = stored(nodes.select("id", "sig").join(bounded_ids(ids), "id"), "lines-signatures")
    wanted = nodes.select("id", "doc", "line", "th").join(bounded_ids(ids), "id").groupBy("doc", "th").agg(F.collect_list(F.struct("line", "id")).alias("wanted"))
    texts = stored(line_texts(plain.join(wanted, ["doc", "th"])), "lines-texts")

    def similar_lines(x: pd.Series, y: pd.Series) -> pd.Series:
        sets = {line: line_set(line) for line in {*x, *y}}  # a star's centre is in many pairs of a batch
        return pd.Series([similar(sets[a], sets[b], share) for a, b in zip(x, y, strict=True)], dtype=bool)

    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        return agreeing(x, y, np.uint16)

    def verify(pairs: DataFrame) -> DataFrame:
        close = joined_pairs(pairs, sigs, "sig").where(F.pandas_udf(agree, "double")("x", "y") >= SIGNATURE_LEAST).select("a", "b")
        close = stored(close, "lines-close")
        return joined_pairs(close, texts, "text").where(F.pandas_udf(similar_lines, "boolean")("x", "y")).select("a", "b").distinct()

    def remaining(rows: DataFrame) -> DataFrame:
        return remaining_edges(rows.join(sigs, "id"), texts.select("id", F.col("text").alias("s")), line_set, np.uint16, BANDS, share, SIGNATURE_LEAST)

    comp = link(members, verify, remaining)
    drop_stored(members, texts)
    narrow = nodes.drop("sig")
    heads = narrow.join(comp, "id").groupBy("component").agg(F.min(place).alias("head"))
    classes = narrow.join(comp, "id", "left").join(bounded_ids(stored(heads, "lines-heads"), HEAD_ROWS), "component", "left")
    classes = classes.where((F.col("n") > 1) | F.col("component").isNotNull()).select("h1", "h2", F.coalesce("head", place).alias("head"))
    classes = stored(classes, "lines-classes")
    drop_stored(nodes)
    gone = hashed_lines(plain).join(classes, ["h1", "h2"]).where(F.struct("doc", "line", "th") != F.col("head"))
    return gone.groupBy("doc", "th").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text, id_ = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    return docs.select(F.coalesce(id_, F.lit(-(2**63))).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """docs with its lines deduplicated: text_col without the lines that go, and n_lines, n_gone.

    A line is what "\\n" parts, whole and as it is; lines without a word stay where they are. Two lines are linked if
    their sets of 8-character shingles (a shorter line is one shingle, padded) have a similarity of share / 100 or more.
    Of a component the line that occurs first, by id and place, stays. Null texts stay null, with 0 lines, and empty ones
    empty; a null id comes before all others. Repeated rows, equal in id and text, are one document and share their fate.
    Columns n_lines and n_gone are replaced, others are kept, whatever their names. An empty table gives an empty result.
    """
    found = stored(removals(docs, id_col, text_col, share), "lines-gone")
    text, id_ = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    doc, th, gone = fresh(docs.columns, "doc", "th", "gone")
    tagged = docs.drop("n_lines", "n_gone").withColumns({doc: F.coalesce(id_, F.lit(-(2**63))), th: F.xxhash64(text)})
    marked = tagged.join(found.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("gone").alias(gone)), [doc, th], "left")

    @F.pandas_udf("text string, n_lines long")
    def without(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        new, n = [], []
        for text, own in zip(texts, gone, strict=True):
            n.append(text.count("\n") + 1 if text is not None else 0)
            if own is None:
                new.append(None)
            else:
                lines, drop = text.split("\n"), set(own.tolist())
                new.append("\n".join([x for i, x in enumerate(lines) if i not in drop]))
        return pd.DataFrame({"text": pd.Series(new, dtype=object), "n_lines": pd.Series(n, dtype="int64")})

    (new,) = fresh([*docs.columns, doc, th, gone], "new")
    marked = marked.withColumn(new, without(text, F.col(gone)))
    left = F.when(F.col(gone).isNull(), text).otherwise(F.col(f"{new}.text"))
    counts = {"n_lines": F.col(f"{new}.n_lines"), "n_gone": F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")}
    names = [c for c in docs.columns if c not in counts]
    return marked.select(*[(left.alias(c) if c == text_col else F.col(f"`{c}`")) for c in names], *[x.alias(c) for c, x in counts.items()])
