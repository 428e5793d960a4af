"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over 16 bytes triggers phrases: each possible start of a 100-byte string is assigned the trigger, the
position of the least hash among the next 61, so equal strings have their trigger at the same place whatever surrounds
them. Consecutive starts of one trigger form a phrase; with the 99 bytes after it, the phrase's text holds all of its
strings. The dictionary is the set of distinct phrase texts, the parse the places of its phrases in the corpus.

* Parse: phrases of equal text are sorted by (document, place). All but the first are repeated as a whole. As every
  string lies within one phrase, the parse needs no order beyond a phrase.
* Dictionary: only phrases that share a trigger string can share strings. They are brought together, and two suffix
  arrays are made of them: of the suffixes from the trigger on, and of the prefixes read backwards from the trigger,
  each with the lengths of common prefixes of neighbours, counted in bytes. A string that starts j bytes before the
  trigger equals another just if they agree in j bytes backwards and 100 - j forwards: both are runs of the two arrays.
* Corpus order: strings of one class are sorted by the place of their phrase; the first stays.

So two strings are told equal by their bytes, and two phrases by 128 bits beside the trigger's 64. A trigger string
shared by more than HOT phrases is not brought to one task: its strings are dealt out one by one, by 128-bit hashes.
Exact copies of documents are found first and don't enter the parse.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_ids, drop_stored, prepare, stored, whole_groups
from .linking import mixed

LENGTH, TRIGGER, GRAM = 100, 40, 16
REACH = LENGTH - TRIGGER + 1
#: Starts of strings that are parsed at once; longer texts are parsed in parts.
PART = 1 << 20
#: Phrases of one trigger that a task sorts at most, and phrases that it sorts at once if their triggers are rarer.
HOT, BLOCK = 100_000, 30_000
#: Phrases to look into that may be broadcast, 16 bytes each and one row for each text.
BROADCAST_PHRASES = 2_000_000
_RNG = np.random.default_rng(11)
_LETTERS = _RNG.integers(0, 1 << 62, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1 << 61, 1 << 62)) * 8 + 5
_POWERS = [np.ones((2, 1), np.uint64)]


def powers(n: int) -> np.ndarray:
    """Powers of the base modulo 2^64, and of its inverse."""
    if _POWERS[0].shape[1] < n:
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[0] = np.stack([np.cumprod(np.r_[np.uint64(1), np.full(n, b % (1 << 64), np.uint64)]) for b in (_BASE, inverse)])
    return _POWERS[0]


class Parse:
    """Hashes of a part of a text, from running sums."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.letters = _LETTERS[0][raw]
        self.sums = np.zeros((2, len(raw) + 1), np.uint64)
        own = powers(len(raw))[0, : len(raw)]
        np.cumsum(self.letters * own, out=self.sums[0, 1:])
        np.cumsum(_LETTERS[1][raw] * own, out=self.sums[1, 1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        sums = self.sums[which]
        return mixed((sums[end] - sums[begin]) * powers(len(self.raw))[1, begin] + (end - begin).astype(np.uint64))

    def phrases(self) -> tuple[np.ndarray, ...]:
        """(trigger's hash, two hashes of the phrase's text, first start, number of starts, trigger's place after the
        first start) of each phrase."""
        n = len(self.raw)
        starts = n - LENGTH + 1
        gram = self.letters
        for k in (1, 2, 4, 8):
            gram = gram[:-k] * np.uint64(pow(_BASE, k, 1 << 64)) + gram[k:]
        places = starts + REACH - 1
        rank = (mixed(gram[:places]) & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(places, dtype=np.uint64))
        for k in (1, 2, 4, 8, 16, REACH - 32):
            rank = np.minimum(rank[:-k], rank[k:])
        at = (np.uint64(0xFFFFFFFF) - (rank & np.uint64(0xFFFFFFFF))).astype(np.int64)
        change = np.flatnonzero(np.diff(at))
        first, last = np.r_[0, change + 1], np.r_[change, starts - 1]
        trigger = at[first]
        whole = [self.hashes(first, last + LENGTH, which) for which in (0, 1)]
        return self.hashes(trigger, trigger + TRIGGER), *whole, first, last - first + 1, trigger - first


def parts(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for o in range(0, len(raw) - LENGTH + 1, PART):
        yield o, raw[o : o + PART + LENGTH - 1]


def text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def place(s: np.ndarray, n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """First start, number of starts and trigger's place of a phrase in one number; without its last 6 bits, a mark."""
    return s << 12 | n << 6 | t


def parsed(docs: DataFrame) -> DataFrame:
    """The parse of docs(doc, th, text): a row (g, c1, c2, doc, th, p) for each phrase.

    A phrase that comes earlier in its batch is known to be repeated: it is dealt out at random, with the complement of
    p, and only the first of the batch goes to where equal phrases meet. So a phrase of very many documents arrives
    there once for each batch.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, lengths = [], []
            for text in batch.column(2).to_pylist():
                raw, n = text_bytes(text), 0
                for o, part in parts(raw):
                    g, c1, c2, s, k, t = Parse(part).phrases()
                    found.append((g, c1, c2, place(s + o, k, t)))
                    n += len(g)
                lengths.append(n)
            if not found:
                continue
            g, c1, c2, p = (np.concatenate(x) for x in zip(*found, strict=True))
            owner = np.repeat(np.arange(batch.num_rows), lengths)
            doc, th = (batch.column(i).to_numpy(zero_copy_only=False)[owner] for i in (0, 1))
            order = np.lexsort((p, doc, c2, c1, g))
            head = np.r_[True, (g[order[1:]] != g[order[:-1]]) | (c1[order[1:]] != c1[order[:-1]]) | (c2[order[1:]] != c2[order[:-1]])]
            first = order[np.flatnonzero(head)][np.cumsum(head) - 1]
            again = order[(doc[order] != doc[first]) | (p[order] != p[first])]
            g[again] = mixed(c1[again] + p[again].astype(np.uint64) + th[again].view(np.uint64))
            c1[again], c2[again] = 0, 0
            p[again] = ~p[again]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (g, c1, c2, doc, th, p)], names=["g", "c1", "c2", "doc", "th", "p"])

    return docs.select("doc", "th", "text").mapInArrow(rows, "g long, c1 long, c2 long, doc long, th long, p long")


def phrase_texts(docs: DataFrame) -> DataFrame:
    """A row (g, doc, th, p, raw) with the text of each phrase of docs(doc, th, ps, gs, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps, gs, texts = batch.column(2), batch.column(3), batch.column(4)
            for i in range(batch.num_rows):
                data = (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
                p, g = ps[i].values.to_numpy(), gs[i].values.to_numpy()
                s, n = (p >> 12).tolist(), (p >> 6 & 63).tolist()
                for at in range(0, len(p), BLOCK):
                    raw = [data[a : a + b + LENGTH - 1] for a, b in zip(s[at : at + BLOCK], n[at : at + BLOCK], strict=True)]
                    own = [np.full(len(raw), batch.column(c)[i].as_py()) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(g[at : at + BLOCK]), *map(pa.array, own), pa.array(p[at : at + BLOCK]), pa.array(raw, pa.binary())], names=["g", "doc", "th", "p", "raw"])

    return docs.select("doc", "th", "ps", "gs", "text").mapInArrow(rows, "g long, doc long, th long, p long, raw binary")


def sorted_suffixes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of rows of bytes and, for each of its places but the first, the bytes shared with the one before."""
    order = np.argsort(np.ascontiguousarray(keys).view(f"V{keys.shape[1]}").ravel(), kind="stable")
    differs = keys[order[1:]] != keys[order[:-1]]
    return order, np.where(differs.any(1), differs.argmax(1), keys.shape[1])


def classes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """For each row, the number of its run of suffixes that agree in so many bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.r_[0, np.cumsum(shared < depth)]
    return out


def repeated_strings(g: np.ndarray, doc: np.ndarray, p: np.ndarray, raw: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, number of starts) of runs of strings that also start earlier, in phrases with whole triggers' groups."""
    s, n, t = p >> 12, p >> 6 & 63, p & 63
    begin = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)
    middle, end = begin[:-1] + t, begin[1:]
    size = 8
    right, left = np.zeros((len(g), size + LENGTH), np.uint8), np.zeros((len(g), size + REACH - 1), np.uint8)
    right[:, :size] = left[:, :size] = g.astype(">i8").view(np.uint8).reshape(-1, size)
    for k in range(LENGTH):
        own = middle + k < end
        right[own, size + k] = data[middle[own] + k]
    for k in range(REACH - 1):
        own = k < t
        left[own, size + k] = data[middle[own] - 1 - k]
    forwards, backwards = sorted_suffixes(right), sorted_suffixes(left)
    by_place = np.lexsort((s + t, doc))
    same = (doc[by_place[1:]] == doc[by_place[:-1]]) & ((s + t)[by_place[1:]] == (s + t)[by_place[:-1]])
    when = np.empty(len(g), np.int64)
    when[by_place] = np.cumsum(np.r_[0, ~same])
    marked = np.zeros((len(g), REACH + 2), bool)  # column REACH - j: strings that start j bytes before the trigger
    for j in range(REACH):
        rows = np.flatnonzero((t - n < j) & (j <= t))
        key = classes(*forwards, size + LENGTH - j)[rows] * (len(g) + 1) + classes(*backwards, size + j)[rows]
        order = np.lexsort((when[rows], key))
        rows, key = rows[order], key[order]
        head = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        first = when[rows[np.flatnonzero(head)]][np.cumsum(head) - 1]
        marked[rows[when[rows] > first], REACH - j] = True
    change = np.diff(marked.astype(np.int8), axis=1)
    row, at = np.nonzero(change == 1)
    return row, (s + t)[row] - REACH + at + 1, np.nonzero(change == -1)[1] - at


def shared_strings(texts: DataFrame) -> DataFrame:
    """(doc, th, m): marks of repeated strings in phrases (g, doc, th, p, raw), brought together by trigger and sorted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in whole_groups(batches, ["g"], BLOCK):
            doc, th, p = (own.column(i).to_numpy() for i in (1, 2, 3))
            row, s, n = repeated_strings(own.column(0).to_numpy(), doc, p, own.column(4))
            yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(th[row]), pa.array(s << 6 | n)], names=["doc", "th", "m"])

    return texts.repartition("g").sortWithinPartitions("g").mapInArrow(rows, "doc long, th long, m long")


def dealt_strings(texts: DataFrame) -> DataFrame:
    """As shared_strings, for hot triggers: each string is a row, and its earliest place is pre-aggregated."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, raws = batch.column(3).to_numpy(), batch.column(4).to_pylist()
            n = p >> 6 & 63
            w = [xxhash.xxh128_digest(raw[k : k + LENGTH]) for raw in raws for k in range(len(raw) - LENGTH + 1)]
            at = np.repeat(np.arange(len(p)), n)
            s = (p >> 12)[at] + np.arange(len(at)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), batch.column(1).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array(s)], names=["w", "doc", "th", "s"])

    strings = stored(texts.mapInArrow(rows, "w binary, doc long, th long, s long"), "repeats-strings")
    first = strings.groupBy("w").agg(F.min(F.struct("doc", "s")).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    return strings.join(first, "w").where(F.struct("doc", "s") > F.col("first")).select("doc", "th", (F.col("s") * 64 + 1).alias("m"))


def kept_bytes(text: str | None, marks: np.ndarray | None, copy: bool) -> tuple[int, int, int, bytes]:
    """(bytes, removed, maximal removed runs, the remaining bytes) of a text with marks, 64 s + n."""
    raw = text_bytes(text)
    if copy and len(raw) >= LENGTH:
        return len(raw), len(raw), 1, b""
    if marks is None or not len(marks):
        return len(raw), 0, 0, raw.tobytes()
    change = np.zeros(len(raw) + 1, np.int32)
    s = marks >> 6
    np.add.at(change, s, 1)
    np.add.at(change, s + (marks & 63) + LENGTH - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(raw), int(gone.sum()), runs, raw[~gone].tobytes()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot: int = HOT) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans and kept_sha256; with_text adds the remaining bytes as kept_bytes.

    A byte goes if a 100-byte string that covers it also starts earlier: in a document of smaller id, or before in the
    same one. Null and empty texts, and texts below 100 bytes, keep everything. Rows that repeat an id count as
    starting at the same places: neither is earlier than the other. A null id comes before all others. Other columns
    are not read, so their names can't clash. An empty table gives an empty result. hot: phrases of one trigger that
    are brought to one task.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.col(f"`{text_col}`").cast("string")
    id_ = F.col(f"`{id_col}`").cast("long")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    all_docs = docs.select(id_.alias("id"), F.coalesce(id_, F.lit(-(2**63))).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    digests = stored(all_docs.where(F.length("text") >= LENGTH // 4).select("doc", "th", F.md5(F.col("text").cast("binary")).alias("md5")), "repeats-digests")
    first = digests.groupBy("md5").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where(F.col("first") < F.col("last")).select("md5", "first")
    copies = stored(digests.join(first, "md5").where(F.col("doc") > F.col("first")).select("doc", "th").distinct(), "repeats-copies")
    drop_stored(digests)
    own = all_docs.select("doc", "th", "text").join(bounded_ids(copies), ["doc", "th"], "left_anti")

    phrase = F.struct("c1", "c2")
    by_trigger = Window.partitionBy("g").orderBy("c1", "c2", "doc", "p")
    equal = Window.partitionBy("g", "c1", "c2").orderBy("doc", "p").rowsBetween(Window.unboundedPreceding, 0)
    so_far = by_trigger.rowsBetween(Window.unboundedPreceding, 0)
    ordered = parsed(own).select("*", F.first(F.struct("doc", "p", "th")).over(equal).alias("f"), F.lead(phrase).over(by_trigger).alias("after"), F.first(phrase).over(so_far).alias("least"))
    again = (F.col("p") < 0) | (F.struct("doc", "p") > F.struct("f.doc", "f.p"))
    ends = F.col("after").isNull() | (F.col("after") != phrase)
    #: The last row of equal phrases knows whether other phrases have their trigger; it stands for the first of them.
    look = (F.col("p") >= 0) & ends & ((F.col("least") != phrase) | F.col("after").isNotNull())
    #: Rows of one id with other texts may start a phrase at the same place: neither is earlier, so all of them are looked into.
    tied = ~again & (F.col("th") != F.col("f.th"))
    p = F.when(F.col("p") < 0, F.bitwise_not("p")).otherwise(F.col("p"))
    table = stored(ordered.where(again | look | tied).select("g", "doc", "th", p.alias("p"), "f", again.alias("again"), look.alias("look"), tied.alias("tied")), "repeats-phrases")
    inside = table.where("look").select("g", "f.doc", "f.th", "f.p").unionByName(table.where("tied").select("g", "doc", "th", "p"))
    crowded = stored(inside.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("g"), "repeats-hot")

    def texts_of(phrases: DataFrame) -> DataFrame:
        by_text = phrases.groupBy("doc", "th").agg(F.collect_list(F.struct("p", "g")).alias("x")).select("doc", "th", F.col("x.p").alias("ps"), F.col("x.g").alias("gs"))
        by_text = F.broadcast(by_text) if n_inside <= BROADCAST_PHRASES else by_text
        return phrase_texts(own.join(by_text, ["doc", "th"]))

    n_inside, n_crowded = inside.count(), crowded.count()
    found = [table.where("again").select("doc", "th", F.shiftright("p", 6).alias("m"))]
    if n_crowded:
        found.append(stored(dealt_strings(texts_of(inside.join(bounded_ids(crowded), "g"))), "repeats-marks"))
        inside = inside.join(bounded_ids(crowded), "g", "left_anti")
    found.append(stored(shared_strings(texts_of(inside)), "repeats-marks"))
    marks = found[0]
    for more in found[1:]:
        marks = marks.unionByName(more)
    by_text = marks.groupBy("doc", "th").agg(F.collect_list("m").alias("marks"))
    joined = all_docs.join(by_text, ["doc", "th"], "left").join(bounded_ids(copies.withColumn("copy", F.lit(True))), ["doc", "th"], "left")

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks, copy = (batch.column(i) for i in (1, 2, 3))
            got = [[], [], [], []]
            digest = []
            for i in range(batch.num_rows):
                *numbers, kept = kept_bytes(texts[i].as_py(), marks[i].values.to_numpy() if marks[i].is_valid else None, bool(copy[i].as_py()))
                for column, x in zip(got, [*numbers, kept if with_text else None], strict=True):
                    column.append(x)
                digest.append(hashlib.sha256(kept).hexdigest())
            cols = [batch.column(0), *[pa.array(x, pa.int64()) for x in got[:3]], pa.array(digest, pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(got[3], pa.binary())], [*names, "kept_bytes"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    out = joined.select("id", "text", "marks", "copy").mapInArrow(results, schema)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
