"""Best-fit packing of tokenised documents into sequences, with certified bin counts.

Documents are tokenised once into pieces of at most the capacity; whole-capacity pieces fill a sequence each. The rest
is dealt to partitions, each packed by best-fit decreasing and given a lower bound by dual-feasible functions. A
partition whose bin count equals its bound is certified. While all bins are more than the bound of all pieces, partitions
exchange the documents of their unfilled bins, which are dealt anew, to fewer partitions, and repacked if that saves bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, prepare, stored

PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"
#: Space-separated chunks of text whose token ids a Python worker keeps: about 40 MB. Characters that it encodes at once.
CACHE_CHUNKS, ENCODE_CHARS = 1_000_000, 250_000
_ENCODERS: dict[str, "Encoder"] = {}


#: The byte-level pre-tokenizer's split, a fixed value of the public format.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ChunkTable:
    """Token ids by the 64-bit hash of a chunk: sorted keys, and where in a pool the ids of each key lie.

    Recent keys wait in a small table, so that the large one is seldom merged. It holds at most CACHE_CHUNKS keys and
    then starts anew.
    """

    def __init__(self):
        self.parts = [tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64)) for _ in range(2)]
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, count) of sorted keys; a count of -1 for unknown ones."""
        start, count = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for own, starts, counts in self.parts:
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[at] == keys
                start[hit], count[hit] = starts[at[hit]], counts[at[hit]]
        return start, count

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Keeps sorted new keys with their ids in a row; returns their starts."""
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        starts = self.filled + np.r_[0, np.cumsum(counts)[:-1]]
        self.filled += len(ids)
        self.parts[1] = self._merged(self.parts[1], (keys, starts, counts))
        if 4 * len(self.parts[1][0]) > len(self.parts[0][0]):
            self.parts[0], self.parts[1] = self._merged(*self.parts), tuple(x[:0] for x in self.parts[1])
        return starts

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        at = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, at, y) for x, y in zip(a, b, strict=True))

    def __len__(self) -> int:
        return len(self.parts[0][0]) + len(self.parts[1][0])


class Encoder:
    """Token ids of texts as little-endian uint32, equal to the tokenizer's own on the whole text.

    The byte-level pre-tokenizer never joins characters across a single space between other characters: such a space
    starts the next token. So texts are cut there; chunks are hashed and looked up a batch at a time, and the unknown
    ones are encoded as one string, whose ids are parted by their byte lengths. Texts with other white space are
    encoded as a whole, and texts with a special token by the tokenizer itself. The quick encoder takes its ranks from
    the tokenizer's vocabulary; where that isn't a byte-level one in merge order, the tokenizer does everything.
    """

    def __init__(self, path: str):
        import json
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        self.other = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"].get("vocab", {})
        added = {t["content"] for t in spec.get("added_tokens", [])}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"].get("merges", [])]
        made = [vocab.get(a + b, -1) for a, b in merges]
        pre = spec.get("pre_tokenizer") or {}
        byte_level = spec["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.quick = None
        if byte_level and made == sorted(made) and min(made, default=-1) >= 0 and all(c in letters for t in vocab if t not in added for c in t):
            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}
            self.quick = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
            for t, i in ranks.items():
                self.lengths[i] = len(t)
        self.table = ChunkTable()
        rng = np.random.default_rng(20)
        self.letter = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 62, 1 << 63)) | 5
        self.powers = np.ones((2, 1), np.uint64)

    def ids(self, text: str) -> np.ndarray:
        """By the tokenizer itself."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def plain(self, text: str) -> np.ndarray:
        return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out, begin, size = [], 0, 0
        for end, t in enumerate(texts, 1):
            size += len(t)
            if size >= ENCODE_CHARS or end == len(texts):
                out += self._encoded(texts[begin:end])
                begin, size = end, 0
        return out

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        usual, heads, tails = [], [], []
        for i, t in enumerate(texts):
            if self.quick is None or self.special and self.special.search(t):
                out[i] = self.ids(t) if t else np.zeros(0, "<u4")
            elif "  " in t or " \n" in t or t[-1:] == " " or self.other.search(t):
                out[i] = self.plain(t)
            else:
                head, space, tail = t.partition(" ")
                usual.append(i)
                heads.append(self.plain(head) if head else np.zeros(0, "<u4"))
                tails.append((space + tail).encode())
        found, sizes = self._chunks(b"".join(tails), np.array([len(t) for t in tails], np.int64))
        ends = np.cumsum(sizes).tolist()
        for i, head, s, e in zip(usual, heads, [0, *ends], ends, strict=False):
            out[i] = np.concatenate([head, found[s:e]])
        return out

    def _hashes(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Polynomial hashes modulo 2^64 of raw[begin:end], from one running sum."""
        n = len(raw)
        if n > self.powers.shape[1]:
            inverse = pow(self.base, -1, 1 << 64)
            self.powers = np.stack([np.cumprod(np.r_[np.uint64(1), np.full(n + n // 4, b, np.uint64)]) for b in (self.base, inverse)])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letter[raw] * self.powers[0, :n], out=sums[1:])
        h = (sums[end] - sums[begin]) * self.powers[1, begin]
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)

    def _chunks(self, blob: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, each empty or starting with a space, and how many ids each of them has."""
        raw = np.frombuffer(blob, np.uint8)
        begin = np.flatnonzero(raw == 32)
        if not len(begin):
            return np.zeros(0, "<u4"), np.zeros(len(sizes), np.int64)
        end = np.r_[begin[1:], len(raw)]
        keys, first, place = np.unique(self._hashes(raw, begin, end), return_index=True, return_inverse=True)
        if len(self.table) > CACHE_CHUNKS:
            self.table = ChunkTable()
        start, count = self.table.find(keys)
        missing = np.flatnonzero(count < 0)
        if len(missing):
            b, e = begin[first[missing]], end[first[missing]]
            ids = self.plain(b"".join([blob[s:t] for s, t in zip(b.tolist(), e.tolist(), strict=True)]).decode())
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(e - b)) + 1
            count[missing] = np.diff(cuts, prepend=0)
            start[missing] = self.table.add(keys[missing], count[missing], ids)
        start, count = start[place], count[place]
        before = np.r_[0, np.cumsum(count)]
        found = self.table.pool[np.repeat(start - before[:-1], count) + np.arange(before[-1])]
        edges = np.searchsorted(begin, np.r_[0, np.cumsum(sizes)])
        return found.astype("<u4", copy=False), np.diff(before[edges])


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first takes the remainder, the others are whole."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, eos: int, with_ids: bool) -> DataFrame:
    """Per piece: the id, piece, start, length, ids_crc32 and, if asked for, its ids as little-endian uint32 bytes."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows, texts = [], batch.column(1)
            for i, ids in enumerate(enc.encode_batch([t or "" for t in texts.to_pylist()])):
                ids = np.append(ids, np.uint32(eos)).astype("<u4", copy=False).tobytes()
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * s : 4 * (s + n)]
                    rows.append((i, k, s, n, zlib.crc32(own), own if with_ids else None))
            at, k, s, n, crc, own = zip(*rows, strict=True) if rows else ((),) * 6
            cols = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(own, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kept = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(pieces, f"id {kind}, {PIECE_SCHEMA}" + ", ids binary" * with_ids)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item and the number of bins. Bins wait by free space; a bit mask finds the tightest that fits."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = waiting[free].pop()
            if not waiting[free]:
                mask ^= 1 << free
        else:
            free, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - free
        if free > size:
            waiting[free - size].append(b)
            mask |= 1 << (free - size)
    return bins, offsets, used


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest bins by dual-feasible functions, for counts[s] items of size s: total size, large-item thresholds, and
    the stepwise functions that round (k + 1) x / capacity down, alone and after a threshold."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    best = 0
    for eps in sorted({0, 1, *range(8, capacity // 2 + 1, 8), capacity // 3, capacity // 3 + 1, capacity // 4, capacity // 4 + 1, capacity // 2}):
        raised = np.where(sizes > capacity - eps, capacity, np.where(sizes >= eps, sizes, 0))
        best = max(best, -(-int((counts * raised).sum()) // capacity))
        for k in range(1, 13):
            stepped = np.where((k + 1) * raised % capacity == 0, raised * k, capacity * ((k + 1) * raised // capacity))
            best = max(best, -(-int((counts * stepped).sum()) // (k * capacity)))
    return best


def packed_partitions(items: DataFrame, capacity: int) -> DataFrame:
    """Best-fit decreasing within each __part; adds __bin, offset, __fill of the bin, and __bound of the partition."""
    fields = [f for f in items.schema.fields if f.name not in ("__bin", "offset", "__fill", "__bound")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", __bin long, offset long, __fill long, __bound long"
    names = [f.name for f in fields]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[names].sort_values(["length", "__slot"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        return pdf.assign(__bin=bins, offset=offsets, __fill=np.bincount(bins, weights=lengths, minlength=used).astype(np.int64)[bins], __bound=bound)

    return items.select(*names).groupBy("__part").applyInPandas(pack, schema)



def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    eos: int = 2,
    part_items: int = 100_000,
    rounds: int = 4,
    with_ids: bool = False,
) -> DataFrame:
    """Per piece of each document: id_col, piece, start, length, ids_crc32, sequence_id, offset, certified, and ids if with_ids.

    A null or empty text is its end token alone; only documents beyond capacity are cut, the first piece taking the
    remainder. Repeated rows and null ids are packed like any others. An empty table gives an empty result. Columns
    other than the two named are not read, so their names can't clash. certified: the partition that packed the
    piece uses as few sequences as its lower bound. part_items bounds the pieces
    that one task packs at first; each exchange deals what is left over to half as many partitions for its size.
    So a task holds at most part_items times 2 to the power of rounds pieces.
    """
    prepare(docs.sparkSession)
    table = stored(tokenised(docs, id_col, text_col, tokenizer, capacity, eos, with_ids).withColumn("__slot", F.monotonically_increasing_id()), "pack-pieces")
    plain = [c for c in table.columns if c != "ids"]
    whole = table.where(F.col("length") == capacity).select(*plain, F.col("__slot").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    open_items = table.where(F.col("length") < capacity).select(*plain)
    done: list[DataFrame] = []
    packed = stored(packed_partitions(dealt(open_items, open_items.count(), part_items, 0), capacity), "pack-round0")
    least, frozen = least_sequences(open_items, capacity), 0
    for turn in range(1, rounds + 1):
        # A certified partition may still waste part of a bin that it shares with no other: gaps are of all together.
        pool = packed.where(F.col("__fill") < capacity)
        first = F.col("offset") == 0
        total = packed.where(first).count()
        if frozen + total <= least:
            break
        n, before, parts = pool.agg(F.count(F.lit(1)), F.count(F.when(first, 1)), F.countDistinct("__part")).first()
        if parts < 2:
            break
        again = stored(packed_partitions(dealt(pool.select(*plain), n, part_items << turn, turn), capacity), f"pack-round{turn}")
        after = again.where(F.col("offset") == 0).count()
        if after >= before:
            drop_stored(again)
            if n <= part_items << turn:
                break
            continue
        frozen += total - before
        done.append(numbered(packed.join(pool.select("__slot"), "__slot", "left_anti"), turn - 1, plain))
        packed = again
    done.append(numbered(packed, rounds + 1, plain))
    out = whole
    for part in done:
        out = out.unionByName(part)
    if with_ids:
        out = out.join(table.select("__slot", "ids"), "__slot")
    return out.drop("__slot").withColumnRenamed("id", id_col)


def dealt(items: DataFrame, n: int, part_items: int, turn: int) -> DataFrame:
    """Items in as many even partitions as n needs; their stored slot, not their id, decides, so a hot id is spread."""
    return items.withColumn("__part", F.pmod(F.xxhash64("__slot", F.lit(turn)), F.lit(max(1, -(-n // part_items)))).cast("long"))


def numbered(packed: DataFrame, turn: int, plain: list[str]) -> DataFrame:
    """With sequence ids below zero, apart for each round, partition and bin."""
    totals = packed.groupBy("__part").agg((F.max("__bin") + 1 == F.max("__bound")).alias("certified"))
    number = -(F.lit(turn << 58) + F.shiftleft(F.col("__part"), 30) + F.col("__bin") + 1)
    return packed.join(totals, "__part").select(*plain, number.cast("long").alias("sequence_id"), "offset", "certified")


def least_sequences(lengths: DataFrame, capacity: int = 1024) -> int:
    """The certificate for a whole packing: a lower bound on its sequences, from at most `capacity` counts by length."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in lengths.groupBy("length").count().collect():
        counts[n] = c
    return lower_bound(counts, capacity)
