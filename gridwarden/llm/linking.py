"""Linking near-equal sets that share a band: candidates by stars, exact verification, components.

Within a bucket of equal band keys no pairs are listed. A bucket names one of its members as centre and the others are
compared with it; that is linear in the bucket. Buckets within one component are done. Large ones that aren't get further
centres, while that settles them; what then remains in several components of a bucket is compared where it lies, in
blocks of bounded size, by signatures first, and only edges that join components come out. So no link within a bucket
is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_ids, stored, whole_groups
from .components import components

#: Members of a bucket that are compared with each other without further stars, and that one task compares at most.
FEW, BLOCK = 50, 1_000
#: Keys that a task sees, and that a task packs at once.
TASK_KEYS, DEAL_KEYS = 1_000_000, 300_000
#: Rows of groups, and pairs of them, that a task looks at in one go.
GROUP_ROWS, PAIRS = 8_000, 20_000


def packed(keys: np.ndarray) -> np.ndarray:
    """The 6 bytes of each 48-bit key."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(*keys.shape, 8)[..., :6]


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.int64).ravel()


def shared_buckets(nodes: DataFrame, keys_of: Callable[[pa.Array], np.ndarray], bands: int) -> DataFrame:
    """(k, id, x): a row for each band of nodes(id, sig) whose key another node has too; x is one of them, the same for
    the whole key. keys_of gives the band keys of a batch of signatures.

    Keys are dealt out packed, 10 bytes each, in rows of many. A task keeps the keys that it has seen once and the first
    node of each, and passes on a node when its key has been seen before; so a key of very many nodes takes no memory.
    """
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() * bands // TASK_KEYS + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def rows() -> pa.RecordBatch:
            k, ids = (np.concatenate(x) for x in zip(*waiting, strict=True))
            k, ids = k.ravel(), np.repeat(ids, bands)
            p = k % (4 * parts)
            if 4 * parts < 1 << 15:
                p = p.astype(np.int16)  # these are sorted by radix
            order = np.argsort(p, kind="stable")
            if (ids[0] >> 32) != (ids[-1] >> 32):
                order = order[np.argsort((ids >> 32)[order], kind="stable")]
            cuts = np.flatnonzero(np.r_[True, (np.diff(p[order]) != 0) | (np.diff(ids[order] >> 32) != 0), True])
            raw, low = packed(k[order]), (ids[order] & 0xFFFFFFFF).astype(np.uint32)
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            first = order[cuts[:-1]]
            cols = [pa.array(p[first].astype(np.int64)), pa.array(ids[first] >> 32), pa.array([raw[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([low[a:b].tobytes() for a, b in spans], pa.binary())]
            waiting.clear()
            return pa.RecordBatch.from_arrays(cols, names=["p", "high", "ks", "lows"])

        for batch in batches:
            if batch.num_rows:
                waiting.append((keys_of(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)))
                held += batch.num_rows * bands
                if held >= DEAL_KEYS:
                    yield rows()
                    held = 0
        if waiting:
            yield rows()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, first, told = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            lows = [np.frombuffer(x, np.uint32) for x in batch.column(3).to_pylist()]
            ids = np.concatenate(lows).astype(np.int64) | np.repeat(batch.column(1).to_numpy() << 32, [len(x) for x in lows])
            k = unpacked(b"".join(batch.column(2).to_pylist()))
            order = np.argsort(k)
            k, ids = k[order], ids[order]
            head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            own, many = k[head], np.diff(np.r_[head, len(k)]) > 1
            at = np.searchsorted(seen, own)
            known = np.zeros(len(own), bool)
            known[at < len(seen)] = seen[at[at < len(seen)]] == own[at < len(seen)]
            out = np.repeat(known | many, np.diff(np.r_[head, len(k)]))
            centre = ids[head]
            centre[known] = first[at[known]]
            centre = np.repeat(centre, np.diff(np.r_[head, len(k)]))
            late = at[known][~told[at[known]]]
            cols = (np.r_[k[out], seen[late]], np.r_[ids[out], first[late]], np.r_[centre[out], first[late]])
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["k", "id", "x"])
            told[late] = True
            new = ~known
            seen, first, told = (np.insert(x, at[new], y[new]) for x, y in ((seen, own), (first, ids[head]), (told, many)))

    dealt = nodes.select("id", nodes.columns[1]).mapInArrow(deal, "p long, high long, ks binary, lows binary")
    return dealt.repartition(parts, "p").mapInArrow(meet, "k long, id long, x long")


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], remaining: Callable[[DataFrame], DataFrame], most_rounds: int = 6) -> DataFrame:
    """(id, component) over members(k, id, x), x the first centre of bucket k, for ids that are linked with another.

    verify: keeps of pairs(a, b) those whose sets are similar enough. remaining: verified edges (a, b) across components
    within the buckets of rows(k, id, c, n), for what stars leave over.
    """
    edges = stored(verify(stored(star_pairs(members), "link-pairs")).select("a", "b"), "link-edges")
    comp = stored(components(edges), "link-components")
    left = stored(unsettled(members, comp), "link-left")
    crowded = left.where(F.col("n") > FEW)
    n_crowded = crowded.count()
    for turn in range(1, most_rounds):
        if not n_crowded:
            break
        order = F.xxhash64("id", F.lit(turn))
        bucket = crowded.groupBy("k").agg(F.min_by(F.struct("id", "c"), order).alias("x")).select("k", F.col("x.id").alias("x"), F.col("x.c").alias("xc"))
        pairs = star_pairs(crowded.join(bounded_ids(stored(bucket, "link-centres")), "k").where(F.col("c") != F.col("xc")))
        edges = edges.unionByName(stored(verify(stored(pairs, "link-pairs")).select("a", "b"), "link-edges"))
        comp = stored(components(edges), "link-components")
        crowded = stored(unsettled(crowded, comp), "link-left")
        before, n_crowded = n_crowded, crowded.count()
        if n_crowded > 0.8 * before:
            break
    if left.isEmpty():
        return comp
    found = stored(remaining(unsettled(left, comp)), "link-edges")
    return stored(components(edges.unionByName(found)), "link-components")


def star_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a member and its bucket's centre."""
    return rows.where(F.col("id") != F.col("x")).select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()


def unsettled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """(k, id, c, n) for buckets with three members or more, in several components. Those settled before stay so."""
    now = rows.select("k", "id").join(bounded_ids(comp), "id", "left").select("k", "id", F.coalesce("component", "id").alias("c"))
    open_ = now.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")).where((F.col("lo") < F.col("hi")) & (F.col("n") > 2)).select("k", "n")
    return now.join(bounded_ids(stored(open_, "link-open")), "k").select("k", "id", "c", "n")


def remaining_edges(rows: DataFrame, contents: DataFrame, as_set: Callable, dtype: type, bands: int, share: int, least: float) -> DataFrame:
    """Edges (a, b) that join components within a bucket, verified where its members are.

    rows: k, id, c, n (members of the bucket), sig. contents: id, s (what as_set makes the member's set of). Pairs across
    components are compared by signature, of type dtype, in the first band that they share. A bucket beyond BLOCK members
    is cut into blocks, and each pair of blocks is a group of its own. Only members that agree with another so far get
    their contents joined; a pair is compared on its sets unless edges found before join it already: at most one edge less
    than members comes out.
    """
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "c", "sig")

    def candidates(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, head): pairs of rows of one group that may be similar, x before y, and where groups begin."""
        k, i, j, side, c = (group.column(name).to_numpy() for name in ("k", "i", "j", "mine", "c"))
        sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype).reshape(group.num_rows, -1)
        keys = band_keys(sigs, bands)
        head = np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        number = np.cumsum(head)
        band = (keys == k[:, None]).argmax(1)
        earlier = np.arange(bands)
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        x = np.arange(len(k))
        for step in range(1, len(k)):
            x = x[x + step < len(k)]
            x = x[number[x + step] == number[x]]
            if not len(x):
                break
            y = x + step
            near = (c[x] != c[y]) & ((i[x] == j[x]) | (side[x] != side[y]))
            for part in np.array_split(np.flatnonzero(near), 1 + int(near.sum()) // PAIRS):
                a, b = x[part], y[part]
                alike = (sigs[a] == sigs[b]).mean(1) >= least
                a, b = a[alike], b[alike]
                new = ~((keys[a] == keys[b]) & (earlier < band[a][:, None])).any(1)
                xs.append(a[new])
                ys.append(b[new])
        return np.concatenate(xs), np.concatenate(ys), np.flatnonzero(head)

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["k", "i", "j"], GROUP_ROWS):
            keep = np.zeros(group.num_rows, bool)
            x, y, _ = candidates(group)
            keep[x] = keep[y] = True
            yield group.filter(pa.array(keep))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["k", "i", "j"], GROUP_ROWS):
            x, y, head = candidates(group)
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            ids, known = group.column("id").to_numpy(), {}
            texts = group.column("s")
            for r in np.unique(np.r_[x, y]).tolist():
                if ids[r] not in known:
                    known[ids[r]] = as_set(texts[r].as_py())
            number = np.searchsorted(head, np.arange(len(ids)), side="right")
            root = np.unique(np.rec.fromarrays([number, group.column("c").to_numpy()]), return_inverse=True)[1].tolist()
            members: dict[int, list[int]] = {}
            for r, c in enumerate(root):
                members.setdefault(c, []).append(r)
            a, b = [], []
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                if root[p] != root[q] and similar(known[ids[p]], known[ids[q]], share):
                    a.append(min(ids[p], ids[q]))
                    b.append(max(ids[p], ids[q]))
                    into, of = sorted((root[p], root[q]), key=lambda c: -len(members[c]))
                    for r in members[of]:
                        root[r] = into
                    members[into] += members.pop(of)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    schema = "k long, i int, j int, mine int, id long, c long, sig binary"
    group = ["k", "i", "j"]
    close = stored(dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(hopeful, schema), "link-close")
    found = close.join(contents, "id").repartition(*group).sortWithinPartitions(*group).select(*close.columns, "s")
    return found.mapInArrow(compare, "a long, b long").distinct()


def similar(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    """Whether two sets, as sorted distinct hashes, have a similarity of share / 100 or more."""
    if 100 * min(len(a), len(b)) < share * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")  # merges the two runs
    common = np.count_nonzero(both[1:] == both[:-1])
    return 100 * common >= share * (len(a) + len(b) - common)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finishes 64-bit hashes, so that all of their bits depend on all of the input's."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """48-bit keys, one row for each signature and one column for each band. Two that are equal by chance only cost a comparison."""
    rows = signatures.shape[1] // bands
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for i in range(rows):
        total = mixed(total + parts[:, :, i])
    return (total & np.uint64((1 << 48) - 1)).view(np.int64)


def agreeing(x: pd.Series, y: pd.Series, dtype: type) -> pd.Series:
    """Share of minima in which two signatures agree, an estimate of similarity; for many pairs."""
    if not len(x):
        return pd.Series([], dtype="float64")
    a, b = (np.frombuffer(b"".join(s), dtype).reshape(len(s), -1) for s in (x, y))
    return pd.Series((a == b).mean(1))


def joined_pairs(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs(a, b) with the column of both ends, as x and y."""
    left = table.select(F.col("id").alias("a"), F.col(column).alias("x"))
    right = table.select(F.col("id").alias("b"), F.col(column).alias("y"))
    return pairs.join(left, "a").join(right, "b")
