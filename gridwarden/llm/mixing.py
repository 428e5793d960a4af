"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within its source, documents are range-partitioned by that key into buckets of
bounded size; bucket totals are pre-aggregated and turned into prefix sums, which name the bucket where the source's
budget ends, after whole epochs. Only in that bucket the order of documents matters: there a window adds the prefixes
of equal documents and finds the one at the cut. So a source has one row that says where it is cut, and every document
decides by itself what is taken of it: no text is shuffled or sorted.

A hot source is spread over as many buckets as its rows need, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, maybe_broadcast, prepare, stored, word_count

#: Key space: 15 hexadecimal digits of an MD5.
KEY_SPACE = float(16**15)
#: Rows aimed at in one bucket.
BUCKET_ROWS = 4_000


def hash_key(id_col: Column, text_col: Column, seed: int) -> Column:
    """A hash-random number below 16^15 for an id and a text, equal on every run; rows that share an id are spread."""
    digest = F.md5(F.coalesce(text_col, F.lit("")).cast("binary"))
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), digest)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """One row per source of sized(source, size): source, rank, rows, source_size, target.

    Sources rank by code point, null last, and take the weights in turn. share times all sizes is dealt by weight; a
    target stops at max_epochs times the size of its source and the excess is dealt again by weight. That is water
    filling: with sources in order of cap / weight, the level is where the first source is not filled.
    There is one row per source here, so the two windows are over metadata, not documents.
    """
    by_source = sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - filled) / open_weight
    levelled = ranked.withColumn("level", level).withColumn("at", F.row_number().over(order))
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("at", "level"))).over(everything)
    target = F.coalesce(F.least("cap", F.col("weight") * first["level"]), F.col("cap"))
    return levelled.select("source", "rank", "rows", "source_size", target.alias("target"))


def source_cuts(keyed: DataFrame, targets: DataFrame, bucket_rows: int) -> DataFrame:
    """One row per source of keyed(source, id, key, size): source, source_size, target, epochs, and where the last epoch
    is cut: the key, id and size of the documents there, and the words that each of them gives.

    Documents before the cut, by key, id and size, give all of their words once more. The cut is null for a source
    without words. What is left there is shared by as many documents as are equal in id, text and source, rounded down.
    """
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    ends = stored(targets.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "mix-ends")
    its = maybe_broadcast(ends.select(F.col("source").alias("its"), "rank", F.ceil(F.col("rows") / F.lit(bucket_rows)).alias("buckets"), "rest"), "its")
    placed = keyed.join(its, F.col("source").eqNullSafe(F.col("its"))).drop("its", "source")
    placed = placed.withColumn("bucket", F.least(F.floor(F.col("key") / F.lit(KEY_SPACE) * F.col("buckets")), F.col("buckets") - 1).cast("long"))
    totals = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("total"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at_cut = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("total"))
    last = stored(totals.withColumn("before", before).where(at_cut).select("rank", "bucket", "before"), "mix-buckets")
    equal = placed.join(maybe_broadcast(last), ["rank", "bucket"]).groupBy("rank", "key", "id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    own = F.col("n") * F.col("size")
    inside = Window.partitionBy("rank").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    equal = equal.withColumn("before", F.col("before") + F.sum(own).over(inside) - own)
    cut = equal.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + own))
    part = F.floor((F.col("rest") - F.col("before")) / F.col("n")).cast("long")
    cut = cut.select(F.col("rank").alias("cut_rank"), F.struct("key", "id", "size").alias("cut"), part.alias("part"))
    return ends.join(cut, F.col("rank") == F.col("cut_rank"), "left").select("source", "source_size", "target", "epochs", "cut", "part")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    bucket_rows: int = BUCKET_ROWS,
    out_col: str = "mix",
) -> DataFrame:
    """docs with a struct column out_col: size, source_size, target, taken (words the mix takes, repeats counted).

    Null text counts no words; a null source is a source of its own, ranked last; a null id is an id like any other.
    Documents of equal key are ordered by id, then size; rows equal in id, text and source get the same share. A source
    without words has target 0. An empty table gives an empty result. A column named out_col is replaced; other columns
    are kept, whatever their names. sum(taken) of a source is below its target by less than one word, or, if the
    document at the cut is there n times, by less than n words.
    """
    prepare(docs.sparkSession)
    text, id_ = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    source = F.col(f"`{source_col}`").cast("string")
    keyed = docs.select(source.alias("source"), id_.alias("id"), hash_key(id_, text, seed).alias("key"), word_count(text).alias("size"))
    keyed = stored(keyed, "mix-keys")
    targets = stored(source_targets(keyed, weights, share, max_epochs), "mix-targets")
    cuts = stored(source_cuts(keyed, targets, bucket_rows), "mix-cuts")
    c, size, key = fresh(docs.columns, "cut", "size", "key")
    its = maybe_broadcast(cuts.select(F.struct("*").alias(c)), f"{c}.source")
    joined = docs.withColumn(size, word_count(text)).withColumn(key, hash_key(id_, text, seed)).join(its, source.eqNullSafe(F.col(f"{c}.source")))
    own, cut = F.struct(F.col(key).alias("key"), id_.alias("id"), F.col(size).alias("size")), F.col(f"{c}.cut")
    last = F.when(own < cut, F.col(size)).when(own == cut, F.col(f"{c}.part")).otherwise(F.lit(0))
    taken = F.col(f"{c}.epochs") * F.col(size) + last
    out = F.struct(F.col(size).alias("size"), f"{c}.source_size", f"{c}.target", taken.cast("long").alias("taken"))
    return joined.select(*[F.col(f"`{x}`") for x in docs.columns if x != out_col], out.alias(out_col))


def apply_mix(mixed: DataFrame, text_col: str = "text", mix_col: str = "mix") -> DataFrame:
    """The rows that the mix takes: a document once for each whole epoch, and the first words of the one at the cut.

    A document without words is taken by no budget, and its row goes. Column names can't clash.
    """
    size, taken, text = F.col(f"`{mix_col}`.size"), F.col(f"`{mix_col}`.taken"), F.col(f"`{text_col}`")
    epoch, words = fresh(mixed.columns, "epoch", "words")
    copies = F.ceil(taken / size).cast("int")
    cut = F.call_function("regexp_extract", text, F.concat(F.lit(r"\A(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){0,"), F.col(words).cast("string"), F.lit("}+")), F.lit(0))
    rows = mixed.where((size > 0) & (taken > 0)).withColumn(epoch, F.explode(F.sequence(F.lit(0), copies - 1))).withColumn(words, F.least(size, taken - F.col(epoch) * size))
    return rows.withColumn(text_col, F.when(F.col(words) == size, text).otherwise(cut)).drop(epoch, words, mix_col)
