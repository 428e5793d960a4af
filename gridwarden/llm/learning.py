"""What the trained operators share: which rows may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learned from: CRC-32 of the id as text is a multiple of five. A null id counts as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, most: int) -> DataFrame:
    """docs with __label, for at most `most` labelled ids outside the held-out fifth, chosen by a hash of the id.

    Null ids and labels are left out; of several labels of an id the larger counts.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label")).orderBy(F.xxhash64(id_col), id_col).limit(most)
    chosen = chosen.withColumnRenamed(id_col, "__its_id")
    return docs.join(F.broadcast(chosen), F.col(f"`{id_col}`") == F.col("__its_id")).drop("__its_id")
